"""Vectorised word scanning of Arrow string columns.

A batch of texts is looked at as one byte buffer: a 256-entry table says which bytes belong to words, and every word gets
a 64-bit polynomial hash from prefix sums modulo 2**64.  No Python object is made per word, so the operators that need
word n-grams of whole texts can afford to look at all of them.  Whole texts are always scanned; nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are scanned in groups of rows of about this many bytes (a longer single text is a group of its own).
GROUP_BYTES = 1 << 20
#: Inside a group, prefix sums restart after about this many bytes, at a byte between two words.
BLOCK_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_MULT_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INV_2 = np.uint64(pow(int(_MULT_2), -1, 1 << 64))
#: For the second hash every byte stands for a number of its own.
_BYTES_2 = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def byte_table(inside) -> np.ndarray:
    """Boolean table over the 256 byte values. A table of small numbers is several kinds of words; 0 is outside words."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words of letters and digits: ASCII letters and digits and every non-ASCII character.
ALNUM = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
#: Words between ASCII white space.
NONSPACE = byte_table(lambda b: b not in b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of letters and digits (1), and runs of other characters that are not white space (2).
WORDS_AND_SIGNS = np.where(ALNUM, 1, np.where(NONSPACE, 2, 0)).astype(np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 65536), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some rows, in text order. Positions are byte offsets into data."""

    data: np.ndarray  # the bytes as given
    offsets: np.ndarray  # n + 1 row boundaries in data
    row: np.ndarray  # row of each word
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray  # uint64
    second: np.ndarray | None = None  # another hash of the same bytes, if asked for
    marks: np.ndarray | None = None  # bytes of marks, if asked for

    @property
    def first(self) -> np.ndarray:
        """Index of each row's first word, with a closing entry."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row boundaries of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, raw = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if raw is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each."""
    _, offsets = buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def _cuts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Block boundaries: row ends, or bytes outside words where one row is longer than a block."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + BLOCK_BYTES)
        if hi < n:
            at = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            if at > lo:
                hi = at
            else:
                while hi < n and table[data[hi]] and hi not in offsets[np.searchsorted(offsets, hi) : np.searchsorted(offsets, hi) + 1]:
                    hi += 1
        yield lo, hi
        lo = hi


def _hashes(values: np.ndarray, begin: np.ndarray, finish: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Polynomial hash of every stretch of values, from prefix sums. values is overwritten."""
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    values *= up[: len(values)]
    np.cumsum(values, out=sums[1:])
    return mix((sums[finish] - sums[begin]) * down[begin])


def places(data: np.ndarray, marks: str) -> np.ndarray:
    """Which bytes belong to one of the marks (characters outside ASCII)."""
    out = np.zeros(len(data), dtype=bool)
    for m in marks:
        code = m.encode()
        at = np.flatnonzero(data[: len(data) - len(code) + 1] == code[0]) if len(data) >= len(code) else np.zeros(0, dtype=np.int64)
        for i, byte in enumerate(code[1:], 1):
            at = at[data[at + i] == byte]
        for i in range(len(code)):
            out[at + i] = True
    return out


def scan(texts: pa.Array, table: np.ndarray = ALNUM, lower: bool = True, twice: bool = False, marks: str = "") -> Words:
    """All words of all texts; A-Z are lower-cased first if asked for (in hashes; data stays as given).

    twice: a second hash as well, made from the bytes on its own; equal in both means equal words for all purposes.
    marks: characters outside ASCII that belong to no word.
    """
    data, offsets = buffers(texts)
    marked = places(data, marks) if marks else None
    starts, ends, hashes, seconds = [], [], [], []
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[offsets] = True
    for lo, hi in _cuts(data, offsets, table):
        part = data[lo:hi]
        kind = table[part] if marked is None else np.where(marked[lo:hi], 0, table[part])
        inside = kind > 0
        edge = breaks[lo : hi + 1].copy()  # a word starts or ends at these places if its byte is inside
        edge[0] = edge[-1] = True
        edge[1:-1] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(inside & edge[:-1])
        finish = np.flatnonzero(inside & edge[1:]) + 1
        if not len(begin):
            continue
        chars = _LOWER[part] if lower else part
        starts.append(begin + lo)
        ends.append(finish + lo)
        hashes.append(_hashes(chars.astype(np.uint64) + np.uint64(1), begin, finish, _power(_MULT, len(part) + 1, "up"), _power(_INV, len(part) + 1, "down")))
        if twice:
            seconds.append(_hashes(_BYTES_2[chars], begin, finish, _power(_MULT_2, len(part) + 1, "up2"), _power(_INV_2, len(part) + 1, "down2")))
    if not starts:
        none, empty = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        return Words(data, offsets, none, none, none, empty, empty if twice else None, marked)
    start = np.concatenate(starts)
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, row, start, np.concatenate(ends), np.concatenate(hashes), np.concatenate(seconds) if twice else None, marked)


def grams(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Rolling hash of every k consecutive entries (n - k + 1 of them); second rolls with another base."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93 if second else 0xA24BAED4963EE407)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= base
        out += hashes[j : j + n]
    return mix(out)


def within_row(row: np.ndarray, k: int) -> np.ndarray:
    """Which of the n - k + 1 k-grams lie in one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def signed(x: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark longs."""
    return pa.array(x.view(np.int64))
