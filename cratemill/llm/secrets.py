"""Secret scans: fixed patterns, and automata that score any token by how well it fits a credential's format.

Patterns find and label credentials (base spans).  From a bounded sample of those, one probabilistic automaton for each
label is inferred; then every long token is a candidate, and gets a span if a credential's automaton makes it far likelier than
the model of ordinary tokens (character pairs, counted over all documents) does.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textscan
from .automata import ALPHABET, Automaton, infer

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "grammar")
#: The patterns of the base and their least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Shortest token that is scored, and the characters of tokens.
CANDIDATE = 12
_HEX = textscan.byte_table(lambda b: b in b"0123456789abcdef")
_TOKEN = textscan.byte_table(lambda b: b < 0x80 and (chr(b).isalnum() or b in b"+/_-"))


def _runs(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every maximal run of at least `least` bytes of the table inside a row."""
    inside = table[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = end - start >= least
    start, end = start[long], end[long]
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def scan(texts: pa.Array) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], list[tuple[str, str]]]]:
    """For each text: base spans (start, end, kind), candidate tokens (start, end, token), labelled credentials (kind, text).

    Starts and ends count code points.
    """
    data, offsets = textscan.buffers(texts)
    raw = data.tobytes()
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    out: list[tuple[list, list, list]] = [([], [], []) for _ in range(len(offsets) - 1)]

    def add(row: int, s: int, e: int, kind: str, secret: bytes) -> None:
        base = points[offsets[row]]
        out[row][0].append((int(points[s] - base), int(points[e] - base), kind))
        out[row][2].append((kind, secret.decode()))

    for row in range(len(offsets) - 1):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        for m in ASSIGN.finditer(raw, lo, hi):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                add(row, m.start(), m.end(), "assign", m[2])
        for m in ACCESS.finditer(raw, lo, hi):
            if m.end() - m.start() >= LEAST["access"]:
                add(row, m.start(), m.end(), "access", m[0])
    for row, s, e in zip(*_runs(_HEX, data, offsets, LEAST["hex"])):
        add(row, s, e, "hex", raw[s:e])
    for row, s, e in zip(*_runs(_TOKEN, data, offsets, CANDIDATE)):
        # one or two = at the end are padding; any other parts a name from a value
        pad = raw[e : min(e + 3, int(offsets[row + 1]))]
        ends = len(pad) - len(pad.lstrip(b"="))
        e += ends if ends <= 2 and not _TOKEN[data[e + ends : e + ends + 1]].any() else 0
        base = points[offsets[row]]
        out[row][1].append((int(points[s] - base), int(points[e] - base), raw[s:e].decode()))
    return out


def found(docs: DataFrame) -> DataFrame:
    """The pass over all texts: doc_id, base array<struct<start,end,kind>>, tokens array<...>, labelled array<...>."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, base array<struct<start:long,end:long,kind:string>>, tokens array<struct<start:long,end:long,token:string>>, labelled array<struct<kind:string,secret:string>>"
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    toks = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string())]))
    labs = pa.list_(pa.struct([("kind", pa.string()), ("secret", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in textscan.row_groups(b.column(1)):
                rows = scan(b.column(1).slice(lo, hi - lo))
                cols = [
                    pa.array([[dict(zip(names, x)) for x in r[i]] for r in rows], t)
                    for i, (t, names) in enumerate(((spans, ("start", "end", "kind")), (toks, ("start", "end", "token")), (labs, ("kind", "secret"))))
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], ["doc_id", "base", "tokens", "labelled"])

    return common.pick(docs, "doc_id", "text").mapInArrow(run, schema)


def fit(rows: DataFrame, per_kind: int = 400, longest: int = 256) -> dict[str, Automaton]:
    """An automaton for each kind that has a credential, however few there are.

    The sample is bounded: of each kind the per_kind distinct credentials with the smallest hashes over all documents; longer ones
    than `longest` characters are no part of it. Whole credentials are learned from.
    """
    labelled = rows.select(F.explode("labelled").alias("x")).select("x.*").where(F.length("secret") <= longest)
    models = {}
    for kind in KINDS[:3]:
        own = labelled.where(F.col("kind") == kind).groupBy("secret").agg(F.lit(1).alias("one"))
        sample = [r["secret"] for r in own.orderBy(F.xxhash64("secret"), "secret").limit(per_kind).collect()]  # bounded by per_kind
        if sample:
            models[kind] = infer(sample)
    return models


#: Stands before the first and after the last character of a token.
_EDGE = "\n"
_CHARS = ALPHABET + _EDGE
_CODE = np.zeros(256, dtype=np.int64)
_CODE[np.frombuffer(_CHARS.encode(), dtype=np.uint8)] = np.arange(len(_CHARS))


def uncovered(base: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> list[bool]:
    """Of each token whether it overlaps no base span. Both are swept once by start; tokens do not overlap each other."""
    base, out, at, reach = sorted(base), [], 0, 0
    for start, end in tokens:
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][1])
            at += 1
        out.append(reach <= start)
    return out


@dataclass(frozen=True)
class Ordinary:
    """How often a character follows another one in ordinary tokens, and how often a character is followed by any."""

    pair: dict[str, float]
    first: dict[str, float]

    def score(self, token: str, counted: bool) -> float:
        """Log-likelihood of a token.

        What is ordinary, the other tokens tell: a token that was counted itself is taken out of the counts.
        """
        text = _EDGE + token + _EDGE
        pairs = [text[i : i + 2] for i in range(len(text) - 1)]
        if not counted:
            return sum(math.log(self.pair[p] / self.first[p[0]]) for p in pairs)
        own, begin = Counter(pairs), Counter(text[:-1])
        return sum(math.log((self.pair[p] - own[p]) / (self.first[p[0]] - begin[p[0]])) for p in pairs)


def background(rows: DataFrame, prior: float = 8.0) -> Ordinary:
    """Counts of character pairs in all tokens of all documents that overlap no base span.

    Counts are summed up in the tasks; at most one row for each pair of characters comes to the driver. prior is added to
    every count.
    """
    side = len(_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(side * side, dtype=np.int64)
        for b in batches:
            text = [_EDGE]
            for base, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                free = uncovered([(x["start"], x["end"]) for x in base], [(t["start"], t["end"]) for t in tokens])
                text += [t["token"] + _EDGE for t, keep in zip(tokens, free) if keep]
            codes = _CODE[np.frombuffer("".join(text).encode(), dtype=np.uint8)]
            count += np.bincount(codes[:-1] * side + codes[1:], minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["pair", "n"])

    counted = rows.where(F.size("tokens") > 0).select("base", "tokens").mapInArrow(run, "pair int, n long")
    sums = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    count = np.full(side * side, prior)
    count[sums.column("pair").to_numpy()] += sums.column("n").to_numpy()
    first = count.reshape(side, side).sum(axis=1)
    return Ordinary({a + b: float(count[i * side + j]) for i, a in enumerate(_CHARS) for j, b in enumerate(_CHARS)}, {a: float(first[i]) for i, a in enumerate(_CHARS)})


def is_credential(token: str, models: dict[str, Automaton], ordinary: Ordinary, counted: bool, bits: float) -> bool:
    """Whether some automaton makes the token 2**bits times as likely as an ordinary token."""
    least = ordinary.score(token, counted) + bits * math.log(2)
    return any(m.score(token, least) >= least for m in models.values())


def secrets(docs: DataFrame, per_kind: int = 400, longest: int = 256, bits: float = 20.0) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar, n_confirmed.

    Whole texts are scanned; null is empty. Spans are kind:start:end in code points, end exclusive, by start, then kind.
    Every token of CANDIDATE characters or more is scored by its format; it is a credential if an automaton makes it 2**bits times
    as likely as the model of ordinary tokens. Such a token is a grammar span if it overlaps no base span (n_grammar), else it
    confirms one (n_confirmed). Without any labelled credential there are no automata and only base spans. per_kind and longest
    bound the sample that automata are fitted on. Repeated rows give repeated result rows; other columns are ignored.
    """
    rows = common.materialize(found(docs), "secrets")
    held = rows.sparkSession.sparkContext.broadcast((fit(rows, per_kind, longest), background(rows)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, ordinary = held.value
        order = {k: i for i, k in enumerate(KINDS)}
        join = lambda xs: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, order[k], e, k) for s, e, k in xs))
        for b in batches:
            out = []
            for r in b.to_pylist():
                base = [(x["start"], x["end"], x["kind"]) for x in r["base"]]
                free = uncovered([(s, e) for s, e, _ in base], [(t["start"], t["end"]) for t in r["tokens"]])
                likely = [is_credential(t["token"], models, ordinary, f, bits) for t, f in zip(r["tokens"], free)]
                more = [(t["start"], t["end"], "grammar") for t, f, y in zip(r["tokens"], free, likely) if f and y]
                n = [sum(k == kind for *_, kind in base) for k in KINDS[:3]]
                out.append((r["doc_id"], *n, hashlib.sha256(join(base).encode()).hexdigest(), join(base + more), len(more), sum(likely) - len(more)))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar", "n_confirmed"]
            types = [b.schema.field(0).type, *[pa.int64()] * 3, pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)

    slim = rows.select("doc_id", "base", "tokens")
    return slim.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long, n_confirmed long")
