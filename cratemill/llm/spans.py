"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences; every run of `run` consecutive sentences is hashed and the hashes are joined over all
documents.  Of equal runs the first (by doc_id, then place) stays; sentences covered by any other are removed.

Passages that hold no such run (few marks, or partial sentences at both ends) are found by runs of words: of every
`passage` consecutive words, the run of passage - slack + 1 words with the least hash is joined as well (winnowing; Schleimer et al., 2003).
Which run that is depends on those words only, so equal passages of that length always share a run, and no more than
slack - 1 words at either end of a repeated passage lie outside its runs.

Runs are equal if two 64-bit hashes are, which are made from the bytes on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textscan
from .common import KeyFilter

#: A sentence ends at these characters, in ASCII and outside it.
_END = textscan.byte_table(lambda b: b in b".!?\n")
MARKS = "。！？｡।॥؟۔…։።။។"

#: Places from here on are words, where runs of words begin; below are sentences.
_WORDS = 1 << 30
#: What runs of words cover beyond removed sentences goes if it has so many words.
SCRAP = 20
#: Of so many words that follow each other, one begins a chosen run of words.
SLACK = 10


def sentences(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, start byte, end byte, number of words and two hashes of every sentence.

    Sentences are compared by their words (letters and digits, A-Z lower-cased), so white space and punctuation do not matter. A
    sentence reaches to the start of the next one; one without words belongs to the one before it.
    """
    return _sentences(textscan.scan(texts, twice=True, marks=MARKS))


def _sentences(w: textscan.Words) -> tuple[np.ndarray, ...]:
    n = len(w.row)
    if not n:
        none, empty = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        return none, none, none, none, empty, empty
    ends = np.concatenate([[0], np.cumsum(_END[w.data] | w.marks, dtype=np.int64)])
    number = ends[w.start]
    new = np.ones(n, dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (w.row[1:] != w.row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    # the hash of a sentence: its words' hashes, each turned by its place, added up
    place = np.arange(n) - np.repeat(first, size)
    turn = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h, second = (textscan.mix(np.add.reduceat(textscan.mix(x + turn), first)) if x is not None else None for x in (w.hash, w.second))
    row, start = w.row[first], w.start[first].copy()
    begins = np.ones(len(first), dtype=bool)
    begins[1:] = row[1:] != row[:-1]
    start[begins] = w.offsets[row[begins]]
    stop = np.append(start[1:], 0)
    last = np.append(begins[1:], True)
    stop[last] = w.offsets[row[last] + 1]
    return row, start, stop, size, h, second


def _slide(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over every n consecutive entries."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def winnow(row: np.ndarray, h: np.ndarray, passage: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places where chosen runs begin, and a hash for each word place; row and h are of every word."""
    k, t = passage - slack + 1, slack
    a = textscan.grams(h, k)
    inside = textscan.within_row(row, passage)
    if not inside.any():
        return np.zeros(0, dtype=np.int64), a
    least = np.where(inside, _slide(a, t, np.minimum), np.uint64(0))
    pad = np.zeros(t - 1, dtype=np.uint64)
    # a run is chosen if it is the least of any window that it lies in
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), t, np.maximum) == a), a


def runs(docs: DataFrame, run: int, only: KeyFilter | None = None, passage: int = 0, slack: int = SLACK) -> DataFrame:
    """(doc_id, tag, at, a, b): 128-bit hashes of all runs of sentences, and of the chosen runs of words if passage is
    given; only those that the filter may hold, if given."""
    held = docs.sparkSession.sparkContext.broadcast(only)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textscan.row_groups(batch.column(2)):
                w = textscan.scan(batch.column(2).slice(lo, hi - lo), twice=True, marks=MARKS)
                row, _, _, _, h, second = _sentences(w)
                a = textscan.grams(h, run)
                found = [(row, second, run, np.flatnonzero(textscan.within_row(row, run)), a, 0)]
                if passage:
                    chosen, a = winnow(w.row, w.hash, passage, slack)
                    found.append((w.row, w.second, passage - slack + 1, chosen, a, _WORDS))
                for row, second, k, keep, a, base in found:
                    if held.value is not None:
                        keep = keep[held.value.maybe(a[keep])]
                    b = textscan.grams(second, k, second=True)[keep] if len(keep) else np.zeros(0, dtype=np.uint64)
                    at = keep - np.searchsorted(row, row[keep]) + base
                    rows = pa.array(row[keep] + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), textscan.signed(a[keep]), textscan.signed(b)], ["doc_id", "tag", "at", "a", "b"])

    rows = common.pick(docs, "doc_id", "text").select("doc_id", common.text_tag(F.col("text")).alias("tag"), "text")
    return rows.mapInArrow(find, f"doc_id {kind}, tag long, at int, a long, b long")


def repeats(docs: DataFrame, run: int = 3, passage: int = 0, slack: int = SLACK) -> DataFrame:
    """(doc_id, tag, sentences, first_doc_ids): of every document, the starts of runs that are not the first of their kind.

    Two light shuffles: counts by hash (combined before the shuffle), then the runs whose hash occurs twice or more.
    """
    counted = runs(docs, run, passage=passage, slack=slack).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    twice = common.materialize(counted, "repeated")
    # eight bits for each repeated run, 32 MB at most; beyond that the filter lets more through and the join decides
    bits = min(28, max(20, 3 + twice.count().bit_length()))
    again = common.materialize(runs(docs, run, KeyFilter.of(twice, "a", bits), passage, slack), "runs")
    first = again.groupBy("a", "b").agg(F.min(F.struct("doc_id", "tag", "at")).alias("first"))
    # written out, so that the join below starts from plain shuffles and a very common run is split over tasks
    first = common.materialize(first.select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first"), "firsts")
    paired = again.join(first, (again["a"] == first["fa"]) & (again["b"] == first["fb"]))
    later = paired.where(~common.same(F.col("doc_id"), F.col("first.doc_id")) | (F.col("tag") != F.col("first.tag")) | (F.col("at") != F.col("first.at")))
    return later.groupBy("doc_id", "tag").agg(F.collect_set("at").alias("at"), F.array_sort(F.collect_set("first.doc_id")).alias("first_doc_ids"))


def cut(texts: pa.Array, starts: list[list[int]], run: int, min_words: int, passage: int = 0, slack: int = SLACK) -> list[tuple[str, list[dict], int]]:
    """For each text: what stays, the removed spans (start, end in code points) and the number of removed words."""
    out = []
    for i, at in enumerate(starts):
        raw = (texts[i].as_py() or "").encode()
        if not at:
            out.append((raw.decode(), [], 0))
            continue
        w = textscan.scan(texts.slice(i, 1), marks=MARKS)
        size = _sentences(w)[3]
        covered = np.zeros(len(size), dtype=bool)
        by_words = np.zeros(len(w.row), dtype=bool)
        for s in at:
            if s < _WORDS:
                covered[s : s + run] = True
            else:
                by_words[s - _WORDS : s - _WORDS + passage - slack + 1] = True
        covered = np.repeat(covered, size)
        # beside removed sentences, no scraps of the next sentence are torn off
        for lo, hi in _stretches(by_words & ~covered):
            if hi - lo >= SCRAP:
                covered[lo:hi] = True
        kept, spans, words, done = [], [], 0, 0
        for lo, hi in _stretches(covered):
            if hi - lo < min_words:
                continue
            s, e = int(w.start[lo]) if lo else 0, int(w.start[hi]) if hi < len(covered) else len(raw)
            spans.append({"start": len(raw[:s].decode()), "end": len(raw[:e].decode())})
            kept.append(raw[done:s])
            words, done = words + int(hi - lo), e
        kept.append(raw[done:])
        out.append((b"".join(kept).decode(), spans, words))
    return out


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]])))
    return list(zip(edge[::2], edge[1::2]))


def dedup_spans(docs: DataFrame, run: int = 3, min_words: int = 0, changed_only: bool = False, passage: int = 50, slack: int = SLACK) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, text without repeated spans, spans, n_removed_words, first_doc_ids.

    run: consecutive sentences in a span. min_words: pieces of fewer words stay (by default none do).
    changed_only: only the documents that lose something. passage: a repeated passage of so many words
    is found whatever its marks are (0: by sentences only); up to slack - 1 words at each of its ends may stay. A null text stays null. A null doc_id comes before all others. Rows alike in doc_id and text are one document (its
    runs do not repeat each other) and give a result row each. Repeats inside one document are removed too. Other
    columns are ignored.
    """
    later = common.materialize(repeats(docs, run, passage, slack), "later").select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "at", "first_doc_ids")
    rows = common.pick(docs, "doc_id", "text").withColumn("tag", common.text_tag(F.col("text")))
    joined = rows.join(later, common.same(rows["doc_id"], later["d"]) & (rows["tag"] == later["t"]), "inner" if changed_only else "left")
    slim = joined.select("doc_id", "text", "at", "first_doc_ids")
    kind = slim.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = cut(b.column(1), b.column(2).to_pylist(), run, min_words, passage, slack)
            texts = pa.array([t if v else None for (t, _, _), v in zip(done, b.column(1).is_valid().to_pylist())], pa.string())
            got = pa.RecordBatch.from_arrays([b.column(0), texts, pa.array([s for _, s, _ in done], span), pa.array([n for _, _, n in done], pa.int64()), b.column(3)], ["doc_id", "text", "spans", "n_removed_words", "first_doc_ids"])
            yield got.filter(pa.array([n > 0 for _, _, n in done], pa.bool_())) if changed_only else got

    return slim.mapInArrow(apply, f"doc_id {kind}, text string, spans array<struct<start:long,end:long>>, n_removed_words long, first_doc_ids array<{kind}>")
