"""Benchmark decontamination by greedy string tiling.

The words of all documents and of all benchmark items are hashed in runs of k (rolling, as in Karp-Rabin) and joined.  Shared
runs seed matches of a document with an item; the longest matches are marked first, and no word of either side twice.  The
share of an item's words that lie in tiles tells whether the document leaks it, also where its parts were reordered.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textscan
from .common import KeyFilter


def seeds(texts: DataFrame, key: str, ks: list[int], only: KeyFilter | None = None, own: bool = False) -> DataFrame:
    """(key, tag, at, n, k, a, b): place and 128-bit hash of every run of k words of texts (key, text), n words in the text.

    All k of ks are taken; if own, of each text only the largest that it has words for (a text of fewer words than the largest k is
    one run of all its words).
    """
    held = texts.sparkSession.sparkContext.broadcast(only)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textscan.row_groups(batch.column(2)):
                w = textscan.scan(batch.column(2).slice(lo, hi - lo), twice=True)
                first = w.first
                size = np.diff(first)
                for k in ks:
                    a = textscan.grams(w.hash, k)
                    keep = textscan.within_row(w.row, k)
                    if own:
                        keep &= np.minimum(size, max(ks))[w.row[: len(keep)]] == k
                    if held.value is not None:
                        keep &= held.value.maybe(a)
                    keep = np.flatnonzero(keep)
                    b = textscan.grams(w.second, k, second=True)[keep] if len(keep) else a[keep]
                    row = w.row[keep]
                    rows = pa.array(row + lo)
                    cols = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x.astype(np.int32)) for x in (keep - first[row], size[row], np.full(len(keep), k))), textscan.signed(a[keep]), textscan.signed(b)]
                    yield pa.RecordBatch.from_arrays(cols, [key, "tag", "at", "n", "k", "a", "b"])

    rows = common.pick(texts, key, "text").select(key, common.text_tag(F.col("text")).alias("tag"), "text")
    return rows.mapInArrow(run, f"{key} {kind}, tag long, at int, n int, k int, a long, b long")


def tile(matches: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, length) from maximal matches of the same form.

    The longest match is marked first (ties: the earlier in the item, then in the document); what is left of a match that
    a tile overlaps is tried again if it has k words.
    """
    low_d, low_i = min(d for d, _, _ in matches), min(i for _, i, _ in matches)
    in_doc = np.zeros(max(d + n for d, _, n in matches) - low_d, dtype=bool)
    in_item = np.zeros(max(i + n for _, i, n in matches) - low_i, dtype=bool)
    heap = [(-n, i - low_i, d - low_d) for d, i, n in matches]
    heapq.heapify(heap)
    tiles, free_words = [], len(in_item)
    while heap and free_words >= k:
        n, i, d = heapq.heappop(heap)
        n = -n
        busy = in_item[i : i + n] | in_doc[d : d + n]
        if not busy.any():
            in_item[i : i + n] = in_doc[d : d + n] = True
            tiles.append((d + low_d, i + low_i, n))
            free_words -= n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], busy.view(np.int8), [1]])))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo >= k:
                heapq.heappush(heap, (lo - hi, i + lo, d + lo))
    return tiles


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.8) -> DataFrame:
    """(doc_id, tag, item_id, coverage, tiles, matched_words) of every document and item whose coverage reaches the threshold.

    docs: doc_id, text; benchmark: item_id, text. Words are letters and digits, A-Z lower-cased. Items of the same words are one
    text class for the join and reported under each of their ids. An item of fewer than k words is found where all of them stand
    together. Null and empty texts match nothing; a null id stays null. Rows alike in doc_id and text give one
    result. Other columns are ignored.
    """
    items = seeds(benchmark, "item_id", list(range(1, k + 1)), own=True)
    items = common.materialize(items.select("item_id", F.col("tag").alias("item_tag"), F.col("at").alias("item_at"), F.col("n").alias("item_n"), "k", "a", "b"), "item-seeds")
    names = items.select("item_id", "item_tag").distinct()
    classes = items.select("item_tag", "item_at", "item_n", "k", "a", "b").distinct()
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # k of them at most
    found = seeds(docs, "doc_id", sizes, KeyFilter.of(items, "a"))
    # runs that follow each other on a diagonal are one match
    shared = found.drop("n").join(classes, ["k", "a", "b"]).withColumn("shift", F.col("at") - F.col("item_at"))
    pair = ["doc_id", "tag", "item_tag", "item_n", "k"]
    line = Window.partitionBy(*pair, "shift").orderBy("item_at")
    lines = shared.withColumn("island", F.col("item_at") - F.dense_rank().over(line)).groupBy(*pair, "shift", "island").agg(F.min("item_at").alias("i"), (F.max("item_at") - F.min("item_at") + F.first("k")).alias("n"))
    matches = lines.groupBy(*pair).agg(F.sum("n").alias("reach"), F.collect_list(F.struct((F.col("i") + F.col("shift")).alias("d"), "i", "n")).alias("matches"))
    # tiles cannot cover more words than the matches have
    matches = matches.where(F.col("reach") >= coverage * F.col("item_n")).select("doc_id", "tag", "item_tag", "item_n", "k", "matches")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tiles = [[{"doc_word": d, "item_word": i, "words": n} for d, i, n in tile([(m["d"], m["i"], m["n"]) for m in ms], least)] for least, ms in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            words = [sum(t["words"] for t in ts) for ts in tiles]
            share = [w / n for w, n in zip(words, b.column(3).to_pylist())]
            form = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(share, pa.float64()), pa.array(tiles, form), pa.array(words, pa.int64())], ["doc_id", "tag", "item_tag", "coverage", "tiles", "matched_words"])

    tiled = matches.mapInArrow(run, f"doc_id {kind}, tag long, item_tag long, coverage double, tiles array<struct<doc_word:int,item_word:int,words:int>>, matched_words long")
    tiled = tiled.where(F.col("coverage") >= coverage)
    named = tiled.join(names.withColumnRenamed("item_tag", "it"), F.col("item_tag") == F.col("it"))
    return named.select("doc_id", "tag", "item_id", "coverage", "tiles", "matched_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.8) -> DataFrame:
    """docs without the documents that leak a benchmark item; all columns are kept."""
    bad = common.materialize(leaks(docs, benchmark, k, coverage).select("doc_id", "tag").distinct(), "leaks")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("tag").alias("bad_tag"))
    tag = common.fresh(docs, "tag")
    tagged = docs.withColumn(tag, common.text_tag(docs["text"]))
    return tagged.join(bad, common.same(tagged["doc_id"], bad["bad_id"]) & (tagged[tag] == bad["bad_tag"]), "left_anti").drop(tag)
