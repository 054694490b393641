"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.  The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints, so all pairs within Hamming distance r are among the pairs
within Manhattan distance r.

The grid: the 32 axes are dealt to `groups` groups.  A Manhattan distance of r touches r groups at most, so two neighbours are
equal on at least one choice of groups - r groups; on the axes that are left, their coordinates add up to sums at
most r apart.  A grid cell is a choice, the coordinates of its axes and the sum of the others in steps of r + 1; every
point is stored in one cell per choice and looks for partners in the one or two cells that its range [sum - r, sum] touches.
Candidates pass the Manhattan bound first, then the exact Hamming distance.

Two-bit segments, because wider ones tell too little apart: random fingerprints have 48 bits of entropy in 32 segments of
two bits, 32 in 16 of four, 20 in 8 of eight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Shingles are counted in runs of this many, which bounds the memory for one very long text.
_RUN = 1 << 16


def fingerprint(text: bytes) -> int:
    """SimHash of a text's 3-word shingles: A-Z lower-cased, words between ASCII white space, repeats counted."""
    words = text.lower().split()
    if not words:
        return 0
    counts, n = np.zeros(64, dtype=np.int64), max(1, len(words) - 2)
    for lo in range(0, n, _RUN):
        part = words[lo : min(n, lo + _RUN) + 2]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) >= 3 else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
        # add up the bits eight rows at a time before they are unpacked to wider numbers
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):
            counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, fp): one row per row of docs (doc_id, text); a null text is empty and has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            fps = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "tag", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = common.pick(docs, "doc_id", "text").select("doc_id", common.text_tag(F.col("text")).alias("tag"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, tag long, fp long")


def embed(fp: str) -> str:
    """SQL for the embedding: the bit count of every two-bit segment in unary (00, 01, 11), packed in one long.

    In that code the Manhattan distance of two vectors is the number of differing bits.
    """
    low = 0x5555555555555555
    return f"((({fp}) | shiftrightunsigned({fp}, 1)) & {low}L) | shiftleft(({fp}) & shiftrightunsigned({fp}, 1) & {low}L, 1)"


def cell_masks(radius: int, groups: int) -> list[int]:
    """For every choice of groups - radius groups of axes, the bits of the packed vector in them (as a signed long)."""
    edges = [round(32 * g / groups) for g in range(groups + 1)]
    masks = [sum(3 << (2 * axis) for axis in range(a, b)) for a, b in zip(edges, edges[1:])]
    picked = [sum(c) for c in combinations(masks, groups - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in picked]


def _long(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"({x}L)"


def groups_for(points: int, radius: int) -> int:
    """As many groups of axes as keep a cell of random fingerprints to a few points: more points, more choices of finer cells.

    It decides how much is compared, not what is found.
    """
    groups = radius + 3
    while groups < 12 and 48 * (groups - radius) / groups < math.log2(max(points, 2)) - 2:
        groups += 1
    return groups


#: Cells are dealt to so many buckets to find the crowded ones.
_BUCKETS = 1 << 14


def links(fps: DataFrame, radius: int = 3, groups: int = 6, least: int = 1000) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in radius bits at most; each pair once.

    fps: fingerprints in column fp, distinct. Copies share a fingerprint, so a group of copies is one point here. Buckets of cells
    that hold more than a 4096-th of all cells (and more than `least`) are split: their points are dealt to several tasks and
    those that look for partners are sent to each.
    """
    masks = cell_masks(radius, groups)
    step = radius + 1
    at = fps.select("fp", F.expr(embed("fp")).alias("e"))
    spread = F.posexplode(F.array(*(F.expr(f"struct(e & {_long(m)} AS cell, bit_count(e & ~{_long(m)}) AS rest)") for m in masks))).alias("choice", "at")
    cells = at.select("fp", spread).select("fp", "choice", "at.cell", "at.rest")
    bucket = lambda stripe: F.pmod(F.xxhash64("choice", "cell", stripe), F.lit(_BUCKETS))
    stored = cells.withColumn("stripe", F.floor(F.col("rest") / step).cast("int")).withColumn("bucket", bucket("stripe"))
    sizes = common.materialize(stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")  # one row for each bucket
    hot = common.materialize(common.hot_keys(sizes, "bucket", least=least), "hot-cells")
    first, last = F.floor(F.greatest(F.col("rest") - radius, F.lit(0)) / step).cast("int"), F.floor(F.col("rest") / step).cast("int")
    asking = cells.withColumn("stripe", F.explode(F.sequence(first, last))).withColumn("bucket", bucket("stripe"))
    b = asking.select(F.col("fp").alias("q"), F.col("choice").alias("q_choice"), F.col("cell").alias("q_cell"), F.col("stripe").alias("q_stripe"), F.col("rest").alias("q_rest"), F.col("bucket").alias("q_bucket"))
    crowded = F.broadcast(hot)  # bounded by common.hot_keys
    left = stored.join(crowded, stored["bucket"] == hot["hot"], "left").withColumn("part", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("salts").cast("long"))).cast("int"))
    right = b.join(crowded, b["q_bucket"] == hot["hot"], "left").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    left, right = left.drop("hot", "salts", "bucket"), right.drop("hot", "salts", "q_bucket")
    differ = f"(({embed('fp')}) ^ ({embed('q')}))"
    # of the choices on which two points are equal, only the first makes the pair; the smaller sum is the stored side
    once = "CASE " + " ".join(f"WHEN ({differ} & {_long(m)}) = 0 THEN {i}" for i, m in enumerate(masks)) + " END"
    close = (
        (F.col("choice") == F.col("q_choice"))
        & (F.col("cell") == F.col("q_cell"))
        & (F.col("stripe") == F.col("q_stripe"))
        & (F.col("part") == F.col("q_part"))
        & ((F.col("rest") < F.col("q_rest")) | ((F.col("rest") == F.col("q_rest")) & (F.col("fp") < F.col("q"))))
        & F.expr(f"bit_count({differ}) <= {radius}")
        & F.expr(f"bit_count(fp ^ q) <= {radius}")
        & (F.expr(once) == F.col("choice"))
    )
    # Spark sizes either side by the file of points, before it is exploded to cells, so it would broadcast them by that size
    return left.hint("merge").join(right.hint("merge"), close).select(F.least("fp", "q").alias("a"), F.greatest("fp", "q").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node that has an edge, the smallest node it can reach.

    Each round takes the smallest label among neighbours and then the label of that label, so chains are followed at
    doubling distance, until nothing changes. Labels are written out each round; only whether any changed comes to the driver.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = common.materialize(edges.select(ways).select("e.*"), "edges")
    labels = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("via"), F.col("root").alias("top"))
        jumped = stepped.join(up, stepped["root"] == up["via"], "left").select("node", "was", F.least("root", F.coalesce("top", "root")).alias("root"))
        new = common.materialize(jumped, "labels")
        labels = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, radius: int = 3, groups: int | None = None) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, tag, fp, root, component_id.

    component_id is the smallest doc_id of all rows whose fingerprints can be reached over links of radius bits at most.
    groups: groups of axes in the grid, by default by the number of fingerprints; the result does not depend on it.
    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give repeated result rows.
    A null doc_id is kept; it is never the smallest unless all of a component's are null. Other columns are ignored.
    """
    rows = common.materialize(fingerprints(docs), "fingerprints")
    points = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "points")
    roots = components(links(points, radius, groups or groups_for(points.count(), radius)))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = common.materialize(rooted, "rooted")
    ids = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component_id"))
    of_fp = rooted.join(ids, rooted["root"] == ids["r"]).select(F.col("fp").alias("p"), "root", "component_id")
    hot = common.materialize(common.hot_keys(points, "fp"), "hot-fingerprints")
    found = common.salted_join(rows, of_fp, "fp", "p", hot, [F.col("doc_id"), F.col("tag")])
    return found.select("doc_id", "tag", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, groups: int | None = None) -> DataFrame:
    """docs with one document of each component: the smallest doc_id (null last), then the smallest text hash.

    Rows that are alike in both are alike in text too; they tie and stay together, so run the exact deduplication first.
    All columns are kept.
    """
    found = near_duplicates(docs, radius, groups)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("tag").alias("t"))
    stay = found.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.i").alias("stay_id"), F.col("m.t").alias("stay_tag"))
    tag = common.fresh(docs, "tag")
    tagged = docs.withColumn(tag, common.text_tag(docs["text"]))
    return tagged.join(stay, common.same(tagged["doc_id"], stay["stay_id"]) & (tagged[tag] == stay["stay_tag"]), "left_semi").drop(tag)
