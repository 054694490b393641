"""Mixing sources to target weights by systematic sampling.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratemill.operators.ranking import global_rank

from . import common

#: Expected copies are fixed-point numbers with this many fraction bits: sums stay exact, reruns agree.
FRACTION = 20


def words(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of sources (source, source_size).

    Sources by code point, null last, get the weights in turn and share the sum of all sizes. A target stops at `most` times
    its source's size; what is over is shared again by weight until no source is above. Each round is one aggregate over the
    sources; two sums come to the driver.
    """
    ranked = global_rank(sources, [F.col("source").isNull(), F.col("source")], write=lambda d: common.materialize(d, "sources"))
    cycle = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    open_ = common.materialize(ranked.select("source", "source_size", cycle.cast("double").alias("w"), F.lit(None).cast("double").alias("capped")), "targets")
    total = open_.agg(F.sum("source_size").cast("double").alias("t")).first()["t"] or 0.0
    while True:
        sums = open_.agg(F.sum(F.coalesce("capped", F.lit(0.0))).alias("c"), F.sum(F.when(F.col("capped").isNull(), F.col("w"))).alias("w")).first()
        left, per = total - (sums["c"] or 0.0), sums["w"]
        if not per:
            break
        cap = F.col("source_size").cast("double") * most
        share = F.lit(left) * F.col("w") / F.lit(per)
        above = F.col("capped").isNull() & (share > cap)
        if open_.where(above).isEmpty():
            return open_.select("source", "source_size", F.coalesce("capped", share).alias("target"))
        open_ = common.materialize(open_.withColumn("capped", F.when(above, cap).otherwise(F.col("capped"))), "targets")
    return open_.select("source", "source_size", F.coalesce("capped", F.lit(0.0)).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The one random offset of a source, in units of 2**-FRACTION: drawn from a hash, so reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(source, F.lit("")))), 1, FRACTION // 4), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """Of every row of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    Every document of a source is expected target / source_size times. The documents of a source are laid out in a row by
    size, then doc_id (so that what is taken comes near the target even for few documents of unequal size); their expected
    copies are summed up from one random offset, and a document is emitted once for each integer that its stretch
    crosses, `most` times at most. Nulls: a null text has size 0, a null source is a source (the last). Sources without
    words get target 0 and are not taken. Rows that are alike in doc_id, size and text are interchangeable. Other columns are ignored.
    """
    sized = common.pick(docs, "doc_id", "text", "source").select("doc_id", "source", words(F.col("text")).alias("size"), common.text_tag(F.col("text")).alias("tag"))
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id"), F.col("tag"), F.monotonically_increasing_id()]
    # words are counted once: the range partitioning looks at its input twice
    keyed = common.materialize(sized.withColumn("tie", order.pop()), "sizes")
    placed = global_rank(keyed, [*order, F.col("tie")], within=["source"], name="place", write=lambda d: common.materialize(d, "mix"))
    placed = common.materialize(placed, "placed")
    per_source = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    per_source = per_source.withColumnsRenamed({"source": "s"}).withColumn("target", F.round("target", 6))
    rate = F.floor(F.try_divide(F.col("target"), F.col("source_size")) * F.lit(1 << FRACTION))
    joined = placed.join(per_source, common.same(placed["source"], per_source["s"])).withColumns({"rate": F.coalesce(rate, F.lit(0)).cast("long"), "u": offset(F.col("source"), seed)})
    crossed = F.shiftright(F.col("u") + F.col("rate") * F.col("place"), FRACTION) - F.shiftright(F.col("u") + F.col("rate") * (F.col("place") - 1), FRACTION)
    return joined.withColumn("copies", crossed).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (
  SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM src),
-- capped sources are those with the smallest cap per weight: try every number of them
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i, sum(source_size::DOUBLE) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
lvl AS (SELECT min_by((total - below) / rest, i) AS level FROM o WHERE (total - below) / rest <= cap / w),
tgt AS (SELECT source, source_size, round(least(cap, w * (SELECT level FROM lvl)), 6) AS target,
    ('0x' || substr(md5('mix/' || coalesce(source, '')), 1, 5))::BIGINT AS u FROM w),
pl AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.u, coalesce(floor(t.target / nullif(t.source_size, 0) * 1048576), 0)::BIGINT AS r,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST, md5(s.text)) AS k
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (((u + r * k) >> 20) - ((u + r * (k - 1)) >> 20)) * size AS taken FROM pl
"""
