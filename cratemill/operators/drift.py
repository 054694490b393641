"""Drift statistics from counts, integrity checks, verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratemill.operators.ranking import global_rank, quantiles

EPS = 1e-6


def side_counts(ref: DataFrame, cur: DataFrame, bin_: Column) -> DataFrame:
    """(bin, r, c): counts of either side by bin; the statistics below work on these few rows."""
    r = ref.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("r"), F.lit(0).cast("long").alias("c"))
    c = cur.groupBy(bin_.alias("bin")).agg(F.lit(0).cast("long").alias("r"), F.count(F.lit(1)).alias("c"))
    return r.unionByName(c).groupBy("bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def psi(counts: DataFrame) -> DataFrame:
    """Population stability index; shares are clipped from below."""
    total = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    p, q = F.greatest(F.col("r") / F.col("nr"), F.lit(EPS)), F.greatest(F.col("c") / F.col("nc"), F.lit(EPS))
    return counts.join(F.broadcast(total)).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def psi_by(counts: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, psi, n): the index of every window of counts (key, bin, n) against the fixed reference (bin, n); bins of either side count."""
    ref = reference.select("bin", F.col("n").alias("r"))
    windows = counts.groupBy(key).agg(F.sum("n").alias("nc"))
    bins = counts.select("bin").union(ref.select("bin")).distinct()
    grid = windows.join(F.broadcast(bins))  # the few bins of every window
    total = ref.agg(F.sum("r").alias("nr"))
    rows = grid.join(counts.select(key, "bin", F.col("n").alias("c")), [key, "bin"], "left").join(ref, "bin", "left").join(F.broadcast(total))
    p, q = (F.greatest(F.coalesce(F.col(x), F.lit(0)) / F.col(n), F.lit(EPS)) for x, n in (("r", "nr"), ("c", "nc")))
    return rows.groupBy(key).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"), F.max("nc").alias("n"))


def edges_bin(x: Column, edges: list[float]) -> Column:
    return sum(((x > e).cast("int") for e in edges), F.lit(0))


def decile_counts(ref: DataFrame, cur: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """side_counts by the reference's deciles (equal edges fall together)."""
    cuts = quantiles(ref, F.col(column), {f"q{i}": i / bins for i in range(1, bins)})
    cuts = cuts.select(F.array(*(F.col(f"q{i}") for i in range(1, bins))).alias("cuts"))
    place = F.size(F.filter(F.array_distinct("cuts"), lambda e: F.col(column) > e))
    binned = lambda d: d.select(column).join(F.broadcast(cuts)).select(place.alias("b"))
    return side_counts(binned(ref), binned(cur), F.col("b"))


def top_k_counts(ref: DataFrame, cur: DataFrame, column: str, k: int) -> DataFrame:
    """side_counts over the reference's k commonest values and other."""
    top = ref.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(k).select("v")
    named = lambda d: d.select(column).join(F.broadcast(top), F.col(column) == F.col("v"), "left").select(F.coalesce("v", F.lit("other")).alias("b"))
    return side_counts(named(ref), named(cur), F.col("b"))


def chi_square(counts: DataFrame) -> DataFrame:
    """statistic and degrees of freedom of the 2 x k table."""
    total = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    rows = counts.join(F.broadcast(total))
    both, n = F.col("r") + F.col("c"), F.col("nr") + F.col("nc")
    cell = lambda o, side: F.pow(F.col(o) - both * F.col(side) / n, 2) / (both * F.col(side) / n)
    return rows.agg(F.sum(cell("r", "nr") + cell("c", "nc")).alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"))


def ks(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """statistic, nr, nc: the largest gap of the two distribution functions.

    Equal values are counted first; running counts go over range-partitioned values, part by part, never through one task.
    """
    counts = side_counts(ref, cur, F.col(column)).where("bin is not null")
    n = int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = counts.repartitionByRange(n, "bin").sortWithinPartitions("bin").withColumn("part", F.spark_partition_id()).checkpoint()
    # one row for each partition: how many rows of either side lie in earlier ones
    sums = parts.groupBy("part").agg(F.sum("r").alias("sr"), F.sum("c").alias("sc"))
    over = "over (partition by null order by part rows between unbounded preceding and 1 preceding)"
    earlier = sums.select("part", F.expr(f"coalesce(sum(sr) {over}, 0)").alias("br"), F.expr(f"coalesce(sum(sc) {over}, 0)").alias("bc"))
    inner = Window.partitionBy("part").orderBy("bin")
    run = parts.join(earlier, "part").select((F.col("br") + F.sum("r").over(inner)).alias("cr"), (F.col("bc") + F.sum("c").over(inner)).alias("cc"))
    total = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    return run.join(F.broadcast(total)).groupBy("nr", "nc").agg(F.max(F.abs(F.col("cr") / F.col("nr") - F.col("cc") / F.col("nc"))).alias("statistic"))


def ks_p_value(statistic: float, nr: int, nc: int) -> float:
    """Asymptotic p-value (Kolmogorov's series)."""
    if statistic <= 0:
        return 1.0
    lam = math.sqrt(nr * nc / (nr + nc)) * statistic
    total = sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))
    return max(0.0, min(1.0, 2 * total))


def binary_shift(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """psi and z of two proportions."""
    side = lambda d, n: d.agg(F.avg(column).alias(f"p_{n}"), F.count(column).alias(f"n_{n}"))
    j = side(ref, "r").join(F.broadcast(side(cur, "c")))
    p, q = F.col("p_r"), F.col("p_c")
    pool = (p * F.col("n_r") + q * F.col("n_c")) / (F.col("n_r") + F.col("n_c"))
    z = (q - p) / F.sqrt(pool * (1 - pool) * (1 / F.col("n_r") + 1 / F.col("n_c")))
    term = lambda a, b: (b - a) * F.ln(F.greatest(b, F.lit(EPS)) / F.greatest(a, F.lit(EPS)))
    return j.select((term(p, q) + term(1 - p, 1 - q)).alias("psi"), z.alias("z"))


def integrity(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """(check, share, ok): for each check the share of rows that pass and whether it reaches its minimum; one pass."""
    agg = df.agg(*(F.avg(F.coalesce(cond, F.lit(False)).cast("int")).alias(k) for k, (cond, _) in checks.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("share"), (F.col(k) >= least).alias("ok")) for k, (_, least) in checks.items()))
    return agg.select(F.explode(rows).alias("x")).select("x.*")


def verdicts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics (metric, value) against thresholds (metric, warn, fail)."""
    v = F.when(F.col("value") >= F.col("fail"), "fail").when(F.col("value") >= F.col("warn"), "warn").otherwise("pass")
    return metrics.join(F.broadcast(thresholds), "metric").select("metric", "value", v.alias("verdict"))
