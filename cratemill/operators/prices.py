"""Sales to price labels: eligibility, nowcast, label synthesis, error metrics, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratemill.operators.ranking import quantiles


def as_of(sales: DataFrame, fetched: DataFrame) -> DataFrame:
    """sales up to their release's reference time (fetched: release_id, t_ref)."""
    return sales.join(fetched, "release_id").where(F.col("order_date") <= F.col("t_ref"))


#: The steps of the cascade (tag, least ordinal, least number of sales).
CASCADE = (("strict", 7.0, 8), ("relax_1", 6.0, 12), ("relax_2", 5.0, 14))


def cascade(sales: DataFrame, steps: tuple[tuple[str, float, int], ...] = CASCADE) -> DataFrame:
    """Eligible sales with relax_tag: of each release the strictest pool that has enough sales. sales: release_id, media_ord, sleeve_ord.

    Conditional counts per release give the tag; sales are joined back, so no release's sales have to meet in one place.
    """
    eff = F.least("media_ord", "sleeve_ord")
    per = sales.groupBy("release_id").agg(*(F.count_if(eff >= floor).alias(tag) for tag, floor, _ in steps))
    tag, floor = F.lit("none"), F.lit(None).cast("double")
    for name, least, n in reversed(steps):
        tag, floor = F.when(F.col(name) >= n, name).otherwise(tag), F.when(F.col(name) >= n, least).otherwise(floor)
    chosen = per.select("release_id", tag.alias("relax_tag"), floor.alias("floor"))
    return sales.join(chosen, "release_id").where(eff >= F.col("floor")).drop("floor")


def uplifted(sales: DataFrame, per_grade: float = 0.08, near_mint: float = 7.0) -> DataFrame:
    """sales with uplift_usd: the price that the record would have fetched near mint, `per_grade` in the log for each grade below.

    Prices that are not positive stay as they are.
    """
    below = F.greatest(F.lit(near_mint) - F.least("media_ord", "sleeve_ord"), F.lit(0.0))
    return sales.withColumn("uplift_usd", F.when(F.col("usd") > 0, F.col("usd") * F.exp(per_grade * below)).otherwise(F.col("usd")))


def cascade_tags(sales: DataFrame, steps=CASCADE) -> DataFrame:
    eff = F.least("media_ord", "sleeve_ord")
    per = sales.groupBy("release_id").agg(*(F.count_if(eff >= floor).alias(tag) for tag, floor, _ in steps))
    tag = F.lit("none")
    for name, _, n in reversed(steps):
        tag = F.when(F.col(name) >= n, name).otherwise(tag)
    return per.select("release_id", tag.alias("relax_tag"))


def days(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 86400e6


#: The first day of the bin of a date.
BINS = {"day": F.to_date, "week": lambda d: F.trunc(d, "week"), "month": lambda d: F.trunc(d, "month")}


def theil_sen(sales: DataFrame, bin_: str = "month") -> DataFrame:
    """Per release the trend of median log prices by day, week or month: slope, intercept, bins. sales: release_id, order_date, usd.

    Only bins are paired, so a release of many sales gives few pairs.
    """
    bins = sales.where("usd > 0").groupBy("release_id", BINS[bin_]("order_date").alias("m")).agg(F.ln(F.median("usd")).alias("y"))
    origin = bins.groupBy("release_id").agg(F.min("m").alias("m0"))
    at = bins.join(origin, "release_id").select("release_id", F.datediff("m", "m0").cast("double").alias("x"), "y")
    a, b = at.alias("a"), at.alias("b")
    pairs = a.join(b, (F.col("a.release_id") == F.col("b.release_id")) & (F.col("a.x") < F.col("b.x")))
    slopes = pairs.groupBy(F.col("a.release_id").alias("release_id")).agg(F.median((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("slope"))
    centers = at.groupBy("release_id").agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.count(F.lit(1)).alias("bins"))
    return slopes.join(centers, "release_id").select("release_id", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "bins")


def weighted_center(sales: DataFrame, half_life: float = 90.0) -> DataFrame:
    """Per release the recency-weighted mean and median, and the last sale. sales: release_id, order_date, usd, t_ref."""
    w = F.exp(-F.greatest(days(F.col("t_ref"), F.col("order_date")), F.lit(0.0)) / max(1.0, half_life))
    rows = sales.withColumn("w", w)
    line = Window.partitionBy("release_id").orderBy("usd", "order_date", "line")
    whole = Window.partitionBy("release_id")
    cum = rows.withColumn("cum", F.sum("w").over(line)).withColumn("all", F.sum("w").over(whole))
    return cum.groupBy("release_id").agg(
        (F.sum(F.col("usd") * F.col("w")) / F.sum("w")).alias("w_mean"),
        F.min(F.when(F.col("cum") >= 0.5 * F.col("all") * (1 - 1e-12), F.col("usd"))).alias("w_median"),
        F.max_by("usd", F.struct("order_date", "usd")).alias("last_usd"),
        F.count(F.lit(1)).alias("n"),
    )


def sale_stats(sales: DataFrame) -> DataFrame:
    return sales.groupBy("release_id").agg(F.min("usd").alias("low"), F.median("usd").alias("median"), F.max("usd").alias("high"), F.avg("usd").alias("average"), F.count(F.lit(1)).alias("n"))


def nowcast(sales: DataFrame, min_bins: int = 4, shrink: float = 0.7, half_life: float = 90.0, bin_: str = "month") -> DataFrame:
    """(release_id, sold, tier, n): A a trend, shrunk to the weighted median; B the weighted median; C the last sale."""
    trend = theil_sen(sales, bin_)
    center = weighted_center(sales, half_life)
    first = sales.groupBy("release_id").agg(F.min(BINS[bin_]("order_date")).alias("m0"), F.max(BINS[bin_]("t_ref")).alias("mr"))
    j = center.join(first, "release_id").join(trend, "release_id", "left")
    raw = F.col("intercept") + F.col("slope") * F.datediff("mr", "m0")
    is_a = F.coalesce(F.col("bins") >= min_bins, F.lit(False)) & F.abs(raw).between(0, 25)
    sold = F.when(is_a, F.exp(shrink * raw + (1 - shrink) * F.ln("w_median"))).when(F.col("n") >= 3, F.col("w_median")).otherwise(F.col("last_usd"))
    return j.select("release_id", sold.alias("sold"), F.when(is_a, "A").when(F.col("n") >= 3, "B").otherwise("C").alias("tier"), "n")


def dollars(log1p: Column) -> Column:
    return F.expm1(log1p)


def errors(df: DataFrame) -> DataFrame:
    """df with true and predicted dollars and the absolute percentage error (price floor one cent)."""
    t, p = dollars(F.col("y_true")), dollars(F.col("y_pred"))
    return df.withColumns({"t": t, "p": p, "ae": F.abs(p - t), "ape": F.abs(p - t) / F.greatest(t, F.lit(0.01))})


def with_quantiles(g: DataFrame, rows: DataFrame, value: Column, shares: dict[str, float], by: list[str]) -> DataFrame:
    """g (a row for each group) with quantiles of the groups' rows."""
    q = quantiles(rows, value, shares, by)
    if not by:
        return g.join(F.broadcast(q))  # one row each
    q = q.withColumnsRenamed({c: f"__q_{c}" for c in by})
    match = F.lit(True)
    for c in by:
        match = match & g[c].eqNullSafe(q[f"__q_{c}"])
    return g.join(q, match, "left").drop(*(f"__q_{c}" for c in by))


def metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mae, wape, mdape and n."""
    rows, by = errors(df), by or []
    g = rows.groupBy(*by).agg(F.avg("ae").alias("mae"), (F.sum("ae") / F.sum("t")).alias("wape"), F.count(F.lit(1)).alias("n"))
    return with_quantiles(g, rows, F.col("ape"), {"mdape": 0.5}, by)


def quantile_bins(df: DataFrame, column: str, shares: list[float], name: str) -> DataFrame:
    """df with the bin of column between its exact quantiles (right-closed, the first bin takes the minimum)."""
    cuts = quantiles(df, F.col(column), {f"q{i}": x for i, x in enumerate(shares)})
    cuts = cuts.select(F.array(*(F.col(f"q{i}") for i in range(len(shares)))).alias("__cuts"))
    place = F.size(F.filter(F.array_distinct("__cuts"), lambda e: F.col(column) > e))
    return df.join(F.broadcast(cuts)).withColumn(name, place).drop("__cuts")
