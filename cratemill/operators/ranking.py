"""Global order numbers without a single-task sort."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def global_rank(df: DataFrame, order: list[Column], within: list[str] | None = None, name: str = "rn", write=None, partitions: int | None = None) -> DataFrame:
    """Number the rows 1, 2, ... in the given order, for the whole frame or anew for each value of `within`.

    The rows are range-partitioned and sorted, so a key that holds most rows is spread by the rest of the order. Each
    partition counts its rows per key; the counts of earlier partitions are added to the place inside the partition. The order
    should end in something unique. `within` columns must lead `order`. `write` cuts the lineage of the sorted frame
    (a function of a frame, checkpoint by default), since both passes must see the same partitions.
    """
    within = within or []
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, part, lead = (f"__{x}_{uuid.uuid4().hex[:8]}" for x in ("place", "part", "lead"))
    sorted_df = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    sorted_df = write(sorted_df) if write else sorted_df.checkpoint()
    sorted_df = sorted_df.withColumn(part, F.shiftright(place, 33))
    counts = sorted_df.groupBy(part, *within).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least"))
    # one row for each partition and key: a few numbers, whatever the number of rows
    before = counts.select(
        *(F.col(c).alias(f"{lead}_{i}") for i, c in enumerate([part, *within])),
        "least",
        F.expr(f"sum(n) over (partition by {', '.join(f'`{c}`' for c in within) or 'null'} order by `{part}` rows between unbounded preceding and 1 preceding)").alias("before"),
    )
    match = F.lit(True)
    for i, c in enumerate([part, *within]):
        match = match & sorted_df[c].eqNullSafe(before[f"{lead}_{i}"])
    out = sorted_df.join(before, match).withColumn(name, F.col(place) - F.col("least") + F.coalesce("before", F.lit(0)) + 1)
    return out.select(*df.columns, name)


#: Rows that one task ranks for quantiles: a task's share does not grow with the table.
ROWS_PER_TASK = 2_000_000


def quantiles(df: DataFrame, value: Column, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by..., one column for each name of shares): exact quantiles of value, interpolated between neighbours; nulls are left out.

    For few groups of many rows: rows are ranked by a range partition and the one or two rows at each place are picked, so
    no group's values have to meet in one task or one hash map. Without rows and groups the quantiles are null.
    """
    by = by or []
    flat = df.select(*by, value.cast("double").alias("__v")).where("__v is not null")
    keys = [F.col(c) for c in by]
    sizes = flat.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).select(*(F.col(c).alias(f"__by_{c}") for c in by), "__n").checkpoint()
    rows = sizes.agg(F.sum("__n").alias("n")).first()["n"] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
    ranked = global_rank(flat, [*keys, F.col("__v")], within=by, name="__rn", partitions=parts)
    match = F.lit(True)
    for c in by:
        match = match & ranked[c].eqNullSafe(sizes[f"__by_{c}"])
    at = {name: (F.col("__n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    low, high = {k: F.floor(h) for k, h in at.items()}, {k: F.ceil(h) for k, h in at.items()}
    place = F.col("__rn") - 1
    wanted = F.lit(False)
    for k in shares:
        wanted = wanted | (place == low[k]) | (place == high[k])
    # sizes has a row for each group; groups are few by contract
    picked = ranked.join(sizes, match).where(wanted)
    one = lambda k, side: F.max(F.when(place == side[k], F.col("__v")))
    rest = {k: F.max(F.when(place == low[k], h - low[k])) for k, h in at.items()}
    return picked.groupBy(*by).agg(*((one(k, low) + (one(k, high) - one(k, low)) * rest[k]).alias(k) for k in shares))
