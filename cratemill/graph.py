"""Connected components of a table of links, with the rows of hot nodes dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratemill import tables

#: A task takes so many rows of one key without harm; fewer rows are not looked at for hot keys.
FEW = 50_000


def hot_or_none(df: DataFrame, key: str, parts: int = 4096, least: int = 1000, few: int = FEW) -> DataFrame | None:
    """tables.hot_keys of the rows of a table df, or None if no key is hot or df has few rows."""
    if df.count() <= few:
        return None
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if (seen["most"] or 0) <= max((seen["rows"] or 0) // parts, least):
        return None
    return tables.materialize(tables.hot_keys(counts, key, parts=parts, least=least), "hot-keys")


def split_join(rows: DataFrame, small: DataFrame, key: str, small_key: str, hot: DataFrame | None, spread: list[Column], how: str = "inner") -> DataFrame:
    """tables.salted_join, or a plain join where no key is hot."""
    return tables.salted_join(rows, small, key, small_key, hot, spread, how) if hot is not None else rows.join(small, rows[key] == small[small_key], how)


def components(edges: DataFrame, parts: int = 4096, least: int = 1000, few: int = FEW) -> DataFrame:
    """(node, root): of every node that has an edge (a, b), the smallest node it can reach. Nodes can be of any type that sorts.

    Each round takes the smallest label among neighbours and then the label of that label, so chains are followed at doubling distance,
    until nothing changes. A node with many links, and a root that many nodes carry, is spread over several tasks (split_join).
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = tables.materialize(edges.select(ways).select("e.*"), "edges")
    centres = hot_or_none(both, "b", parts, least, few)
    labels = tables.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    nodes = labels.count()
    while True:
        near = split_join(both, labels, "b", "node", centres, [F.col("a")]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        hot = None
        if nodes > few:
            stepped = tables.materialize(stepped, "stepped")
            hot = hot_or_none(stepped, "root", parts, least, few)
        up = labels.select(F.col("node").alias("via"), F.col("root").alias("top"))
        jumped = split_join(stepped, up, "root", "via", hot, [F.col("node")], "left")
        new = tables.materialize(jumped.select("node", "was", F.least("root", F.coalesce("top", "root")).alias("root")), "labels")
        labels = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return labels
