"""Upserts, merges and patches of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """stored with the rows of new laid over it: of a key the last row by `order` wins, new rows over stored ones; blank keys go.

    One aggregate by key instead of a join: rows of both sides are combined before the shuffle.
    """
    cols = stored.columns
    rows = stored.select(*cols, F.lit(0).alias("__new")).unionByName(new.select(*cols, F.lit(1).alias("__new")))
    for k in key:
        rows = rows.where(F.trim(F.col(k).cast("string")) != "")
    rest = [c for c in cols if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("__new", order)).alias("__row"))
    return last.select(*key, "__row.*").select(*cols)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c).isin("", "{}", "[]"), None).otherwise(c)


def coalescing_upsert(stored: DataFrame, new: DataFrame, key: str, columns: list[str], ladders: list[str]) -> DataFrame:
    """New non-null fields win, others stay; an empty ladder (`ladders`, JSON text) never replaces a stored one. One row per key on either side."""
    s, n = stored.select(key, *columns).alias("s"), new.select(key, *columns).alias("n")
    both = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full")

    def pick(c: str) -> Column:
        fresh, old = F.col(f"n.{c}"), F.col(f"s.{c}")
        return F.coalesce(blank_to_null(fresh), old, fresh) if c in ladders else F.coalesce(fresh, old)

    return both.select(F.coalesce(F.col(f"n.{key}"), F.col(f"s.{key}")).alias(key), *(pick(c).alias(c) for c in columns))


def newest_values(rows: DataFrame, key: list[str], time: str, columns: list[str], ladders: list[str], tie: str) -> DataFrame:
    """Of every key and column the newest value that is not blank (equal times: the row with more values, then the larger tie).

    Works for any number of sources: union them first. Each column is an aggregate, so nothing is sorted per key.
    """
    value = {c: blank_to_null(F.col(c)) if c in ladders else F.col(c) for c in columns}
    filled = sum((v.isNotNull().cast("int") for v in value.values()), F.lit(0))
    rank = F.struct(F.col(time), filled, F.col(tie))
    picks = [F.max_by(v, F.when(v.isNotNull(), rank)).alias(c) for c, v in value.items()]
    return rows.groupBy(*key).agg(F.max(time).alias(time), *picks)


def newest_rows(rows: DataFrame, key: list[str], time: str, columns: list[str], tie: str) -> DataFrame:
    """The newest row of every key, ties by the number of values, then by `tie`."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    best = rows.groupBy(*key).agg(F.max_by(F.struct(time, *columns, tie), F.struct(time, filled, tie)).alias("r"))
    return best.select(*key, "r.*")


def first_per_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of every key in ingest order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*").select(*rows.columns)


def cross_source(rows: DataFrame, primary: str, order: str) -> DataFrame:
    """Rows kept of the same (artist, title) in several sources, walked in order.

    A row of the primary source is always kept. Another row is kept if the source kept last is its own, or none has been kept. So
    before any primary row only the first row's source stays, and after one nothing else does. Blank artist or title: kept.
    """
    key = [F.lower(F.trim("artist")), F.lower(F.trim("title"))]
    w = Window.partitionBy(*key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_primary = (F.col("source") == primary).cast("int")
    seen = F.coalesce(F.max(is_primary).over(before), F.lit(0))
    first = F.first("source").over(w)
    blank = (F.coalesce(F.trim("artist"), F.lit("")) == "") | (F.coalesce(F.trim("title"), F.lit("")) == "")
    keep = blank | (is_primary == 1) | ((seen == 0) & (first == F.col("source")))
    return rows.withColumn("__keep", keep).where("__keep").drop("__keep")


def row_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def last_patches(patches: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """The last patch of every (source, item_id)."""
    return patches.groupBy("source", "item_id").agg(F.max_by(F.struct(*fields), order).alias("p")).select("source", "item_id", "p.*")


def apply_patches(records: DataFrame, patches: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """records with non-null fields of the last patch laid over; `patched` tells which."""
    last = last_patches(patches, order, fields).withColumnsRenamed({f: f"__{f}" for f in fields}).withColumn("patched", F.lit(True))
    out = records.join(last, ["source", "item_id"], "left")
    return out.withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields} | {"patched": F.coalesce("patched", F.lit(False))}).drop(*(f"__{f}" for f in fields))


def orphan_patches(records: DataFrame, patches: DataFrame) -> DataFrame:
    return patches.select("source", "item_id").distinct().join(records.select("source", "item_id"), ["source", "item_id"], "left_anti")


def overlay(base: DataFrame, over: DataFrame, key: str, numbers: list[str], ladder: str) -> DataFrame:
    """base with valid values of over: numbers that parse and are positive, a ladder that is not empty."""
    o = over.select(key, *(F.col(c).alias(f"__{c}") for c in (*numbers, ladder)))
    out = base.join(o, key, "left")
    number = lambda c: F.expr(f"try_cast(`__{c}` AS DOUBLE)")
    values = {c: F.coalesce(F.when(number(c) > 0, number(c)), F.col(c)) for c in numbers} | {ladder: F.coalesce(blank_to_null(F.col(f"__{ladder}")), F.col(ladder))}
    return out.withColumns(values).drop(*(f"__{c}" for c in (*numbers, ladder)))


def overlap(**keys: DataFrame) -> DataFrame:
    """How many ids (column id) are in each combination of tables: one aggregate over flags."""
    names = list(keys)
    flagged = None
    for n, df in keys.items():
        part = df.select("id", *(F.lit(1 if m == n else 0).alias(m) for m in names))
        flagged = part if flagged is None else flagged.unionByName(part)
    per_id = flagged.groupBy("id").agg(*(F.max(n).alias(n) for n in names))
    return per_id.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def fold_decisions(queue: DataFrame) -> DataFrame:
    """One patch per (source, item): of each target the last accepted label that is not empty."""
    label = F.when(F.col("decision") == "accept_llm", F.col("llm_label")).otherwise(F.col("final_label"))
    done = queue.where(F.col("decision").isin("accept_llm", "edit", "keep")).withColumn("label", F.nullif(F.trim(label), F.lit("")))
    last = lambda t: F.max_by("label", F.when((F.col("target") == t) & F.col("label").isNotNull(), F.col("queue_row_id"))).alias(f"{t}_label")
    return done.groupBy("source", "item_id").agg(last("sleeve"), last("media")).where("sleeve_label is not null or media_label is not null")


def merge_patch_files(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Known keys get only the sleeve label of the last new line, on every line of theirs; unknown keys are appended. new: with column line."""
    last = new.groupBy("source", "item_id").agg(F.max_by(F.struct("sleeve_label", "media_label"), "line").alias("n"))
    patched = stored.join(last, ["source", "item_id"], "left").select("source", "item_id", F.coalesce("n.sleeve_label", "sleeve_label").alias("sleeve_label"), "media_label")
    added = last.join(stored.select("source", "item_id").distinct(), ["source", "item_id"], "left_anti").select("source", "item_id", "n.sleeve_label", "n.media_label")
    return patched.unionByName(added)
