"""Tables in the shared folder, and joins whose hot keys are spread: what corpus operators and others share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in have:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process, as in tests, a folder of our own; on a cluster it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cratemill-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_scratch: list[list[str]] = []


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/cratemill-{what}-{uuid.uuid4().hex}"
    for paths in _scratch:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the paths that are made inside the block, so that a caller can delete them once its own result is written."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield paths
    finally:
        _scratch.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages start from the files, not from lineage."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(counts: DataFrame, key: str, n: str = "n", parts: int = 4096, least: int = 32) -> DataFrame:
    """(hot, salts): the keys that hold more than a `parts`-th of all rows, and over how many salts each is to be spread.

    counts has one row for each key, with its number of rows in n. Counts add up to the number of rows, so there are at most
    `parts` hot keys whatever the data, and they may be broadcast. Groups of `least` rows or fewer are never split.
    """
    total = counts.agg(F.sum(n).alias("n")).first()["n"] or 0
    limit = max(total // parts, least)
    return counts.where(F.col(n) > limit).select(F.col(key).alias("hot"), F.ceil(F.col(n) / limit).cast("int").alias("salts"))


def salted_join(rows: DataFrame, small: DataFrame, key: str, small_key: str, hot: DataFrame, spread: list[Column], how: str = "inner") -> DataFrame:
    """rows join small on key = small_key, with hot keys split over several tasks.

    small has few rows for each key. A hot key's rows are dealt to its salts by a hash of `spread`; its rows in small are
    repeated once for each salt. small must not have columns named like those of rows.
    """
    salt, other = fresh(rows, "salt"), fresh(rows, "other_salt")
    h = F.broadcast(hot)
    left = rows.join(h, rows[key] == h["hot"], "left").withColumn(salt, F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("salts").cast("long"))).cast("int")).drop("hot", "salts")
    right = small.join(h, small[small_key] == h["hot"], "left").withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("hot", "salts")
    return left.join(right, (left[key] == right[small_key]) & (left[salt] == right[other]), how).drop(salt, other)
