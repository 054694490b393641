"""Exact deduplication as a stateful stream.

The table is streamed through a keyed aggregation whose state lives on disk (RocksDB), is never expired and holds for
every digest the identifier that stays, where its content lies (file and row) and the number of rows.  After the last
batch the state is read as a table.  A row whose digest was seen more than once is a hit: its full text is compared with the
text at the state's locator, and digests under which different texts met are told apart by the text itself.

Only DataFrame operations are used.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small state stores: no disk is set aside beforehand, and a commit ships changes instead of whole files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # an executor's stores share one bounded memory, and a store is closed once its batch is committed
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha(text: Column) -> Column:
    """SHA-256 of the UTF-8 text in lower-case hex; null is empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _located(df: DataFrame, digest) -> DataFrame:
    """doc_id, text, digest and the row's place: a file and a row in it."""
    return df.select(
        "doc_id",
        "text",
        digest(F.col("text")).alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )


def digest_state(spark: SparkSession, path: str, digest=sha, bytes_per_batch: int = 256 << 30) -> DataFrame:
    """Stream the Parquet table at path through the keyed state: digest, keep (doc_id, file, at), n.

    bytes_per_batch bounds a micro-batch; the stream stops when the files there are have been read. An interrupted stream can
    go on from its checkpoint, which lies in the shared folder.
    """
    checkpoint = common.new_path(spark, "dedup-state")
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    path = path.rstrip("/")
    # the stream source takes one file only by a pattern; a path that is one already is read as it is
    glob = path if set(path) & set("[]{}*?") else f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(glob)
    rows = _located(stream, digest).select("digest", F.struct("doc_id", "file", "at").alias("place"))
    counted = rows.groupBy("digest").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, _STATE):
        query = counted.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        key, keep, n = (state.schema[a].dataType.names for a in ("key", "value", "value"))
        return state.select(F.col(f"key.{key[0]}").alias("digest"), F.col(f"value.{keep[0]}").alias("keep"), F.col(f"value.{n[1]}").alias("n"))


def dedup_table(spark: SparkSession, path: str, digest=sha, bytes_per_batch: int = 256 << 30) -> DataFrame:
    """Of every row of the Parquet table at path: doc_id, file, at, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are, byte by byte; null is empty. The row with the largest doc_id stays (null is
    smaller than any), among equal ids the one that lies last. Repeated rows are rows: they count, and one of them can stay. Other
    columns are ignored. digest can be any function of the text: texts that meet under one digest are compared in full.
    """
    state = common.materialize(digest_state(spark, path, digest, bytes_per_batch), "digests")
    hot = common.materialize(common.hot_keys(state, "digest"), "hot-digests")
    rows = _located(spark.read.parquet(path), digest)
    place = [F.col("file"), F.col("at")]
    hits = state.where("n > 1")
    # every hit is compared with the text at the locator, byte by byte; copies of one text are dealt to several tasks
    at = hits.select(F.col("digest").alias("d"), F.col("keep.file").alias("kf"), F.col("keep.at").alias("ka"))
    full = F.coalesce(F.col("text"), F.lit(""))
    kept = (F.col("file") == F.col("kf")) & (F.col("at") == F.col("ka"))
    hit = common.materialize(common.salted_join(rows, at, "digest", "d", hot, place), "hits")
    kept_text = hit.where(kept).select(F.col("digest").alias("kd"), full.alias("kept_text"))
    seen = common.salted_join(hit, kept_text, "digest", "kd", hot, place).where(full != F.col("kept_text"))
    mixed = common.materialize(seen.select("digest").distinct(), "collisions")
    known = state.select(F.col("digest").alias("d"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("kf"), F.col("keep.at").alias("ka"), F.col("n").alias("group_size"))
    slim = rows.select("doc_id", "file", "at", "digest", sha(F.col("text")).alias("text_sha256"))
    cols = ("doc_id", "file", "at", "keep_id", "group_size", "kept", "text_sha256")
    if mixed.isEmpty():
        return common.salted_join(slim, known, "digest", "d", hot, place).withColumn("kept", kept).select(*cols)
    plain = slim.join(mixed.select(F.col("digest").alias("m")), slim["digest"] == F.col("m"), "left_anti")
    plain = common.salted_join(plain, known, "digest", "d", hot, place).withColumn("kept", kept).select(*cols)
    odd = rows.join(mixed.select(F.col("digest").alias("m")), rows["digest"] == F.col("m"), "left_semi").withColumn("full", full)
    groups = odd.groupBy("full").agg(F.max(F.struct("doc_id", "file", "at")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.col("full").alias("g"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("kf"), F.col("keep.at").alias("ka"), "group_size")
    odd = odd.join(groups, odd["full"] == groups["g"]).withColumn("kept", kept).withColumn("text_sha256", sha(F.col("full"))).select(*cols)
    return plain.unionByName(odd)


def dedup(docs: DataFrame, bytes_per_batch: int = 256 << 30) -> DataFrame:
    """docs without the rows that do not stay; all columns are kept.

    docs may be any frame, so it is first written to the shared folder: the stream and the locators need files.
    """
    spark = docs.sparkSession
    path = common.new_path(spark, "dedup-input")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    plain.withColumns({"doc_id": F.col(doc_id), "text": F.col(text)}).drop(doc_id, text).write.parquet(path)
    stay = dedup_table(spark, path, bytes_per_batch=bytes_per_batch).where("kept").select(F.col("file").alias("kf"), F.col("at").alias("ka"))
    rows = spark.read.parquet(path)
    place = rows.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    left = place.join(stay, (place["__file"] == stay["kf"]) & (place["__at"] == stay["ka"]), "left_semi")
    names = ["doc_id" if c == doc_id else "text" if c == text else c for c in plain.columns]
    return left.select(*names).toDF(*docs.columns)
