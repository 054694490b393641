"""Incremental ingest as streams: snapshots, sales, drift."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratemill.operators import merges


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir; a folder of our own only where Spark is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cratemill-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream (one file is taken by a pattern; a path that is one already is read as it is)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path if set(path) & set("[]{}*?") else f"{path[:-1]}[{path[-1]}]")


def _snapshot_rows(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").cast("string").alias("release_id"), F.col("ts").alias("fetched_at"), F.when(kind == "error", None).otherwise(F.col("value")).alias("lowest_price"),
        F.when(kind == "view", None).otherwise((F.col("event_id") % 50).cast("int")).alias("num_for_sale"), F.when(kind == "click", "{}").otherwise(F.col("props")).alias("ladder"), "event_id",
    )


class SnapshotStore:
    """The newest values of every release, in hash buckets; a batch rewrites the buckets that it touches and no others.

    Batch n writes its buckets to a folder of its own, then a list of where every bucket is (one line for each bucket). A batch that
    is run again starts from the list before it and writes the same folder, so nothing is merged twice and a batch that broke off
    leaves the store as it was. Old folders stay until vacuum.
    """

    values = ("lowest_price", "num_for_sale", "ladder")

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets

    def places(self, n: int) -> dict[int, int]:
        """Which batch wrote each bucket, as of batch n; none before the first."""
        return {r["bucket"]: r["batch"] for r in self.spark.read.schema("bucket int, batch int").json(f"{self.root}/list/{n}").collect()} if n >= 0 else {}

    def read(self, n: int, buckets: set[int] | None = None) -> DataFrame | None:
        """Stored rows (release_id, fetched_at, values, event_id) as of batch n, of the given buckets only; None if there are none."""
        paths = [f"{self.root}/table/{batch}/bucket={b}" for b, batch in sorted(self.places(n).items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, rows: DataFrame, n: int) -> None:
        """Merge rows (release_id, fetched_at, values, event_id) as batch n; batches come in order, each perhaps more than once."""
        bucket = F.pmod(F.xxhash64("release_id"), F.lit(self.buckets)).cast("int")
        touched = {r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()}  # as many as there are buckets at most
        places = self.places(n - 1)
        old = self.read(n - 1, touched)
        kinds = dict(rows.dtypes)
        every = rows if old is None else rows.unionByName(old)
        # a value keeps the time and id of its own snapshot, so later merges compare it rightly
        parts = [F.max_by(F.struct("fetched_at", "event_id", v), F.when(F.col(v).isNotNull(), F.struct("fetched_at", "event_id"))).alias(v) for v in self.values]
        clean = every.withColumn("ladder", merges.blank_to_null(F.col("ladder")))
        merged = clean.groupBy("release_id").agg(F.max(F.struct("fetched_at", "event_id")).alias("top"), *parts)
        blank = lambda but=None: [F.lit(None).cast(kinds[v]).alias(v) if v != but else F.col(f"{v}.{v}").alias(v) for v in self.values]
        one = lambda src, but=None: F.struct(F.col(f"{src}.fetched_at").alias("fetched_at"), *blank(but), F.col(f"{src}.event_id").alias("event_id"))
        held = F.filter(F.array(one("top"), *(F.when(F.col(v).isNotNull(), one(v, v)) for v in self.values)), lambda x: x.isNotNull())
        lines = merged.select("release_id", F.explode(held).alias("x")).select("release_id", "x.*").withColumn("bucket", bucket)
        lines.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/table/{n}")
        now = places | dict.fromkeys(touched, n)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").json(f"{self.root}/list/{n}")

    def newest(self, n: int) -> DataFrame:
        """(release_id, fetched_at, values): the newest value that is not blank of every column, as of batch n."""
        return merges.newest_values(self.read(n), ["release_id"], "fetched_at", list(self.values), [], "event_id")


def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR01: snapshots arrive in batches; each is merged into a SnapshotStore."""
    store = SnapshotStore(spark, shared_path(spark, "snapshots"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    merge = lambda batch, n: store.merge(_snapshot_rows(batch), n)
    query = stream_table(spark, f"{sf_dir}/events.parquet").writeStream.foreachBatch(merge).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return store.newest(max((b["batchId"] for b in query.recentProgress if b["numInputRows"]), default=0))


class SaleStore:
    """Sales by row hash, each once, in partitions by date; no state besides the stored table.

    A batch is compared with what earlier batches stored for its own dates (a hash covers the date, so no other partition can hold it).
    Batch n writes a folder of its own, so a batch that is run again replaces its rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, before: int | None = None) -> DataFrame | None:
        """Stored rows (release_id, row_hash, order_date, batch), of batches before the given one only; None if nothing is stored."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/table")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return rows if before is None else rows.where(F.col("batch") < before)

    def add(self, rows: DataFrame, n: int) -> None:
        """Store the rows (release_id, row_hash, order_date) of batch n that are not stored yet."""
        once = rows.dropDuplicates(["release_id", "row_hash"])
        old = self.read(before=n)
        if old is not None:
            # partitions of other dates are not read: the batch's dates are few and known when the stored side is scanned
            day = once.select(F.col("order_date").alias("day")).distinct()
            seen = old.join(F.broadcast(day), F.col("order_date").eqNullSafe(F.col("day")), "left_semi").select("release_id", "row_hash")
            once = once.join(seen, ["release_id", "row_hash"], "left_anti")
        once.select("release_id", "row_hash", "order_date").write.mode("overwrite").partitionBy("order_date").parquet(f"{self.root}/table/batch={n}")


def stream_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR02: sales arrive in any order and perhaps again; every row is stored once (SaleStore)."""
    from cratemill.sources import views

    store = SaleStore(spark, shared_path(spark, "sales"))
    rows = spark.sql(views.VIEWS["sales"].replace("FROM lineitem", "FROM {arrived}"), arrived=stream_table(spark, f"{sf_dir}/lineitem.parquet"))
    parts = (F.col("release_id"), F.date_format("order_date", "yyyy-MM-dd"), F.col("media_condition"), F.col("sleeve_condition"), F.col("price_original_text"), F.col("seller_comments"))
    keyed = rows.select("release_id", merges.row_hash(*parts).alias("row_hash"), F.date_format("order_date", "yyyy-MM").alias("order_date"))
    query = keyed.writeStream.foreachBatch(store.add).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read().select("release_id", "row_hash")


def stream_drift(spark: SparkSession, sf_dir: str, edges: list[float]) -> DataFrame:
    """STR03: counts per day and bin of a value stream, kept by tumbling windows; the table of all windows."""
    root = shared_path(spark, "drift")
    rows = stream_table(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    bin_ = sum((F.col("value") >= e).cast("int") for e in edges)
    counts = rows.groupBy(F.window("ts", "1 day").alias("w"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.select(F.col("w.start").alias("day"), "bin", "n", F.lit(n).alias("batch")).write.mode("overwrite").parquet(f"{root}/table/batch={n}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.parquet(f"{root}/table")
    return every.groupBy("day", "bin").agg(F.max_by("n", "batch").alias("n"))
