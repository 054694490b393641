"""Stored tables of the streams: what a batch rewrites, what it leaves alone, batches that are run again."""

import os
import random

from pyspark.sql import functions as F

from cratemill.streaming.incremental import SaleStore, SnapshotStore, shared_path

ROWS = "release_id string, fetched_at timestamp, lowest_price double, num_for_sale int, ladder string, event_id long"


def snapshots(spark, rows):
    return spark.createDataFrame([(r, None, p, n, x, e) for r, _, p, n, x, e in rows], ROWS).withColumn("fetched_at", F.timestamp_seconds(F.col("event_id") % 1000))


def files(root, n):
    root = root.removeprefix("file://")
    return {p: os.stat(p).st_mtime_ns for d, _, names in os.walk(f"{root}/table/{n}") for p in (os.path.join(d, x) for x in names)}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark):
    rng = random.Random(1)
    store = SnapshotStore(spark, shared_path(spark, "store"), buckets=8)
    batches = [[(f"r{i}", None, rng.choice([None, 1.0 + i]), rng.choice([None, i]), rng.choice([None, "{}", f'{{"a":{i}}}']), 1000 * b + i) for i in ids] for b, ids in enumerate((range(60), [3], [3, 70, 71]))]
    store.merge(snapshots(spark, batches[0]), 0)
    first = files(store.root, 0)
    store.merge(snapshots(spark, batches[1]), 1)
    assert len(set(store.places(1).values())) == 2 and sum(v == 1 for v in store.places(1).values()) == 1
    store.merge(snapshots(spark, batches[2]), 2)
    assert files(store.root, 0) == first and len([v for v in store.places(2).values() if v == 2]) <= 3
    every = [r for b in batches for r in b]
    got = {r["release_id"]: r for r in store.newest(2).collect()}
    assert set(got) == {r[0] for r in every}
    for release, row in got.items():
        own = sorted((r for r in every if r[0] == release), key=lambda r: (r[5] % 1000, r[5]))
        last = lambda at: next((r[at] for r in reversed(own) if r[at] not in (None, "{}")), None)  # noqa: B023, E731
        assert (row["lowest_price"], row["num_for_sale"], row["ladder"]) == (last(2), last(3), last(4))


def test_a_batch_can_be_run_again(spark):
    store = SnapshotStore(spark, shared_path(spark, "store"), buckets=4)
    one, two = ([(f"r{i}", None, float(i), None, None, 1000 * b + i) for i in range(20)] for b in (0, 1))
    store.merge(snapshots(spark, one), 0)
    store.merge(snapshots(spark, two), 1)
    before = sorted(map(str, store.newest(1).collect()))
    store.merge(snapshots(spark, two), 1)
    assert sorted(map(str, store.newest(1).collect())) == before
    assert store.read(-1) is None


def test_sales_are_stored_once(spark):
    store = SaleStore(spark, shared_path(spark, "sales"))
    frame = lambda rows: spark.createDataFrame(rows, "release_id string, row_hash string, order_date string")
    assert store.read() is None
    store.add(frame([("a", "1", "2024-01"), ("a", "1", "2024-01"), ("a", "2", None), ("b", "1", "2024-02")]), 0)
    late = frame([("a", "1", "2024-01"), ("a", "2", None), ("c", "9", "1990-01"), ("b", "3", "2024-02")])
    store.add(late, 1)
    want = [("a", "1"), ("a", "2"), ("b", "1"), ("b", "3"), ("c", "9")]
    rows = lambda: sorted((r["release_id"], r["row_hash"]) for r in store.read().collect())
    assert rows() == want
    store.add(late, 1)  # again
    assert rows() == want
    store.add(frame([]), 2)
    assert rows() == want
