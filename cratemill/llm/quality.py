"""Quality classifier by importance resampling (DSIR, Xie et al., 2023).

Two generative models over hashed word n-grams are counted: one over good labelled texts (target), one over all texts
(raw).  The log-importance of a text is the log-ratio of its likelihoods; with a Gumbel noise added, the k largest are a
sample without replacement in proportion to importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textscan

#: Buckets of the hashed n-grams: the models' size, whatever the data.
BUCKETS = 1 << 14


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every unigram and bigram; words and runs of signs are tokens, letter case counts."""
    w = textscan.scan(texts, textscan.WORDS_AND_SIGNS, lower=False)
    two = textscan.within_row(w.row, 2)
    rows = np.concatenate([w.row, w.row[:-1][two]]) if len(w.row) else w.row
    ids = np.concatenate([w.hash, textscan.grams(w.hash, 2)[two]]) if len(w.row) else w.hash
    return rows, (ids & np.uint64(BUCKETS - 1)).astype(np.int64)


def label_states(labels: DataFrame) -> DataFrame:
    """(doc_id, fine, good): one row per labelled id. fine: of quality 1; good: fine and not toxic.

    An unknown toxicity counts as none. Null ids and unknown qualities are no labels; an id with contrary labels is neither fine nor good.
    """
    own = common.pick(labels, *(c for c in ("doc_id", "quality", "toxic") if c in labels.columns)).where("doc_id is not null and quality in (0, 1)")
    toxic = F.coalesce("toxic", F.lit(0)) if "toxic" in own.columns else F.lit(0)
    per = own.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(toxic).alias("t"))
    return per.select("doc_id", (F.col("q") == 1).alias("fine"), ((F.col("q") == 1) & (F.col("t") == 0)).alias("good"))


def sample_labels(states: DataFrame, bound: int) -> list:
    """Ids of good documents: the `bound` with the smallest hashes."""
    return [r["doc_id"] for r in states.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()]  # bounded


def log_ratios(docs: DataFrame, good: list) -> np.ndarray:
    """For each bucket log p(target) - log p(raw). Counts are summed up in the tasks, then by bucket.

    The target model is smoothed towards the raw one with as much weight as it has tokens, so what is rare counts little.
    """
    held = docs.sparkSession.sparkContext.broadcast(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        ids_of_good = None
        for b in batches:
            if ids_of_good is None:
                ids_of_good = pa.array(held.value, b.column(0).type)
            chosen = pc.is_in(b.column(0), value_set=ids_of_good).to_numpy(zero_copy_only=False)
            for lo, hi in textscan.row_groups(b.column(1)):
                rows, ids = buckets(b.column(1).slice(lo, hi - lo))
                raw += np.bincount(ids, minlength=BUCKETS)
                target += np.bincount(ids[chosen[lo:hi][rows]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    counted = common.pick(docs, "doc_id", "text").mapInArrow(run, "bucket int, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = sums.column("bucket").to_numpy()
    raw[at], target[at] = sums.column("raw").to_numpy(), sums.column("target").to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    prior = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target / target.sum() + prior) / 2) - np.log(prior)


def weight(docs: DataFrame, ratios: np.ndarray):
    """A column function: the log-importance of a text (0 for one without tokens)."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("double")
    def log_importance(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for lo, hi in textscan.row_groups(texts):
            rows, ids = buckets(texts.slice(lo, hi - lo))
            out[lo:hi] = np.bincount(rows, weights=held.value[ids], minlength=hi - lo)
        return pa.array(out)

    return log_importance


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, None if it has fewer values than k (or k is 0).

    Histograms of 4096 bins are refined around the value, so little comes to the driver.
    """
    edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    lo, hi = edges["lo"], edges["hi"]
    if not 0 < k <= edges["n"]:
        return None
    while lo < hi:
        width = max(1, -(-(hi - lo + 1) // 4096))
        inside = df.where(F.col(column).between(lo, hi))
        bins = inside.groupBy(F.expr(f"({column} - {lo}L) div {width}L").alias("bin")).count().orderBy(F.desc("bin")).collect()
        for r in bins:
            if k <= r["count"]:
                lo, hi = lo + r["bin"] * width, min(hi, lo + (r["bin"] + 1) * width - 1)
                break
            k -= r["count"]
    return lo


#: Keys are compared as integers of this many parts of one.
PARTS = 1 << 20


def gumbel(doc_id: Column, tag: Column, seed: int | Column) -> Column:
    """Standard Gumbel noise drawn from a hash of the row, so reruns agree."""
    drawn = seed if isinstance(seed, Column) else F.lit(seed)
    u = (F.shiftrightunsigned(F.xxhash64(drawn, doc_id, tag), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(-F.ln(u))


def sample_key(weight: Column, doc_id: Column, tag: Column, seed: int | Column) -> Column:
    """The key of a row: the rows with the k largest are a sample without replacement in proportion to exp(weight)."""
    return F.floor((weight + gumbel(doc_id, tag, seed)) * PARTS).cast("long")


def quality(docs: DataFrame, labels: DataFrame, bound: int = 20000, seed: int = 7, keep: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """The rows of docs that are sampled, with their log-importance and key added (log_importance, sample_key).

    labels: doc_id, quality (0 or 1), toxic. The target model is fitted on a bounded sample of labelled documents: the `bound`
    good ids (quality 1, not toxic) with the smallest hashes. The raw model counts all documents. The importance of a text is the ratio of
    its likelihoods; rows are drawn without replacement in proportion to it. keep: the size k of the sample; by default
    the number of rows times the share of quality 1 among all labelled ids. It may be 0, or more than there are rows (all are kept).
    Rows with equal keys (in particular repeated rows) are kept or left together, so the sample can be larger by such ties. Null
    and empty texts have log-importance 0. Without labels everything is kept. carry: the columns of docs that the result
    has (by default all of them). Each text is looked at twice: once to count, once to weigh.
    """
    states = common.materialize(label_states(labels), "labels")
    ratio = log_ratios(docs, sample_labels(states, bound))
    cols = docs.columns if carry is None else carry
    names = {c: docs.columns.index(c) for c in ("doc_id", "text")}
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    doc_id, text = (F.col(f"c{names[c]}") for c in ("doc_id", "text"))
    scored = flat.withColumn("w", weight(docs, ratio)(text)).withColumn("key", sample_key(F.col("w"), doc_id, common.text_tag(text), seed))
    own = [i for i, c in enumerate(docs.columns) if c in cols]
    scored = common.materialize(scored.select(*(f"c{i}" for i in own), "w", "key"), "importance")
    share = states.agg(F.avg(F.col("fine").cast("int")).alias("s")).first()["s"]
    k = keep if keep is not None else scored.count() if share is None else round(scored.count() * share)
    least = kth_largest(scored, "key", k)
    out = scored.where(F.lit(False)) if k <= 0 else scored if least is None else scored.where(F.col("key") >= least)
    added = [w if w not in docs.columns else common.fresh(docs, w) for w in ("log_importance", "sample_key")]
    return out.toDF(*(docs.columns[i] for i in own), *added)
