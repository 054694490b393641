"""Review queues: gates, decisions, policies, cohorts, balanced samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratemill.operators.classify import hash_draw
from cratemill.operators.ranking import global_rank, quantiles


def gate(least: float = 0.2, no_disagreement: tuple[str, ...] = ("sale",)) -> Column:
    """Why a row comes to review: an issue, low self-confidence, or a model that disagrees (not in some sources)."""
    differs = (F.col("model_label") != F.col("assigned_label")) & ~F.col("source").isin(*no_disagreement)
    return F.when(F.col("is_issue") == 1, "issue").when(F.col("self_confidence") < least, "low_confidence").when(differs, "disagreement")


def shard(n: int, *key: Column) -> Column:
    """A stable shard number of a key."""
    return F.conv(F.substring(F.sha2(F.concat_ws("/", *key), 256), 1, 8), 16, 10).cast("long") % n


def gold() -> Column:
    d = F.col("decision")
    return F.when(d == "accept_llm", F.col("llm_label")).when(d == "keep", F.col("assigned_label")).when(d == "edit", F.nullif(F.trim("final_label"), F.lit("")))


def validated(rows: DataFrame, reasons: list[str], verdicts: list[str]) -> DataFrame:
    """rows with the status of their JSON response and its confidence, clipped to 0..1 (only if ok)."""
    j = F.from_json("response", "verdict string, confidence double, reason string, abstain boolean")
    r = rows.withColumn("j", j)
    bad = F.col("j").isNull() | (F.col("j.verdict").isNull() & F.col("j.reason").isNull())
    status = F.when(bad, "malformed").when(~F.col("j.reason").isin(*reasons), "bad_reason").when(F.col("j.abstain"), "abstain").when(~F.col("j.verdict").isin(*verdicts), "bad_verdict").otherwise("ok")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("j.confidence")))
    return r.withColumn("status", status).withColumn("confidence", F.when(F.col("status") == "ok", clipped)).drop("j")


def candidates(queue: DataFrame) -> DataFrame:
    """One row per row and candidate label: queue_row_id, source, truth, label, score, origin."""
    one = lambda label, score, origin: F.struct(F.col(label).alias("label"), F.col(score).alias("score"), F.lit(origin).alias("origin"))
    both = F.array(one("model_label", "self_confidence", "model"), one("llm_label", "llm_confidence", "llm"))
    return queue.select("queue_row_id", "source", "truth", F.explode(both).alias("x")).select("queue_row_id", "source", "truth", "x.*")


def decide(rows: DataFrame, threshold: Column) -> DataFrame:
    """Of every queue row the candidate with the best score above its threshold."""
    best = rows.where(F.col("score") >= threshold).groupBy("queue_row_id", "source", "truth").agg(F.max_by(F.struct("label", "score", "origin"), F.struct("score", "origin")).alias("b"))
    return best.select("queue_row_id", "source", "truth", "b.*")


def policy_score(decided: DataFrame, total: DataFrame) -> DataFrame:
    r = decided.agg(F.count(F.lit(1)).alias("decided"), F.avg((F.col("label") == F.col("truth")).cast("int")).alias("precision"))
    return r.join(F.broadcast(total)).select("decided", "precision", (F.col("decided") / F.col("total")).alias("coverage"))


def fit_thresholds(rows: DataFrame, grid: list[float], floor: float) -> DataFrame:
    """Per source the threshold of the grid that decides most rows at a precision of at least `floor` (ties: the smaller)."""
    steps = F.filter(F.array(*(F.lit(t) for t in grid)), lambda t: F.col("score") >= t)
    r = rows.withColumn("th", F.explode(steps)).groupBy("th", "source").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("truth")).cast("int")).alias("prec"))
    return r.where(F.col("prec") >= floor).groupBy("source").agg(F.max_by("th", F.struct(F.col("n"), (-F.col("th")).alias("m"))).alias("threshold"), F.max("n").alias("n"))


def cohorts(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The commonest correction by (old, predicted) and by old, with its count. done: old, predicted, fixed."""
    pair = done.groupBy("old", "predicted", "fixed").agg(F.count(F.lit(1)).alias("n"))
    top = lambda df, keys: df.groupBy(*keys).agg(F.max_by("fixed", F.struct("n", "fixed")).alias("fixed"), F.max("n").alias("n"))
    return top(pair, ["old", "predicted"]), top(pair.groupBy("old", "fixed").agg(F.sum("n").alias("n")), ["old"])


def suggest(queue: DataFrame, by_pair: DataFrame, by_old: DataFrame) -> DataFrame:
    """queue with suggested: the pair's correction seen twice, else the old label's seen three times, else the prediction."""
    a = by_pair.select(F.col("old").alias("o1"), F.col("predicted").alias("p1"), F.col("fixed").alias("f1"), F.col("n").alias("n1"))
    b = by_old.select(F.col("old").alias("o2"), F.col("fixed").alias("f2"), F.col("n").alias("n2"))
    j = queue.join(F.broadcast(a), (F.col("assigned_label") == F.col("o1")) & (F.col("model_label") == F.col("p1")), "left").join(F.broadcast(b), F.col("assigned_label") == F.col("o2"), "left")
    return j.withColumn("suggested", F.coalesce(F.when(F.col("n1") >= 2, F.col("f1")), F.when(F.col("n2") >= 3, F.col("f2")), F.col("model_label"))).drop("o1", "p1", "f1", "n1", "o2", "f2", "n2")


def trim_balanced(rows: DataFrame, joint: list[str], per_joint: int, single: list[str], per_single: int, draw: str, key: str, most: int) -> DataFrame:
    """Caps per joint stratum, then per single stratum (by hash), then overall (by key)."""
    cap = lambda df, keys, n: df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(draw, key))).where(F.col("__rn") <= n).drop("__rn")
    return cap(cap(rows, joint, per_joint), single, per_single).orderBy(key).limit(most)


def water_fill(rows: DataFrame, outer: list[str], inner: list[str], cap: int, budget: int, draw: str, key: str) -> DataFrame:
    """`budget` rows of every outer stratum, dealt evenly to inner strata that have rows left, `cap` at most from one."""
    turn = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*outer, *inner).orderBy(draw, key))).where(F.col("__turn") <= cap)
    return turn.withColumn("__rn", F.row_number().over(Window.partitionBy(*outer).orderBy("__turn", draw, key))).where(F.col("__rn") <= budget).drop("__rn", "__turn")


def stratified_split(rows: DataFrame, stratum: str, draw: str, key: str, train: float = 0.7, val: float = 0.15, rare: int = 5) -> DataFrame:
    """split train/val/test by hash rank within the stratum; strata with fewer than `rare` rows are train.

    A few strata hold all rows, so ranks are counted over range partitions.
    """
    n = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    r = global_rank(rows, [F.asc(stratum), F.asc(draw), F.asc(key)], within=[stratum], name="rn").join(n, stratum)
    split = F.when(F.col("n") < rare, "train").when(F.col("rn") <= F.round(F.col("n") * train), "train").when(F.col("rn") <= F.round(F.col("n") * (train + val)), "val").otherwise("test")
    return r.withColumn("split", split)


def group_split(ids: DataFrame, key: str, train: float, folds: int, seed: int) -> DataFrame:
    """(key, split, fold) of distinct ids by the rank of their hash."""
    ranked = global_rank(ids.withColumn("__h", hash_draw(F.col(key).cast("long"), seed)), [F.asc("__h"), F.asc(key)], name="rn")
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(F.broadcast(n)).select(key, F.when(F.col("rn") <= F.round(F.col("n") * train), "train").otherwise("test").alias("split"), ((F.col("rn") - 1) % folds).alias("fold"))


def anchor_folds(releases: DataFrame, key: str, anchor: str, folds: int, seed: int) -> DataFrame:
    """(key, quartile, fold) of distinct releases: folds are even inside each quartile of the anchor. A null anchor counts as 0."""
    rows = releases.select(key, F.coalesce(F.col(anchor), F.lit(0.0)).cast("double").alias("__a"))
    cuts = quantiles(rows, F.col("__a"), {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    placed = rows.join(F.broadcast(cuts)).select(key, sum(((F.col("__a") >= F.col(q)).cast("int") for q in ("q1", "q2", "q3")), F.lit(0)).alias("quartile"), hash_draw(F.col(key).cast("long"), seed).alias("__h"))
    ranked = global_rank(placed, [F.asc("quartile"), F.asc("__h"), F.asc(key)], within=["quartile"], name="rn")
    return ranked.select(key, "quartile", ((F.col("rn") - 1) % folds).alias("fold"))
