"""Classification metrics and samples from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by..., truth, pred, n): everything below works on these few rows."""
    return df.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(cm: DataFrame) -> DataFrame:
    """Per class precision, recall, f1 and support (0 where undefined), with accuracy and macro_f1 over classes of truth or prediction."""
    sides = cm.select(F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    per = sides.select("x.*", "hit").groupBy("cls").agg(F.sum("t").alias("support"), F.sum("p").alias("pp"), (F.sum("hit") / 2).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("pp")), "recall": ratio(F.col("tp"), F.col("support"))})
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    total = per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    return per.join(F.broadcast(total)).select("cls", "precision", "recall", "f1", "support", "accuracy", "macro_f1")


def reliability(df: DataFrame, truth: str, pred: str, confidence: str, bins: int) -> DataFrame:
    """Bins [lo, hi) of confidence with mean confidence and accuracy; a confidence of 1 falls in no bin."""
    rows = df.where(F.col(confidence) < 1.0).withColumn("bin", F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("acc"))


def ece(df: DataFrame, truth: str, pred: str, confidence: str, bins: int) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("total"))
    r = reliability(df, truth, pred, confidence, bins).join(F.broadcast(total))
    return r.agg((F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("n")) / F.max("total")).alias("ece"))


def label_space(df: DataFrame, columns: list[str]) -> DataFrame:
    out = df.select(F.col(columns[0]).alias("cls")).distinct()
    for c in columns[1:]:
        out = out.union(df.select(F.col(c).alias("cls")).distinct())
    return out.distinct()


def override_audit(df: DataFrame, truth: str, model: str, rule: str, by: str) -> DataFrame:
    """Overrides of a model by rules: helpful if the rule is right, harmful if the model was, else neutral."""
    t, m, r = F.col(truth), F.col(model), F.col(rule)
    over = m != r
    return df.groupBy(by).agg(F.count_if(over).alias("overrides"), F.count_if(over & (r == t)).alias("helpful"), F.count_if(over & (m == t)).alias("harmful"), F.count_if(over & (m != t) & (r != t)).alias("neutral"))


def breakdown(cm: DataFrame) -> DataFrame:
    """Confusion counts with their share of the true and of the predicted class."""
    share = lambda k: F.col("n") / F.sum("n").over(Window.partitionBy(k))
    return cm.withColumns({"of_true": share("truth"), "of_predicted": share("pred")})


def distribution(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """(target, label, n) over label columns; nulls do not count."""
    pairs = F.array(*(F.struct(F.lit(t).alias("target"), F.col(c).alias("label")) for t, c in targets.items()))
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("label is not null").groupBy("target", "label").agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def hash_draw(key: Column, seed: int) -> Column:
    """A repeatable pseudo-random number of a numeric key."""
    return F.abs((key * 7919 + seed) % 2147483647)


def stratified_sample(df: DataFrame, stratum: str, key: str, per: int, n: int, seed: int) -> DataFrame:
    """n keys: `per` of every stratum first (round by round), then whatever comes next by hash."""
    drawn = df.select(key, stratum, hash_draw(F.col(key), seed).alias("h"))
    first = drawn.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy("h", key))).where(F.col("rn") <= per)
    rest = drawn.join(first.select(key), key, "left_anti").orderBy("h", key).limit(n)
    both = first.select(key, F.lit(0).alias("part"), F.col("rn").cast("long").alias("o")).unionByName(rest.select(key, F.lit(1).alias("part"), F.col("h").alias("o")))
    return both.orderBy("part", "o", key).limit(n).select(key)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits."""
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _normal(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    return F.transform(p, lambda x: F.when(total == 0, x).otherwise(x / total))


def evidence_prior(p: Column, strength: Column, classes: list[str], careful: tuple[str, ...], none: float, weak: float) -> Column:
    """Probabilities mixed with an even prior over the careful classes, the more the less a note says (none, weak, strong)."""
    share = sum(k in careful for k in classes)
    if not share:
        return p
    a = F.when(F.lower(strength) == "none", none).when(F.lower(strength) == "weak", weak).otherwise(0.0)
    prior = F.array(*(F.lit(1 / share if k in careful else 0.0) for k in classes))
    return _normal(F.zip_with(p, prior, lambda x, y: (1 - a) * x + a * y))


def band_blend(p: Column, band_p: Column, band_of: list[int], alpha: float) -> Column:
    """Probabilities of classes mixed with those of the bands that they lie in (band_of: place of each class's band in band_p)."""
    mapped = F.array(*(F.get(band_p, F.lit(b)) for b in band_of))
    return _normal(F.zip_with(p, mapped, lambda x, y: (1 - alpha) * x + alpha * y))


def best_class(p: Column, classes: list[str]) -> Column:
    return F.get(F.array(*(F.lit(k) for k in classes)), (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def confidence_band(p: Column, classes: list[str], order: list[str], most: float) -> Column:
    """"better/worse" if the two likeliest classes follow each other in the order and differ by `most` or less, else null."""
    first = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    rest = F.transform(p, lambda x, i: F.when(i == first, -1.0).otherwise(x))
    second = (F.array_position(rest, F.array_max(rest)) - 1).cast("int")
    rank = F.array(*(F.lit(order.index(k) if k in order else None).cast("int") for k in classes))
    a, b = F.get(rank, first), F.get(rank, second)
    names = F.array(*(F.lit(k) for k in order))
    close = (F.array_max(p) - F.array_max(rest) <= most) & (F.abs(a - b) == 1)
    return F.when(close, F.concat(F.get(names, F.least(a, b)), F.lit("/"), F.get(names, F.greatest(a, b))))
