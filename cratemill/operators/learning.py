"""Distributed learning pipelines: factor models, content scores, text features, heads, price models."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratemill.operators.prices import metrics
from cratemill.operators.ranking import global_rank, quantiles
from cratemill.operators.store import load_bundle, save_bundle
from cratemill.streaming.incremental import shared_path


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """(column, index) of the distinct values, 0, 1, ... in order; numbered without a single-task sort."""
    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    return global_rank(ids, [F.asc(column)], name="rn").select(column, (F.col("rn") - 1).cast("int").alias("index"))


#: Interactions of a block of the factor model: a task sorts one block in memory.
ALS_BLOCK = 4_000_000


def train_als(inter: DataFrame, rank: int = 16, iterations: int = 5, regularization: float = 0.05, alpha: float = 10.0, seed: int = 7):
    """Implicit-feedback factors; the confidence of an interaction is alpha times its strength. inter: user, item (int), strength."""
    blocks = max(10, -(-inter.count() // ALS_BLOCK))  # 10 is Spark's own number
    return ALS(rank=rank, maxIter=iterations, numUserBlocks=blocks, numItemBlocks=blocks, regParam=regularization, alpha=alpha, implicitPrefs=True, userCol="user", itemCol="item", ratingCol="strength", seed=seed, coldStartStrategy="drop").fit(inter)


def als_top_n(model, users: DataFrame, n: int, owned: DataFrame, margin: int) -> DataFrame:
    """(user, item, score, rank) of the n best items not owned; fewer only where a user has fewer such items with factors.

    The model gives n + k items or more to a user who owns k, then owned ones go. Users are asked for by size class of k (up to
    margin, twice it, four times, ...; margin is 1 at least), so a hot user is one small request and answers grow with the owned rows only.
    """
    held = owned.select("user", "item").distinct().groupBy("user").agg(F.count(F.lit(1)).alias("k"))
    over = F.floor((F.coalesce("k", F.lit(0)) - 1) / margin)
    sized = users.join(held, "user", "left").select("user", F.when(over > 0, F.length(F.bin(over))).otherwise(0).alias("class")).checkpoint()  # read again for every class
    items = model.itemFactors.count()
    asked = {r["class"]: min(n + (margin << r["class"]), items) for r in sized.select("class").distinct().collect()} or {0: n}
    recs = reduce(DataFrame.unionByName, (model.recommendForUserSubset(sized.where(F.col("class") == k).select("user"), asked[k]).select("user", "recommendations") for k in sorted(asked)))
    recs = recs.select("user", F.explode("recommendations").alias("r")).select("user", "r.item", F.col("r.rating").cast("double").alias("score"))
    free = recs.join(owned.select("user", "item"), ["user", "item"], "left_anti")
    return free.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= n)


def album_features(albums: DataFrame, top_k: int) -> DataFrame:
    """(album_id, features array): scaled year and rating, flags of the commonest genres. dense_ids gives the artist's index."""
    genres = F.filter(F.transform(F.split("genre", ","), lambda g: F.lower(F.trim(g))), lambda g: g != "")
    g = albums.withColumn("genres", genres)
    top = g.select(F.explode("genres").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g").limit(top_k)
    listed = top.agg(F.array_sort(F.collect_list("g")).alias("top"))
    span = albums.where("year > 0").agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    rates = albums.agg(F.min("avg_rating").alias("r0"), F.max("avg_rating").alias("r1"))
    scaled = lambda x, lo, hi: F.coalesce(F.when(F.col(hi) > F.col(lo), (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))), F.lit(0.0))
    j = g.join(F.broadcast(listed)).join(F.broadcast(span)).join(F.broadcast(rates))
    year = F.when(F.col("year") > 0, scaled("year", "y0", "y1")).otherwise(0.0)
    flags = F.transform("top", lambda t: F.array_contains("genres", t).cast("double"))
    return j.select("album_id", F.concat(F.array(year, scaled("avg_rating", "r0", "r1")), flags).alias("features"))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_vectors(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, mean array): the mean of arrays by key, as sums by place."""
    at = rows.select(key, F.posexplode(column).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def content_scores(features: DataFrame, owned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user_id, album_id, score): the mean cosine similarity of an item to the user's items.

    The mean of cosines is the dot product with the mean of the user's unit vectors, so no item x item matrix is made.
    """
    u = features.select("album_id", unit(F.col("features")).alias("unit"))
    mean = mean_vectors(owned.join(u, "album_id"), "user_id", "unit")
    return pairs.join(u, "album_id").join(mean, "user_id").select("user_id", "album_id", dot(F.col("unit"), F.col("mean")).alias("score"))


def top_terms(weights: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(cls, term, weight): the k terms with the largest mean weight of each class. weights: cls, term, weight; docs: doc_id, cls.

    The mean is over all documents of the class, with zero where a term is missing.
    """
    size = docs.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    sums = weights.groupBy("cls", "term").agg(F.sum("weight").alias("w")).join(size, "cls")
    mean = sums.select("cls", "term", F.round(F.col("w") / F.col("n"), 6).alias("weight"))
    return mean.withColumn("rn", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("weight"), "term"))).where(F.col("rn") <= k).drop("rn")


def out_of_fold(df: DataFrame, features: str, label: str, fold: Column, k: int, reg: float, iterations: int = 30) -> DataFrame:
    """df with predicted and probabilities of a head that was fitted on the other folds, and the labels in the order of probabilities.

    fold: 0 to k - 1. k distributed fits; no row is scored by a head that saw it. A label that a fit did not see has probability zero.
    """
    labels = [r[label] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]  # the classes
    out = None
    for i in range(k):
        model = fit_head(df.where(fold != i), features, label, reg, iterations)
        scored = apply_head(model, df.where(fold == i), features)
        known = model.stages[0].labels
        by_name = F.map_from_arrays(F.array(*(F.lit(x) for x in known)), F.slice("probabilities", 1, len(known)))
        scored = scored.withColumn("probabilities", F.array(*(F.coalesce(F.try_element_at(by_name, F.lit(x)), F.lit(0.0)) for x in labels)))
        out = scored if out is None else out.unionByName(scored)
    return out.withColumn("labels", F.array(*(F.lit(x) for x in labels)))


def fit_head(train: DataFrame, features: str, label: str, reg: float = 0.1, iterations: int = 30, weight: str | None = None):
    """A multinomial logistic head over an array column."""
    lr = LogisticRegression(featuresCol="__v", labelCol="__y", regParam=reg, maxIter=iterations, family="multinomial", probabilityCol="__p")
    if weight:
        lr = lr.setWeightCol(weight)
    index = StringIndexer(inputCol=label, outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, lr]).fit(train.withColumn("__v", array_to_vector(features)))


def apply_head(model, df: DataFrame, features: str) -> DataFrame:
    """df with predicted (label) and probabilities (array)."""
    labels = model.stages[0].labels
    rows = model.stages[1].transform(df.withColumn("__v", array_to_vector(features)))
    names = F.array(*(F.lit(x) for x in [*labels, "?"]))
    return rows.withColumns({"predicted": F.get(names, F.col("prediction").cast("int")), "probabilities": vector_to_array("__p")}).drop("__v", "__p", "rawPrediction", "prediction")


def choose_reg(train: DataFrame, val: DataFrame, features: str, label: str, grid: list[float]) -> float:
    """The penalty of the grid with the best macro-F1 on the validation rows; each fit is distributed."""
    from cratemill.operators.classify import class_metrics, confusion

    best = []
    for reg in grid:
        scored = apply_head(fit_head(train, features, label, reg), val, features)
        row = class_metrics(confusion(scored, label, "predicted")).agg(F.max("macro_f1").alias("f")).first()
        best.append((row["f"] or 0.0, -reg))
    return -max(best)[1]


def isotonic(df: DataFrame, classes: list[str], truth: str) -> DataFrame:
    """Probabilities calibrated class by class by isotonic regression, then made to sum to one. df: key columns, truth, p (array)."""
    out = df
    for i, name in enumerate(classes):
        x = F.get("p", F.lit(i))
        data = out.withColumns({"__f": x, "__l": (F.col(truth) == name).cast("double")})
        out = IsotonicRegression(featuresCol="__f", labelCol="__l", predictionCol=f"__c{i}").fit(data).transform(data).drop("__f", "__l")
    cal = F.array(*(F.greatest(F.col(f"__c{i}"), F.lit(1e-9)) for i in range(len(classes))))
    total = reduce(lambda a, b: a + b, (F.greatest(F.col(f"__c{i}"), F.lit(1e-9)) for i in range(len(classes))))
    return out.withColumn("calibrated", F.transform(cal, lambda v: v / total)).drop(*(f"__c{i}" for i in range(len(classes))))


def price_model(train: DataFrame, inputs: list[str], target: str, family: str = "gbt", seed: int = 7, trees: int = 20, depth: int = 5):
    """A residual regressor: gradient-boosted trees or a random forest."""
    assemble = VectorAssembler(inputCols=inputs, outputCol="__v", handleInvalid="keep")
    cls = {"gbt": lambda: GBTRegressor(featuresCol="__v", labelCol=target, maxIter=trees, maxDepth=depth, seed=seed), "forest": lambda: RandomForestRegressor(featuresCol="__v", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)}
    return Pipeline(stages=[assemble, cls[family]()]).fit(train)


#: Families that price_model fits.
FAMILIES = ("gbt", "forest")


def best_family(tried: DataFrame, goal: str) -> str:
    """The family of tried (family, ...) with the least goal, by name where equal."""
    return tried.orderBy(F.asc_nulls_last(goal), "family").first()["family"]


def interval_report(estimates: DataFrame, truth: Column) -> DataFrame:
    """One row of estimates (price, lo, hi): how many there are, the share of true values inside, and the mean width of intervals."""
    inside = truth.between(F.col("lo"), F.col("hi"))
    return estimates.agg(F.count(F.lit(1)).alias("priced"), F.avg(inside.cast("int")).alias("inside"), F.avg(F.col("hi") - F.col("lo")).alias("width"))


def refit_champion(rows: DataFrame, test: Column, inputs: list[str], target: str, base: str, family: str, trees: int, depth: int, cover: float = 0.8, path: str | None = None) -> str:
    """Fit on the rows that are not test, take the half width that covers `cover` of the test rows' errors, fit again on all rows, save; the path.

    target is what the model predicts, as a residual over the column base; errors are those of base + prediction. The half width is an
    exact quantile of the test rows.
    """
    first = price_model(rows.where(~test), inputs, target, family, trees=trees, depth=depth)
    errors = first.transform(rows.where(test)).select(F.abs(F.col(target) - F.col("prediction")).alias("e"))
    half = quantiles(errors, F.col("e"), {"half": cover}).first()
    final = price_model(rows, inputs, target, family, trees=trees, depth=depth)
    spark = rows.sparkSession
    facts = {"family": family, "inputs": inputs, "base": base, "half": half["half"] if half and half["half"] is not None else 0.0, "cover": cover}
    return save_bundle(spark, path or shared_path(spark, "price-champion"), {"model": final}, facts)


def estimate(path: str, rows: DataFrame) -> DataFrame:
    """rows with price, lo and hi from a saved champion: a batch job that fits nothing. Logs become prices; lo is 0 at least."""
    models, facts = load_bundle(rows.sparkSession, path)
    y = F.col("prediction") + F.col(facts["base"])
    half = F.lit(float(facts["half"]))
    out = models["model"].transform(rows).withColumns({"price": F.expm1(y), "lo": F.greatest(F.lit(0.0), F.expm1(y - half)), "hi": F.expm1(y + half)})
    return out.drop("prediction", "__v")


def champion(trials: DataFrame, limits: dict[str, float], penalty: float, goal: str) -> DataFrame:
    """The best trial: feasible ones first, then the goal plus a penalty for every limit broken, then the id."""
    over = reduce(lambda a, b: a + b, (F.greatest(F.col(k) - v, F.lit(0.0)) for k, v in limits.items()))
    return trials.withColumns({"excess": over, "objective": F.col(goal) + penalty * over}).orderBy((F.col("excess") > 0).cast("int"), "objective", "trial").limit(1)


def draw_trials(n: int, seed: int, trees: tuple[int, int], depth: tuple[int, int], families: tuple[str, ...] = ("gbt", "forest")) -> list[dict]:
    """n different settings drawn by a seed (fewer if there are not so many); trees and depth are bounds, both included."""
    rng, seen = random.Random(seed), []
    for _ in range(20 * n):
        one = {"family": rng.choice(families), "trees": rng.randint(*trees), "depth": rng.randint(*depth)}
        if one not in seen:
            seen.append(one)
        if len(seen) == n:
            break
    return seen


def search(rows: DataFrame, trials: list[dict], fold: Column, folds: int, inputs: list[str], target: str, base: str, path: str) -> DataFrame:
    """(trial, family, trees, depth, mae, wape, mdape, n): every trial fitted on all folds but one and measured on that one, all folds together.

    fold: 0 to folds - 1, the same for all rows of a release, so no release is on both sides. Each trial's line is written below path when it is
    done; a search that starts again fits only what has no line. target is predicted as a residual over the column base.
    """
    spark = rows.sparkSession
    held = rows.withColumn("__fold", fold).checkpoint()  # read again for every fit
    schema = "trial string, family string, trees int, depth int, mae double, wape double, mdape double, n long"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in trials:
        name = f"{t['family']}-{t['trees']}-{t['depth']}"
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if done.getFileSystem(conf).exists(done):
            continue
        scored = None
        for i in range(folds):
            model = price_model(held.where(F.col("__fold") != i), inputs, target, t["family"], trees=t["trees"], depth=t["depth"])
            part = model.transform(held.where(F.col("__fold") == i)).select((F.col(target) + F.col(base)).alias("y_true"), (F.col("prediction") + F.col(base)).alias("y_pred"))
            scored = part if scored is None else scored.unionByName(part)
        line = metrics(scored).select(F.lit(name).alias("trial"), F.lit(t["family"]).alias("family"), F.lit(t["trees"]).alias("trees"), F.lit(t["depth"]).alias("depth"), "mae", "wape", "mdape", F.col("n").cast("long").alias("n"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.schema(schema).parquet(*(f"{path}/{t['family']}-{t['trees']}-{t['depth']}" for t in trials))


def label_audit(df: DataFrame, classes: list[str], label: str, probs: str) -> DataFrame:
    """Confident learning (Northcutt et al., 2021): self-confidence, the class most likely meant, and an issue flag.

    A row is an issue if another class's probability reaches that class's threshold (its mean self-confidence) and is the
    largest such. Rows are ranked by self-confidence.
    """
    idx = F.array_position(F.array(*(F.lit(x) for x in classes)), F.col(label))
    own = F.when(idx > 0, F.element_at(F.col(probs), idx.cast("int")))
    rows = df.withColumn("self_confidence", own)
    means = rows.groupBy(label).agg(F.avg("self_confidence").alias("m"))
    table = means.agg(F.map_from_entries(F.collect_list(F.struct(label, "m"))).alias("__t"))
    cand = F.filter(F.transform(F.sequence(F.lit(1), F.lit(len(classes))), lambda i: F.struct(F.element_at(F.col(probs), i).alias("p"), F.element_at(F.array(*(F.lit(x) for x in classes)), i).alias("c"))), lambda s: s["p"] >= F.coalesce(F.try_element_at("__t", s["c"]), F.lit(1.1)))
    meant = F.array_max(cand)["c"]
    return rows.join(F.broadcast(table)).withColumn("meant", meant).withColumn("is_issue", F.coalesce(F.col("meant") != F.col(label), F.lit(False))).drop("__t")


def accuracy(df: DataFrame, label: str, predicted: str) -> float:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("a")).first()["a"]


