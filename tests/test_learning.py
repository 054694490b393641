"""Learning pipelines: they fit, and give what they promise, on the smallest tables or on made-up separable data."""

import random

import pytest
from pyspark.sql import functions as F

from cratemill.operators import learning as L
from cratemill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = [(i, "ab"[i % 2], [rng.gauss(i % 2 * 3, 1), rng.gauss(0, 1)]) for i in range(200)]
    return spark.createDataFrame(rows, "id int, y string, x array<double>")


def test_head_separates(points):
    out = L.apply_head(L.fit_head(points.where("id < 150"), "x", "y"), points.where("id >= 150"), "x")
    assert L.accuracy(out, "y", "predicted") > 0.85
    assert L.choose_reg(points.where("id < 100"), points.where("id between 100 and 150"), "x", "y", [0.01, 10.0]) in (0.01, 10.0)


def test_isotonic_sums_to_one(points):
    out = L.apply_head(L.fit_head(points, "x", "y"), points, "x").withColumn("p", F.slice("probabilities", 1, 2))
    total = L.isotonic(out.select("id", "y", "p"), ["a", "b"], "y").select(F.aggregate("calibrated", F.lit(0.0), lambda a, v: a + v).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)


def test_label_audit_follows_its_rule(points):
    """Thresholds are mean self-confidences; an issue is a larger class among those that reach theirs."""
    wrong = points.withColumn("given", F.when(F.col("id") % 25 == 0, F.when(F.col("y") == "a", "b").otherwise("a")).otherwise(F.col("y")))
    out = L.apply_head(L.fit_head(wrong, "x", "given"), wrong, "x").withColumn("p", F.slice("probabilities", 1, 2))
    rows = L.label_audit(out.select("id", "given", "p"), ["a", "b"], "given", "p").collect()
    least = {g: sum(r["p"]["ab".index(g)] for r in rows if r["given"] == g) / sum(r["given"] == g for r in rows) for g in "ab"}
    for r in rows:
        reach = [(p, g) for p, g in zip(r["p"], "ab") if p >= least[g]]
        assert r["is_issue"] == bool(reach and max(reach)[1] != r["given"])
    flipped, flagged = set(range(0, 200, 25)), {r["id"] for r in rows if r["is_issue"]}
    assert len(flipped & flagged) >= 4 and len(flagged - flipped) <= 10


@pytest.mark.parametrize("name", ["ML01", "ML04", "ML05", "ML06", "ML09", "ML12", "ML16", "UDF02"])
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_recommendations_leave_out_owned(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(20), rng.randrange(30)) for _ in range(200)}
    inter = spark.createDataFrame([(u, i, 1.0) for u, i in pairs], "user int, item int, strength double")
    top = L.als_top_n(L.train_als(inter, rank=4, iterations=2), inter.select("user").distinct(), 5, inter, 30).collect()
    assert not {(r["user"], r["item"]) for r in top} & pairs
    assert max(r["rank"] for r in top) <= 5


def test_every_user_gets_n_recommendations(spark):
    """Users who own far more than the margin get n items as well, or all that are left."""
    rng = random.Random(3)
    pairs = {(0, i) for i in range(60)} | {(1, i) for i in range(78)} | {(2, i) for i in range(15, 28)} | {(u, rng.randrange(80)) for u in range(3, 25) for _ in range(8)} | {(u, 58 + u) for u in range(3, 22)}
    inter = spark.createDataFrame([(u, i, 1.0) for u, i in pairs], "user int, item int, strength double")
    items = len({i for _, i in pairs})
    top = L.als_top_n(L.train_als(inter, rank=4, iterations=2), inter.select("user").distinct(), 5, inter, 2).collect()
    assert not {(r["user"], r["item"]) for r in top} & pairs
    for u in range(25):
        assert sorted(r["rank"] for r in top if r["user"] == u) == list(range(1, 1 + min(5, items - sum(x == u for x, _ in pairs))))


def test_out_of_fold_never_scores_what_it_saw(points):
    """A row whose label is unlike all others of its kind cannot be learned by heart: its own label gets little probability."""
    odd = points.withColumn("given", F.when(F.col("id") == 7, "a").otherwise(F.col("y")))
    out = L.out_of_fold(odd, "x", "given", F.col("id") % 4, 4, 1e-6).collect()
    assert sorted(r["id"] for r in out) == list(range(200))
    assert all(r["labels"] == ["a", "b"] and sum(r["probabilities"]) == pytest.approx(1) for r in out)
    assert sum(r["predicted"] == r["given"] for r in out) > 170
    rare = points.withColumn("given", F.when(F.col("id") == 7, "c").otherwise(F.col("y")))
    row = next(r for r in L.out_of_fold(rare, "x", "given", F.col("id") % 4, 4, 0.1).collect() if r["id"] == 7)
    assert row["labels"] == ["a", "b", "c"] and row["probabilities"][2] == 0.0


def test_probability_steps(spark):
    from cratemill.operators import classify as K

    df = spark.createDataFrame([([0.5, 0.3, 0.2], "none"), ([0.5, 0.3, 0.2], "strong")], "p array<double>, s string")
    names = ["Mint", "Near Mint", "Poor"]
    prior = [r[0] for r in df.select(K.evidence_prior(F.col("p"), F.col("s"), names, ("Near Mint",), 0.4, 0.2)).collect()]
    assert prior[0] == pytest.approx([0.3, 0.58, 0.12]) and prior[1] == pytest.approx([0.5, 0.3, 0.2])
    blended = df.select(K.band_blend(F.col("p"), F.array(F.lit(0.9), F.lit(0.1)), [0, 0, 1], 0.5)).first()[0]
    assert blended == pytest.approx([0.7 / 1.45, 0.6 / 1.45, 0.15 / 1.45])
    band = lambda most: df.select(K.confidence_band(F.col("p"), names, names, most)).first()[0]
    assert band(0.25) == "Mint/Near Mint" and band(0.1) is None


def test_a_saved_champion_estimates_without_a_fit(spark, monkeypatch):
    """Prices follow their inputs; the interval covers about the share that was asked for; loading does not fit."""
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(10)), rng.gauss(0, 0.1)) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, x double, noise double").selectExpr("id", "x", "2.0D AS base", "x / 5 + noise AS z").cache()
    path = L.refit_champion(df, F.col("id") % 4 == 0, ["x"], "z", "base", "gbt", 10, 3)
    monkeypatch.setattr(L, "price_model", None)
    out = L.estimate(path, df.drop("z")).join(df.select("id", "z"), "id").withColumn("true", F.expm1(F.col("base") + F.col("z")))
    row = out.agg(F.avg((F.abs(F.log1p("price") - F.log1p("true")) < 0.3).cast("int")).alias("close"), F.avg(F.col("true").between(F.col("lo"), F.col("hi")).cast("int")).alias("inside"), F.min("lo").alias("least")).first()
    assert row["close"] > 0.97 and 0.7 < row["inside"] < 0.9 and row["least"] >= 0


def test_search_resumes_and_prefers_feasible_trials(spark, monkeypatch, tmp_path):
    """Trials are real fits over folds of releases; a second run fits none; an infeasible trial loses to a feasible one."""
    rng = random.Random(8)
    rows = [(i, f"r{i % 40}", float(i % 40 % 10), rng.gauss(0, 0.05)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, release_id string, x double, noise double").selectExpr("id", "release_id", "x", "3.0D AS base", "x / 4 + noise AS z")
    trials = [{"family": "gbt", "trees": 8, "depth": 3}, {"family": "forest", "trees": 1, "depth": 1}]
    seen, real = [], L.price_model
    monkeypatch.setattr(L, "price_model", lambda train, *a, **k: (seen.append({r["release_id"] for r in train.select("release_id").distinct().collect()}), real(train, *a, **k))[1])
    args = (F.pmod(F.xxhash64("release_id"), F.lit(2)), 2, ["x"], "z", "base", f"file://{tmp_path}/trials")
    got = {r["trial"]: r for r in L.search(df, trials, *args).collect()}
    assert len(seen) == 4 and not seen[0] & seen[1] and got["gbt-8-3"]["n"] == 400
    assert got["gbt-8-3"]["mdape"] < got["forest-1-1"]["mdape"]
    again = L.search(df, trials, *args)
    assert len(seen) == 4 and again.count() == 2
    limit = (got["gbt-8-3"]["wape"] + got["forest-1-1"]["wape"]) / 2
    assert L.champion(again, {"wape": limit}, 10.0, "mdape").first()["trial"] == "gbt-8-3"
    drawn = L.draw_trials(5, 1, (2, 4), (2, 3))
    assert drawn == L.draw_trials(5, 1, (2, 4), (2, 3)) and len({str(t) for t in drawn}) == 5


def test_price_families_end_in_a_champion(spark):
    """The family with the least error is refitted and prices every row with an interval that holds most true prices."""
    rows = {r["family"]: r for r in registry.queries()["ML12"](spark, SF).collect()}
    assert rows.keys() == set(L.FAMILIES)
    best = min(rows.values(), key=lambda r: (r["mae"], r["family"]))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert best["champion"] and best["priced"] == lines and 0.7 < best["inside"] <= 1.0 and best["width"] > 0
    assert all(not r["champion"] and r["priced"] is None for r in rows.values() if r["family"] != best["family"])


def test_best_family(spark):
    tried = spark.createDataFrame([("a", None), ("c", 2.0), ("b", 2.0), ("d", 3.0)], "family string, mae double")
    assert L.best_family(tried, "mae") == "b"
