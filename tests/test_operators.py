"""Operators whose rules are sequential, against plain walks; worked examples of text and money functions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cratemill.functions import catalogue as C
from cratemill.functions import money, notes
from cratemill.operators import catalogue, drift, merges, prices, ranking, recommend, review
from cratemill.sources import connectors


def test_global_rank_is_a_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = {r["id"]: (r["whole"], r["part"]) for r in ranking.global_rank(ranking.global_rank(df, [F.col("v"), F.col("id")], name="whole"), [F.col("k"), F.col("v"), F.col("id")], within=["k"], name="part", partitions=7).collect()}
    whole = {i: n for n, (_, i) in enumerate(sorted((v, i) for _, v, i in rows), 1)}
    part = {}
    for k in "abc":
        part |= {i: n for n, (_, i) in enumerate(sorted((v, i) for q, v, i in rows if q == k), 1)}
    assert got == {i: (whole[i], part[i]) for i in whole}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_match(spark, seed):
    rng = random.Random(seed)
    artists, titles = ["ann", "bob & co"], ["red moon", "red moons", "blue sea", "blue see", "old road", "the old road"]
    albums = [(f"a{i}", i, rng.choice(artists).upper(), rng.choice(titles), rng.choice([0, 1990, 1991, 1995])) for i in range(14)]
    masters = [(f"m{i}", i, rng.choice(artists), rng.choice(titles), rng.choice([0, 1990, 1991, 1994])) for i in range(14)]
    got = {r["master_id"]: r["album_id"] for r in recommend.match(spark.createDataFrame(albums, "album_id string, album_no int, artist string, title string, year int"), spark.createDataFrame(masters, "master_id string, master_no int, artist string, title string, year int"), 0.8).collect()}
    want, used = {}, set()
    key = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    for aid, _, artist, title, year in albums:
        near = [(m, no, key(t)) for m, no, ar, t, y in masters if key(ar) == key(artist) and m not in used and (y <= 0 or (year > 0 and abs(y - year) <= 1))]
        exact = sorted((no, m) for m, no, t in near if t == key(title))
        fuzzy = sorted((-SequenceMatcher(None, key(title), t).ratio(), m) for m, _, t in near)
        pick = exact[0][1] if exact else fuzzy[0][1] if fuzzy and -fuzzy[0][0] >= 0.8 else None
        if pick:
            used.add(pick)
            want[pick] = aid
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_quota_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"r{i}", rng.choice("abcdef"), int(rng.random() < 0.6)) for i in range(1, 60)]
    places, cap, share = rng.choice([5, 20, 40]), rng.choice([1, 3, 9]), rng.choice([0.0, 0.5, 0.8, 1.0])
    got = catalogue.quota_block(spark.createDataFrame(rows, "ord int, release_id string, aid string, vinyl int"), places, cap, share).collect()
    quota = {True: round(places * share)}
    quota[False] = places - quota[True]
    taken, of = [], {}
    for _, rid, aid, v in rows:
        if quota[v > 0] > 0 and of.get(aid, 0) < cap:
            quota[v > 0] -= 1
            of[aid] = of.get(aid, 0) + 1
            taken.append(rid)
    assert {r["release_id"] for r in got if r["taken_in"] == 1} == set(taken)
    rest = [r[1] for r in rows if r[1] not in taken][: places - len(taken)]
    assert {r["release_id"] for r in got if r["taken_in"] == 2} == set(rest)


@pytest.mark.parametrize("seed", range(5))
def test_cross_source_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["p", "x", "y"]), rng.choice(["A", "a ", "B", None]), "t") for i in range(40)]
    got = {r["i"] for r in merges.cross_source(spark.createDataFrame(rows, "i int, source string, artist string, title string"), "p", "i").collect()}
    last, want = {}, set()
    for i, s, a, t in rows:
        if a is None:
            want.add(i)
            continue
        k = a.lower().strip()
        if s == "p" or last.get(k, s) == s:
            want.add(i)
            last[k] = s
    assert got == want


def test_water_fill(spark):
    rng = random.Random(3)
    rows = [("s", rng.choice("aabc"), i, rng.random()) for i in range(60)]
    got = review.water_fill(spark.createDataFrame(rows, "o string, i string, id int, h double"), ["o"], ["i"], 10, 21, "h", "id").collect()
    n = {k: sum(r["i"] == k for r in got) for k in "abc"}
    have = {k: min(10, sum(r[1] == k for r in rows)) for k in "abc"}
    assert sum(n.values()) == 21 and all(n[k] in (7, have[k]) or n[k] >= 7 for k in n)


def test_newest_values_for_three_sources(spark):
    rows = [("k", 1, 5.0, "{}", 1), ("k", 2, None, '{"a":1}', 2), ("k", 3, 7.0, None, 3), ("k", 3, None, None, 4)]
    r = merges.newest_values(spark.createDataFrame(rows, "id string, t int, p double, l string, n int"), ["id"], "t", ["p", "l"], ["l"], "n").first()
    assert (r["t"], r["p"], r["l"]) == (3, 7.0, '{"a":1}')


def test_ks_matches_plain(spark):
    rng = random.Random(4)
    a, b = [rng.randrange(50) for _ in range(300)], [rng.randrange(45) + 3 for _ in range(200)]
    mk = lambda xs: spark.createDataFrame([(x,) for x in xs], "v int")
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})
    got = drift.ks(mk(a), mk(b), "v").first()
    assert got["statistic"] == pytest.approx(want)
    assert 0 <= drift.ks_p_value(got["statistic"], 300, 200) <= 1


def test_theil_sen_of_a_line(spark):
    rows = [("r", f"2001-{m:02d}-15", 2.718281828 ** (0.01 * d)) for m, d in zip(range(1, 7), (0, 31, 59, 90, 120, 151))]
    df = spark.createDataFrame(rows, "release_id string, d string, usd double").withColumn("order_date", F.to_timestamp("d"))
    r = prices.theil_sen(df).first()
    assert r["slope"] == pytest.approx(0.01, rel=1e-6) and r["bins"] == 6


@pytest.mark.parametrize(("text", "usd", "gbp", "eur"), [("$1,234.50", 1234.5, None, None), ("A$20", None, None, None), ("€12,34", None, None, 12.34), ("£1,100.00", None, 1100.0, None), (None, None, None, None), ("$0", None, None, None), ("about 5", None, None, None)])
def test_money(spark, text, usd, gbp, eur):
    r = spark.createDataFrame([(text,)], "t string").select(money.usd(F.col("t")).alias("u"), money.gbp(F.col("t")).alias("g"), money.eur(F.col("t")).alias("e")).first()
    assert tuple(r) == (usd, gbp, eur)


def test_conditions(spark):
    t = ["Near Mint (NM or M-)", "vg+", "VG++", "sealed mint copy", "", None, "No Cover", "xyz"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t string").orderBy("i").select(money.condition_ordinal(F.col("t"))).collect()]
    assert got[:3] == [7.0, 6.0, 8.0 if "m" in "vg++" else 6.0] and got[4:7] == [-1.0, -1.0, -2.0]


def test_formats(spark):
    rows = [(0, None, "Vinyl, LP, Album"), (1, '[{"name":"Vinyl","descriptions":["12\\""]}]', None), (2, "[]", "7 inch"), (3, "not json", "CD"), (4, '[{"name":"File"}]', "x"), (5, None, "Unofficial Release, LP")]
    df = spark.createDataFrame(rows, "i int, j string, d string").orderBy("i")
    j, d = F.col("j"), F.col("d")
    got = [tuple(r) for r in df.select(C.format_rank(j, d), C.not_digital(j, d), C.official(j, d)).collect()]
    assert got == [(4, True, True), (3, True, True), (1, True, True), (0, True, True), (0, False, True), (4, True, False)]


def test_rules(spark):
    rows = [(0, "Water damage on cover"), (1, "water damage free, light hairlines"), (2, "skips, surface noise"), (3, "skips"), (4, "generic sleeve")]
    df = spark.createDataFrame(rows, "i int, t string").orderBy("i")
    t = F.col("t")
    assert [tuple(r) for r in df.select(notes.hard_grade(t, "sleeve"), notes.hard_grade(t, "media")).collect()] == [("Poor", "Poor"), (None, None) if False else ("Poor", "Poor"), ("Poor", "Poor"), (None, None), ("Generic", None)]
    soft = [r[0] for r in df.select(notes.soft_grade(t, F.lit("Good"), F.lit(0.1))).collect()]
    assert soft[3] is None and soft[2] == "Good"


def test_cleaning(spark):
    df = spark.createDataFrame([("6 sealed **BUY NOW** VG+original [seam split] http://x.y/z",)], "t string")
    r = df.select(notes.clean(notes.seller_text(F.col("t"))).alias("c")).first()
    assert r["c"] == "sealed very good plus original [seam split]"


def test_canonical_needs_all_columns(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        connectors.canonical(spark.range(1).withColumnRenamed("id", "a"), ["a", "b"])


def test_gzip_xml(spark, tmp_path):
    import gzip

    path = tmp_path / "d.xml.gz"
    path.write_bytes(gzip.compress(b"<releases><release id='1' status='Accepted'><title>T</title><released>1999-01</released><genres><genre>Rock</genre></genres></release><release id='x'/><release id='2' status='Deleted'/></releases>"))
    rows = connectors.release_rows(connectors.read_xml(spark, str(path), "release", connectors.RELEASE_XML)).collect()
    assert [(r["release_id"], r["genre"], r["year"], r["decade"]) for r in rows] == [("1", "Rock", 1999, 1990)]


def test_match_of_many_equal_titles(spark):
    """Three hundred albums and masters of one title: the k-th album gets the k-th master, and rounds are few."""
    albums = spark.createDataFrame([(f"a{i}", i, "ann", "untitled", 0) for i in range(300)], "album_id string, album_no int, artist string, title string, year int")
    masters = spark.createDataFrame([(f"m{i}", i, "Ann", "Untitled", 0) for i in range(280)], "master_id string, master_no int, artist string, title string, year int")
    got = {r["album_id"]: r["master_id"] for r in recommend.match(albums, masters).collect()}
    assert got == {f"a{i}": f"m{i}" for i in range(280)}


@pytest.mark.parametrize("name", ["SRC10", "SRC11"])
def test_dumps_are_read_by_several_tasks(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_xml_files_have_bounded_rows(spark, tmp_path):
    path = str(tmp_path / "x")
    connectors.write_xml(spark.range(100).select(F.col("id").alias("_id")), path, "release", "releases", rows_per_file=7)
    files = [p.read_text().count("<release ") for p in (tmp_path / "x").glob("part-*")]
    assert max(files) <= 7 and sum(files) == 100


def test_listing_rows_work_each_pattern_once(spark):
    from cratemill.sources import html

    row = '<tr><td class="item_description"><strong><a href="/sell/item/{}">{}</a></strong><p class="item_condition">Media: NM<br>Sleeve: VG</p><p>{}</p></td></tr>'
    page = "<table>" + row.format(1, "A - B", "first") + row.format(2, "C", "x &amp; y") + row.format(1, "Later - D", "again") + "</table>"
    out = html.listing_rows(spark.createDataFrame([(7, page)], "page_id int, html string"))
    got = sorted(tuple(r) for r in out.select("page_id", "listing_id", "artist", "title", "media", "sleeve", "comments").collect())
    assert got == [(7, "1", "A", "B", "NM", "VG", "first"), (7, "2", "", "C", "NM", "VG", "x & y")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in ("item_description", "strong\\b", "(?is)<p\\b")] == [1, 1, 1]


def test_match_of_a_chain_takes_few_jobs(spark):
    """Every album wants the master that the one before it gets, so refusals follow one another; the number of jobs doesn't follow them."""
    n = 40
    albums = spark.createDataFrame([(f"a{i}", i, "ann", "untitled", 1900 + i) for i in range(n)], "album_id string, album_no int, artist string, title string, year int")
    masters = spark.createDataFrame([(f"m{i}", i, "Ann", "Untitled", 1900 + i) for i in range(n)], "master_id string, master_no int, artist string, title string, year int")
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = {r["album_id"]: r["master_id"] for r in recommend.match(albums, masters).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {f"a{i}": f"m{i}" for i in range(n)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 60


def test_low_rated_takes_any_text(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "n/a"), ("b", "2"), ("b", "4"), ("c", "none")], "album_id string, rating string")
    assert [r["album_id"] for r in recommend.only_low_rated(df).collect()] == ["a"]


def test_quantiles_rank_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    parts, real = [], ranking.global_rank
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(ranking, "global_rank", lambda *a, **k: (parts.append(k["partitions"]), real(*a, **k))[1])
    assert ranking.quantiles(spark.range(1001), F.col("id"), {"m": 0.5}).first()["m"] == 500
    assert parts == [max(21, int(spark.conf.get("spark.sql.shuffle.partitions")))]


@pytest.mark.parametrize("seed", range(2))
def test_quantiles_are_exact(spark, seed):
    import numpy as np

    rng = random.Random(seed)
    rows = [(rng.choice("abc") if i % 5 else None, None if i % 11 == 0 else rng.choice([1.0, 2.5, 7.0, rng.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"lo": 0.0, "p10": 0.1, "mid": 0.5, "p95": 0.95, "hi": 1.0}
    got = {r["k"]: r for r in ranking.quantiles(df, F.col("v"), shares, ["k"]).collect()}
    for k in ("a", "b", "c", None):
        own = [v for q, v in rows if q == k and v is not None]
        assert [got[k][n] for n in shares] == pytest.approx(list(np.quantile(own, list(shares.values()))))
    whole = ranking.quantiles(df, F.col("v"), {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert [r["m"] for r in ranking.quantiles(df.limit(0), F.col("v"), {"m": 0.5}).collect()] == [None]


def test_rules_apply(spark):
    rows = [
        (0, "small seam split on top", "Near Mint", "Near Mint", 0.9), (1, "seam split and ring wear", "Near Mint", "Near Mint", 0.9), (2, "sealed, plays well, water damage", "Mint", "Mint", 0.1),
        (3, "deep scratch", "Good", "Good", 0.9), (4, "skips; surface noise", None, "Excellent", 0.9), (5, "nothing to say", "Excellent", "Very Good", 0.9), (6, "small seam split, seam split", "Very Good Plus", "Good", 0.5), (7, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, t string, s string, m string, c double")
    out = {r["i"]: r for r in notes.apply_rules(df, "t", {"sleeve": "s", "media": "m"}, {"sleeve": "c", "media": "c"}).collect()}
    finals = {i: (r["sleeve_final"], r["media_final"]) for i, r in out.items()}
    assert finals == {0: ("Very Good Plus", "Near Mint"), 1: ("Very Good", "Near Mint"), 2: ("Mint", "Mint"), 3: ("Poor", "Poor"), 4: ("Poor", "Poor"), 5: ("Near Mint", "Very Good"), 6: ("Very Good Plus", "Good"), 7: (None, None)}
    assert out[2]["contradiction"] and out[2]["overridden"] == [] and out[5]["collapsed"] == ["sleeve"]
    assert (out[3]["sleeve_tier"], out[3]["media_signal"], out[4]["media_tier"], out[4]["media_signal"]) == ("strict", "deep scratch", "cosignal", "skips")
    assert out[0]["sleeve_tier"] is None and out[0]["overridden"] == ["sleeve"]


def test_rules_from_a_table(spark):
    rows = [("Poor", "hard", "Poor", 0), ("Poor", "strict", "mouldy", 1), ("Poor", "strict", "broken", 0), ("Poor", "forbidden", "not broken", 0), ("Poor", "targets", "media", 0), ("Good", "soft", "Good", 0), ("Good", "supporting", "worn", 0), ("Good", "confidence", "0.7", 0), ("Good", "only_downgrade", "true", 0), (None, "pair", "new|worn", 0), (None, None, None, None)]
    rules = notes.rules_from_table(spark.createDataFrame(rows, "grade string, list string, value string, place int"))
    assert rules.hard == (notes.GradeRule("Poor", strict=("broken", "mouldy"), forbidden=("not broken",), targets=("media",)),)
    assert rules.soft == (notes.GradeRule("Good", supporting=("worn",), confidence=0.7, only_downgrade=True),)
    assert rules.pairs == (("new", "worn"),) and rules.order == notes.RULES.order
    df = spark.createDataFrame([("broken",), ("not broken",), ("New, but worn",)], "t string")
    assert [tuple(r) for r in df.select(notes.hard_grade(F.col("t"), "media", rules), notes.hard_grade(F.col("t"), "sleeve", rules), notes.contradiction(F.col("t"), rules)).collect()] == [("Poor", None, False), (None, None, False), (None, None, True)]


def test_pages_that_lack_something(spark):
    from cratemill.sources import html

    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<table><tr><th>Price</th></tr><tr><td>2001-01-01</td></tr></table>"), (4, "<TABLE><TR><TH>Order Date<TH>Condition<TH>Price<TR><TD>2001-01-01<TD>NM<TD>&pound;5<tr><td>thanks<!-- x --><tr><td>2001-02-30<td><b>VG</b>")], "page_id int, html string")
    got = [(r["page_id"], r["sale"], r["order_date"], r["media_condition"], r["sleeve_condition"], r["price_text"], r["comments"]) for r in html.sale_rows(pages).orderBy("sale").collect()]
    assert got == []  # a table that never ends is no table
    whole = pages.where("page_id = 4").withColumn("html", F.concat("html", F.lit("</TABLE>")))
    got = [(r["page_id"], r["sale"], r["order_date"], r["media_condition"], r["sleeve_condition"], r["price_text"], r["comments"]) for r in html.sale_rows(whole).orderBy("sale").collect()]
    assert got == [(4, 1, "2001-01-01", "NM", "", "£5", "thanks"), (4, 2, "2001-02-30", "VG", "", "", "")]
    assert html.listing_rows(pages).count() == 0 and html.linked_ids(pages).count() == 0
    assert [tuple(r)[1:] for r in html.sale_summary(pages).orderBy("page_id").collect()] == [(None,) * 5] * 4


def test_session_views_are_left_alone(spark):
    from cratemill.sources import views

    spark.range(3).createOrReplaceTempView("documents")
    assert views.view(spark, "/root/testdata/sf0.001", "notes").count() == 200
    assert spark.table("documents").count() == 3
    spark.catalog.dropTempView("documents")
