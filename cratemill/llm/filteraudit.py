"""What each of several filters removes, for every order in which they can be applied.

A document is a mask of the filters that it fails; only the numbers of documents per part and mask matter. Orders are numbered by
their Lehmer rank (their place among all orders, sorted). The orders in which a mask falls at one step form intervals of ranks: those
that begin with filters it passes, followed by one that it fails. So each mask adds its count where an interval begins and takes
it away where the interval ends; a running sum over the ranks gives what every order removes at that step.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: k filters have k! orders; each part gets k * k! result rows.
MOST_FILTERS = 7


def lehmer_rank(prefix: tuple[int, ...], k: int) -> int:
    """Rank of the first order of 0 to k - 1 that begins with prefix; those that begin so are the next (k - len(prefix))!."""
    return sum(sum(x < p and x not in prefix[:i] for x in range(k)) * factorial(k - 1 - i) for i, p in enumerate(prefix))


def intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, begin, end): the ranks begin to end - 1 are the orders that remove the mask at the step; neighbours are merged."""
    out = []
    for mask in range(1, 1 << k):
        inside, outside = ([i for i in range(k) if (mask >> i & 1) == bit] for bit in (1, 0))
        for step in range(1, len(outside) + 2):
            size = factorial(k - step)
            merged: list[list[int]] = []
            for begin in sorted(lehmer_rank((*head, last), k) for head in permutations(outside, step - 1) for last in inside):
                if merged and merged[-1][1] == begin:
                    merged[-1][1] += size
                else:
                    merged.append([begin, begin + size])
            out += [(mask, step, a, b) for a, b in merged]
    return out


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text: few words (A), repetitive (B), many capitals (C), signs (D).

    Words stand between ASCII white space and differ by case.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    size = F.size(words)
    return {
        "A": size < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * size,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, filters=text_filters) -> tuple[DataFrame, str]:
    """((part, mask, n, good, toxic), letters): documents by part and mask of the failed filters; the last letter stands for repeated texts.

    Rows are joined with their labels by doc_id, then counted by text (its SHA-256), part and labels, so a text that a third of all rows
    share is a few rows before its smallest doc_id is looked for.
    """
    text = F.coalesce("text", F.lit(""))
    failing = filters(text)
    letters = "".join(failing)
    last = chr(ord(max(letters)) + 1)
    bits = sum((F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(failing.values())), F.lit(0))
    rows = common.pick(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.cast("int").alias("bits"))
    marks = common.pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = rows.join(marks, F.col("doc_id") == F.col("labelled"), "left").drop("labelled").na.fill(0, ["good", "toxic"])
    kinds = ["digest", "part", "bits", "good", "toxic"]
    # rows of one id lie together after the join; then copies are summed up before they move
    by_id = joined.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by(F.when(known, F.col("n")), "doc_id").alias("n_least"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"))
    first = F.min("least").over(Window.partitionBy("digest"))
    passing = F.col("n_null") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("bits") + (1 << len(letters))).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("m")
    halves = by_text.withColumn("passing", F.coalesce(passing, F.lit(0))).select("part", "good", "toxic", split).where("m.n > 0")
    return halves.groupBy("part", "m.mask").agg(F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("good"), F.sum(F.col("m.n") * F.col("toxic")).alias("toxic")), letters + last


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs (doc_id, text, lang), labels (doc_id, quality, toxic); other columns are ignored. filters gives a failure condition for each letter,
    in order, from the text column; one more letter fails rows whose text is that of a row with a smaller doc_id, wherever that is.
    Null texts and langs are empty. A null doc_id is neither smaller nor larger than any, so such rows never fail the last filter and have no
    labels; rows that are alike in text and doc_id don't fail by one another. Of several labels of a document any 1 counts. No rows, no result.
    """
    counts, letters = masks(docs, labels, filters)
    k = len(letters)
    if k > MOST_FILTERS:
        raise ValueError(f"{k} filters have {factorial(k)} orders; at most {MOST_FILTERS} filters can be audited")
    counts = common.materialize(counts, "masks")  # 2**k rows for each part
    spark = counts.sparkSession
    ranges = spark.createDataFrame(intervals(k), "mask int, step int, begin int, end int")
    sums = ["n", "good", "toxic"]
    ends = F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign")))).alias("e")
    changes = counts.join(F.broadcast(ranges), "mask").select("part", "step", *sums, ends).groupBy("part", "step", "e.rank").agg(*(F.sum(F.col(c) * F.col("e.sign")).alias(c) for c in sums))

    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    whole = counts.groupBy("part").agg(F.sum("n").alias("documents"))
    grid = whole.select("part", "documents", F.posexplode(orders).alias("rank", "filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    grid = grid.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    along = Window.partitionBy("part", "step").orderBy("rank")
    lost = [F.sum(F.coalesce(c, F.lit(0))).over(along).alias(a) for c, a in zip(sums, ("removed", "good_lost", "toxic_lost"))]
    steps = grid.join(changes, ["part", "step", "rank"], "left").select("part", "filter_order", "rank", "step", "letter", "documents", *lost)

    of_mask = F.explode(F.array(*(F.struct(F.lit(x).alias("letter"), F.lit(1 << i).alias("bit")) for i, x in enumerate(letters)))).alias("f")
    fails = counts.select("part", "mask", "n", of_mask).groupBy("part", "f.letter").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("f.bit")) > 0, F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("mask") == F.col("f.bit"), F.col("n")).otherwise(0)).alias("unique_fails")
    )
    kept = F.col("documents") - F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step"))
    out = steps.join(fails, ["part", "letter"]).withColumns({"kept": kept, "redundant": F.col("fails") - F.col("removed"), "shapley": F.sum("removed").over(Window.partitionBy("part", "letter"))})
    numbers = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *(F.col(c).cast("long").alias(c) for c in numbers))


ORACLE = """
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM words LEFT JOIN marks USING (doc_id)),
sets AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) s),
r AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN len(failed) = len(translate(failed, before || x, '')) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, x) AND failed = translate(failed, before, '') THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, x) AND failed <> translate(failed, before, '') THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, x) AND failed = translate(failed, before, '') THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, x) AND failed = translate(failed, before, '') THEN toxic ELSE 0 END) AS toxic_lost
  FROM sets, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM r
"""
