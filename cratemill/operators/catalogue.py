"""Catalogue ordering, sampling and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratemill.functions import catalogue as C
from cratemill.operators.ranking import global_rank


def with_counts(releases: DataFrame) -> DataFrame:
    """releases with mc, the eligible releases of the same master, and ac, those of the same first artist.

    Both counts are combined before their shuffle; null keys are told apart from counts.
    """
    keyed = releases.withColumn("aid", C.first_artist_id(F.col("artists_json")))
    eligible = keyed.where(C.queue_filter())
    mc = eligible.where(F.trim("master_id") != "").groupBy("master_id").agg(F.count(F.lit(1)).alias("mc"))
    ac = eligible.where(F.col("aid").isNotNull()).groupBy("aid").agg(F.count(F.lit(1)).alias("ac"))
    return keyed.join(mc, "master_id", "left").join(ac, "aid", "left")


def proxy_score(w_master: float, w_artist: float) -> Column:
    return F.lit(w_master) * F.coalesce("mc", F.lit(0)) + F.lit(w_artist) * F.coalesce("ac", F.lit(0))


def proxy_rows(releases: DataFrame, w_master: float = 1.0, w_artist: float = 0.5) -> DataFrame:
    """Eligible releases with score, vinyl rank and the columns that break ties."""
    rows = with_counts(releases).where(C.queue_filter())
    return rows.select("release_id", F.coalesce("aid", F.lit("")).alias("aid"), C.format_rank(F.col("formats_json"), F.col("format_desc")).alias("vinyl"), proxy_score(w_master, w_artist).alias("score"), "year", F.coalesce("label_tier", F.lit(0)).alias("tier"), "decade", "genre")


#: Best first: score, format, the newest year, the tier; the id makes it unique.
BEST = [F.desc, F.desc, F.desc_nulls_last, F.desc, F.asc]


def best_first() -> list[Column]:
    return [f(c) for f, c in zip(BEST, ("score", "vinyl", "year", "tier", "release_id"))]


def proxy_order(releases: DataFrame, **weights: float) -> DataFrame:
    """(ord, release_id, aid, vinyl): the global order, numbered without a single-task sort."""
    return global_rank(proxy_rows(releases, **weights), best_first(), name="ord").select("ord", "release_id", "aid", "vinyl")


def stratified(rows: DataFrame, strata: list[str], per_stratum: int, vinyl_share: float | None = None, per_artist: int | None = None) -> DataFrame:
    """release_id of the best `per_stratum` rows of every stratum.

    per_artist: at most so many of one artist (within the stratum, and within its half if split) compete. vinyl_share: the
    places are split into vinyl and other ones.
    """
    rows = rows.withColumn("is_vinyl", F.col("vinyl") > 0)
    keys = [*strata, "is_vinyl"] if vinyl_share is not None else strata
    if per_artist:
        rows = rows.withColumn("arn", F.row_number().over(Window.partitionBy(*keys, "aid").orderBy(*best_first()))).where(F.col("arn") <= per_artist)
    places = F.lit(per_stratum)
    if vinyl_share is not None:
        share = max(0, min(per_stratum, round(per_stratum * min(1.0, max(0.0, vinyl_share)))))
        places = F.when(F.col("is_vinyl"), share).otherwise(per_stratum - share)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first()))).where(F.col("rn") <= places).select("release_id")


def stratified_by_hash(rows: DataFrame, strata: list[str], per_stratum: int, seed: int) -> DataFrame:
    """A repeatable sample: by a hash of the numeric id."""
    draw = F.abs((F.col("release_id").cast("long") * 7919 + seed) % 2147483647)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*strata).orderBy(draw, "release_id"))).where(F.col("rn") <= per_stratum).select("release_id")


def quota_block(ordered: DataFrame, places: int, per_artist: int, vinyl_share: float, fill: bool = True) -> DataFrame:
    """release_id and taken_in (1 strict pass, 2 relaxed pass) of ordered rows (ord, release_id, aid, vinyl).

    Strict: the best rows of either class up to its quota, at most per_artist of an artist; a skipped row does not count for the
    artist. Relaxed: what is missing is filled in order, whatever artist and class. Ids are distinct.
    The walk over one class never needs more than `places` rows, so each step ends in a top-n.
    """
    vinyl_places = round(places * vinyl_share)
    kind = ordered.withColumn("is_vinyl", F.col("vinyl") > 0)
    # an artist's places are shared by both classes, so the cap is counted along the whole order up to where a class is full
    capped = kind.withColumn("arn", F.row_number().over(Window.partitionBy("aid").orderBy("ord"))).where(F.col("arn") <= per_artist)
    quota = {True: vinyl_places, False: places - vinyl_places}
    first = [capped.where(F.col("is_vinyl") == F.lit(v)).orderBy("ord").limit(n) for v, n in quota.items()]
    full_at = [d.agg(F.when(F.count(F.lit(1)) >= n, F.coalesce(F.max("ord"), F.lit(0))).alias("at")) for d, n in zip(first, quota.values())]
    ends = full_at[0].select(F.col("at").alias("v")).crossJoin(full_at[1].select(F.col("at").alias("n")))  # one row
    row = ends.first()
    known = [(row["v"], True), (row["n"], False)]
    known = sorted((at, v) for at, v in known if at is not None)
    if not known:
        strict = first[0].unionByName(first[1])
    else:
        at, is_v = known[0]
        head = capped.where(F.col("ord") <= at)
        used = head.groupBy("aid").agg(F.count(F.lit(1)).alias("used"))
        rest = kind.where((F.col("ord") > at) & (F.col("is_vinyl") != F.lit(is_v))).join(used, "aid", "left")
        rest = rest.withColumn("arn", F.row_number().over(Window.partitionBy("aid").orderBy("ord")) + F.coalesce("used", F.lit(0))).where(F.col("arn") <= per_artist)
        have = head.where(F.col("is_vinyl") != F.lit(is_v)).count()
        strict = head.drop("arn").unionByName(rest.select(*kind.columns).orderBy("ord").limit(max(0, quota[not is_v] - have)))
    strict = strict.select("release_id", F.lit(1).alias("taken_in"))
    if not fill:
        return strict
    missing = places - strict.count()
    more = ordered.join(strict.select("release_id"), "release_id", "left_anti").orderBy("ord").limit(max(0, missing)).select("release_id", F.lit(2).alias("taken_in"))
    return strict.unionByName(more)


def merge_lists(head: DataFrame, tail: DataFrame, most: int) -> DataFrame:
    """(release_id, pos) of an ordered union without repeats: the head list first, `most` ids in all. Inputs: release_id, ord."""
    both = head.select("release_id", F.lit(0).alias("part"), "ord").unionByName(tail.select("release_id", F.lit(1).alias("part"), "ord"))
    first = both.groupBy("release_id").agg(F.min(F.struct("part", "ord")).alias("at"))
    top = first.orderBy("at", "release_id").limit(most)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("at", "release_id"))).select("release_id", "pos")  # `most` rows


def tier_a(releases: DataFrame) -> DataFrame:
    """Per master: releases, vinyl releases, countries, labels, first and last year."""
    c = F.col
    label = F.get(F.from_json("labels_json", C.LABELS), F.lit(0))
    named = lambda x: F.nullif(F.trim(x), F.lit(""))
    return releases.where(F.trim("master_id") != "").groupBy("master_id").agg(
        F.count(F.lit(1)).alias("release_count"),
        F.sum(C.is_vinyl(c("formats_json"), c("format_desc"))).alias("vinyl_release_count"),
        F.count_distinct(named(c("country"))).alias("unique_country_count"),
        F.count_distinct(F.coalesce(named(label["id"]), named(label["name"]))).alias("unique_label_count"),
        F.min(F.when(c("year") > 0, c("year"))).alias("year_first"),
        F.max(F.when(c("year") > 0, c("year"))).alias("year_last"),
    )


def tier_b(releases: DataFrame, marketplace: DataFrame) -> DataFrame:
    """Per master: sums over its releases' marketplace rows, the lowest positive price, whether there is any row."""
    m = marketplace.select("release_id", "community_want", "community_have", "num_for_sale", "release_lowest_price", F.lit(1).alias("has_row"))
    total = lambda x: F.sum(F.coalesce(x, F.lit(0))).alias(x)
    return releases.where(F.trim("master_id") != "").select("release_id", "master_id").join(m, "release_id", "left").groupBy("master_id").agg(
        total("community_want"), total("community_have"), total("num_for_sale"),
        F.min(F.when(F.col("release_lowest_price") > 0, F.col("release_lowest_price"))).alias("lowest_price"),
        F.max(F.coalesce("has_row", F.lit(0))).alias("has_community_stats"),
    )


def era_span(first: Column, last: Column) -> Column:
    return F.coalesce(F.least(F.greatest(last - first, F.lit(0)), F.lit(80)), F.lit(0))


def master_stats(releases: DataFrame, marketplace: DataFrame, album_map: DataFrame) -> DataFrame:
    """Tier A with tier B where there is one, for masters that an album is mapped to (master_id, album_id)."""
    both = tier_a(releases).join(tier_b(releases, marketplace), "master_id", "left").join(album_map, "master_id")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("community_want", "community_have", "num_for_sale", "has_community_stats")}
    return both.withColumns(zero).withColumn("era_span", era_span(F.col("year_first"), F.col("year_last")))
