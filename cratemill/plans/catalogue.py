"""Queries over the catalogue: predicates, global order, stratified samples, statistics of masters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratemill.functions import catalogue as C
from cratemill.operators import catalogue as O
from cratemill.plans.registry import query
from cratemill.sources.views import view

c = F.col
_TEXT = "lower(coalesce(format_desc, ''))"
_NAME0 = "lower(trim(coalesce(artists_json->0->>'name', '')))"
KEEP_ARTIST = f"(artists_json IS NULL OR ({_NAME0} NOT LIKE '%various%' AND {_NAME0} <> 'unknown artist' AND coalesce(artists_json->0->>'id', '') <> '194'))"
_FILE_JSON = "coalesce(len(list_filter(json_extract_string(formats_json, '$[*].name'), lambda x: lower(trim(x)) = 'file')), 0) > 0"
KEEP_FILE = f"(NOT {_FILE_JSON} AND NOT ({_TEXT} = 'file' OR {_TEXT} LIKE 'file,%' OR {_TEXT} LIKE '%, file' OR {_TEXT} LIKE '%, file,%'))"
_DESCS = "coalesce(json_extract_string(formats_json, '$[*].descriptions[*]'), [])"
_NAMES = "coalesce(json_extract_string(formats_json, '$[*].name'), [])"
_any = lambda cond: f"len(list_filter({_DESCS}, lambda x: {cond})) > 0"
_name = lambda *n: f"len(list_filter({_NAMES}, lambda x: lower(trim(x)) IN ({', '.join(repr(x) for x in n)}))) > 0"
KEEP_OFFICIAL = f"({_TEXT} NOT LIKE '%unofficial release%' AND NOT {_any("lower(x) LIKE '%unofficial release%'")})"
_inch = lambda n: f"({_TEXT} LIKE '%{n}\"%' OR {_TEXT} LIKE '%{n} inch%' OR {_any(f"lower(x) LIKE '%{n}\"%' OR lower(x) LIKE '%{n} inch%'")})"
_LP = f"(' ' || replace(replace({_TEXT}, ',', ' '), ';', ' ') || ' ' LIKE '% lp %' OR {_TEXT} LIKE '%, lp%' OR {_name('lp')} OR {_any("' ' || lower(x) || ' ' LIKE '% lp %'")})"
RANK = f"CASE WHEN {_LP} THEN 4 WHEN {_inch(12)} THEN 3 WHEN {_inch(10)} THEN 2 WHEN {_inch(7)} OR {_TEXT} LIKE '%vinyl%' OR {_name('vinyl', 'lp')} THEN 1 ELSE 0 END"
ALBUMISH = f"(regexp_matches({_TEXT}, '(^|[^a-z0-9])(album|lp)([^a-z0-9]|$)') OR {_any("regexp_matches(lower(x), '(^|[^a-z0-9])(album|lp)([^a-z0-9]|$)')")})"
KEEP = f"({KEEP_ARTIST} AND {KEEP_FILE} AND {KEEP_OFFICIAL})"
_rel = lambda s, d: view(s, d, "releases")
_flags = lambda: (c("formats_json"), c("format_desc"))


@query("FLT01", f"SELECT release_id FROM releases WHERE {KEEP_ARTIST}")
def _(s, d):
    return _rel(s, d).where(C.has_single_artist(c("artists_json"))).select("release_id")


@query("FLT02", f"SELECT release_id FROM releases WHERE {KEEP_FILE}")
def _(s, d):
    return _rel(s, d).where(C.not_digital(*_flags())).select("release_id")


@query("FLT03", f"SELECT release_id FROM releases WHERE {KEEP_OFFICIAL}")
def _(s, d):
    return _rel(s, d).where(C.official(*_flags())).select("release_id")


@query("FLT04", f"SELECT release_id, {RANK} AS format_rank FROM releases")
def _(s, d):
    return _rel(s, d).select("release_id", C.format_rank(*_flags()).alias("format_rank"))


@query("FLT05", f"SELECT release_id, CASE WHEN {RANK} > 0 THEN 1 ELSE 0 END AS is_vinyl FROM releases")
def _(s, d):
    return _rel(s, d).select("release_id", C.is_vinyl(*_flags()).alias("is_vinyl"))


@query("FLT06", f"SELECT DISTINCT master_id FROM releases WHERE trim(master_id) <> '' AND {ALBUMISH}")
def _(s, d):
    return _rel(s, d).where((F.trim("master_id") != "") & C.albumish(*_flags())).select("master_id").distinct()


@query("FLT18", f"SELECT release_id, community_have, community_want FROM releases JOIN marketplace USING (release_id) WHERE community_have >= 10 AND community_want >= 12 AND {KEEP}")
def _(s, d):
    m = view(s, d, "marketplace").select("release_id", "community_have", "community_want").where("community_have >= 10 AND community_want >= 12")
    return _rel(s, d).where(C.queue_filter()).select("release_id").join(m, "release_id")


@query("FLT24", "SELECT release_id FROM releases WHERE lower(format_desc) LIKE '%lp%' OR lower(format_desc) LIKE '%12\"%'")
def _(s, d):
    t = F.lower("format_desc")
    return _rel(s, d).where(F.contains(t, F.lit("lp")) | F.contains(t, F.lit('12"'))).select("release_id")


_COUNTS = f"""WITH el AS (SELECT *, artists_json->0->>'id' AS aid FROM releases WHERE {KEEP}),
mcs AS (SELECT master_id, count(*) AS mc FROM el WHERE trim(master_id) <> '' GROUP BY 1), acs AS (SELECT aid, count(*) AS ac FROM el WHERE aid IS NOT NULL GROUP BY 1),
px AS (SELECT release_id, coalesce(el.aid, '') AS aid, {RANK} AS vinyl, 1.0::DOUBLE * coalesce(mc, 0) + 0.5::DOUBLE * coalesce(ac, 0) AS score, year, label_tier AS tier, decade, genre FROM el LEFT JOIN mcs ON el.master_id = mcs.master_id LEFT JOIN acs ON el.aid = acs.aid)"""
_BEST = "score DESC, vinyl DESC, year DESC NULLS LAST, tier DESC, release_id"


@query("JOIN01", f"{_COUNTS} SELECT r.release_id, mc, ac FROM (SELECT *, artists_json->0->>'id' AS aid FROM releases) r LEFT JOIN mcs ON r.master_id = mcs.master_id LEFT JOIN acs ON r.aid = acs.aid")
def _(s, d):
    return O.with_counts(_rel(s, d)).select("release_id", "mc", "ac")


@query("JOIN02", "SELECT release_id, coalesce(community_have, 0) AS have, coalesce(community_want, 0) AS want, row_number() OVER (ORDER BY coalesce(community_have, 0) + coalesce(community_want, 0) DESC, CAST(release_id AS BIGINT)) AS pos FROM releases LEFT JOIN marketplace USING (release_id)")
def _(s, d):
    have, want = F.coalesce("community_have", F.lit(0)), F.coalesce("community_want", F.lit(0))
    rows = _rel(s, d).select("release_id").join(view(s, d, "marketplace").select("release_id", "community_have", "community_want"), "release_id", "left")
    known = rows.select("release_id", have.alias("have"), want.alias("want"))
    return O.global_rank(known, [F.desc(c("have") + c("want")), c("release_id").cast("long")], name="pos")


@query("SORT03", f"{_COUNTS} SELECT release_id, score FROM px")
def _(s, d):
    return O.proxy_rows(_rel(s, d)).select("release_id", "score")


@query("WIN01", f"{_COUNTS} SELECT row_number() OVER (ORDER BY {_BEST}) AS ord, release_id, aid, vinyl FROM px")
def _(s, d):
    return O.proxy_order(_rel(s, d))


def _sampled(name: str, keys: str, oracle: str, **how) -> None:
    @query(name, f"{_COUNTS} {oracle}")
    def _(s, d):
        return O.stratified(O.proxy_rows(_rel(s, d)), keys.split(", "), 12, **how)


_sampled("WIN02", "decade, genre", f"SELECT release_id FROM px QUALIFY row_number() OVER (PARTITION BY decade, genre ORDER BY {_BEST}) <= 12")
_sampled("WIN03", "decade", f"SELECT release_id FROM px QUALIFY row_number() OVER (PARTITION BY decade, vinyl > 0 ORDER BY {_BEST}) <= CASE WHEN vinyl > 0 THEN 8 ELSE 4 END", vinyl_share=0.7)
_CAP = f"SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY decade, aid ORDER BY {_BEST}) <= 2"
_sampled("WIN04", "decade", f"SELECT release_id FROM ({_CAP}) q QUALIFY row_number() OVER (PARTITION BY decade ORDER BY {_BEST}) <= 12", per_artist=2)
_CAP2 = f"SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY decade, vinyl > 0, aid ORDER BY {_BEST}) <= 2"
_sampled("WIN05", "decade", f"SELECT release_id FROM ({_CAP2}) q QUALIFY row_number() OVER (PARTITION BY decade, vinyl > 0 ORDER BY {_BEST}) <= CASE WHEN vinyl > 0 THEN 8 ELSE 4 END", vinyl_share=0.7, per_artist=2)


@query("WIN06", f"SELECT release_id FROM releases WHERE {KEEP} QUALIFY row_number() OVER (PARTITION BY decade, genre ORDER BY abs((CAST(release_id AS BIGINT) * 7919 + 42) % 2147483647), release_id) <= 5")
def _(s, d):
    return O.stratified_by_hash(_rel(s, d).where(C.queue_filter()), ["decade", "genre"], 5, 42)


@query("WIN07")
def _(s, d):
    return O.quota_block(O.proxy_order(_rel(s, d)), 400, 12, 0.8)


@query("SET01", f"{_COUNTS} SELECT release_id, 'vinyl' AS kind FROM px WHERE vinyl > 0 UNION ALL SELECT release_id, 'other' FROM px WHERE vinyl = 0")
def _(s, d):
    rows = O.proxy_rows(_rel(s, d))
    half = lambda cond, kind: rows.where(cond).select("release_id", F.lit(kind).alias("kind"))
    return half("vinyl > 0", "vinyl").unionAll(half("vinyl = 0", "other"))


@query(
    "SET02",
    f"""{_COUNTS}, head AS (SELECT release_id, 0 AS part, row_number() OVER (ORDER BY {_BEST}) AS ord FROM px QUALIFY ord <= 150),
tail AS (SELECT release_id, 1 AS part, CAST(release_id AS BIGINT) AS ord FROM releases),
firsts AS (SELECT release_id, min(part * 1000000000 + ord) AS place FROM (SELECT * FROM head UNION ALL SELECT * FROM tail) q GROUP BY 1)
SELECT release_id, row_number() OVER (ORDER BY place, release_id) AS pos FROM firsts QUALIFY pos <= 400""",
)
def _(s, d):
    head = O.proxy_order(_rel(s, d)).where("ord <= 150")
    return O.merge_lists(head, _rel(s, d).select("release_id", c("release_id").cast("long").alias("ord")), 400)


@query("SET03", "SELECT DISTINCT album_id AS release_id FROM (SELECT album_id FROM collection UNION ALL SELECT album_id FROM wantlist UNION ALL SELECT release_id FROM releases) q WHERE regexp_full_match(album_id, '[0-9]+')")
def _(s, d):
    ids = [view(s, d, v).select(c(k).alias("release_id")) for v, k in (("collection", "album_id"), ("wantlist", "album_id"), ("releases", "release_id"))]
    return ids[0].union(ids[1]).union(ids[2]).where(F.rlike("release_id", F.lit("^[0-9]+$"))).distinct()


@query("SORT01", "SELECT release_id, year, release_lowest_price AS price FROM releases JOIN marketplace USING (release_id) WHERE formats_json IS NOT NULL ORDER BY CASE WHEN year < 1980 THEN 0 ELSE 1 END, price DESC, year NULLS LAST, CAST(release_id AS BIGINT) LIMIT 300")
def _(s, d):
    m = view(s, d, "marketplace").select("release_id", c("release_lowest_price").alias("price"))
    rows = _rel(s, d).where("formats_json is not null").select("release_id", "year").join(m, "release_id")
    return rows.orderBy(F.when(c("year") < 1980, 0).otherwise(1), F.desc("price"), F.asc_nulls_last("year"), c("release_id").cast("long")).limit(300)


def _ordered(kind: str, key: str) -> None:
    """Every release with its place in the order."""

    @query(f"SORT02_{kind}", f"SELECT release_id, row_number() OVER (ORDER BY {key.format('coalesce(community_have, 0)', 'coalesce(community_want, 0)')} DESC, CAST(release_id AS BIGINT)) AS pos FROM releases LEFT JOIN marketplace USING (release_id)")
    def _(s, d):
        rows = _rel(s, d).select("release_id").join(view(s, d, "marketplace").select("release_id", "community_have", "community_want"), "release_id", "left")
        keyed = rows.select("release_id", F.expr(key.format("coalesce(community_have, 0)", "coalesce(community_want, 0)")).alias("k"))
        return O.global_rank(keyed, [F.desc("k"), c("release_id").cast("long")], name="pos").select("release_id", "pos")


_ordered("have", "{0}")
_ordered("want", "{1}")
_ordered("popularity", "{0} + {1}")


@query("SORT06", f"""{_COUNTS}, o AS (SELECT row_number() OVER (ORDER BY {_BEST}) AS ord, release_id FROM px), n AS (SELECT count(*) AS n FROM o),
p AS (SELECT o.*, CASE WHEN ord <= 20 THEN 'head' WHEN ord > n - 20 THEN 'tail' ELSE 'middle' END AS part FROM o, n WHERE ord <= 20 OR ord > n - 20 OR ord BETWEEN n // 2 - 9 AND n // 2 + 10)
SELECT part, ord, p.release_id, coalesce(community_have, 0) + coalesce(community_want, 0) AS community FROM p LEFT JOIN marketplace m ON p.release_id = m.release_id""")  # fmt: skip
def _(s, d):
    ranked = O.proxy_order(_rel(s, d))
    n = ranked.agg(F.max("ord").alias("n"))
    part = F.when(c("ord") <= 20, "head").when(c("ord") > c("n") - 20, "tail").when(c("ord").between(F.expr("n div 2 - 9"), F.expr("n div 2 + 10")), "middle")
    probe = ranked.join(F.broadcast(n)).withColumn("part", part).where("part is not null")
    m = view(s, d, "marketplace").select("release_id", (c("community_have") + c("community_want")).alias("community"))
    return probe.join(m, "release_id", "left").select("part", "ord", "release_id", F.coalesce("community", F.lit(0)).alias("community"))


_TIER_A = f"""SELECT master_id, count(*) AS release_count, sum(CASE WHEN {RANK} > 0 THEN 1 ELSE 0 END) AS vinyl_release_count, count(DISTINCT nullif(trim(country), '')) AS unique_country_count,
count(DISTINCT coalesce(nullif(trim(labels_json->0->>'id'), ''), nullif(trim(labels_json->0->>'name'), ''))) AS unique_label_count, min(CASE WHEN year > 0 THEN year END) AS year_first, max(CASE WHEN year > 0 THEN year END) AS year_last FROM releases WHERE trim(master_id) <> '' GROUP BY 1"""
_TIER_B = """SELECT master_id, sum(coalesce(community_want, 0)) AS community_want, sum(coalesce(community_have, 0)) AS community_have, sum(coalesce(num_for_sale, 0)) AS num_for_sale,
min(CASE WHEN release_lowest_price > 0 THEN release_lowest_price END) AS lowest_price, max(CASE WHEN m.release_id IS NULL THEN 0 ELSE 1 END) AS has_community_stats FROM releases r LEFT JOIN marketplace m ON r.release_id = m.release_id WHERE trim(master_id) <> '' GROUP BY 1"""
_SPAN = "coalesce(least(greatest(year_last - year_first, 0), 80), 0) AS era_span"


@query("AGG03", _TIER_A)
def _(s, d):
    return O.tier_a(_rel(s, d))


@query("AGG04", _TIER_B)
def _(s, d):
    return O.tier_b(_rel(s, d), view(s, d, "marketplace"))


@query("AGG05", f"SELECT master_id, {_SPAN} FROM ({_TIER_A}) q")
def _(s, d):
    return O.tier_a(_rel(s, d)).select("master_id", O.era_span(c("year_first"), c("year_last")).alias("era_span"))


@query("JOIN14", f"SELECT a.*, b.* EXCLUDE (master_id), mp.album_id, {_SPAN} FROM ({_TIER_A}) a JOIN ({_TIER_B}) b USING (master_id) JOIN (SELECT master_id, min(release_id) AS album_id FROM releases WHERE CAST(release_id AS BIGINT) % 2 = 0 AND master_id IS NOT NULL GROUP BY 1) mp USING (master_id)")
def _(s, d):
    album_map = _rel(s, d).where((c("release_id").cast("long") % 2 == 0) & c("master_id").isNotNull()).groupBy("master_id").agg(F.min("release_id").alias("album_id"))
    return O.master_stats(_rel(s, d), view(s, d, "marketplace"), album_map)


@query("AGG54", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("AGG59", "SELECT max(coalesce(community_have, 0) + coalesce(community_want, 0)) AS max_sum FROM marketplace")
def _(s, d):
    return view(s, d, "marketplace").agg(F.max(F.coalesce("community_have", F.lit(0)) + F.coalesce("community_want", F.lit(0))).alias("max_sum"))


@query("AGG60", "SELECT count(*) AS n, sum(CASE WHEN community_have > 0 THEN 1 ELSE 0 END) AS positive, max(community_have) AS most FROM (SELECT community_have FROM marketplace ORDER BY CAST(release_id AS BIGINT) LIMIT 500) q")
def _(s, d):
    probe = view(s, d, "marketplace").orderBy(c("release_id").cast("long")).limit(500)
    return probe.agg(F.count(F.lit(1)).alias("n"), F.sum((c("community_have") > 0).cast("int")).alias("positive"), F.max("community_have").alias("most"))


_EMPTY_J, _EMPTY_T = "(formats_json IS NULL OR trim(formats_json) IN ('', '[]'))", "(format_desc IS NULL OR trim(format_desc) = '')"


@query("AGG38", f"SELECT slice, count(*) AS n, sum(CAST({_EMPTY_J} AS INT)) AS empty_json, sum(CAST({_EMPTY_T} AS INT)) AS empty_text, sum(CAST({_EMPTY_J} AND {_EMPTY_T} AS INT)) AS both_empty FROM (SELECT *, unnest(CASE WHEN list_price < 1000 THEN ['all', 'cheap'] ELSE ['all'] END) AS slice FROM releases) q GROUP BY 1")
def _(s, d):
    j, t = c("formats_json").isNull() | F.trim("formats_json").isin("", "[]"), c("format_desc").isNull() | (F.trim("format_desc") == "")
    rows = _rel(s, d).select(j.alias("j"), t.alias("t"), F.explode(F.when(c("list_price") < 1000, F.array(F.lit("all"), F.lit("cheap"))).otherwise(F.array(F.lit("all")))).alias("slice"))
    n = lambda x: F.sum(x.cast("int"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), n(c("j")).alias("empty_json"), n(c("t")).alias("empty_text"), n(c("j") & c("t")).alias("both_empty"))


@query("AGG39", "SELECT min(num_for_sale) AS least, quantile_cont(num_for_sale, 0.5) AS p50, quantile_cont(num_for_sale, 0.9) AS p90, max(num_for_sale) AS most, sum(CAST(num_for_sale < 10 AS INT)) AS under_10, sum(CAST(num_for_sale >= 10 AND num_for_sale < 30 AS INT)) AS from_10, sum(CAST(num_for_sale >= 30 AS INT)) AS from_30 FROM marketplace")
def _(s, d):
    n = c("num_for_sale")
    # a histogram of distinct depths first, so the percentile sees few rows
    count = lambda cond: F.sum(F.when(cond, c("k")).otherwise(0))
    p = lambda q: F.percentile(n, q, c("k"))
    return view(s, d, "marketplace").groupBy(n).agg(F.count(F.lit(1)).alias("k")).agg(F.min(n).alias("least"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.max(n).alias("most"), count(n < 10).alias("under_10"), count((n >= 10) & (n < 30)).alias("from_10"), count(n >= 30).alias("from_30"))


@query("FN05", "SELECT release_id, CAST(regexp_matches(t, 'colored|coloured|color vinyl') AS INT) AS is_colored_vinyl, CAST(regexp_matches(t, 'picture disc|pic disc') AS INT) AS is_picture_disc, CAST(regexp_matches(t, 'promo|white label') AS INT) AS is_promo FROM (SELECT release_id, lower(coalesce(format_desc, '')) AS t FROM releases) q")
def _(s, d):
    return _rel(s, d).select("release_id", *(e.alias(k) for k, e in C.text_flags(c("format_desc")).items()))


@query("FN06", f"SELECT release_id, CASE WHEN len({_NAMES}) > 0 THEN CASE WHEN {_any("lower(trim(x)) = 'repress'")} THEN 0 ELSE 1 END WHEN regexp_matches({_TEXT}, '\\brepress\\b') THEN 0 ELSE 1 END AS is_original FROM releases")
def _(s, d):
    return _rel(s, d).select("release_id", C.is_original(*_flags()).alias("is_original"))


_QTY = "list_sum(list_transform(coalesce(json_extract_string(formats_json, '$[*].qty'), []), lambda x: greatest(floor(coalesce(TRY_CAST(x AS DOUBLE), 0)), 0)))"


@query("FN07", f"""WITH t AS (SELECT release_id, lower(array_to_string(list_concat({_NAMES}, {_DESCS}), ' ') || ' ' || coalesce(format_desc, '')) AS t, coalesce({_QTY}, 0) AS q FROM releases),
f AS (SELECT release_id, regexp_matches(t, '\\blp\\b') AS is_lp, regexp_matches(t, '7\\s*"|\\b7\\s*inch\\b') AS is_7inch, regexp_matches(t, '10\\s*"|\\b10\\s*inch\\b') AS is_10inch, regexp_matches(t, '1\\s*2\\s*"|\\b12\\s*inch\\b') AS is_12inch,
regexp_matches(t, '\\bcd\\b|compact disc') AS is_cd, contains(t, 'box set') AS is_box_set, regexp_matches(t, '\\b[2-9]\\s*x\\s*vinyl\\b|(double|triple) vinyl|quad.*vinyl|vinyl.*quad') OR q >= 2 AS several FROM t)
SELECT release_id, is_lp::INT AS is_lp, is_7inch::INT AS is_7inch, is_10inch::INT AS is_10inch, is_12inch::INT AS is_12inch, is_cd::INT AS is_cd, is_box_set::INT AS is_box_set, (several AND NOT is_box_set)::INT AS is_multi_disc,
CASE WHEN is_box_set OR several THEN 5 WHEN is_7inch THEN 2 WHEN is_10inch OR is_12inch THEN 3 WHEN is_lp THEN 4 WHEN is_cd THEN 1 ELSE 0 END AS format_family FROM f""")  # fmt: skip
def _(s, d):
    return _rel(s, d).select("release_id", *(e.alias(k) for k, e in C.medium_flags(*_flags()).items()))


@query("FN08", f"SELECT release_id, CASE WHEN genres_json IS NULL THEN 1 ELSE 2 END AS genre_count, 1 AS style_count, CASE WHEN artists_json IS NULL THEN 0 ELSE 1 END AS artist_count, 1 AS label_count, len({_NAMES}) AS format_count, coalesce(artists_json->0->>'id', '') AS first_artist, labels_json->0->>'id' AS first_label FROM releases")
def _(s, d):
    ids = (F.coalesce(C.first_artist_id(c("artists_json")), F.lit("")).alias("first_artist"), F.coalesce(C.first_label_id(c("labels_json")), F.lit("")).alias("first_label"))
    return _rel(s, d).select("release_id", *(e.alias(k) for k, e in C.counts().items()), *ids)


@query("FN03", "SELECT page_id, CASE WHEN TRY_CAST(t AS INT) BETWEEN 1800 AND 2100 THEN TRY_CAST(t AS INT) ELSE CAST(nullif(regexp_extract(t, '(^|[^0-9])(1[89][0-9][0-9]|20[0-9][0-9]|2100)([^0-9]|$)', 2), '') AS INT) END AS year FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '([0-9]+)', 1) ELSE url END AS t FROM pages) q")
def _(s, d):
    t = F.when(c("page_id") % 2 == 0, F.regexp_extract("url", "([0-9]+)", 1)).otherwise(c("url"))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", C.year_of(t).alias("year"))
