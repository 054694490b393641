"""Queries of money texts, sale eligibility, nowcasts, price labels, guardrails and price metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratemill.functions import labels as L
from cratemill.functions import money as M
from cratemill.operators import prices as P
from cratemill.operators.ranking import quantiles
from cratemill.plans.registry import query
from cratemill.sources.views import sql, view

c = F.col


def _chain(t: str) -> str:
    exact = " ".join(f"WHEN {t} = '{n}' THEN {v}" for n, v in M.CONDITIONS)
    near = " ".join(f"WHEN contains({t}, '{n}') OR contains('{n}', {t}) THEN {v}" for n, v in M.CONDITIONS)
    return f"CAST(CASE WHEN coalesce({t}, '') = '' THEN -1 {exact} {near} ELSE -1 END AS DOUBLE)"


_COND = "lower(trim(media_condition))"


@query("FN04", f"SELECT l_orderkey, l_linenumber, {_chain('lower(trim(media_condition))')} AS media, {_chain('lower(trim(sleeve_condition))')} AS sleeve FROM sales")
def _(s, d):
    return view(s, d, "sales").select("l_orderkey", "l_linenumber", M.condition_ordinal(c("media_condition")).alias("media"), M.condition_ordinal(c("sleeve_condition")).alias("sleeve"))


_NUM = "CASE WHEN len({0}) - len(replace({0}, ',', '')) = 1 AND len({0}) = len(replace({0}, '.', '')) THEN TRY_CAST(replace({0}, ',', '.') AS DOUBLE) ELSE TRY_CAST(replace({0}, ',', '') AS DOUBLE) END"


def _money(sign: str, t: str) -> str:
    return f"(CASE WHEN {_NUM.format(f"regexp_extract({t}, '{sign}\\s*(\\d[\\d.,]*)', 1)")} > 0 THEN {_NUM.format(f"regexp_extract({t}, '{sign}\\s*(\\d[\\d.,]*)', 1)")} END)"


_USD = lambda t: f"(CASE WHEN NOT contains({t}, '€') AND NOT starts_with(trim({t}), '£') AND NOT regexp_matches({t}, '[A-Za-z]\\$') THEN {_money('\\$', t)} END)"


@query("FN12", f"SELECT l_orderkey, l_linenumber, price_original_text AS t, {_USD('price_original_text')} AS usd, {_money('£', 'price_original_text')} AS gbp, {_money('€', 'price_original_text')} AS eur, {_NUM.format("nullif(regexp_replace(price_original_text, '[^\\d.,-]', '', 'g'), '')")} AS loose FROM sales")
def _(s, d):
    t = c("price_original_text")
    return view(s, d, "sales").select("l_orderkey", "l_linenumber", t.alias("t"), M.usd(t).alias("usd"), M.gbp(t).alias("gbp"), M.eur(t).alias("eur"), M.loose(t).alias("loose"))


_SALE_USD = f"coalesce({_USD('price_user_currency_text')}, {_USD('price_original_text')})"


def _sale_usd():
    return F.coalesce(M.usd(c("price_user_currency_text")), M.usd(c("price_original_text")))


@query("FN13", f"SELECT l_orderkey, l_linenumber, {_SALE_USD} AS sale_usd FROM sales")
def _(s, d):
    return view(s, d, "sales").select("l_orderkey", "l_linenumber", _sale_usd().alias("sale_usd"))


_RATE = f"SELECT median({_USD('price_user_currency_text')} / {_money('€', 'price_original_text')}) AS rate FROM sales WHERE {_USD('price_user_currency_text')} / {_money('€', 'price_original_text')} BETWEEN 0.8 AND 1.6"


def _rate(s, d):
    ratio = M.usd(c("price_user_currency_text")) / M.eur(c("price_original_text"))
    # equal ratios are counted first, so the median sees few rows
    seen = view(s, d, "sales").select(ratio.alias("r")).where(c("r").between(0.8, 1.6)).groupBy("r").agg(F.count(F.lit(1)).alias("w"))
    return seen.agg(F.percentile("r", 0.5, c("w")).alias("rate"))


@query("AGG52", _RATE)
def _(s, d):
    return _rate(s, d)


_FINAL = f"WITH r AS ({_RATE}), v AS (SELECT l_orderkey, l_linenumber, coalesce({_USD('price_user_currency_text')}, {_USD('price_original_text')}, {_money('€', 'price_original_text')} * rate, {_money('£', 'price_original_text')} * 1.27) AS usd FROM sales, r)"


def _final(name: str):
    @query(name, f"{_FINAL} SELECT l_orderkey, l_linenumber, CASE WHEN usd IS NOT NULL THEN '$' || printf('%.2f', usd + 1e-9) END AS price FROM v")
    def _(s, d):
        t = c("price_original_text")
        usd = F.coalesce(_sale_usd(), M.eur(t) * c("rate"), M.gbp(t) * 1.27)
        return view(s, d, "sales").join(F.broadcast(_rate(s, d))).select("l_orderkey", "l_linenumber", M.as_text(usd + 1e-9).alias("price"))


_final("FN14")
_final("UDF01")


def _step(i: int, g: str) -> str:
    return f"(price_suggestions_json->>'$.\"{g}\".value')::DOUBLE"


_MINT, _NM, _VGP, _GOOD = (_step(0, g) for g in ("Mint (M)", "Near Mint (NM or M-)", "Very Good Plus (VG+)", "Good (G)"))
_POS = lambda x: f"CASE WHEN {x} > 0 THEN {x} END"


@query("FN15", f"SELECT release_id, {_POS(_NM)} AS nm, {_POS(_VGP)} AS vg_plus_by_part, greatest({_POS(_MINT)}, {_POS(_NM)}, {_POS(_VGP)}, {_POS(_GOOD)}) AS top, {_POS(_MINT)} AS mint FROM marketplace")
def _(s, d):
    v = M.ladder(c("price_suggestions_json"))
    return view(s, d, "marketplace").select("release_id", M.rung(v, F.lit("near mint (nm or m-)")).alias("nm"), M.rung(v, F.lit("vg+")).alias("vg_plus_by_part"), M.top_rung(v).alias("top"), M.mint_rung(v).alias("mint"))


@query("FLT22", f"SELECT release_id FROM marketplace WHERE release_lowest_price > 300 OR greatest({_POS(_MINT)}, {_POS(_NM)}, {_POS(_VGP)}, {_POS(_GOOD)}) IS NOT NULL")
def _(s, d):
    return view(s, d, "marketplace").where((c("release_lowest_price") > 300) | (F.size(M.ladder(c("price_suggestions_json"))) > 0)).select("release_id")


@query("FN51", f"SELECT release_id, TRY_CAST(num_for_sale AS INT) AS num_for_sale, CASE WHEN release_lowest_price > 0 THEN release_lowest_price END AS lowest, CASE WHEN trim(price_suggestions_json) IN ('', '{{}}') THEN NULL ELSE price_suggestions_json END AS ladder FROM marketplace")
def _(s, d):
    j = c("price_suggestions_json")
    return view(s, d, "marketplace").select("release_id", c("num_for_sale").cast("int").alias("num_for_sale"), F.when(c("release_lowest_price") > 0, c("release_lowest_price")).alias("lowest"), F.when(~F.trim(j).isin("", "{}"), j).alias("ladder"))


_NMSALE = "SELECT s.release_id, order_date, usd, l_orderkey, l_linenumber FROM sales s JOIN (SELECT release_id, fetched_at AS t_ref FROM marketplace) m ON s.release_id = m.release_id WHERE order_date <= t_ref - INTERVAL 400 DAY AND usd > 0 AND contains(lower(media_condition), 'near mint')"


@query("FLT15", _NMSALE)
def _(s, d):
    t = view(s, d, "marketplace").select("release_id", F.expr("fetched_at - INTERVAL 400 DAY").alias("t_ref"))
    nm = view(s, d, "sales").where(F.contains(F.lower("media_condition"), F.lit("near mint")) & (c("usd") > 0))
    return P.as_of(nm, t).select("release_id", "order_date", "usd", "l_orderkey", "l_linenumber")


_TREF = "SELECT r.release_id, least(m.fetched_at, CASE WHEN f.status = 'ok' THEN CAST('2001-06-01' AS TIMESTAMP) END) AS t_ref FROM releases r LEFT JOIN marketplace m ON r.release_id = m.release_id LEFT JOIN fetches f ON r.release_id = f.release_id"


def _t_ref(s, d):
    return sql(s, d, _TREF).where("t_ref is not null")


@query("JOIN17", f"SELECT s.release_id, count(*) AS n, max(order_date) AS last_date FROM sales s JOIN ({_TREF}) t ON s.release_id = t.release_id WHERE order_date <= t_ref GROUP BY 1")
def _(s, d):
    return P.as_of(view(s, d, "sales"), _t_ref(s, d)).groupBy("release_id").agg(F.count(F.lit(1)).alias("n"), F.max("order_date").alias("last_date"))


_TAGS = "SELECT release_id, CASE WHEN count(*) FILTER (WHERE e >= 7) >= 8 THEN 'strict' WHEN count(*) FILTER (WHERE e >= 6) >= 12 THEN 'relax_1' WHEN count(*) FILTER (WHERE e >= 5) >= 14 THEN 'relax_2' ELSE 'none' END AS relax_tag FROM (SELECT *, least(media_ord, sleeve_ord) AS e FROM sales) q GROUP BY 1"


@query("FLT16", _TAGS)
def _(s, d):
    return P.cascade_tags(view(s, d, "sales"))


@query("FLT16_uplift", f"SELECT s.release_id, l_orderkey, l_linenumber, relax_tag, round(CASE WHEN usd > 0 THEN usd * exp(0.08 * greatest(7 - least(media_ord, sleeve_ord), 0)) ELSE usd END, 8) AS uplift_usd FROM sales s JOIN ({_TAGS}) t ON s.release_id = t.release_id WHERE least(media_ord, sleeve_ord) >= CASE relax_tag WHEN 'strict' THEN 7 WHEN 'relax_1' THEN 6 WHEN 'relax_2' THEN 5 END")
def _(s, d):
    return P.uplifted(P.cascade(view(s, d, "sales"))).select("release_id", "l_orderkey", "l_linenumber", "relax_tag", F.round("uplift_usd", 8).alias("uplift_usd"))


_ELIG = f"(SELECT s.*, CAST('2001-12-31' AS TIMESTAMP) AS t_ref, l_orderkey * 10 + l_linenumber AS line FROM sales s JOIN ({_TAGS}) t ON s.release_id = t.release_id WHERE least(media_ord, sleeve_ord) >= CASE relax_tag WHEN 'strict' THEN 7 WHEN 'relax_1' THEN 6 WHEN 'relax_2' THEN 5 END)"


def _eligible(s, d):
    rows = view(s, d, "sales").withColumn("line", c("l_orderkey") * 10 + c("l_linenumber"))
    return P.cascade(rows).withColumn("t_ref", F.to_timestamp(F.lit("2001-12-31")))


@query("AGG06", f"SELECT release_id, min(usd) AS low, round(median(usd), 6) AS median, max(usd) AS high, round(avg(usd), 6) AS average, count(*) AS n FROM sales s JOIN ({_TREF}) t USING (release_id) WHERE order_date <= t_ref GROUP BY 1")
def _(s, d):
    out = P.sale_stats(P.as_of(view(s, d, "sales"), _t_ref(s, d)))
    return out.withColumns({"median": F.round("median", 6), "average": F.round("average", 6)})


_THEIL = f"""b AS (SELECT release_id, date_trunc('month', order_date) AS m, ln(median(usd)) AS y FROM {_ELIG} e GROUP BY 1, 2),
x AS (SELECT release_id, date_diff('day', min(m) OVER (PARTITION BY release_id), m)::DOUBLE AS x, y FROM b),
sl AS (SELECT a.release_id, median((b.y - a.y) / (b.x - a.x)) AS slope FROM x a JOIN x b ON a.release_id = b.release_id AND a.x < b.x GROUP BY 1),
th AS (SELECT x.release_id, slope, median(y) - slope * median(x) AS intercept, count(*) AS bins FROM x JOIN sl USING (release_id) GROUP BY 1, 2)"""
_CENTER = f"""e AS (SELECT *, exp(-greatest((epoch_us(t_ref) - epoch_us(order_date)) / 86400e6, 0) / 90) AS w FROM {_ELIG} q),
cw AS (SELECT *, sum(w) OVER (PARTITION BY release_id ORDER BY usd, order_date, line) AS cum, sum(w) OVER (PARTITION BY release_id) AS al FROM e),
ce AS (SELECT release_id, sum(usd * w) / sum(w) AS w_mean, min(usd) FILTER (WHERE cum >= 0.5 * al * (1 - 1e-12)) AS w_median, max_by(usd, (order_date, usd)) AS last_usd, count(*) AS n FROM cw GROUP BY 1)"""


@query("WIN17", f"WITH {_THEIL} SELECT release_id, round(slope, 8) AS slope, round(intercept, 6) AS intercept, bins FROM th")
def _(s, d):
    return P.theil_sen(_eligible(s, d)).withColumns({"slope": F.round("slope", 8), "intercept": F.round("intercept", 6)})


def _theil(name: str, bin_: str) -> None:
    @query(name, f"WITH {_THEIL.replace("date_trunc('month', order_date)", f"date_trunc('{bin_}', order_date)")} SELECT release_id, round(slope, 8) AS slope, round(intercept, 6) AS intercept, bins FROM th")
    def _(s, d):
        return P.theil_sen(_eligible(s, d), bin_).withColumns({"slope": F.round("slope", 8), "intercept": F.round("intercept", 6)})


_theil("WIN17_week", "week")
_theil("WIN17_day", "day")


@query("WIN18", f"WITH {_CENTER} SELECT release_id, round(w_mean, 5) AS w_mean, w_median, last_usd, n FROM ce")
def _(s, d):
    return P.weighted_center(_eligible(s, d)).withColumn("w_mean", F.round("w_mean", 5))


_NOW = f"""{_THEIL}, {_CENTER}, fm AS (SELECT release_id, date_trunc('month', min(order_date)) AS m0 FROM e GROUP BY 1),
raw AS (SELECT ce.*, bins, intercept + slope * date_diff('day', m0, CAST('2001-12-01' AS TIMESTAMP)) AS raw FROM ce JOIN fm USING (release_id) LEFT JOIN th USING (release_id)),
ia AS (SELECT *, coalesce(bins >= 4, false) AND coalesce(abs(raw) BETWEEN 0 AND 25, false) AS is_a FROM raw),
now_ AS (SELECT release_id, CASE WHEN is_a THEN exp(0.7 * raw + 0.3 * ln(w_median)) WHEN n >= 3 THEN w_median ELSE last_usd END AS sold, CASE WHEN is_a THEN 'A' WHEN n >= 3 THEN 'B' ELSE 'C' END AS tier, n FROM ia)"""


@query("WIN17_nowcast", f"WITH {_NOW} SELECT release_id, round(sold, 4) AS sold, tier, n FROM now_")
def _(s, d):
    return P.nowcast(_eligible(s, d)).withColumn("sold", F.round("sold", 4))


def _weight(sold: str, floor: str, tier: str) -> str:
    w = f"greatest(0.2, least(0.9, 0.65 - CASE {tier} WHEN 'B' THEN 0.1 WHEN 'C' THEN 0.25 ELSE 0 END))"
    gap = f"(ln({floor}) - ln({sold}))"
    return f"greatest(0.2, least(0.9, {w} + CASE WHEN {gap} < -0.05 THEN 0.2 * least(abs({gap}), 1.0) WHEN {gap} > 0.05 THEN -0.15 * least({gap}, 1.0) ELSE 0 END))::DOUBLE"


def _blend(sold: str, floor: str, tier: str) -> str:
    return f"CASE WHEN {sold} > 0 AND {floor} > 0 THEN exp({_weight(sold, floor, tier)} * ln({sold}) + (1 - {_weight(sold, floor, tier)}) * ln({floor})) WHEN {sold} > 0 THEN {sold} WHEN {floor} > 0 THEN {floor} END"


_STATS = "SELECT m.release_id, m.release_lowest_price AS listing, s.low, s.high, s.median, s.average, s.n, CASE s.n % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, price_suggestions_json FROM marketplace m LEFT JOIN (SELECT release_id, min(usd) AS low, max(usd) AS high, median(usd) AS median, avg(usd) AS average, count(*) AS n FROM sales WHERE media_ord >= 6 AND sleeve_ord >= 6 GROUP BY 1) s ON m.release_id = s.release_id"


def _stats(s, d):
    return sql(s, d, _STATS)


@query("FN29", f"WITH t AS ({_STATS}) SELECT release_id, round({_weight('median', 'listing', 'tier')}, 6) AS w, round({_blend('median', 'listing', 'tier')}, 8) AS y FROM t")
def _(s, d):
    m, lo, t = c("median"), c("listing"), c("tier")
    return _stats(s, d).select("release_id", F.round(L.blend_weight(m, lo, t), 6).alias("w"), F.round(L.blend(m, lo, t), 8).alias("y"))


_CAPL = "least(listing, CASE WHEN median > 0 THEN greatest(median, coalesce(high, 0)) WHEN high > 0 THEN high END * 3.0)"
_CAPY = lambda y, a: f"greatest(least({y}, CASE WHEN high > 0 THEN high * 2.0 END, CASE WHEN {a} > 0 THEN {a} * 4.0 END), 1e-9)"


@query("FN30", f"WITH t AS ({_STATS}) SELECT release_id, {_CAPL} AS listing_capped, {_CAPY('listing * 3', 'average')} AS label_capped FROM t")
def _(s, d):
    lo, m, hi = c("listing"), c("median"), c("high")
    return _stats(s, d).select("release_id", L.capped_listing(lo, m, hi).alias("listing_capped"), L.capped_label(lo * 3, c("average"), hi).alias("label_capped"))


@query("FN31", f"WITH t AS ({_STATS}) SELECT release_id, coalesce(CASE WHEN median > 0 THEN median END, {_POS(_NM)}, listing) AS full_anchor, coalesce({_POS(_NM)}, listing) AS no_history_anchor FROM t")
def _(s, d):
    nm = M.rung(M.ladder(c("price_suggestions_json")), F.lit("Near Mint (NM or M-)"))
    return _stats(s, d).select("release_id", F.coalesce(F.when(c("median") > 0, c("median")), nm, c("listing")).alias("full_anchor"), F.coalesce(nm, c("listing")).alias("no_history_anchor"))


_CRED = "coalesce(listing >= 1.0 AND (low IS NULL OR listing >= low) AND (low IS NULL OR high IS NULL OR listing <= high), false)"
_REF = f"greatest(CASE WHEN median > 0 THEN median END, CASE WHEN average > 0 THEN average END, CASE WHEN {_CRED} THEN listing END)"


def _five():
    return tuple(c(x) for x in ("median", "average", "listing", "low", "high"))


@query("FN32", f"WITH t AS ({_STATS}) SELECT release_id, {_CRED} AS credible, round({_REF}, 6) AS reference FROM t")
def _(s, d):
    m, a, lo, low, hi = _five()
    return _stats(s, d).select("release_id", L.credible_listing(lo, low, hi).alias("credible"), F.round(L.reference_floor(m, a, lo, low, hi), 6).alias("reference"))


@query("FN33", f"WITH t AS ({_STATS}) SELECT release_id, coalesce(greatest({_POS(_MINT)}, {_POS(_NM)}, {_POS(_VGP)}, {_POS(_GOOD)}) > {_REF} * 2.5, false) AS inflated, least({_POS(_MINT)}, {_POS(_NM)} * 3.0, {_POS(_NM)} * 4.0) AS mint_trimmed, {_POS(_VGP)} AS vgp FROM t")
def _(s, d):
    v = M.ladder(c("price_suggestions_json"))
    nm = M.rung(v, F.lit("Near Mint (NM or M-)"))
    trimmed = L.trimmed_ladder(v, nm)
    return _stats(s, d).select("release_id", F.coalesce(M.top_rung(v) > L.reference_floor(*_five()) * 2.5, F.lit(False)).alias("inflated"), F.try_element_at(trimmed, F.lit("Mint (M)")).alias("mint_trimmed"), F.try_element_at(trimmed, F.lit("Very Good Plus (VG+)")).alias("vgp"))


_GUARD = f"""WITH t AS ({_STATS}), a AS (SELECT *, {_NM} AS rung, {_REF} AS ref, {_CRED} AS cred, median > 0 AND average > 0 AND n >= 3 AS enough FROM t),
b AS (SELECT *, CASE WHEN cred THEN listing WHEN low > 0 AND NOT (average < median AND median / low > 4.0) THEN low ELSE median END AS fl FROM a),
r AS (SELECT *, rung / ref AS r_ladder, CASE WHEN enough THEN median / fl * CASE WHEN average < median THEN 1.0 ELSE average / median END ELSE 2.5 END AS r_sale,
  coalesce(enough AND median / fl < 1 AND (average < median OR (low > 0 AND median / low > 4.0 AND cred)), false) AS skip FROM b),
g AS (SELECT *, CASE WHEN NOT coalesce(ref > 0 AND rung > 0, false) THEN 'none' WHEN r_ladder - r_sale > 0 AND rung > ref AND NOT skip THEN 'down' WHEN r_ladder - r_sale < 0 AND rung < ref THEN 'up' ELSE 'none' END AS direction FROM r),
s AS (SELECT *, CASE direction WHEN 'down' THEN r_ladder ELSE r_sale END AS base FROM g),
gg AS (SELECT *, coalesce(CASE WHEN direction = 'none' OR abs(r_ladder - r_sale) <= 0.05 * base THEN 0.0 ELSE greatest(0, least(1, abs(r_ladder - r_sale) / base / 0.5)) END, 0.0)::DOUBLE AS strength FROM s)"""


def _guarded(s, d):
    rung = M.rung(M.ladder(c("price_suggestions_json")), F.lit("Near Mint (NM or M-)"))
    rows = _stats(s, d).withColumn("rung", rung)
    m, a, lo, low, hi = _five()
    return rows.withColumns(L.ratio_guard(c("rung"), m, a, lo, low, hi, c("n")))


@query("FN34", f"{_GUARD} SELECT release_id, round(r_sale, 6) AS r_sale, round(r_ladder, 6) AS r_ladder, direction, round(strength, 6) AS strength FROM gg")
def _(s, d):
    return _guarded(s, d).select("release_id", *(F.round(x, 6).alias(x) for x in ("r_sale", "r_ladder")), "direction", F.round("strength", 6).alias("strength"))


_ANCHOR = f"CASE WHEN strength > 0 AND ref > 0 AND rung > 0 THEN exp({_weight('rung', 'ref', "'A'")} * strength * ln(ref) + (1 - {_weight('rung', 'ref', "'A'")} * strength) * ln(rung)) ELSE rung END"


_TOP = f"greatest({_POS(_MINT)}, {_POS(_NM)}, {_POS(_VGP)}, {_POS(_GOOD)})"


@query("FN35", f"{_GUARD} SELECT release_id, round({_ANCHOR}, 4) AS anchor, coalesce(ref > 0, false) AS guardrails_active, round(CASE WHEN ref > 0 AND {_TOP} > 0 THEN {_TOP} / ref END, 6) AS top_to_reference, coalesce({_TOP} > ref * 2.5, false) AS inflated, strength > 0 AS blended, round(strength, 6) AS strength, cred AS listing_credible, coalesce(low IS NULL OR listing >= low, false) AS listing_over_low FROM gg")
def _(s, d):
    top, ref = M.top_rung(M.ladder(c("price_suggestions_json"))), c("reference")
    false = F.lit(False)
    return _guarded(s, d).select(
        "release_id", F.round(L.anchor_toward_reference(c("rung"), ref, c("strength")), 4).alias("anchor"), F.coalesce(ref > 0, false).alias("guardrails_active"), F.round(F.when((ref > 0) & (top > 0), top / ref), 6).alias("top_to_reference"),
        F.coalesce(top > ref * 2.5, false).alias("inflated"), (c("strength") > 0).alias("blended"), F.round("strength", 6).alias("strength"), L.credible_listing(c("listing"), c("low"), c("high")).alias("listing_credible"),
        F.coalesce(c("low").isNull() | (c("listing") >= c("low")), false).alias("listing_over_low"),
    )


@query("AGG49", f"{_GUARD} SELECT direction, CASE WHEN strength = 0 THEN 'none' WHEN strength < 1 THEN 'some' ELSE 'full' END AS bucket, count(*) AS n, round(quantile_cont(r_ladder, 0.5), 6) AS p50, round(quantile_cont(r_ladder, 0.9), 6) AS p90, min(release_id) AS example FROM gg GROUP BY 1, 2")
def _(s, d):
    bucket = F.when(c("strength") == 0, "none").when(c("strength") < 1, "some").otherwise("full")
    rows, by = _guarded(s, d).withColumn("bucket", bucket), ["direction", "bucket"]
    out = P.with_quantiles(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("release_id").alias("example")), rows, c("r_ladder"), {"p50": 0.5, "p90": 0.9}, by)
    return out.withColumns({x: F.round(x, 6) for x in ("p50", "p90")})


_LBL = f"""WITH {_NOW}, mm AS (SELECT release_id, release_lowest_price AS listing0 FROM marketplace), pk AS (SELECT release_id, max(usd) AS high FROM sales GROUP BY 1),
j AS (SELECT n.release_id, sold, tier, listing0, high, least(listing0, greatest(sold, high) * 3.0) AS listing FROM now_ n JOIN pk USING (release_id) LEFT JOIN mm USING (release_id)),
y AS (SELECT *, {_blend('sold', 'listing', 'tier')} AS y0 FROM j)"""


@query("ML17", f"{_LBL} SELECT release_id, tier, round({_CAPY('y0', 'sold')}, 3) AS label FROM y")
def _(s, d):
    sold = P.nowcast(_eligible(s, d))
    peak = view(s, d, "sales").groupBy("release_id").agg(F.max("usd").alias("high"))
    m = view(s, d, "marketplace").select("release_id", c("release_lowest_price").alias("listing0"))
    j = sold.join(peak, "release_id").join(m, "release_id", "left").withColumn("listing", L.capped_listing(c("listing0"), c("sold"), c("high")))
    y = L.capped_label(L.blend(c("sold"), c("listing"), c("tier")), c("sold"), c("high"))
    return j.select("release_id", "tier", F.round(y, 3).alias("label"))


@query("JOIN03", "SELECT s.l_orderkey, s.l_linenumber, round(ln(1 + usd), 6) AS log_price, media_ord, sleeve_ord, round(ln(1 + release_lowest_price), 6) AS anchor, year FROM sales s JOIN marketplace m ON s.release_id = m.release_id LEFT JOIN releases r ON s.release_id = r.release_id")
def _(s, d):
    m = view(s, d, "marketplace").select("release_id", F.round(F.log1p("release_lowest_price"), 6).alias("anchor"))
    r = view(s, d, "releases").select("release_id", "year")
    return view(s, d, "sales").join(m, "release_id").join(r, "release_id", "left").select("l_orderkey", "l_linenumber", F.round(F.log1p("usd"), 6).alias("log_price"), "media_ord", "sleeve_ord", "anchor", "year")


@query("JOIN04", "SELECT m.release_id, r.year, r.genre, f.status, round(m.release_lowest_price, 6) AS floor, s.n AS n_sales, round(s.median, 6) AS median FROM marketplace m JOIN releases r ON m.release_id = r.release_id LEFT JOIN fetches f ON m.release_id = f.release_id LEFT JOIN (SELECT release_id, count(*) AS n, median(usd) AS median FROM sales GROUP BY 1) s ON m.release_id = s.release_id WHERE m.release_lowest_price > 0")
def _(s, d):
    stats = P.sale_stats(view(s, d, "sales")).select("release_id", c("n").alias("n_sales"), F.round("median", 6).alias("median"))
    m = view(s, d, "marketplace").where("release_lowest_price > 0").select("release_id", F.round("release_lowest_price", 6).alias("floor"))
    j = m.join(view(s, d, "releases").select("release_id", "year", "genre"), "release_id").join(view(s, d, "fetches").select("release_id", "status"), "release_id", "left")
    return j.join(stats, "release_id", "left")


@query("JOIN12", "SELECT s.seller_comments AS comments, r.format_desc, count(*) AS n FROM sales s LEFT JOIN releases r ON s.release_id = r.release_id WHERE regexp_matches(lower(coalesce(r.format_desc, 'vinyl')), 'vinyl|(^|[^a-z0-9])lp([^a-z0-9]|$)|[0-9]\"') GROUP BY 1, 2")
def _(s, d):
    r = view(s, d, "releases").select("release_id", "format_desc")
    kept = view(s, d, "sales").join(r, "release_id", "left").where(F.rlike(F.lower(F.coalesce("format_desc", F.lit("vinyl"))), F.lit('vinyl|(^|[^a-z0-9])lp([^a-z0-9]|$)|[0-9]"')))
    return kept.groupBy(c("seller_comments").alias("comments"), "format_desc").agg(F.count(F.lit(1)).alias("n"))


_ERR = "e AS (SELECT *, exp(y_true) - 1 AS t, exp(y_pred) - 1 AS p, abs(exp(y_pred) - exp(y_true)) AS ae, abs(exp(y_pred) - exp(y_true)) / greatest(exp(y_true) - 1, 0.01) AS ape FROM priced)"
_MET = "round(avg(ae), 4) AS mae, round(sum(ae) / sum(t), 6) AS wape, round(median(ape), 6) AS mdape, count(*) AS n"


def _rounded(df):
    return df.withColumns({"mae": F.round("mae", 4), "wape": F.round("wape", 6), "mdape": F.round("mdape", 6)})


@query("AGG13", f"WITH {_ERR} SELECT {_MET} FROM e")
def _(s, d):
    return _rounded(P.metrics(view(s, d, "priced")))


@query("AGG14", f"WITH {_ERR} SELECT bucket, {_MET} FROM e WHERE isfinite(y_true) AND isfinite(y_pred) AND year < 1955 GROUP BY 1 HAVING count(*) >= 300")
def _(s, d):
    return _rounded(P.metrics(view(s, d, "priced").where("year < 1955 and not isnan(y_true) and not isnan(y_pred)"), ["bucket"]).where("n >= 300"))


_Q = "q AS (SELECT [quantile_cont(t, 0.25), quantile_cont(t, 0.5), quantile_cont(t, 0.75)] AS qs FROM e), b AS (SELECT e.*, 1 + (t > qs[1])::INT + (t > qs[2])::INT + (t > qs[3])::INT AS quartile FROM e, q)"


def _quartiles(s, d):
    return P.quantile_bins(P.errors(view(s, d, "priced")), "t", [0.25, 0.5, 0.75], "q0").withColumn("quartile", c("q0") + 1)


@query("AGG15", f"WITH {_ERR}, {_Q} SELECT quartile, round(median(ape), 6) AS mdape, count(*) AS n FROM b GROUP BY 1")
def _(s, d):
    rows = _quartiles(s, d)
    g = rows.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"))
    return P.with_quantiles(g, rows, c("ape"), {"mdape": 0.5}, ["quartile"]).withColumn("mdape", F.round("mdape", 6))


@query("AGG16", f"WITH {_ERR}, {_Q} SELECT quartile, bucket, round(median(ape), 6) AS mdape, round(avg(ape), 6) AS mean_ape, round(quantile_cont(ape, 0.9), 6) AS p90, round(max(ape), 6) AS max_ape, count(*) AS n FROM b GROUP BY 1, 2")
def _(s, d):
    rows, by = _quartiles(s, d), ["quartile", "bucket"]
    g = rows.groupBy(*by).agg(F.avg("ape").alias("mean_ape"), F.max("ape").alias("max_ape"), F.count(F.lit(1)).alias("n"))
    out = P.with_quantiles(g, rows, c("ape"), {"mdape": 0.5, "p90": 0.9}, by)
    return out.withColumns({x: F.round(x, 6) for x in ("mean_ape", "max_ape", "mdape", "p90")})


@query("AGG17", f"WITH {_ERR}, m AS (SELECT bucket, median(ape) AS md, count(*) * CASE bucket WHEN 'lp' THEN 2.0 WHEN 'cd' THEN 0.5 ELSE 1.0 END AS w FROM e GROUP BY 1) SELECT round(sum(md * w) / sum(w), 6) AS weighted_mdape FROM m")
def _(s, d):
    m = P.metrics(view(s, d, "priced"), ["bucket"]).select("bucket", c("mdape").alias("md"), "n")
    w = c("n") * F.when(c("bucket") == "lp", 2.0).when(c("bucket") == "cd", 0.5).otherwise(1.0)
    return m.agg(F.round(F.sum(c("md") * w) / F.sum(w), 6).alias("weighted_mdape"))


@query("AGG18", f"WITH {_ERR}, m AS (SELECT median(t) AS md FROM e WHERE year < 1980) SELECT round(median(abs(t - md) / greatest(t, 0.01)), 6) AS baseline_mdape FROM e, m WHERE year >= 1980")
def _(s, d):
    e = P.errors(view(s, d, "priced"))
    m = quantiles(e.where("year < 1980"), c("t"), {"md": 0.5})  # one row
    rows = e.where("year >= 1980").join(F.broadcast(m))
    return quantiles(rows, F.abs(c("t") - c("md")) / F.greatest("t", F.lit(0.01)), {"baseline_mdape": 0.5}).withColumn("baseline_mdape", F.round("baseline_mdape", 6))


@query("SORT04", f"WITH {_ERR} SELECT l_orderkey, l_linenumber, round(ae, 4) AS ae FROM e ORDER BY round(ae, 4) DESC, l_orderkey, l_linenumber LIMIT 100")
def _(s, d):
    return P.errors(view(s, d, "priced")).select("l_orderkey", "l_linenumber", F.round("ae", 4).alias("ae")).orderBy(F.desc("ae"), "l_orderkey", "l_linenumber").limit(100)


@query("SORT05", f"{_LBL} SELECT release_id, round(y0 / sold, 4) AS score FROM y ORDER BY 2 DESC, release_id LIMIT 50")
def _(s, d):
    m = view(s, d, "marketplace").select("release_id", c("release_lowest_price").alias("listing0"))
    peak = view(s, d, "sales").groupBy("release_id").agg(F.max("usd").alias("high"))
    j = P.nowcast(_eligible(s, d)).join(peak, "release_id").join(m, "release_id", "left").withColumn("listing", L.capped_listing(c("listing0"), c("sold"), c("high")))
    return j.select("release_id", F.round(L.blend(c("sold"), c("listing"), c("tier")) / c("sold"), 4).alias("score")).orderBy(F.desc("score"), "release_id").limit(50)


@query("FN36", "SELECT l_orderkey, l_linenumber, round(y_true - ln(1 + anchor), 6) AS z, round(greatest(-1, least(1, y_pred - ln(1 + anchor))) + ln(1 + anchor), 6) AS decoded FROM priced")
def _(s, d):
    a = F.log1p("anchor")
    return view(s, d, "priced").select("l_orderkey", "l_linenumber", F.round(c("y_true") - a, 6).alias("z"), F.round(L.clip(c("y_pred") - a, -1.0, 1.0) + a, 6).alias("decoded"))


@query("FN37", "WITH w AS (SELECT l_orderkey, l_linenumber, bucket, 1 / sqrt(greatest(anchor, 1.0)) * CASE bucket WHEN 'lp' THEN 1.2 WHEN 'cd' THEN 0.8 ELSE 1.0 END AS w FROM priced) SELECT l_orderkey, l_linenumber, bucket, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def _(s, d):
    w = view(s, d, "priced").withColumn("w", 1 / F.sqrt(F.greatest("anchor", F.lit(1.0))) * F.when(c("bucket") == "lp", 1.2).when(c("bucket") == "cd", 0.8).otherwise(1.0))
    mean = w.agg(F.avg("w").alias("mean"))
    return w.join(F.broadcast(mean)).select("l_orderkey", "l_linenumber", "bucket", F.round(c("w") / c("mean"), 6).alias("weight"))


@query("FN38", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-2.0 * (ln(1 + anchor) - 6.85))), 6) AS w FROM priced")
def _(s, d):
    return view(s, d, "priced").select("l_orderkey", "l_linenumber", F.round(1 / (1 + F.exp(-2.0 * (F.log1p("anchor") - 6.85))), 6).alias("w"))


@query("FN39", f"SELECT release_id, round((exp(ln(1 + {_NM}) + 0.1) - 1 + exp(ln(1 + {_VGP}) - 0.05) - 1) / 2, 4) AS price FROM marketplace WHERE {_POS(_NM)} IS NOT NULL AND {_POS(_VGP)} IS NOT NULL")
def _(s, d):
    v = M.ladder(c("price_suggestions_json"))
    path = lambda g, z: F.expm1(F.log1p(M.rung(v, F.lit(g))) + z)
    return view(s, d, "marketplace").select("release_id", F.round((path("Near Mint (NM or M-)", 0.1) + path("Very Good Plus (VG+)", -0.05)) / 2, 4).alias("price")).where("price is not null")


_HALF = "SELECT CASE WHEN count(*) >= 30 THEN quantile_cont(abs(y_true - y_pred), 0.8) ELSE median(abs(y_true - y_pred)) END AS half, count(*) AS n FROM priced WHERE year >= 1980"


def _half(s, d):
    r = view(s, d, "priced").where("year >= 1980").select(F.abs(c("y_true") - c("y_pred")).alias("r"))
    both = P.with_quantiles(r.agg(F.count(F.lit(1)).alias("n")), r, c("r"), {"p80": 0.8, "p50": 0.5}, [])
    return both.select(F.when(c("n") >= 30, c("p80")).otherwise(c("p50")).alias("half"), "n")


@query("AGG42", f"SELECT round(half, 6) AS half, n FROM ({_HALF}) q")
def _(s, d):
    return _half(s, d).withColumn("half", F.round("half", 6))


@query("FN40", f"SELECT l_orderkey, l_linenumber, round(greatest(0, exp(y_pred - half) - 1), 2) AS lo, round(exp(y_pred + half) - 1, 2) AS hi FROM priced, ({_HALF}) h")
def _(s, d):
    j = view(s, d, "priced").join(F.broadcast(_half(s, d).select("half")))
    return j.select("l_orderkey", "l_linenumber", F.round(F.greatest(F.lit(0.0), F.exp(c("y_pred") - c("half")) - 1), 2).alias("lo"), F.round(F.exp(c("y_pred") + c("half")) - 1, 2).alias("hi"))


def _hull(point: str, lo: str, hi: str) -> str:
    l, h, p = f"round(least({lo}, {hi}, {point}), 2)", f"round(greatest({lo}, {hi}, {point}), 2)", f"round({point}, 2)"
    return f"CASE WHEN {p} < {l} THEN greatest(0, round({p} - 0.01, 2)) ELSE {l} END AS lo, CASE WHEN {p} > {h} THEN round({p} + 0.01, 2) ELSE {h} END AS hi"


@query("FN40_hull", f"SELECT l_orderkey, l_linenumber, {_hull('p', 'q1', 'q2')} FROM (SELECT l_orderkey, l_linenumber, exp(y_pred) AS p, exp(y_true + 0.05) AS q1, exp(y_true - 0.05) AS q2 FROM priced) q")
def _(s, d):
    """Quantile bounds may cross each other and the price; the hull of all three is the interval."""
    i = L.interval(F.exp("y_pred"), F.exp(c("y_true") + 0.05), F.exp(c("y_true") - 0.05))
    return view(s, d, "priced").withColumn("i", i).select("l_orderkey", "l_linenumber", "i.lo", "i.hi")


@query("FN40_heuristic", f"SELECT l_orderkey, l_linenumber, {_hull('p', 'greatest(0, p - greatest(p * 0.12, 1.0))', 'p + greatest(p * 0.12, 1.0)')} FROM (SELECT l_orderkey, l_linenumber, exp(y_pred) AS p FROM priced) q")
def _(s, d):
    return view(s, d, "priced").withColumn("i", L.heuristic_interval(F.exp("y_pred"))).select("l_orderkey", "l_linenumber", "i.lo", "i.hi")


@query("FN48", f"SELECT release_id, {_POS(_NM)} AS suggestion, CASE WHEN {_POS(_NM)} IS NOT NULL AND release_lowest_price > 0 THEN least({_POS(_NM)}, release_lowest_price) END AS strict, coalesce(release_lowest_price, {_POS(_NM)}) AS lowest FROM marketplace")
def _(s, d):
    nm, lo = M.rung(M.ladder(c("price_suggestions_json")), F.lit("Near Mint (NM or M-)")), c("release_lowest_price")
    return view(s, d, "marketplace").select("release_id", nm.alias("suggestion"), F.when(nm.isNotNull() & (lo > 0), F.least(nm, lo)).alias("strict"), F.coalesce(lo, nm).alias("lowest"))


@query("FN09", "SELECT release_id, round(ln(1 + num_for_sale), 6) AS log_n, round(CASE WHEN community_want + community_have > 0 THEN community_want::DOUBLE / (community_want + community_have) ELSE -1 END, 6) AS want_share, round(ln(1 + community_have) - ln(1 + community_want), 6) AS have_minus_want FROM marketplace")
def _(s, d):
    n, w, h = c("num_for_sale"), c("community_want"), c("community_have")
    return view(s, d, "marketplace").select("release_id", F.round(F.log1p(n), 6).alias("log_n"), F.round(F.when(w + h > 0, w / (w + h)).otherwise(-1.0), 6).alias("want_share"), F.round(F.log1p(h) - F.log1p(w), 6).alias("have_minus_want"))


@query("FN11", "SELECT l_orderkey, l_linenumber, greatest(1, least(8, media_ord)) AS media, round(0.06::DOUBLE * (greatest(1, least(8, media_ord)) - 7) + 0.04::DOUBLE * (greatest(1, least(8, sleeve_ord)) - 7), 6) AS adjustment, round(ln(1 + usd) - 0.06 * (media_ord - 7) - 0.04 * (sleeve_ord - 7), 6) AS nm_log FROM sales")
def _(s, d):
    m, sl = F.greatest(F.lit(1), F.least(F.lit(8), c("media_ord"))), F.greatest(F.lit(1), F.least(F.lit(8), c("sleeve_ord")))
    adj = 0.06 * (m - 7) + 0.04 * (sl - 7)
    return view(s, d, "sales").select("l_orderkey", "l_linenumber", m.alias("media"), F.round(adj, 6).alias("adjustment"), F.round(F.log1p("usd") - 0.06 * (c("media_ord") - 7) - 0.04 * (c("sleeve_ord") - 7), 6).alias("nm_log"))


@query("FN10", "SELECT r.release_id, coalesce(r.year, 0) AS year, coalesce(r.decade, 0) AS decade, r.label_tier, coalesce(m.community_want, 0) AS want, coalesce(m.community_have, 0) AS have, round(ln(1 + coalesce(m.release_lowest_price, 0)), 6) AS log_floor FROM releases r LEFT JOIN marketplace m ON r.release_id = m.release_id")
def _(s, d):
    m = view(s, d, "marketplace").select("release_id", c("community_want").alias("want"), c("community_have").alias("have"), "release_lowest_price")
    z = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return view(s, d, "releases").join(m, "release_id", "left").select("release_id", z("year"), z("decade"), "label_tier", z("want"), z("have"), F.round(F.log1p(F.coalesce("release_lowest_price", F.lit(0))), 6).alias("log_floor"))


@query("AGG53", "SELECT user_id, count(*) AS items, round(sum(price), 2) AS value FROM (SELECT DISTINCT user_id, album_id FROM collection) c JOIN (SELECT release_id, release_lowest_price AS price FROM marketplace) m ON c.album_id = m.release_id GROUP BY 1")
def _(s, d):
    own = view(s, d, "collection").distinct()
    m = view(s, d, "marketplace").select(c("release_id").alias("album_id"), c("release_lowest_price").alias("price"))
    return own.join(m, "album_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("price"), 2).alias("value"))


@query("AGG55", "WITH g AS (SELECT artist, row_number() OVER (ORDER BY count(*) DESC, artist) AS code FROM albums GROUP BY 1 QUALIFY code <= 12) SELECT album_id, coalesce(code, 0) AS code FROM albums a LEFT JOIN g ON a.artist = g.artist")
def _(s, d):
    top = view(s, d, "albums").groupBy("artist").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "artist").limit(12)
    codes = top.withColumn("code", F.row_number().over(P.Window.orderBy(F.desc("n"), "artist"))).select("artist", "code")  # 12 rows
    return view(s, d, "albums").join(F.broadcast(codes), "artist", "left").select("album_id", F.coalesce("code", F.lit(0)).alias("code"))


@query("AGG10", "WITH q AS (SELECT quantile_cont(anchor, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM priced) SELECT l_orderkey, l_linenumber, len(list_filter(list_distinct(qs), lambda e: anchor > e)) AS anchor_bin, CAST(year - year % 10 AS INT) AS decade FROM priced, q")
def _(s, d):
    rows = P.quantile_bins(view(s, d, "priced"), "anchor", [x / 10 for x in range(10)], "anchor_bin")
    return rows.select("l_orderkey", "l_linenumber", "anchor_bin", (c("year") - c("year") % 10).cast("int").alias("decade"))


_BINS = "b AS (SELECT year - year % 10 AS decade, media_ord, y_true FROM priced)"


@query("AGG11", f"WITH {_BINS} SELECT decade, round(median(y_true) FILTER (WHERE media_ord >= 6) - median(y_true) FILTER (WHERE media_ord <= 4), 6) AS delta, count(*) FILTER (WHERE media_ord >= 6) AS hi, count(*) FILTER (WHERE media_ord <= 4) AS lo FROM b GROUP BY 1 HAVING count(*) FILTER (WHERE media_ord >= 6) >= 20 AND count(*) FILTER (WHERE media_ord <= 4) >= 20")
def _(s, d):
    side = F.when(c("media_ord") >= 6, "hi").when(c("media_ord") <= 4, "lo")
    rows = view(s, d, "priced").select((c("year") - c("year") % 10).alias("decade"), side.alias("side"), "y_true").where("side is not null")
    g = P.with_quantiles(rows.groupBy("decade", "side").agg(F.count(F.lit(1)).alias("n")), rows, c("y_true"), {"md": 0.5}, ["decade", "side"])
    pick = lambda side, x: F.max(F.when(c("side") == side, c(x)))
    out = g.groupBy("decade").agg(F.round(pick("hi", "md") - pick("lo", "md"), 6).alias("delta"), pick("hi", "n").alias("hi"), pick("lo", "n").alias("lo"))
    return out.where("hi >= 20 and lo >= 20")


@query("AGG12", "SELECT CAST(l_linenumber AS INT) AS bin, round(median(ln(1 + usd)) FILTER (WHERE media_ord >= 6 AND sleeve_ord >= 6) - median(ln(1 + usd)) FILTER (WHERE media_ord <= 4 AND sleeve_ord <= 4), 6) AS both, round(median(ln(1 + usd)) FILTER (WHERE media_ord >= 6) - median(ln(1 + usd)) FILTER (WHERE media_ord <= 4), 6) AS media, round(median(ln(1 + usd)) FILTER (WHERE sleeve_ord >= 6) - median(ln(1 + usd)) FILTER (WHERE sleeve_ord <= 4), 6) AS sleeve FROM sales GROUP BY 1")
def _(s, d):
    m, sl = c("media_ord"), c("sleeve_ord")
    kinds = {"both": ((m >= 6) & (sl >= 6), (m <= 4) & (sl <= 4)), "media": (m >= 6, m <= 4), "sleeve": (sl >= 6, sl <= 4)}
    sides = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(k).alias("kind"), F.lit(side).alias("side"))) for k, pair in kinds.items() for side, cond in zip(("hi", "lo"), pair))))
    rows = view(s, d, "sales").select(c("l_linenumber").cast("int").alias("bin"), F.log1p("usd").alias("y"), F.explode(sides).alias("k")).select("bin", "y", "k.*")
    q = quantiles(rows, c("y"), {"md": 0.5}, ["bin", "kind", "side"])
    of = lambda k, side: F.max(F.when((c("kind") == k) & (c("side") == side), c("md")))
    gaps = q.groupBy("bin").agg(*(F.round(of(k, "hi") - of(k, "lo"), 6).alias(k) for k in kinds))
    return view(s, d, "sales").select(c("l_linenumber").cast("int").alias("bin")).distinct().join(gaps, "bin", "left")


@query("AGG50", "WITH z AS (SELECT y_true - ln(1 + anchor) AS z FROM priced) SELECT round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd, round(quantile_cont(z, 0.05), 6) AS p05, round(quantile_cont(z, 0.95), 6) AS p95, (SELECT round(median(abs(exp(ln(1 + anchor)) - exp(y_true)) / greatest(exp(y_true) - 1, 0.01)), 6) FROM priced) AS mdape_zero FROM z")
def _(s, d):
    e = view(s, d, "priced").select((c("y_true") - F.log1p("anchor")).alias("z"), (F.abs(c("anchor") + 1 - F.exp("y_true")) / F.greatest(F.exp("y_true") - 1, F.lit(0.01))).alias("ape"))
    out = P.with_quantiles(e.agg(F.avg("z").alias("mean"), F.stddev_pop("z").alias("sd")), e, c("z"), {"p05": 0.05, "p95": 0.95}, [])
    out = P.with_quantiles(out, e, c("ape"), {"mdape_zero": 0.5}, [])
    return out.select(*(F.round(x, 6).alias(x) for x in ("mean", "sd", "p05", "p95", "mdape_zero")))
