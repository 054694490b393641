"""Queries of note cleaning, note quality, rules and grade metrics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cratemill.functions import notes as N
from cratemill.operators import classify as K
from cratemill.plans.registry import query
from cratemill.sources.views import GRADES, sql, table, view

c = F.col
V = N.VOCABULARY
_notes = lambda s, d: view(s, d, "notes")
_any = lambda t, ws: f"regexp_matches({t}, '{'|'.join(re.escape(w).replace(chr(39), chr(39) * 2) for w in ws)}')"
_hits = lambda t, ws: " + ".join(f"contains({t}, '{w}')::INT" for w in ws)
_L = "lower(coalesce(text, ''))"


@query("FN16", "SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '_{3,}', ' ', 'g'), '(?i)\\blinks:\\s*', ' ', 'g'), '(?i)https?://\\S+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM notes")
def _(s, d):
    return _notes(s, d).select("item_id", N.seller_text(c("text")).alias("text"))


@query("FN17")
def _(s, d):
    return _notes(s, d).select("item_id", N.without_boilerplate(c("text")).alias("text"))


@query("FN18")
def _(s, d):
    return _notes(s, d).select("item_id", N.promo_free(c("text")).alias("text"))


@query("FN19")
def _(s, d):
    return _notes(s, d).select("item_id", N.clean(c("text")).alias("text_clean"))


_BOTH = f"({_any(_L, V.subjects)} AND {_any(_L, V.conditions)})"
_EVID = f"CASE WHEN {_any(_L, V.unverified)} THEN 'none' WHEN {_hits(_L, V.playback)} >= 2 OR ({_hits(_L, V.playback)} >= 1 AND ({_any(_L, V.subjects)} OR {_any(_L, V.conditions)})) THEN 'strong' WHEN {_BOTH} OR {_any(_L, V.sealed)} THEN 'weak' ELSE 'none' END"


@query("FN21", f"SELECT item_id, NOT {_any(_L, V.unverified)} AND ({_any(_L, V.sealed)} OR {_any(_L, V.playback)} OR {_BOTH}) AS verifiable, {_EVID} AS evidence, {_any(_L, V.generic)} AS generic FROM notes")
def _(s, d):
    t = c("text")
    return _notes(s, d).withColumn("cues", N.cues(t)).select("item_id", N.verifiable_by(c("cues")).alias("verifiable"), N.evidence_by(c("cues")).alias("evidence"), N.generic_sleeve(t).alias("generic"))


_SL = f"({_any("lower(trim(coalesce(text, '')))", V.sleeve)} OR length(trim(coalesce(text, ''))) >= {V.fallback_chars})"
_MD = f"({_EVID}) <> 'none'"


_PROMPT = {k: v.replace("'", "''") for k, v in N.PROMPTS.items()}
_ADEQUATE = f"WITH q AS (SELECT *, {_SL} AS sl, {_MD} AS md FROM notes)"


@query("FN20", f"{_ADEQUATE} SELECT item_id, sl AS sleeve_note_adequate, md AS media_note_adequate, sl AND md AS adequate_for_training, array_to_string(list_filter([CASE WHEN NOT sl THEN 'sleeve' END, CASE WHEN NOT md THEN 'media' END], lambda x: x IS NOT NULL), ',') AS gaps, array_to_string(list_filter([CASE WHEN NOT sl THEN '{_PROMPT['sleeve']}' END, CASE WHEN NOT md THEN '{_PROMPT['media']}' END], lambda x: x IS NOT NULL), ' ') AS prompts, NOT (sl AND md) AS needs_richer_note FROM q")
def _(s, d):
    q = N.with_quality(_notes(s, d), "text", "text")
    return q.select("item_id", "sleeve_note_adequate", "media_note_adequate", "adequate_for_training", F.array_join("gaps", ",").alias("gaps"), F.array_join("prompts", " ").alias("prompts"), "needs_richer_note")


@query("FLT14", f"SELECT item_id FROM notes WHERE {_SL} AND {_MD}")
def _(s, d):
    return N.with_quality(_notes(s, d), "text", "text").where("adequate_for_training").select("item_id")


@query("AGG58", f"SELECT source, round(avg(CAST({_SL} AND {_MD} AS INT)), 6) AS share FROM notes GROUP BY 1")
def _(s, d):
    return N.with_quality(_notes(s, d), "text", "text").groupBy("source").agg(F.round(F.avg(c("adequate_for_training").cast("int")), 6).alias("share"))


@query("FN22")
def _(s, d):
    return _notes(s, d).select("item_id", F.array_join(N.lost_terms(c("text"), N.clean(c("text"))), ",").alias("lost"))


@query("FN23")
def _(s, d):
    cleaned = _notes(s, d).withColumn("text_clean", N.clean(c("text")))
    q = N.with_quality(cleaned, "text", "text_clean")
    return q.select(
        "item_id", "source", "sleeve_label", "media_label", "text_clean", N.evidence_by(c("cues")).alias("media_evidence_strength"), N.verifiable_by(c("cues")).alias("media_verifiable"),
        "sleeve_note_adequate", "media_note_adequate", "adequate_for_training", F.array_join("gaps", ",").alias("gaps"), F.array_join("prompts", " ").alias("prompts"), "needs_richer_note",
    )


#: In SQL as in Spark, every note is searched once for all signals; rules are then about the list of those found.
_lit = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
_in = lambda t, ws: f"list_filter({_lit(ws)}, lambda w: regexp_matches({t}, '(^|[^a-z0-9])' || regexp_escape(w) || '([^a-z0-9]|$)'))"
_FOUND = f"low AS (SELECT *, lower(coalesce(text, '')) AS t FROM notes), found AS (SELECT *, {_in('t', N.RULES.signals())} AS f FROM low)"
_n = lambda ws: f"len(list_intersect(f, {_lit(ws)}))"
_has = lambda ws: f"list_has_any(f, {_lit(ws)})"
_CONTRA = " OR ".join(f"list_has_all(f, {_lit(p)})" for p in N.RULES.pairs)


def _forb(r: N.GradeRule) -> str:
    t = "t"
    for e in r.exceptions:
        t = f"replace({t}, '{e}', ' ')"
    return f"(len({_in(t, r.forbidden)}) = 0)" if r.forbidden else "true"


_strict = lambda r: _has(r.strict) if r.strict else "false"
_co = lambda r: f"({_has(r.cosignal)} AND {_n(tuple({*r.strict, *r.cosignal}))} >= 2)" if r.cosignal else "false"
_hm = lambda r: f"({_strict(r)} OR {_co(r)})"


def _hard(target: str, value, forbid: bool = True) -> str:
    """value of the first hard rule that fires."""
    return "coalesce(" + ", ".join(f"CASE WHEN {_hm(r)}{f' AND {_forb(r)}' if forbid else ''} THEN {value(r)} END" for r in N.RULES.hard if target in r.targets) + ", NULL)"


_grade = lambda r: f"'{r.grade}'"
_tier = lambda r: f"CASE WHEN {_strict(r)} THEN 'strict' ELSE 'cosignal' END"
_first = lambda r: f"CASE WHEN {_strict(r)} THEN list_filter({_lit(r.strict)}, lambda w: list_contains(f, w))[1] ELSE list_filter({_lit(r.cosignal)}, lambda w: list_contains(f, w))[1] END"


@query("FN24", f"WITH {_FOUND} SELECT item_id, {_CONTRA} AS contradiction FROM found")
def _(s, d):
    return N.with_signals(_notes(s, d), "text").select("item_id", N.contradicts(c("__found")).alias("contradiction"))


@query("FN25", f"WITH {_FOUND} SELECT item_id, {_hard('sleeve', _grade)} AS sleeve_hard, {_hard('media', _grade)} AS media_hard FROM found")
def _(s, d):
    return N.with_signals(_notes(s, d), "text").select("item_id", *(N.hard_by(c("__low"), c("__found"), t)["grade"].alias(f"{t}_hard") for t in ("sleeve", "media")))


_ORD = lambda g: "CASE " + " ".join(f"WHEN {g} = '{x}' THEN {i}" for i, x in enumerate(N.RULES.order)) + " ELSE 99 END"


def _soft(pred: str, differ: bool = False) -> str:
    out = []
    for r in N.RULES.soft:
        here = N.RULES.order.index(r.grade)
        ok = f"{_n(r.supporting)} BETWEEN {r.least} AND {r.most} AND {_forb(r)} AND label_confidence < {r.confidence} AND NOT ({_ORD(pred)} > {here} AND {_ORD(pred)} - {here} > {N.RULES.most_upgrade})"
        ok += f" AND {_ORD(pred)} < {here}" if r.only_downgrade else ""
        ok += f" AND {pred} IS DISTINCT FROM '{r.grade}'" if differ else ""
        out.append(f"CASE WHEN {ok} THEN '{r.grade}' END")
    return "coalesce(" + ", ".join(out) + ")"


@query("FN26", f"WITH {_FOUND} SELECT item_id, {_soft('media_label')} AS media_soft FROM found")
def _(s, d):
    return N.with_signals(_notes(s, d), "text").select("item_id", N.soft_by(c("__low"), c("__found"), None, c("media_label"), c("label_confidence")).alias("media_soft"))


_SPLIT = f"CASE WHEN {_has(N.RULES.splits)} THEN CASE WHEN {_has(N.RULES.small_splits)} AND NOT {_has(N.RULES.split_defects)} THEN 'Very Good Plus' ELSE 'Very Good' END END"


def _overrides(target: str) -> str:
    """Columns of one target: whether the guardrail is on, grade, tier and signal of a hard rule, the rule's grade."""
    label = f"{target}_label"
    guard = f"CASE WHEN {label} = 'Near Mint' THEN split END" if target == "sleeve" else "NULL::VARCHAR"
    free = f"NOT contradiction AND ({guard}) IS NULL"
    rule = f"coalesce({guard}, {_hard(target, _grade)}, {_soft(label, differ=True)})"
    kept = f"CASE WHEN NOT contradiction AND NOT coalesce(({rule}) = 'Very Good' AND {label} = 'Very Good Plus' AND split = 'Very Good Plus', false) THEN {rule} END"
    return f"CASE WHEN {free} THEN {_hard(target, _tier)} END AS {target}_tier, CASE WHEN {free} THEN {_hard(target, _first)} END AS {target}_signal, {kept} AS {target}_rule"


_gone, _stands = N.RULES.collapse
_final = lambda t: f"CASE WHEN coalesce({t}_rule, {t}_label) = '{_gone}' THEN '{_stands}' ELSE coalesce({t}_rule, {t}_label) END"
_which = lambda cond: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond(t)} THEN '{t}' END" for t in ("sleeve", "media")) + "], lambda x: x IS NOT NULL), ',')"
_RULED = f"""WITH {_FOUND}, marked AS (SELECT *, {_CONTRA} AS contradiction, {_SPLIT} AS split FROM found), ruled AS (SELECT *, {_overrides('sleeve')}, {_overrides('media')} FROM marked),
final AS (SELECT *, {_final('sleeve')} AS sleeve, {_final('media')} AS media, {_which(lambda t: f"{t}_rule IS NOT NULL")} AS overridden, {_which(lambda t: f"coalesce({t}_rule, {t}_label) = '{_gone}'")} AS collapsed FROM ruled)"""


def _ruled(s, d):
    out = N.apply_rules(_notes(s, d), "text", {"sleeve": "sleeve_label", "media": "media_label"}, {"sleeve": "label_confidence", "media": "label_confidence"})
    return out.withColumnsRenamed({"sleeve_final": "sleeve", "media_final": "media"})


@query("FN27", f"{_RULED} SELECT item_id, sleeve, media, contradiction, sleeve_tier, sleeve_signal, media_tier, media_signal, overridden, collapsed FROM final")
def _(s, d):
    return _ruled(s, d).select("item_id", "sleeve", "media", "contradiction", "sleeve_tier", "sleeve_signal", "media_tier", "media_signal", F.array_join("overridden", ",").alias("overridden"), F.array_join("collapsed", ",").alias("collapsed"))


_BY = "sum((sleeve IS DISTINCT FROM sleeve_label)::INT) AS sleeve_overrides, sum((media IS DISTINCT FROM media_label)::INT) AS media_overrides, sum(contradiction::INT) AS contradictions"


@query("AGG48", f"{_RULED} SELECT count(*) AS n, {_BY} FROM final")
def _(s, d):
    differ = lambda a, b: F.sum((~c(a).eqNullSafe(c(b))).cast("int"))
    return _ruled(s, d).agg(F.count(F.lit(1)).alias("n"), differ("sleeve", "sleeve_label").alias("sleeve_overrides"), differ("media", "media_label").alias("media_overrides"), F.sum(c("contradiction").cast("int")).alias("contradictions"))


@query("FN28", f"WITH {_FOUND} SELECT item_id, {_hm(N.RULES.hard[0])} AS would_match, coalesce({_hard('media', _grade)} = 'Poor', false) AS would_fire FROM found")
def _(s, d):
    hard = lambda forbid: F.coalesce(N.hard_by(c("__low"), c("__found"), "media", N.RULES, forbid)["grade"] == "Poor", F.lit(False))
    return N.with_signals(_notes(s, d), "text").select("item_id", hard(False).alias("would_match"), hard(True).alias("would_fire"))


_ALLS = [(r.grade, w) for r in N.RULES.soft for w in r.supporting]


@query("FN49", f"WITH {_FOUND} " + " UNION ALL ".join(f"SELECT item_id, '{g}' AS grade, '{w}' AS signal FROM found WHERE list_contains(f, '{w}')" for g, w in _ALLS))
def _(s, d):
    hits = F.array_compact(F.array(*(F.when(F.array_contains(c("__found"), F.lit(w)), F.struct(F.lit(g).alias("grade"), F.lit(w).alias("signal"))) for g, w in _ALLS)))
    return N.with_signals(_notes(s, d), "text").select("item_id", F.explode(hits).alias("f")).select("item_id", "f.*")


_SELF = f"regexp_matches({_L}, '(vg\\+|nm )')"


@query("FN47", f"SELECT item_id, {_hits(_L, V.playback)} AS playback, {_hits(_L, V.sleeve)} AS sleeve, (({_EVID}) = 'strong')::INT AS strong, ({_SELF})::INT AS self_grade, length({_L}) AS chars FROM notes")
def _(s, d):
    q = _notes(s, d).withColumn("__low", N.low(c("text"))).withColumn("cues", N.cues(c("__low")))
    return q.select("item_id", c("cues.playback").alias("playback"), N.hits(c("__low"), V.sleeve).alias("sleeve"), (N.evidence_by(c("cues")) == "strong").cast("int").alias("strong"), F.rlike(c("__low"), F.lit(r"(vg\+|nm )")).cast("int").alias("self_grade"), F.length("__low").alias("chars"))


_DROP = f"CASE WHEN trim(coalesce(text, '')) = '' THEN 'missing_notes' WHEN length(trim(text)) < 80 THEN 'short_notes' WHEN sleeve_label IS NULL THEN 'missing_sleeve' WHEN media_label IS NULL THEN 'missing_media' WHEN {_any('lower(trim(text))', V.generic)} THEN 'generic_note' END"


@query("FLT10", f"SELECT {_DROP} AS drop_reason, count(*) AS n FROM notes WHERE source = 'inventory' GROUP BY 1")
def _(s, d):
    rows = _notes(s, d).where("source = 'inventory'")
    return rows.groupBy(N.drop_reason(c("text"), c("sleeve_label"), c("media_label"), 80).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("FLT11", f"SELECT item_id, {_DROP} AS drop_reason FROM notes WHERE source = 'auction'")
def _(s, d):
    return _notes(s, d).where("source = 'auction'").select("item_id", N.drop_reason(c("text"), c("sleeve_label"), c("media_label"), 80).alias("drop_reason"))


@query("FLT12", "SELECT item_id, CASE WHEN item_id IS NULL THEN 'item_id' WHEN sleeve_label IS NULL THEN 'sleeve_label' WHEN media_label IS NULL THEN 'media_label' END AS missing FROM notes")
def _(s, d):
    out = F.when(F.lit(False), "")
    for k in ("item_id", "sleeve_label", "media_label"):
        out = out.when(c(k).isNull(), k)
    return _notes(s, d).select("item_id", out.alias("missing"))


_IN = "(" + ", ".join(f"'{g}'" for g in GRADES) + ")"


@query("FLT13", f"SELECT item_id, coalesce(sleeve_label IN {_IN}, false) AS sleeve_valid, coalesce(media_label IN {_IN} AND media_label <> 'Generic', false) AS media_valid FROM notes")
def _(s, d):
    ok = lambda x: F.coalesce(x, F.lit(False))
    return _notes(s, d).select("item_id", ok(c("sleeve_label").isin(*GRADES)).alias("sleeve_valid"), ok(c("media_label").isin(*GRADES) & (c("media_label") != "Generic")).alias("media_valid"))


_VIN = "regexp_matches(lower(coalesce(format_desc, '')), 'vinyl|\\blp\\b|\\b(7|10|12)\\s*(\"|inch)')"


def _vinyl():
    return F.rlike(F.lower(F.coalesce("format_desc", F.lit(""))), F.lit(r'vinyl|\blp\b|\b(7|10|12)\s*("|inch)'))


@query("FLT07", f"SELECT release_id, {_VIN} AS vinyl FROM releases")
def _(s, d):
    return view(s, d, "releases").select("release_id", _vinyl().alias("vinyl"))


@query("FLT08", f"SELECT release_id FROM releases WHERE genre NOT IN ('PROMO', 'LARGE') OR format_desc IS NULL OR {_VIN}")
def _(s, d):
    return view(s, d, "releases").where(~c("genre").isin("PROMO", "LARGE") | c("format_desc").isNull() | _vinyl()).select("release_id")


@query("FLT09", "SELECT release_id, coalesce(format_desc, nullif(array_to_string(flatten(list_transform(CAST(formats_json AS JSON[]), lambda f: list_concat([f->>'name'], CAST(f->'descriptions' AS VARCHAR[])))), ', '), '')) AS format_text FROM releases")
def _(s, d):
    from cratemill.functions.catalogue import formats

    parts = F.flatten(F.transform(formats(c("formats_json")), lambda f: F.concat(F.array(f["name"]), f["descriptions"])))
    return view(s, d, "releases").select("release_id", F.coalesce("format_desc", F.nullif(F.array_join(parts, ", "), F.lit(""))).alias("format_text"))


_LONG = "SELECT 'sleeve' AS target, sleeve_label AS label FROM notes WHERE sleeve_label IS NOT NULL UNION ALL SELECT 'media', media_label FROM notes WHERE media_label IS NOT NULL"


def _dist(s, d):
    return K.distribution(_notes(s, d), {"sleeve": "sleeve_label", "media": "media_label"})


@query("AGG07", f"SELECT target, label, count(*) AS n FROM ({_LONG}) q GROUP BY 1, 2")
def _(s, d):
    return _dist(s, d)


@query("AGG08", f"SELECT target, label, count(*) AS n FROM ({_LONG}) q GROUP BY 1, 2 HAVING count(*) < 115")
def _(s, d):
    return _dist(s, d).where("n < 115")


@query("AGG09", f"WITH n AS (SELECT target, label, count(*) AS n FROM ({_LONG}) q GROUP BY 1, 2), i AS (SELECT target, max(n)::DOUBLE / min(n) AS imbalance FROM n GROUP BY 1) SELECT target, round(imbalance, 6) AS imbalance, imbalance = (SELECT max(imbalance) FROM i) AS chosen FROM i")
def _(s, d):
    i = _dist(s, d).groupBy("target").agg((F.max("n") / F.min("n")).alias("imbalance"))
    top = i.agg(F.max("imbalance").alias("top"))
    return i.join(F.broadcast(top)).select("target", F.round("imbalance", 6).alias("imbalance"), (c("imbalance") == c("top")).alias("chosen"))


_graded = lambda s, d: view(s, d, "graded")


def _prf(pred: str, extra: str = "") -> str:
    return f"""cls AS (SELECT DISTINCT y_true AS cls FROM graded UNION SELECT DISTINCT {pred} FROM graded), cm AS (SELECT {extra} y_true, {pred} AS p, count(*) AS n FROM graded GROUP BY ALL)"""


_PER = """per AS (SELECT cls, coalesce(sum(n) FILTER (WHERE y_true = cls AND p = cls), 0) AS tp, coalesce(sum(n) FILTER (WHERE p = cls), 0) AS pp, coalesce(sum(n) FILTER (WHERE y_true = cls), 0) AS support FROM cls, cm GROUP BY 1),
f AS (SELECT *, CASE WHEN pp > 0 THEN tp::DOUBLE / pp ELSE 0 END AS precision_, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall_ FROM per), ff AS (SELECT *, CASE WHEN precision_ + recall_ > 0 THEN 2 * precision_ * recall_ / (precision_ + recall_) ELSE 0 END AS f1 FROM f)"""


@query("AGG19", f"WITH {_prf('y_model')}, {_PER} SELECT cls, round(precision_, 4) AS precision, round(recall_, 4) AS recall, round(f1, 4) AS f1, support, (SELECT round(sum(n) FILTER (WHERE y_true = p)::DOUBLE / sum(n), 4) FROM cm) AS accuracy, (SELECT round(avg(f1), 4) FROM ff) AS macro_f1 FROM ff")
def _(s, d):
    m = K.class_metrics(K.confusion(_graded(s, d), "y_true", "y_model"))
    r = lambda x: F.round(x, 4).alias(x)
    return m.select("cls", r("precision"), r("recall"), r("f1"), "support", r("accuracy"), r("macro_f1"))


_ECE = "b AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, confidence, (y_true = y_model)::INT AS ok FROM graded WHERE confidence < 1.0), r AS (SELECT bin, count(*) AS n, avg(confidence) AS conf, avg(ok) AS acc FROM b GROUP BY 1)"


@query("AGG20", f"WITH {_ECE} SELECT round(sum(abs(conf - acc) * n) / (SELECT count(*) FROM graded), 6) AS ece FROM r")
def _(s, d):
    return K.ece(_graded(s, d), "y_true", "y_model", "confidence", 10).withColumn("ece", F.round("ece", 6))


@query("AGG41", f"WITH {_ECE} SELECT bin, n, round(conf, 6) AS conf, round(acc, 6) AS acc FROM r")
def _(s, d):
    return K.reliability(_graded(s, d), "y_true", "y_model", "confidence", 10).select("bin", "n", F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"))


@query("AGG21", "SELECT DISTINCT y_true AS cls FROM graded UNION SELECT DISTINCT y_rule FROM graded")
def _(s, d):
    return K.label_space(_graded(s, d), ["y_true", "y_rule"])


@query("SET04", "SELECT DISTINCT y_rule AS cls FROM graded WHERE split <> 'train' EXCEPT SELECT y_true FROM graded WHERE split = 'train' AND y_true <> 'Poor'")
def _(s, d):
    g = _graded(s, d)
    return g.where("split <> 'train'").select(c("y_rule").alias("cls")).distinct().exceptAll(g.where("split = 'train' and y_true <> 'Poor'").select("y_true").distinct())


@query("AGG22", "SELECT item_no, CASE WHEN y_model = 'Excellent' THEN y_model ELSE y_rule END AS y FROM graded")
def _(s, d):
    return _graded(s, d).select("item_no", F.when(c("y_model") == "Excellent", c("y_model")).otherwise(c("y_rule")).alias("y"))


@query("AGG23", "SELECT y_rule AS grade, count(*) FILTER (WHERE y_model <> y_rule) AS overrides, count(*) FILTER (WHERE y_model <> y_rule AND y_rule = y_true) AS helpful, count(*) FILTER (WHERE y_model <> y_rule AND y_model = y_true) AS harmful, count(*) FILTER (WHERE y_model <> y_rule AND y_model <> y_true AND y_rule <> y_true) AS neutral_ FROM graded GROUP BY 1")
def _(s, d):
    return K.override_audit(_graded(s, d), "y_true", "y_model", "y_rule", "y_rule").withColumnsRenamed({"y_rule": "grade", "neutral": "neutral_"})


@query("AGG23_transitions", "SELECT y_model, y_rule, count(*) AS n FROM graded WHERE y_model <> y_rule GROUP BY 1, 2 ORDER BY n DESC, y_model, y_rule LIMIT 10")
def _(s, d):
    return _graded(s, d).where("y_model <> y_rule").groupBy("y_model", "y_rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y_model", "y_rule").limit(10)


def _two(name: str) -> str:
    one = lambda p: f"(WITH {_prf(p)}, {_PER} SELECT * FROM ff)"
    return f"SELECT a.cls, round(a.f1, 4) AS f1_a, round(b.f1, 4) AS f1_b, round(b.f1 - a.f1, 4) AS delta FROM {one('y_model')} a JOIN {one('y_rule')} b ON a.cls = b.cls"


def _compare(name: str):
    @query(name, _two(name))
    def _(s, d):
        a = K.class_metrics(K.confusion(_graded(s, d), "y_true", "y_model")).select("cls", c("f1").alias("a"))
        b = K.class_metrics(K.confusion(_graded(s, d), "y_true", "y_rule")).select("cls", c("f1").alias("b"))
        return a.join(b, "cls").select("cls", F.round("a", 4).alias("f1_a"), F.round("b", 4).alias("f1_b"), F.round(c("b") - c("a"), 4).alias("delta"))


_compare("AGG24")


@query("AGG25", "SELECT y_true AS grade, y_rule AS predicted, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY y_true), 6) AS of_true, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY y_rule), 6) AS of_predicted FROM graded GROUP BY 1, 2")
def _(s, d):
    return K.breakdown(K.confusion(_graded(s, d), "y_true", "y_rule")).select(c("truth").alias("grade"), c("pred").alias("predicted"), "n", F.round("of_true", 6).alias("of_true"), F.round("of_predicted", 6).alias("of_predicted"))


@query("AGG26", "SELECT stage, y_true AS grade, round(avg((y_true = p)::INT), 6) AS recall, count(*) AS n FROM (SELECT 'model' AS stage, y_true, y_model AS p FROM graded UNION ALL SELECT 'rule', y_true, y_rule FROM graded) q GROUP BY 1, 2")
def _(s, d):
    g = _graded(s, d)
    both = g.select(F.lit("model").alias("stage"), "y_true", c("y_model").alias("p")).unionByName(g.select(F.lit("rule").alias("stage"), "y_true", c("y_rule").alias("p")))
    return both.groupBy("stage", c("y_true").alias("grade")).agg(F.round(F.avg((c("y_true") == c("p")).cast("int")), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


@query("AGG56", "SELECT y_true, y_model, y_rule, count(*) AS n FROM graded WHERE y_model = y_true AND y_rule <> y_true GROUP BY 1, 2, 3")
def _(s, d):
    return _graded(s, d).where("y_model = y_true and y_rule <> y_true").groupBy("y_true", "y_model", "y_rule").agg(F.count(F.lit(1)).alias("n"))


@query("AGG57", "WITH a AS (SELECT y_true AS grade, avg((y_true = y_rule)::INT) AS r FROM graded WHERE split = 'train' GROUP BY 1), b AS (SELECT y_true AS grade, avg((y_true = y_rule)::INT) AS r FROM graded WHERE split = 'test' AND y_true <> 'Mint' GROUP BY 1) SELECT coalesce(a.grade, b.grade) AS grade, round(a.r, 6) AS before_, round(b.r, 6) AS after_, round(b.r - a.r, 6) AS delta FROM a FULL JOIN b ON a.grade = b.grade")
def _(s, d):
    recall = lambda cond, n: _graded(s, d).where(cond).groupBy(c("y_true").alias("grade")).agg(F.avg((c("y_true") == c("y_rule")).cast("int")).alias(n))
    j = recall("split = 'train'", "a").join(recall("split = 'test' and y_true <> 'Mint'", "b"), "grade", "full")
    return j.select("grade", F.round("a", 6).alias("before_"), F.round("b", 6).alias("after_"), F.round(c("b") - c("a"), 6).alias("delta"))


@query("AGG61", "SELECT y_true, " + ", ".join(f"count(*) FILTER (WHERE y_model = '{g}') AS \"{g}\"" for g in GRADES) + " FROM graded GROUP BY 1")
def _(s, d):
    return _graded(s, d).groupBy("y_true").pivot("y_model", list(GRADES)).count().na.fill(0)


@query("AGG62", "SELECT split, round(avg((y_true = y_model)::INT), 6) AS before_, round(avg((y_true = y_rule)::INT), 6) AS after_, sum((y_model <> y_rule)::INT) AS overrides FROM graded GROUP BY 1")
def _(s, d):
    ok = lambda p: F.round(F.avg((c("y_true") == c(p)).cast("int")), 6)
    return _graded(s, d).groupBy("split").agg(ok("y_model").alias("before_"), ok("y_rule").alias("after_"), F.sum((c("y_model") != c("y_rule")).cast("int")).alias("overrides"))


@query("WIN19", "WITH e AS (SELECT *, abs((item_no * 7919 + 5) % 2147483647) AS h FROM graded WHERE y_true <> y_model), k AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY h, item_no) AS rn FROM e) SELECT item_no FROM k ORDER BY CASE WHEN rn <= 10 THEN 0 ELSE 1 END, CASE WHEN rn <= 10 THEN rn ELSE h END, item_no LIMIT 100")
def _(s, d):
    return K.stratified_sample(_graded(s, d).where("y_true <> y_model"), "y_true", "item_no", 10, 100, 5)


#: Whole vectors stand for eight grades: the logit of a grade is the mean of its eighth of the components.
_LOGIT = "list_transform(range(0, 8), lambda g: list_avg(list_transform(embedding[g * (len(embedding) // 8) + 1 : (g + 1) * (len(embedding) // 8)], lambda x: x::DOUBLE)))"
_STRENGTH = "CASE vec_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'weak' ELSE 'strong' END"
_EXP = f"e AS (SELECT vec_id, {_STRENGTH} AS strength, list_transform({_LOGIT}, lambda x: exp(8 * x)) AS e FROM embeddings), p AS (SELECT vec_id, strength, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"
_names = "[" + ", ".join(f"'{g}'" for g in GRADES) + "]"


def _grade_logits():
    size = F.floor(F.size("embedding") / 8).cast("int")
    mean = lambda g: F.aggregate(F.slice("embedding", g * size + 1, size), F.lit(0.0), lambda a, x: a + x.cast("double")) / size
    return F.transform(F.sequence(F.lit(0), F.lit(7)), mean)


def _grade_probs(s, d):
    return table(s, d, "embeddings").select("vec_id", F.when(c("vec_id") % 3 == 0, "none").when(c("vec_id") % 3 == 1, "weak").otherwise("strong").alias("strength"), K.softmax(_grade_logits(), 1 / 8).alias("p"))


@query("FN41", f"""WITH {_EXP}, b AS (SELECT vec_id, strength, [p[1] + p[2], p[3] + p[4], p[5] + p[6], p[7] + p[8]] AS band, p FROM p),
m AS (SELECT vec_id, strength, list_transform(range(1, 9), lambda i: 0.8 * p[i] + 0.2 * band[(i + 1) // 2]) AS m FROM b), nn AS (SELECT vec_id, strength, list_transform(m, lambda x: x / list_sum(m)) AS q FROM m),
a AS (SELECT vec_id, q, CASE strength WHEN 'none' THEN 0.4 WHEN 'weak' THEN 0.2 ELSE 0 END AS a FROM nn), g AS (SELECT vec_id, list_transform(range(1, 9), lambda i: round((1 - a) * q[i] + a * CASE WHEN i IN (2, 4, 5) THEN 1 / 3::DOUBLE ELSE 0 END, 12)) AS g FROM a),
o AS (SELECT vec_id, g, list_position(g, list_max(g)) AS i1, list_sort(g, 'DESC') AS s FROM g), t AS (SELECT vec_id, i1, s, list_position(list_transform(range(1, 9), lambda i: CASE WHEN i = i1 THEN -1 ELSE g[i] END), s[2]) AS i2 FROM o)
SELECT vec_id, {_names}[i1] AS grade, round(s[1], 5) AS top, CASE WHEN s[1] - s[2] <= 0.1 AND abs(i1 - i2) = 1 AND greatest(i1, i2) <= 7 THEN {_names}[least(i1, i2)] || '/' || {_names}[greatest(i1, i2)] END AS band FROM t""")  # fmt: skip
def _(s, d):
    names = list(GRADES)
    bands = F.array(*(F.get("p", F.lit(i)) + F.get("p", F.lit(i + 1)) for i in (0, 2, 4, 6)))
    mixed = _grade_probs(s, d).withColumn("q", K.band_blend(c("p"), bands, [0, 0, 1, 1, 2, 2, 3, 3], 0.2))
    gated = mixed.withColumn("g", K.evidence_prior(c("q"), c("strength"), names, ("Near Mint", "Very Good Plus", "Very Good"), 0.4, 0.2))
    gated = gated.withColumn("g", F.transform("g", lambda x: F.round(x, 12)))
    return gated.select("vec_id", K.best_class(c("g"), names).alias("grade"), F.round(F.array_max("g"), 5).alias("top"), K.confidence_band(c("g"), names, list(N.RULES.order), 0.1).alias("band"))


@query("UDF03", f"WITH {_EXP} SELECT vec_id, 'c' || (list_position(list_transform(p, lambda x: round(x, 9)), round(list_max(p), 9)) - 1) AS grade FROM p")
def _(s, d):
    p = F.transform("p", lambda x: F.round(x, 9))
    return _grade_probs(s, d).select("vec_id", F.concat(F.lit("c"), (F.array_position(p, F.array_max(p)) - 1).cast("string")).alias("grade"))


@query("WIN20", f"WITH {_EXP} SELECT vec_id, round(s[1], 5) AS top, round(s[1] - s[2], 5) AS gap FROM (SELECT vec_id, list_sort(p, 'DESC') AS s FROM p) q")
def _(s, d):
    top = F.sort_array("p", asc=False)
    return _grade_probs(s, d).withColumn("s", top).select("vec_id", F.round(c("s")[0], 5).alias("top"), F.round(c("s")[0] - c("s")[1], 5).alias("gap"))
