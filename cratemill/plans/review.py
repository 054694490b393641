"""Queries of the review queue: gating, decisions, policies, cohorts, samples and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratemill.operators import review as V
from cratemill.operators.classify import hash_draw
from cratemill.plans.registry import query
from cratemill.sources.views import sql, table, view

c = F.col
_q = lambda s, d: view(s, d, "queue")
_GATE = "CASE WHEN is_issue = 1 THEN 'issue' WHEN self_confidence < 0.2 THEN 'low_confidence' WHEN model_label <> assigned_label AND source <> 'sale' THEN 'disagreement' END"


@query("FLT20", f"SELECT {_GATE} AS gate, count(DISTINCT (source, item_id)) AS listings FROM queue WHERE {_GATE} IS NOT NULL GROUP BY 1")
def _(s, d):
    return _q(s, d).withColumn("gate", V.gate()).where("gate is not null").groupBy("gate").agg(F.count_distinct("source", "item_id").alias("listings"))


_SHARD = "CAST('0x' || substr(sha256(source || '/' || item_id), 1, 8) AS BIGINT) % 7"


@query("FLT21", f"SELECT source, item_id, {_SHARD} AS shard FROM notes")
def _(s, d):
    return view(s, d, "notes").select("source", "item_id", V.shard(7, c("source"), c("item_id")).alias("shard"))


@query("SNK08", "SELECT queue_row_id, source, item_id, target, decision, final_label FROM queue WHERE decision IS NOT NULL")
def _(s, d):
    from cratemill.sources.connectors import csv_round_trip

    rows = _q(s, d).where("decision is not null").select("queue_row_id", "source", "item_id", "target", "decision", "final_label").orderBy("queue_row_id")
    return csv_round_trip(rows)


@query("FN45", "SELECT queue_row_id, model_label <> assigned_label AS model_differs, llm_label <> assigned_label AS llm_differs, CASE decision WHEN 'accept_llm' THEN llm_label WHEN 'keep' THEN assigned_label WHEN 'edit' THEN nullif(trim(final_label), '') END AS gold FROM queue")
def _(s, d):
    return _q(s, d).select("queue_row_id", (c("model_label") != c("assigned_label")).alias("model_differs"), (c("llm_label") != c("assigned_label")).alias("llm_differs"), V.gold().alias("gold"))


_RESP = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not json' ELSE '{\"verdict\":\"' || CASE event_id % 3 WHEN 0 THEN 'Good' WHEN 1 THEN 'Bogus' ELSE 'Mint' END || '\",\"confidence\":' || CAST(event_id % 150 AS STRING) || 'e-2,\"reason\":\"' || CASE event_id % 2 WHEN 0 THEN 'clear' ELSE 'odd' END || '\",\"abstain\":' || CASE WHEN event_id % 7 = 0 THEN 'true' ELSE 'false' END || '}' END AS response FROM events"
_J = "CASE WHEN event_id % 5 = 0 OR event_id % 5 = 1 THEN NULL ELSE response END"
_STATUS = "CASE WHEN j IS NULL THEN 'malformed' WHEN j->>'reason' NOT IN ('clear', 'unsure') THEN 'bad_reason' WHEN (j->>'abstain')::BOOLEAN THEN 'abstain' WHEN j->>'verdict' NOT IN ('Mint', 'Near Mint', 'Good') THEN 'bad_verdict' ELSE 'ok' END"


@query("FN46", f"SELECT event_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'ok' THEN round(greatest(0, least(1, (j->>'confidence')::DOUBLE)), 6) END AS confidence FROM (SELECT event_id, ({_J})::JSON AS j FROM ({_RESP}) r) q")
def _(s, d):
    return V.validated(sql(s, d, _RESP), ["clear", "unsure"], ["Mint", "Near Mint", "Good"]).select("event_id", "status", F.round("confidence", 6).alias("confidence"))


@query("FN50", f"SELECT event_id, CASE WHEN {_STATUS} = 'ok' AND (j->>'confidence')::DOUBLE >= 0.8 THEN 'accept_llm' WHEN {_STATUS} IN ('ok', 'abstain') THEN 'review' ELSE 'skip' END AS auto FROM (SELECT event_id, ({_J})::JSON AS j FROM ({_RESP}) r) q")
def _(s, d):
    v = V.validated(sql(s, d, _RESP), ["clear", "unsure"], ["Mint", "Near Mint", "Good"])
    return v.select("event_id", F.when((c("status") == "ok") & (c("confidence") >= 0.8), "accept_llm").when(c("status").isin("ok", "abstain"), "review").otherwise("skip").alias("auto"))


_TRUTH = "CASE queue_row_id % 3 WHEN 0 THEN 'Poor' WHEN 1 THEN 'Good' ELSE 'Mint' END"


@query("AGG44", f"SELECT source, target, CASE WHEN grouping(target) = 1 THEN 'all' ELSE 'target' END AS level, count(*) AS n, round(avg((assigned_label <> {_TRUTH})::INT), 6) AS corrected FROM queue GROUP BY GROUPING SETS ((source, target), (source))")
def _(s, d):
    q = _q(s, d).withColumn("wrong", (c("assigned_label") != F.expr(_TRUTH)).cast("int"))
    g = q.groupingSets([["source", "target"], ["source"]], "source", "target")
    return g.agg(F.when(F.grouping("target") == 1, "all").otherwise("target").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("wrong"), 6).alias("corrected"))


_POL = f"cand AS (SELECT queue_row_id, source, {_TRUTH} AS truth, unnest([struct_pack(label := model_label, score := self_confidence, origin := 'model'), struct_pack(label := llm_label, score := llm_confidence, origin := 'llm')], recursive := true) FROM queue)"
_BEST = "best AS (SELECT queue_row_id, source, truth, max_by(struct_pack(label := label, score := score, origin := origin), (score, origin)) AS b FROM cand WHERE score >= CASE WHEN origin = 'llm' THEN 0.6 WHEN source = 'sale' THEN 0.8 ELSE 0.5 END GROUP BY 1, 2, 3)"


@query("AGG45", f"WITH {_POL}, {_BEST} SELECT count(*) AS decided, round(avg((b.label = truth)::INT), 6) AS precision, round(count(*)::DOUBLE / (SELECT count(*) FROM queue), 6) AS coverage FROM best")
def _(s, d):
    rows = V.candidates(_q(s, d).withColumn("truth", F.expr(_TRUTH)))
    best = V.decide(rows, F.when(c("origin") == "llm", 0.6).when(c("source") == "sale", 0.8).otherwise(0.5))
    n = _q(s, d).agg(F.count(F.lit(1)).alias("total"))
    return V.policy_score(best, n).select("decided", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


@query("AGG63", f"WITH {_POL}, {_BEST} SELECT queue_row_id, b.label AS label, b.score AS score, b.origin AS origin, 'policy-1' AS version FROM best WHERE queue_row_id % 5 = 4")
def _(s, d):
    rows = V.candidates(_q(s, d).where("decision is null").withColumn("truth", F.expr(_TRUTH)))
    best = V.decide(rows, F.when(c("origin") == "llm", 0.6).when(c("source") == "sale", 0.8).otherwise(0.5))
    return best.select("queue_row_id", "label", "score", "origin", F.lit("policy-1").alias("version"))


@query("AGG46", f"WITH {_POL}, g AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS th), r AS (SELECT th, source, count(*) AS n, avg((label = truth)::INT) AS prec FROM cand, g WHERE origin = 'llm' AND score >= th GROUP BY 1, 2) SELECT source, max_by(th, (n, -th)) AS threshold, max(n) AS n FROM r WHERE prec >= 0.3 GROUP BY 1")
def _(s, d):
    rows = V.candidates(_q(s, d).withColumn("truth", F.expr(_TRUTH))).where("origin = 'llm'")
    return V.fit_thresholds(rows, [0.3, 0.5, 0.7, 0.9], 0.3)


@query("AGG47", f"SELECT source, round(avg((llm_label = {_TRUTH})::INT), 6) AS precision, round(count(*)::DOUBLE / (SELECT count(*) FROM queue), 6) AS coverage FROM queue WHERE llm_confidence >= 0.5 GROUP BY 1")
def _(s, d):
    q = _q(s, d)
    n = q.agg(F.count(F.lit(1)).alias("total"))
    r = q.where("llm_confidence >= 0.5").groupBy("source").agg(F.avg((c("llm_label") == F.expr(_TRUTH)).cast("int")).alias("p"), F.count(F.lit(1)).alias("k"))
    return r.join(F.broadcast(n)).select("source", F.round("p", 6).alias("precision"), F.round(c("k") / c("total"), 6).alias("coverage"))


_COH = f"w AS (SELECT assigned_label AS old, model_label AS predicted, {_TRUTH} AS fixed FROM queue WHERE decision = 'edit'), p AS (SELECT old, predicted, fixed, count(*) AS n FROM w GROUP BY 1, 2, 3), p1 AS (SELECT old, predicted, max_by(fixed, (n, fixed)) AS fixed, max(n) AS n FROM p GROUP BY 1, 2), o AS (SELECT old, fixed, sum(n) AS n FROM p GROUP BY 1, 2), o1 AS (SELECT old, max_by(fixed, (n, fixed)) AS fixed, max(n) AS n FROM o GROUP BY 1)"


def _cohorts(s, d):
    done = _q(s, d).where("decision = 'edit'").select(c("assigned_label").alias("old"), c("model_label").alias("predicted"), F.expr(_TRUTH).alias("fixed"))
    return V.cohorts(done)


@query("AGG43", f"WITH {_COH} SELECT q.queue_row_id, coalesce(CASE WHEN p1.n >= 2 THEN p1.fixed END, CASE WHEN o1.n >= 3 THEN o1.fixed END, q.model_label) AS suggested FROM queue q LEFT JOIN p1 ON q.assigned_label = p1.old AND q.model_label = p1.predicted LEFT JOIN o1 ON q.assigned_label = o1.old")
def _(s, d):
    return V.suggest(_q(s, d), *_cohorts(s, d)).select("queue_row_id", "suggested")


@query("JOIN21", f"WITH {_COH} SELECT q.queue_row_id, q.assigned_label, coalesce(CASE WHEN p1.n >= 2 THEN p1.fixed END, CASE WHEN o1.n >= 3 THEN o1.fixed END, q.model_label) AS suggested, substr(n.text, 1, 120) AS snippet FROM queue q LEFT JOIN p1 ON q.assigned_label = p1.old AND q.model_label = p1.predicted LEFT JOIN o1 ON q.assigned_label = o1.old JOIN notes n ON q.source = n.source AND q.item_id = n.item_id")
def _(s, d):
    rows = V.suggest(_q(s, d), *_cohorts(s, d))
    text = view(s, d, "notes").select("source", "item_id", F.substring("text", 1, 120).alias("snippet"))
    return rows.join(text, ["source", "item_id"]).select("queue_row_id", "assigned_label", "suggested", "snippet")


_H = "abs((doc_id * 7919 + 11) % 2147483647)"


@query("WIN09", f"""WITH n AS (SELECT doc_id, coalesce(sleeve_label, 'none') AS sl, coalesce(media_label, 'none') AS md, {_H} AS h FROM notes), a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY sl, md ORDER BY h, doc_id) <= 8), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY sl ORDER BY h, doc_id) <= 50)
SELECT doc_id FROM b ORDER BY doc_id LIMIT 300""")  # fmt: skip
def _(s, d):
    rows = view(s, d, "notes").select("doc_id", F.coalesce("sleeve_label", F.lit("none")).alias("sl"), F.coalesce("media_label", F.lit("none")).alias("md"), hash_draw(c("doc_id"), 11).alias("h"))
    return V.trim_balanced(rows, ["sl", "md"], 8, ["sl"], 50, "h", "doc_id", 300).select("doc_id")


@query("WIN10", f"""WITH n AS (SELECT doc_id, coalesce(sleeve_label, 'none') AS sl, coalesce(media_label, 'none') AS md, {_H} AS h FROM notes), a AS (SELECT *, row_number() OVER (PARTITION BY sl, md ORDER BY h, doc_id) AS round_ FROM n)
SELECT doc_id FROM a WHERE round_ <= 20 QUALIFY row_number() OVER (PARTITION BY sl ORDER BY round_, h, doc_id) <= 30""")  # fmt: skip
def _(s, d):
    rows = view(s, d, "notes").select("doc_id", F.coalesce("sleeve_label", F.lit("none")).alias("sl"), F.coalesce("media_label", F.lit("none")).alias("md"), hash_draw(c("doc_id"), 11).alias("h"))
    return V.water_fill(rows, ["sl"], ["md"], 20, 30, "h", "doc_id").select("doc_id")


@query("ML10", f"""WITH n AS (SELECT doc_id, coalesce(sleeve_label, 'none') AS st, {_H} AS h FROM notes), r AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY h, doc_id) AS rn, count(*) OVER (PARTITION BY st) AS n FROM n)
SELECT doc_id, CASE WHEN n < 5 THEN 'train' WHEN rn <= round(n * 0.7) THEN 'train' WHEN rn <= round(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM r""")  # fmt: skip
def _(s, d):
    rows = view(s, d, "notes").select("doc_id", F.coalesce("sleeve_label", F.lit("none")).alias("st"), hash_draw(c("doc_id"), 11).alias("h"))
    return V.stratified_split(rows, "st", "h", "doc_id").select("doc_id", "split")


@query("ML11", "WITH i AS (SELECT DISTINCT release_id FROM sales), r AS (SELECT *, row_number() OVER (ORDER BY abs((CAST(release_id AS BIGINT) * 7919 + 3) % 2147483647), release_id) AS rn, count(*) OVER () AS n FROM i) SELECT release_id, CASE WHEN rn <= round(n * 0.8) THEN 'train' ELSE 'test' END AS split, (rn - 1) % 5 AS fold FROM r")
def _(s, d):
    ids = view(s, d, "sales").select("release_id").distinct()
    return V.group_split(ids, "release_id", 0.8, 5, 3)


@query("ML11_quartiles", "WITH i AS (SELECT release_id, avg(usd) AS a FROM sales GROUP BY 1), q AS (SELECT quantile_cont(a, [0.25, 0.5, 0.75]) AS qs FROM i), p AS (SELECT release_id, len(list_filter(qs, lambda e: a >= e))::INT AS quartile, abs((CAST(release_id AS BIGINT) * 7919 + 3) % 2147483647) AS h FROM i, q) SELECT release_id, quartile, (row_number() OVER (PARTITION BY quartile ORDER BY h, release_id) - 1) % 5 AS fold FROM p")
def _(s, d):
    return V.anchor_folds(view(s, d, "sales").groupBy("release_id").agg(F.avg("usd").alias("a")), "release_id", "a", 5, 3)
