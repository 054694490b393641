"""Queries of upserts, merges, patches and overlap audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratemill.operators import merges as M
from cratemill.plans.registry import query
from cratemill.sources.views import sql, table, view

c = F.col
_SNAP = "SELECT release_id, fetched_at, lowest_price, num_for_sale, ladder, event_id FROM snapshots"
_OLD, _NEW = f"{_SNAP} WHERE event_id % 3 <> 0 AND CAST(release_id AS BIGINT) % 7 <> 0", f"{_SNAP} WHERE event_id % 3 = 0 AND CAST(release_id AS BIGINT) % 5 <> 0"
_VALS = ("lowest_price", "num_for_sale", "ladder")


def _last(t: str) -> str:
    return f"SELECT * FROM ({t}) q QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY event_id DESC) = 1"


def _last_rows(s, d, t: str):
    return sql(s, d, t).groupBy("release_id").agg(F.max_by(F.struct("fetched_at", *_VALS, "event_id"), "event_id").alias("r")).select("release_id", "r.*")


@query("SNK04", f"SELECT * FROM (SELECT *, 0 AS isnew FROM ({_OLD}) a UNION ALL SELECT *, 1 FROM ({_NEW}) b) q QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY isnew DESC, event_id DESC) = 1".replace("SELECT * FROM (SELECT *, 0", "SELECT * EXCLUDE (isnew) FROM (SELECT *, 0", 1))
def _(s, d):
    return M.upsert(sql(s, d, _OLD), sql(s, d, _NEW), ["release_id"], "event_id")


_LADDER = "coalesce(CASE WHEN trim(n.ladder) IN ('', '{}', '[]') THEN NULL ELSE n.ladder END, o.ladder, n.ladder)"


@query("SNK05", f"SELECT coalesce(n.release_id, o.release_id) AS release_id, coalesce(n.lowest_price, o.lowest_price) AS lowest_price, coalesce(n.num_for_sale, o.num_for_sale) AS num_for_sale, {_LADDER} AS ladder FROM ({_last(_OLD)}) o FULL JOIN ({_last(_NEW)}) n ON o.release_id = n.release_id")
def _(s, d):
    return M.coalescing_upsert(_last_rows(s, d, _OLD), _last_rows(s, d, _NEW), "release_id", list(_VALS), ["ladder"])


_SALE_KEYS = ("release_id", "CAST(order_date AS STRING)", "media_condition", "sleeve_condition", "price_original_text", "seller_comments")
_HASHED = "sha256(release_id || '|' || strftime(order_date, '%Y-%m-%d') || '|' || coalesce(media_condition, '') || '|' || coalesce(sleeve_condition, '') || '|' || coalesce(price_original_text, '') || '|' || coalesce(seller_comments, ''))"


def _hashed(s, d):
    parts = (c("release_id"), F.date_format("order_date", "yyyy-MM-dd"), c("media_condition"), c("sleeve_condition"), c("price_original_text"), c("seller_comments"))
    return view(s, d, "sales").withColumn("row_hash", M.row_hash(*parts))


@query("SNK06", f"SELECT release_id, {_HASHED} AS row_hash, max(l_orderkey * 10 + l_linenumber) AS line FROM sales GROUP BY 1, 2")
def _(s, d):
    rows = _hashed(s, d).select("release_id", "row_hash", (c("l_orderkey") * 10 + c("l_linenumber")).alias("line"))
    return M.upsert(rows.where("line % 2 = 0"), rows.where("line % 2 = 1").unionByName(rows.where("line % 2 = 0")), ["release_id", "row_hash"], "line")


@query("SNK07", "SELECT r.release_id, genre, year, format_desc, community_have, coalesce(price_suggestions_json, '{}') AS raw_json, coalesce(strftime(fetched_at, '%Y-%m-%d'), '') AS fetched_at FROM releases r LEFT JOIN marketplace m ON r.release_id = m.release_id")
def _(s, d):
    m = view(s, d, "marketplace").select("release_id", "community_have", "price_suggestions_json", "fetched_at")
    rows = view(s, d, "releases").select("release_id", "genre", "year", "format_desc").join(m, "release_id", "left")
    new = rows.select("release_id", "genre", "year", "format_desc", "community_have", F.coalesce("price_suggestions_json", F.lit("{}")).alias("raw_json"), F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("")).alias("fetched_at"))
    stored = new.where(c("release_id").cast("long") % 4 == 0).withColumns({"genre": F.lit("old"), "raw_json": F.lit("old")})
    return M.upsert(stored, new, ["release_id"], "fetched_at")


@query("SNK09", """WITH q AS (SELECT *, nullif(trim(CASE WHEN decision = 'accept_llm' THEN llm_label ELSE final_label END), '') AS label FROM queue WHERE decision IN ('accept_llm', 'edit', 'keep')),
p AS (SELECT source, item_id, arg_max(label, queue_row_id) FILTER (WHERE target = 'sleeve' AND label IS NOT NULL) AS sleeve_label, arg_max(label, queue_row_id) FILTER (WHERE target = 'media' AND label IS NOT NULL) AS media_label FROM q GROUP BY 1, 2)
SELECT * FROM p WHERE sleeve_label IS NOT NULL OR media_label IS NOT NULL""")  # fmt: skip
def _(s, d):
    return M.fold_decisions(view(s, d, "queue"))


_PATCH = "SELECT source, item_id, CASE WHEN queue_row_id % 3 = 0 THEN NULL ELSE assigned_label END AS sleeve_label, CASE WHEN queue_row_id % 5 = 0 THEN NULL ELSE model_label END AS media_label, queue_row_id AS line FROM queue"


@query("SNK10", f"""WITH p AS ({_PATCH}), st AS (SELECT * FROM p WHERE line % 4 = 0 AND CAST(item_id AS BIGINT) % 3 <> 0), nw AS (SELECT * FROM p WHERE line % 4 <> 0 AND CAST(item_id AS BIGINT) % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY source, item_id ORDER BY line DESC) = 1)
SELECT st.source, st.item_id, coalesce(nw.sleeve_label, st.sleeve_label) AS sleeve_label, st.media_label FROM st LEFT JOIN nw USING (source, item_id) UNION ALL SELECT source, item_id, sleeve_label, media_label FROM nw ANTI JOIN st USING (source, item_id)""")  # fmt: skip
def _(s, d):
    p = sql(s, d, _PATCH)
    item = c("item_id").cast("long")
    return M.merge_patch_files(p.where((c("line") % 4 == 0) & (item % 3 != 0)), p.where((c("line") % 4 != 0) & (item % 7 != 0)))


_REC = "SELECT source, item_id, sleeve_label, media_label FROM notes"


@query("JOIN10", f"WITH p AS (SELECT * FROM ({_PATCH}) x QUALIFY row_number() OVER (PARTITION BY source, item_id ORDER BY line DESC) = 1) SELECT r.source, r.item_id, coalesce(p.sleeve_label, r.sleeve_label) AS sleeve_label, coalesce(p.media_label, r.media_label) AS media_label, p.line IS NOT NULL AS patched FROM ({_REC}) r LEFT JOIN p ON r.source = p.source AND r.item_id = p.item_id")
def _(s, d):
    return M.apply_patches(sql(s, d, _REC), sql(s, d, _PATCH), "line", ["sleeve_label", "media_label"]).select("source", "item_id", "sleeve_label", "media_label", "patched")


@query("JOIN10_orphans", f"SELECT count(*) AS orphans FROM (SELECT DISTINCT source, item_id FROM ({_PATCH}) p ANTI JOIN ({_REC}) r USING (source, item_id)) q")
def _(s, d):
    return M.orphan_patches(sql(s, d, _REC), sql(s, d, _PATCH)).agg(F.count(F.lit(1)).alias("orphans"))


@query("JOIN11", "WITH u AS (SELECT release_id AS id, 1 AS fs, 0 AS mp, 0 AS sh FROM releases UNION ALL SELECT release_id, 0, 1, 0 FROM marketplace UNION ALL SELECT release_id, 0, 0, 1 FROM fetches), p AS (SELECT id, max(fs) AS fs, max(mp) AS mp, max(sh) AS sh FROM u GROUP BY 1) SELECT fs, mp, sh, count(*) AS n FROM p GROUP BY 1, 2, 3")
def _(s, d):
    ids = {n: view(s, d, v).select(c("release_id").alias("id")) for n, v in (("fs", "releases"), ("mp", "marketplace"), ("sh", "fetches"))}
    return M.overlap(**ids)


_NEWEST = "max_by({0}, (fetched_at, filled, event_id)) FILTER (WHERE {0} IS NOT NULL) AS {0}"
_FILLED = "(CASE WHEN lowest_price IS NULL THEN 0 ELSE 1 END) + (CASE WHEN num_for_sale IS NULL THEN 0 ELSE 1 END) + (CASE WHEN ladder IS NULL THEN 0 ELSE 1 END) AS filled"
_CLEAN = "SELECT release_id, fetched_at, lowest_price, num_for_sale, CASE WHEN trim(ladder) IN ('', '{}', '[]') THEN NULL ELSE ladder END AS ladder, event_id FROM snapshots"


@query("JOIN18", f"SELECT release_id, max(fetched_at) AS fetched_at, {', '.join(_NEWEST.format(v) for v in _VALS)} FROM (SELECT *, {_FILLED} FROM ({_CLEAN}) x) y GROUP BY 1")
def _(s, d):
    return M.newest_values(view(s, d, "snapshots"), ["release_id"], "fetched_at", list(_VALS), ["ladder"], "event_id")


@query("STR01", f"SELECT release_id, max(fetched_at) AS fetched_at, {', '.join(_NEWEST.format(v) for v in _VALS)} FROM (SELECT *, {_FILLED} FROM ({_CLEAN}) x) y GROUP BY 1")
def _(s, d):
    from cratemill.streaming.incremental import stream_snapshots

    return stream_snapshots(s, d)


@query("STR02", f"SELECT DISTINCT release_id, {_HASHED} AS row_hash FROM sales")
def _(s, d):
    from cratemill.streaming.incremental import stream_sales

    return stream_sales(s, d)


_SALES2 = "SELECT release_id, l_linenumber AS ln, order_date, media_condition, sleeve_condition, price_user_currency_text, l_orderkey FROM sales"


@query("JOIN19", f"SELECT release_id, ln, max(order_date) AS order_date, max_by(media_condition, (order_date, f, l_orderkey)) FILTER (WHERE media_condition IS NOT NULL) AS media_condition, max_by(price_user_currency_text, (order_date, f, l_orderkey)) FILTER (WHERE price_user_currency_text IS NOT NULL) AS price_user_currency_text FROM (SELECT *, CASE WHEN media_condition IS NULL THEN 0 ELSE 1 END + CASE WHEN price_user_currency_text IS NULL THEN 0 ELSE 1 END AS f FROM ({_SALES2}) x) y GROUP BY 1, 2")
def _(s, d):
    return M.newest_values(sql(s, d, _SALES2), ["release_id", "ln"], "order_date", ["media_condition", "price_user_currency_text"], [], "l_orderkey")


@query("JOIN20", "SELECT m.release_id, coalesce(CASE WHEN TRY_CAST(o.p AS DOUBLE) > 0 THEN TRY_CAST(o.p AS DOUBLE) END, m.release_lowest_price) AS release_lowest_price, coalesce(CASE WHEN trim(o.l) IN ('', '{}', '[]') THEN NULL ELSE o.l END, m.price_suggestions_json) AS price_suggestions_json FROM marketplace m LEFT JOIN (SELECT release_id, CASE num_rows % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '-1' ELSE CAST(num_rows AS STRING) || '.5' END AS p, CASE num_rows % 3 WHEN 0 THEN '{}' ELSE '{\"x\":1}' END AS l FROM fetches) o ON m.release_id = o.release_id")
def _(s, d):
    over = sql(s, d, "SELECT release_id, CASE num_rows % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '-1' ELSE CAST(num_rows AS STRING) || '.5' END AS release_lowest_price, CASE num_rows % 3 WHEN 0 THEN '{}' ELSE '{\"x\":1}' END AS price_suggestions_json FROM fetches")
    return M.overlay(view(s, d, "marketplace").select("release_id", "release_lowest_price", "price_suggestions_json"), over, "release_id", ["release_lowest_price"], "price_suggestions_json")


@query("JOIN22", "SELECT release_id FROM releases WHERE release_id NOT IN (SELECT release_id FROM fetches WHERE status = 'ok')")
def _(s, d):
    return view(s, d, "releases").select("release_id").join(view(s, d, "fetches").where("status = 'ok'").select("release_id"), "release_id", "left_anti")


@query("WIN14", f"SELECT release_id, fetched_at, lowest_price, num_for_sale, ladder, event_id FROM (SELECT *, {_FILLED} FROM snapshots) q QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY fetched_at DESC, filled DESC, event_id DESC) = 1")
def _(s, d):
    return M.newest_rows(view(s, d, "snapshots"), ["release_id"], "fetched_at", list(_VALS), "event_id")


_EV = "SELECT event_type AS source, CAST(user_id AS STRING) AS item_id, event_id, value FROM events"


@query("WIN15", f"SELECT * FROM ({_EV}) q QUALIFY row_number() OVER (PARTITION BY source, item_id ORDER BY event_id) = 1")
def _(s, d):
    return M.first_per_key(sql(s, d, _EV), ["source", "item_id"], "event_id")


_XS = "SELECT doc_id, source, artist, CASE WHEN doc_id % 37 = 0 THEN '' ELSE title END AS title FROM notes"


@query("WIN16", f"""WITH x AS ({_XS}), w AS (SELECT *, first_value(source) OVER k AS f, coalesce(max(CAST(source = 'inventory' AS INT)) OVER (PARTITION BY lower(trim(artist)), lower(trim(title)) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM x WINDOW k AS (PARTITION BY lower(trim(artist)), lower(trim(title)) ORDER BY doc_id))
SELECT doc_id, source, artist, title FROM w WHERE trim(title) = '' OR source = 'inventory' OR (seen = 0 AND f = source)""")  # fmt: skip
def _(s, d):
    return M.cross_source(sql(s, d, _XS), "inventory", "doc_id")


@query("JOIN24", "SELECT item_id, text, n_chars FROM notes JOIN (SELECT CAST(doc_id AS STRING) AS item_id, n_chars FROM documents) q USING (item_id)")
def _(s, d):
    more = table(s, d, "documents").select(c("doc_id").cast("string").alias("item_id"), "n_chars")
    return view(s, d, "notes").select("item_id", "text").join(more, "item_id")


@query("JOIN13", "SELECT n.source, n.item_id, q.target, q.split, q.is_issue, n.sleeve_label FROM notes n RIGHT JOIN (SELECT source, item_id, target, split, max(is_issue) AS is_issue FROM queue GROUP BY ALL) q ON n.source = q.source AND n.item_id = q.item_id WHERE n.item_id IS NOT NULL")
def _(s, d):
    q = view(s, d, "queue").groupBy("source", "item_id", "target", "split").agg(F.max("is_issue").alias("is_issue"))
    return q.join(view(s, d, "notes").select("source", "item_id", "sleeve_label"), ["source", "item_id"])
