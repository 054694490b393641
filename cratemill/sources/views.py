"""The marketplace's entities as views over the order tables.

Every view is one SELECT that Spark SQL and DuckDB read alike, so a query and its SQL twin start from the same rows.
All rows are taken; where a remainder decides, it deals rows to entities, or gives a key that the other side does not have.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Media and sleeve ordinals by the two flags of a line.
_ORDINAL = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 7 WHEN 'NF' THEN 6 WHEN 'NO' THEN 5 WHEN 'RF' THEN 4 WHEN 'AO' THEN 3 ELSE 2 END"
GRADES = ("Mint", "Near Mint", "Excellent", "Very Good Plus", "Very Good", "Good", "Poor", "Generic")


def _pick(expr: str, values: tuple[str | None, ...]) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


FORMAT_TEXT = ("Vinyl, LP, Album", '7" Vinyl, Single', 'Vinyl, 12", Colored Vinyl', "CD, Album", "File, MP3, Album", 'Vinyl, 10", Promo', None, "Vinyl, LP, Unofficial Release", "Box Set, 2 x Vinyl, LP, Repress")
FORMAT_JSON = (
    '[{"name":"Vinyl","qty":"1","descriptions":["LP","Album"]}]',
    '[{"name":"Vinyl","qty":"2","descriptions":["12\\"","Repress"]}]'.replace('\\"', " inch"),
    '[{"name":"CD","qty":"1","descriptions":["Album"]}]',
    '[{"name":"File","qty":"1","descriptions":["MP3"]}]',
    "[]",
    None,
    '[{"name":"Vinyl","qty":"1","descriptions":["7 inch","Unofficial Release"]},{"name":"LP","qty":"1","descriptions":[]}]',
)
NOTE_LEADS = (
    "Sealed, never opened", "Plays perfectly, light hairlines on side B", "Seam split on top, ring wear", "NM vinyl, VG+ sleeve", "Water damage on cover, deep scratch",
    "https://shop.example.com/item Visit my store! Combined shipping available", "vinyl ungraded, untested", "Generic white sleeve", "Surface noise, skips on track 2", "Excellent copy, small crease", "As pictured", "Mint and unplayed; cut-out hole in jacket",
)

VIEWS: dict[str, str] = {
    "usage": "SELECT CAST(o_custkey AS STRING) AS user_id, CAST(l_partkey AS STRING) AS album_id, l_linestatus, l_quantity, l_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "collection": "SELECT user_id, album_id FROM usage WHERE l_linestatus = 'F'",
    "wantlist": "SELECT user_id, album_id FROM usage WHERE l_linestatus = 'O'",
    # every line is a rating; albums of one in seven keys never get a good one
    "ratings": "SELECT user_id, album_id, CAST(1 + CAST(l_quantity AS INT) % CASE WHEN CAST(album_id AS BIGINT) % 7 = 0 THEN 2 ELSE 5 END AS DOUBLE) AS rating FROM usage",
    "albums": "SELECT CAST(p_partkey AS STRING) AS album_id, p_brand AS artist, p_name AS album_title, p_type || ', ' || split_part(p_name, ' ', 1) AS genre, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 1950 + p_size END AS year, p_retailprice / 500 AS avg_rating FROM part",
    "releases": f"""SELECT CAST(p_partkey AS STRING) AS release_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand || '/' || p_type END AS master_id, p_name AS title,
        p_type AS genre, split_part(p_name, ' ', 1) AS style, CAST(CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 1950 + p_size END AS INT) AS year,
        CAST(CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 1950 + p_size - (p_size % 10) END AS INT) AS decade, {_pick("p_partkey % 5", ("US", "UK", "Germany", " ", None))} AS country, CAST(p_partkey % 4 AS INT) AS label_tier,
        {_pick("p_partkey % 9", FORMAT_TEXT)} AS format_desc, {_pick("p_partkey % 7", FORMAT_JSON)} AS formats_json,
        CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE '[{{"id":"' || CASE p_brand WHEN 'Brand#5' THEN '194' ELSE substr(p_brand, 7) END || '","name":"' || CASE p_brand WHEN 'Brand#5' THEN 'Various' WHEN 'Brand#6' THEN 'Unknown Artist' ELSE p_brand END || '"}}]' END AS artists_json,
        '[{{"id":"' || CAST(p_partkey % 40 AS STRING) || '","name":"L' || CAST(p_partkey % 40 AS STRING) || '","catno":"C"}}]' AS labels_json,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '["' || p_type || '","Rock"]' END AS genres_json, CAST(NULL AS STRING) AS styles_json, p_retailprice AS list_price FROM part""",
    "masters": "SELECT 'm' || release_id AS master_id, CAST(release_id AS BIGINT) AS master_no, replace(upper(artists_name), '#', ' ') AS artist, title, coalesce(year, 0) AS year FROM (SELECT release_id, coalesce(substr(master_id, 1, instr(master_id, '/') - 1), 'Brand#1') AS artists_name, title, year FROM releases) q",
    "match_albums": "SELECT CAST(p_partkey AS STRING) AS album_id, p_partkey AS album_no, replace(lower(p_brand), '#', '-') AS artist, CASE WHEN p_partkey % 3 = 1 THEN p_name || 's' ELSE p_name END AS title, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 1950 + p_size END AS year FROM part",
    # one listing in ten, and one fetch in eight below, is of a release that the catalogue lacks, so joins have something to miss on both sides
    "marketplace": """SELECT CAST(CASE WHEN l_partkey % 10 = 9 THEN l_partkey + 1000000000 ELSE l_partkey END AS STRING) AS release_id, max(l_shipdate) AS fetched_at, CAST(count(*) AS INT) AS num_for_sale, min(l_extendedprice / l_quantity) AS release_lowest_price,
        CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS INT) AS community_want, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS INT) AS community_have,
        CASE WHEN l_partkey % 6 = 0 THEN '{}' WHEN l_partkey % 6 = 1 THEN NULL ELSE '{"Mint (M)":{"value":' || CAST(count(*) * 40 + l_partkey % 50 AS STRING) || ',"currency":"USD"},"Near Mint (NM or M-)":{"value":' || CAST(count(*) * 30 + l_partkey % 50 AS STRING) || ',"currency":"USD"},"Very Good Plus (VG+)":{"value":' || CAST(count(*) * 20 AS STRING) || ',"currency":"USD"},"Good (G)":{"value":' || CAST(l_partkey % 9 - 1 AS STRING) || ',"currency":"USD"}}' END AS price_suggestions_json
        FROM lineitem GROUP BY l_partkey""",
    "sales": f"""SELECT CAST(l_partkey AS STRING) AS release_id, l_shipdate AS order_date, l_extendedprice / l_quantity AS usd, {_ORDINAL} AS media_ord, CASE WHEN l_linenumber % 3 = 0 THEN {_ORDINAL} - 1 ELSE {_ORDINAL} END AS sleeve_ord,
        {_pick("l_orderkey % 5", ("Mint (M)", "Near Mint (NM or M-)", "Very Good Plus (VG+)", "VG", "Not Graded"))} AS media_condition, {_pick("l_linenumber % 4", ("Near Mint (NM or M-)", "Generic", "No Cover", ""))} AS sleeve_condition,
        CASE l_orderkey % 4 WHEN 0 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || '.50' WHEN 1 THEN '€' || CAST(CAST(l_quantity AS INT) AS STRING) || ',25' WHEN 2 THEN '£1,' || CAST(100 + CAST(l_quantity AS INT) AS STRING) || '.00' ELSE 'about ' || CAST(CAST(l_quantity AS INT) AS STRING) END AS price_original_text,
        CASE WHEN l_linenumber % 2 = 0 THEN '~$' || CAST(CAST(l_quantity AS INT) + 1 AS STRING) || '.10' END AS price_user_currency_text,
        {_pick("l_linenumber % 4", NOTE_LEADS[:4])} AS seller_comments, l_orderkey, l_linenumber FROM lineitem""",
    "fetches": "SELECT CAST(CASE WHEN p_partkey % 8 = 7 THEN p_partkey + 1000000000 ELSE p_partkey END AS STRING) AS release_id, CASE p_partkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' ELSE NULL END AS status, CAST(p_size AS INT) AS num_rows FROM part",
    "notes": f"""SELECT CAST(d.doc_id AS STRING) AS item_id, CASE d.doc_id % 3 WHEN 0 THEN 'auction' WHEN 1 THEN 'inventory' ELSE 'sale' END AS source, {_pick("d.doc_id % 12", NOTE_LEADS)} || '. ' || d.text AS text,
        {_pick("d.doc_id % 9", (*GRADES, None))} AS sleeve_label, {_pick("(d.doc_id + length(d.text)) % 9", (*GRADES[:7], "Generic", None))} AS media_label, CAST(d.doc_id % 100 AS DOUBLE) / 100 AS label_confidence, 'Artist ' || CAST(d.doc_id % 50 AS STRING) AS artist,
        'Title ' || CAST(d.doc_id % 7 AS STRING) AS title, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic, d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "graded": f"""SELECT o_orderkey AS item_no, CASE WHEN o_orderkey % 5 < 3 THEN 'train' WHEN o_orderkey % 5 = 3 THEN 'val' ELSE 'test' END AS split, {_pick("o_custkey % 8", GRADES)} AS y_true,
        {_pick("(o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 8", GRADES)} AS y_model, {_pick("(o_custkey + CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 1 WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END) % 8", GRADES)} AS y_rule,
        CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence, o_orderpriority AS source FROM orders""",
    "priced": f"""SELECT l_orderkey, l_linenumber, CAST(l_partkey AS STRING) AS release_id, ln(1 + l_extendedprice / l_quantity) AS y_true, ln(1 + p_retailprice * (0.8 + 4 * l_discount)) AS y_pred, p_retailprice AS anchor,
        {_pick("p_partkey % 7", ("lp", "7inch", "10inch", "12inch", "cd", "box", "other"))} AS bucket, 1950 + p_size AS year, {_ORDINAL} AS media_ord, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "reference_side": "SELECT CAST(p_partkey AS STRING) AS id, 1950 + p_size AS year, p_type AS genre, CAST(p_partkey % 4 AS INT) AS label_tier, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS flag, ln(1 + p_retailprice) AS pred FROM part WHERE p_partkey % 2 = 0",
    "current_side": "SELECT CAST(p_partkey AS STRING) AS id, 1950 + p_size + CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE 0 END AS year, CASE WHEN p_partkey % 5 = 0 THEN 'PROMO' ELSE p_type END AS genre, CAST(p_partkey % 3 AS INT) AS label_tier, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS flag, ln(1 + p_retailprice * 1.02) AS pred FROM part WHERE p_partkey % 2 = 1",
    "snapshots": "SELECT CAST(user_id AS STRING) AS release_id, ts AS fetched_at, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS lowest_price, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(event_id % 50 AS INT) END AS num_for_sale, CASE WHEN event_type = 'click' THEN '{}' ELSE props END AS ladder, event_id FROM events",
    "queue": """SELECT event_id AS queue_row_id, CASE event_id % 3 WHEN 0 THEN 'auction' WHEN 1 THEN 'inventory' ELSE 'sale' END AS source, CAST(user_id AS STRING) AS item_id, CASE event_id % 2 WHEN 0 THEN 'sleeve' ELSE 'media' END AS target, CASE WHEN event_id % 5 < 4 THEN 'train' ELSE 'test' END AS split,
        CASE event_type WHEN 'view' THEN 'Mint' WHEN 'click' THEN 'Near Mint' WHEN 'signup' THEN 'Very Good' ELSE 'Good' END AS assigned_label, CASE WHEN event_id % 7 = 0 THEN 'Poor' WHEN event_type = 'view' THEN 'Mint' ELSE 'Good' END AS model_label, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '' ELSE 'Very Good' END AS final_label,
        CASE event_id % 5 WHEN 0 THEN 'accept_llm' WHEN 1 THEN 'keep' WHEN 2 THEN 'edit' WHEN 3 THEN 'skip' ELSE NULL END AS decision, 'Good' AS llm_label, CAST(event_id % 97 AS DOUBLE) / 97 AS self_confidence, CAST(event_id % 89 AS DOUBLE) / 89 AS llm_confidence, CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS is_issue, event_type FROM events""",
}


def _needs(sql: str, seen: list[str]) -> list[str]:
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql) and name not in seen:
            _needs(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str, tables: dict[str, str] | None = None) -> str:
    """The SQL with the views that it names put before it, and before those the tables (name to SELECT), if given."""
    names = _needs(sql, [])
    head = [f"{n} AS ({VIEWS[n]})" for n in names]
    own = " ".join([sql, *head])
    head = [f"{n} AS ({select})" for n, select in (tables or {}).items() if re.search(rf"\b{n}\b", own)] + head
    if not head:
        return sql
    body = sql.strip()
    return f"WITH {(',' + chr(10)).join(head)}{', ' + body[4:].strip() if body[:5].upper() == 'WITH ' else chr(10) + body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over views and base tables of one data folder. The session's own views are neither used nor touched."""
    return spark.sql(with_views(text, {n: f"SELECT * FROM parquet.`{sf_dir}/{n}.parquet`" for n in BASE}))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT * FROM {name}")
