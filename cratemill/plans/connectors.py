"""Queries of readers and writers: each derives its files from the tables with Spark, writes them to the shared folder and reads them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratemill.operators.recommend import remap
from cratemill.plans.registry import query
from cratemill.sources import connectors as X
from cratemill.sources import html as H
from cratemill.sources.views import sql, table, view
from cratemill.streaming.incremental import shared_path

c = F.col


def _csv(s, df, headers):
    path = shared_path(s, "csv")
    df.toDF(*headers).write.csv(path, header=True, escape='"')
    return path


@query("SRC01", "SELECT user_id, album_id FROM collection WHERE CAST(album_id AS BIGINT) % 10 <> 0")
def _(s, d):
    rows = view(s, d, "collection").withColumn("album_id", F.when(c("album_id").cast("long") % 10 != 0, c("album_id")))
    return X.load_usage(s, _csv(s, rows, ["User_ID", "Release_Id"]))


@query("SRC02", "SELECT user_id, album_id FROM wantlist")
def _(s, d):
    return X.load_usage(s, _csv(s, view(s, d, "wantlist"), ["USER_ID", "ALBUM_ID"]))


@query("SRC03", "SELECT user_id, album_id, rating FROM ratings")
def _(s, d):
    return X.load_ratings(s, _csv(s, view(s, d, "ratings"), ["user_id", "Album_Id", "Rating"]))


@query("SRC04", "SELECT album_id, artist, album_title, genre FROM albums")
def _(s, d):
    rows = view(s, d, "albums").select("album_id", "artist", "album_title", "genre")
    return X.load_albums(s, _csv(s, rows, ["Album_ID", "Artist", "ALBUM_TITLE", "Genre"]))


@query("SRC05", "SELECT user_id, album_id, least(greatest(rating * 21 / 20, 0), 5) AS rating FROM ratings")
def _(s, d):
    return X.rescaled(view(s, d, "ratings").withColumn("rating", c("rating") * 21), "rating")


@query("SRC06", "SELECT album_id, CASE WHEN CAST(album_id AS BIGINT) % 3 = 0 THEN artist ELSE album_title END AS album_title, artist, genre, year, CAST(NULL AS DOUBLE) AS avg_rating FROM albums")
def _(s, d):
    a = view(s, d, "albums").select("album_id", F.when(c("album_id").cast("long") % 3 == 0, " ").otherwise(c("album_title")).alias("title"), c("artist").alias("name"), "artist", "genre", "year")
    return X.scraped_albums(a)


@query("SRC07", "SELECT user_id, album_id, least(rating * 18 / 20, 5) AS rating FROM ratings WHERE CAST(album_id AS BIGINT) % 6 <> 0")
def _(s, d):
    path = shared_path(s, "ratings-json")
    view(s, d, "ratings").select("user_id", F.when(c("album_id").cast("long") % 6 != 0, c("album_id")).alias("album_id"), (c("rating") * 18).alias("rating")).write.json(path)
    docs = s.read.schema("user_id string, album_id string, rating double").json(path).dropna(subset=["user_id", "album_id"])
    return X.rescaled(docs, "rating")


_DOCS = "SELECT album_id AS id, CASE WHEN CAST(album_id AS BIGINT) % 4 = 0 THEN NULL ELSE album_title END AS title, artist AS name, CASE WHEN CAST(album_id AS BIGINT) % 2 = 0 THEN 80.0D END AS critic_score, CAST(CAST(album_id AS BIGINT) % 100 AS DOUBLE) AS user_score, CASE WHEN CAST(album_id AS BIGINT) % 5 = 0 THEN 90.0D END AS rating, split(genre, ', ') AS genres, 'March ' || CAST(year AS STRING) AS release_date FROM albums"


@query("SRC08", "SELECT album_id, CASE WHEN CAST(album_id AS BIGINT) % 4 = 0 THEN artist ELSE album_title END AS album_title, least(greatest(CASE WHEN CAST(album_id AS BIGINT) % 5 = 0 THEN 90.0::DOUBLE WHEN CAST(album_id AS BIGINT) % 2 = 0 THEN (80.0::DOUBLE + CAST(album_id AS BIGINT) % 100) / 2 ELSE CAST(album_id AS BIGINT) % 100 END / 20, 0), 5) AS avg_rating, genre, CAST(CASE WHEN year > 0 THEN year END AS INT) AS year FROM albums")
def _(s, d):
    path = shared_path(s, "albums-json")
    sql(s, d, _DOCS).write.json(path)
    return X.document_albums(s.read.schema(X.DOCUMENT).json(path))


@query("SRC09", """SELECT 'collection' AS kind, 'export' AS origin, count(*) AS n, (SELECT count(*) FROM collection) - count(*) AS dropped FROM collection JOIN releases ON album_id = release_id WHERE master_id IS NOT NULL
UNION ALL SELECT 'wantlist', 'service', count(*), (SELECT count(*) FROM wantlist) - count(*) FROM wantlist JOIN releases ON album_id = release_id WHERE master_id IS NOT NULL UNION ALL SELECT 'ratings', 'file', count(*), 0 FROM ratings""")
def _(s, d):
    mapping = view(s, d, "releases").where("master_id is not null").select("release_id", c("master_id").alias("mapped"))
    path = _csv(s, view(s, d, "collection"), ["user_id", "release_id"])
    none = view(s, d, "wantlist").limit(0)
    sources = {
        "collection": [("service", None), ("export", lambda: X.load_usage(s, path)), ("file", lambda: none)],
        "wantlist": [("service", lambda: view(s, d, "wantlist")), ("file", lambda: none)],
        "ratings": [("service", lambda: none), ("file", lambda: view(s, d, "ratings"))],
    }
    chosen = X.ingest(sources)
    return X.ingest_report(chosen, {k: remap(df, mapping) for k, (_, df) in chosen.items() if k != "ratings"})


#: Releases as elements: the year in its own element, in the date or in neither; artists without a number, labels by attribute or element.
_XML = """SELECT CASE WHEN no % 19 = 0 THEN 'x' || release_id ELSE release_id END AS _id, CASE WHEN no % 23 = 0 THEN 'Deleted' ELSE 'Accepted' END AS _status, title, country,
CASE WHEN no % 4 = 0 THEN CAST(year AS STRING) WHEN no % 4 = 1 THEN 'unknown' END AS year, CASE WHEN no % 4 < 3 THEN CAST(year - 1 + CASE WHEN no % 4 = 2 THEN 1 ELSE 0 END AS STRING) || '-05-01' ELSE 'May' END AS released, master_id,
named_struct('genre', array(genre, 'Rock')) AS genres, named_struct('style', array(' ', style)) AS styles, named_struct('artist', array(named_struct('id', 'none', 'name', 'Nobody'), named_struct('id', CAST(no % 40 AS STRING), 'name', style))) AS artists,
named_struct('label', array(named_struct('_id', CASE WHEN no % 2 = 0 THEN CAST(no % 40 AS STRING) END, '_catno', 'C1', 'id', 'e' || CAST(no % 40 AS STRING), 'name', 'House'))) AS labels,
named_struct('format', array(named_struct('_name', 'Vinyl', '_qty', '1', 'descriptions', named_struct('description', array('LP', CASE WHEN no % 5 = 0 THEN 'Repress' ELSE 'Album' END))), named_struct('_name', CASE WHEN no % 3 = 0 THEN 'Picture Disc' ELSE 'Promo' END, '_qty', '1', 'descriptions', named_struct('description', array('  '))))) AS formats
FROM (SELECT *, CAST(release_id AS BIGINT) AS no FROM releases) q"""
_ROWS = """SELECT release_id, nullif(trim(master_id), '') AS master_id, genre, style, y AS year, y - y % 10 AS decade, nullif(trim(country), '') AS country, 0 AS label_tier, (no % 5 <> 0)::INT AS is_original_pressing, 0 AS is_colored_vinyl, (no % 3 = 0)::INT AS is_picture_disc, (no % 3 <> 0)::INT AS is_promo,
'Vinyl LP ' || d || ', ' || p AS format_desc, '[{"id":"' || (no % 40) || '","name":"' || style || '"}]' AS artists_json, '[{"id":"' || CASE WHEN no % 2 = 0 THEN '' ELSE 'e' END || (no % 40) || '","name":"House","catno":"C1"}]' AS labels_json, '["' || genre || '","Rock"]' AS genres_json, '["' || style || '"]' AS styles_json,
'[{"name":"Vinyl","qty":"1","descriptions":["LP","' || d || '"]},{"name":"' || p || '","qty":"1","descriptions":[]}]' AS formats_json
FROM (SELECT *, CASE WHEN no % 5 = 0 THEN 'Repress' ELSE 'Album' END AS d, CASE WHEN no % 3 = 0 THEN 'Picture Disc' ELSE 'Promo' END AS p, coalesce(CASE no % 4 WHEN 0 THEN year WHEN 1 THEN year - 1 WHEN 2 THEN year END, 0)::INT AS y FROM (SELECT *, CAST(release_id AS BIGINT) AS no FROM releases) q) r WHERE no % 19 <> 0 AND no % 23 <> 0"""


@query("SRC10", _ROWS)
def _(s, d):
    path = shared_path(s, "releases-xml")
    X.write_xml(sql(s, d, _XML), path, "release", "releases")
    return X.release_rows(X.read_xml(s, path, "release", X.RELEASE_XML)).withColumn("country", F.nullif("country", F.lit("")))


@query("SRC11", "SELECT master_id, 'r' || CAST(master_no AS STRING) AS main_release_id, title, year, CAST(master_no % 9 AS STRING) AS primary_artist_id, artist AS primary_artist_name, 'Rock' AS primary_genre FROM masters")
def _(s, d):
    path = shared_path(s, "masters-xml")
    m = view(s, d, "masters").select(
        c("master_id").alias("_id"), F.concat(F.lit("r"), c("master_no").cast("string")).alias("main_release"), "title", c("year").cast("string").alias("year"), F.lit("Correct").alias("data_quality"),
        F.struct(F.array(F.lit("Rock")).alias("genre")).alias("genres"), F.struct(F.array(F.struct((c("master_no") % 9).cast("string").alias("id"), c("artist").alias("name"))).alias("artist")).alias("artists"),
    )
    X.write_xml(m, path, "master", "masters")
    out = X.master_rows(X.read_xml(s, path, "master", X.MASTER_XML))
    return out.select("master_id", "main_release_id", "title", "year", "primary_artist_id", "primary_artist_name", "primary_genre")


@query("SRC12", "SELECT release_id, genre, style, year, decade, country FROM releases")
def _(s, d):
    body = F.to_json(F.struct(c("release_id").cast("long").alias("id"), "title", F.coalesce("year", F.lit(0)).alias("year"), "country", F.array("genre").alias("genres"), F.array("style").alias("styles")))
    return X.api_rows(view(s, d, "releases").select(body.alias("body")), "body").select("release_id", "genre", "style", "year", "decade", "country")


@query("SRC13", "SELECT release_id, genre, style, year, decade FROM releases")
def _(s, d):
    rows = view(s, d, "releases").select("release_id", "genre", "style", "year", "decade")
    df = X.read_csv(s, _csv(s, rows, ["Release_ID", "Genre", "Style", "Year", "Decade"]))
    return df.withColumns({"year": c("year").cast("int"), "decade": c("decade").cast("int")})


#: Cells and headers of the four kinds of page, in their order: date, media, sleeve, price, price in the user's currency.
_HEADS = ("Order Date|Condition|Sleeve Condition|Price|Price in Your Currency", "order  date|Sleeve Condition|Media Condition|Your Currency|Price", "Order Date|Media Condition|Jacket Condition|Original Price|Price in Your Currency", "Order Date|Vinyl Condition|Cover Condition|Your Currency|Price")
_CELLS = ("D M S P U", "D S M U P", "D M S P U", "D M S U P")
_PIECE = {"D": "date_format(l_shipdate, 'yyyy-MM-dd')", "M": "l_returnflag", "S": "l_linestatus", "P": "'&euro;' || cast(cast(l_quantity as int) as string) || ',00'", "U": "'US$' || cast(cast(l_quantity as int) + 1 as string) || '.50'"}


def _sale_page() -> str:
    """Pages of four kinds: names and order of columns, attributes, a table of something else before, closing tags left out."""
    td = lambda x, k: f"'<TD align=left>' || {x}" if k == 3 else f"'<td class=\"c\" data-n=\"1\"><span>' || {x} || '</span></td>'"
    row = "CASE l_orderkey % 4 " + " ".join(f"WHEN {k} THEN " + " || ".join(td(_PIECE[x], k) for x in cells.split()) for k, cells in enumerate(_CELLS)) + " END"
    end = "CASE WHEN l_orderkey % 4 = 3 THEN '' ELSE '</tr>' END"
    note = "CASE WHEN l_linenumber % 2 = 0 THEN '<tr class=\"sub\"><td colspan=\"5\">note <b>' || cast(l_partkey as string) || '</b> &amp; more</td></tr>' ELSE '' END"
    head = "CASE l_orderkey % 4 " + " ".join(f"WHEN {k} THEN '" + "".join(f"<th scope=\"col\">{h}</th>" for h in heads.split("|")) + "'" for k, heads in enumerate(_HEADS)) + " END"
    other = "CASE WHEN l_orderkey % 4 = 1 THEN '<table><tr><th>Format</th></tr><tr><td>2001-01-01</td></tr></table>' ELSE '' END"
    name = "CASE WHEN l_orderkey % 4 = 1 THEN ' class=\"x sales-history-table\"' ELSE '' END"
    sums = "'<div>Last Sold On: ' || date_format(max(l_shipdate), 'dd MMM yyyy') || '</div><ul><li>Average: $' || cast(count(*) as string) || '.25</li><li>Median: $' || cast(count(*) as string) || '</li><li>High: $1,' || cast(100 + count(*) as string) || '.50</li></ul>'"
    lines = f"concat_ws('', transform(array_sort(collect_list(struct(l_linenumber, '<tr>' || {row} || {end} || {note} AS tr))), x -> x.tr))"
    return f"SELECT l_orderkey AS page_id, '<body>' || {sums} || {other} || '<table' || {name} || '><thead><tr>' || {head} || '</tr></thead>' || {lines} || '</table></body>' AS html FROM lineitem GROUP BY l_orderkey"


@query("SRC14", "SELECT l_orderkey AS page_id, strftime(l_shipdate, '%Y-%m-%d') AS order_date, l_returnflag AS media_condition, l_linestatus AS sleeve_condition, '€' || CAST(CAST(l_quantity AS INT) AS STRING) || ',00' AS price_text, 'US$' || CAST(CAST(l_quantity AS INT) + 1 AS STRING) || '.50' AS user_price_text, CASE WHEN l_linenumber % 2 = 0 THEN 'note ' || CAST(l_partkey AS STRING) || ' & more' ELSE '' END AS comments FROM lineitem")
def _(s, d):
    return H.sale_rows(sql(s, d, _sale_page())).drop("sale")


@query("SRC14_summary", "SELECT l_orderkey AS page_id, strftime(max(l_shipdate), '%d %b %Y') AS last_sold_on, count(*) + 0.25::DOUBLE AS average, count(*)::DOUBLE AS median, 1100.5::DOUBLE + count(*) AS high, NULL::DOUBLE AS low FROM lineitem GROUP BY 1")
def _(s, d):
    return H.sale_summary(sql(s, d, _sale_page()))


#: Items of an order and supplier; an item that a page lists again at its end counts once.
_LIST = """SELECT l_suppkey AS page_id, '<div id="pjax_container"><table><thead><tr><th>Item</th></tr></thead><tbody>' || concat_ws('', transform(array_sort(collect_list(struct(again, l_orderkey, '<tr class="shortcut"><td class="image"><a href="/sell/item/1">img</a></td><td class="item_description x"><strong><a class="t" href="https://market.example/sell/item/' || cast(l_orderkey as string) || '?ev=1">'
|| CASE WHEN again = 1 THEN 'Later - Copy' WHEN l_orderkey % 4 = 0 THEN 'Untitled' ELSE flag || ' &amp; Co - Song - ' || status END || '</a></strong><p class="item_condition"><span>Media:</span> NM or M-<br>' || CASE l_orderkey % 3 WHEN 0 THEN 'Jacket' WHEN 1 THEN 'Cover' ELSE 'Sleeve' END || ': VG+</p><p>ships  from <i>' || status || '</i></p></td></tr>' AS tr))), x -> x.tr)) || '</tbody></table></div>' AS html
FROM (SELECT l_suppkey, l_orderkey, min(l_returnflag) AS flag, max(l_linestatus) AS status, explode(array(0, 1)) AS again FROM lineitem GROUP BY l_suppkey, l_orderkey) q GROUP BY l_suppkey"""


@query("SRC15", "SELECT l_suppkey AS page_id, CAST(l_orderkey AS STRING) AS listing_id, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE min(l_returnflag) || ' & Co' END AS artist, CASE WHEN l_orderkey % 4 = 0 THEN 'Untitled' ELSE 'Song - ' || max(l_linestatus) END AS title, 'NM or M-' AS media, 'VG+' AS sleeve, 'ships from ' || max(l_linestatus) AS comments FROM lineitem GROUP BY 1, l_orderkey")
def _(s, d):
    return H.listing_rows(sql(s, d, _LIST))


@query("SRC16", "SELECT DISTINCT page_id, word FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS word FROM pages) q")
def _(s, d):
    return X.linked_ids(table(s, d, "pages"), r'href="/([^"]+)"').select("page_id", c("release_id").alias("word"))


#: Search pages: a results block among other links, links without a block, a shell that has paths in its markup only.
_SEARCH = """SELECT o_custkey AS page_id, CASE o_custkey % 3 WHEN 2 THEN '<script>{"a":"' ELSE '<nav><a href="/release/999999999-menu">m</a></nav>' END || CASE o_custkey % 3 WHEN 0 THEN '<div class="w" id="search_results"><div>' ELSE '' END
|| concat_ws('', transform(array_sort(collect_list(o_orderkey)), k -> CASE o_custkey % 3 WHEN 2 THEN '/release/' || cast(k as string) || '-x' WHEN 1 THEN '<a class="c" href="https://www.example.com/release/' || cast(k as string) || '?a=/release/5">t</a>' ELSE '<div><a href="/release/' || cast(k as string) || '-t#p">t</a></div><a href="/release/' || cast(k as string) || '">again</a>' END))
|| CASE o_custkey % 3 WHEN 0 THEN '</div></div><a href="/release/888888888">aside</a>' WHEN 2 THEN '"}</script>' ELSE '' END AS html FROM orders GROUP BY o_custkey"""


@query("SRC16_search", "SELECT o_custkey AS page_id, CAST(o_orderkey AS STRING) AS release_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - CASE WHEN o_custkey % 3 = 1 THEN 0 ELSE 1 END AS pos FROM orders UNION ALL SELECT DISTINCT o_custkey, '999999999', 0 FROM orders WHERE o_custkey % 3 = 1")
def _(s, d):
    return H.linked_ids(sql(s, d, _SEARCH))


@query("SRC17", "SELECT count(*) FILTER (WHERE event_id % 9 <> 0) AS good, count(*) FILTER (WHERE event_id % 9 = 0) AS malformed FROM events")
def _(s, d):
    path = shared_path(s, "jsonl")
    line = F.when(c("event_id") % 9 == 0, F.lit('{"event_id": 1, "props')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    table(s, d, "events").select(line.alias("value")).write.text(path)
    rows = X.json_lines(s, path, "event_id long, event_type string")
    bad = c("_corrupt_record").isNotNull()
    return rows.agg(F.count_if(~bad & c("event_id").isNotNull()).alias("good"), F.count_if(bad).alias("malformed"))


@query("SRC18", "SELECT s.release_id, l_orderkey, l_linenumber FROM sales s JOIN fetches f ON s.release_id = f.release_id WHERE f.status = 'ok'")
def _(s, d):
    return X.sale_source(view(s, d, "sales"), view(s, d, "fetches"), ["l_orderkey", "l_linenumber"]).select("release_id", "l_orderkey", "l_linenumber")


@query("SRC18_random", "SELECT release_id, l_orderkey, l_linenumber FROM sales ORDER BY md5('11/' || release_id || '/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING)), release_id, l_orderkey, l_linenumber LIMIT 500")
def _(s, d):
    return X.sale_source(view(s, d, "sales"), None, ["l_orderkey", "l_linenumber"], limit=500, seed=11).select("release_id", "l_orderkey", "l_linenumber")


@query("SRC19", "SELECT release_id || '-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, media_condition AS condition, sleeve_condition, coalesce(seller_comments, '') AS comments FROM sales")
def _(s, d):
    return X.sale_as_listing(view(s, d, "sales").withColumn("seller_comments", F.concat(F.lit("Comments: "), "seller_comments")))


_G = "CASE lower(trim({})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.CONDITION_GRADES.items()) + " END"


@query("SRC20", f"SELECT release_id || '-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS item_id, 'inventory' AS source, coalesce(trim(regexp_replace(seller_comments, '\\s+', ' ', 'g')), '') AS text, {_G.format('media_condition')} AS media_label, {_G.format('sleeve_condition')} AS sleeve_label, 1.0::DOUBLE AS label_confidence, artist, title, year, CASE WHEN trim(coalesce(country, '')) <> '' THEN country ELSE '' END AS country, coalesce(format_desc, '') AS format, media_condition AS raw_media, sleeve_condition AS raw_sleeve FROM sales JOIN (SELECT release_id, coalesce(substr(master_id, 1, instr(master_id, '/') - 1), '') AS artist, title, year, country, format_desc FROM releases) r USING (release_id)")
def _(s, d):
    r = sql(s, d, "SELECT release_id, coalesce(substr(master_id, 1, instr(master_id, '/') - 1), '') AS artist, title, year, country, format_desc AS format FROM releases")
    listings = X.sale_as_listing(view(s, d, "sales"), "release_id").join(r, "release_id")
    return X.unified_listings(listings).select("item_id", "source", "text", "media_label", "sleeve_label", "label_confidence", "artist", "title", "year", "country", "format", "raw_media", "raw_sleeve")


_TOK = "CASE event_id % 7 WHEN 0 THEN 'S' WHEN 1 THEN 'M-' WHEN 2 THEN 'E+ (edge wear)' WHEN 3 THEN 'e' WHEN 4 THEN 'E- to VG' WHEN 5 THEN 'VG+' ELSE 'unknown' END"
_TOK2 = "CASE event_id % 5 WHEN 0 THEN 'E-: small tear' WHEN 1 THEN 'M-' WHEN 2 THEN NULL ELSE 'VG' END"


@query("SRC21", """WITH g AS (SELECT event_id, event_id % 7 AS m, event_id % 5 AS k FROM events)
SELECT event_id, CASE m WHEN 0 THEN 'Mint' WHEN 1 THEN 'Near Mint' WHEN 2 THEN 'Near Mint' WHEN 3 THEN 'Excellent' WHEN 4 THEN 'Excellent' WHEN 5 THEN 'Very Good Plus' END AS media_label,
CASE k WHEN 0 THEN 'Excellent' WHEN 1 THEN 'Near Mint' WHEN 2 THEN NULL ELSE 'Very Good' END AS sleeve_label,
CASE m WHEN 2 THEN '(edge wear)' WHEN 4 THEN 'to VG' ELSE '' END AS media_suffix, CASE k WHEN 0 THEN ': small tear' ELSE '' END AS sleeve_suffix,
least(CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 4 THEN 0.85 WHEN 6 THEN NULL ELSE 0.95 END, CASE k WHEN 0 THEN 0.85 WHEN 1 THEN 1.0 WHEN 2 THEN NULL ELSE 0.95 END)::DOUBLE AS label_confidence FROM g""")
def _(s, d):
    named = F.array(F.struct(F.lit("Record Grading").alias("name"), F.expr(_TOK).alias("value")), F.struct(F.lit("SLEEVE grading").alias("name"), F.expr(_TOK2).alias("value")))
    items = table(s, d, "events").select("event_id", named.alias("aspects"))
    return X.auction_items(items, "record grading", "Sleeve Grading").select("event_id", "media_label", "sleeve_label", "media_suffix", "sleeve_suffix", "label_confidence")


@query("SRC22", "SELECT event_id, event_type FROM events")
def _(s, d):
    path = shared_path(s, "pages-json")
    pages = table(s, d, "events").groupBy((c("event_id") % 50).alias("page")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("listings"))
    pages.write.partitionBy("page").json(path)
    read = s.read.schema("listings array<struct<event_id:long,event_type:string>>").json(f"{path}/page=*")
    return read.select(F.explode("listings").alias("x")).select("x.*")


@query("SNK01", "SELECT user_id, album_id FROM collection")
def _(s, d):
    return X.parquet_round_trip(view(s, d, "collection"))


@query("SNK03", "SELECT release_id AS key, master_id AS value FROM releases WHERE master_id IS NOT NULL")
def _(s, d):
    path = shared_path(s, "map")
    X.write_map(view(s, d, "releases"), path, "release_id", "master_id")
    return X.read_map(s, path)
