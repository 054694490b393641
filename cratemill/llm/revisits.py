"""Resolving not-modified revisits of a web archive.

A revisit record (status 304) says that a page has not changed and carries no body. It is resolved by an as-of join on the
canonical URL: the latest earlier full response is looked up, the validators are checked, and the headers that a 304 may
renew are merged into the response's headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Header fields that a 304 response may renew (RFC 9110, section 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not change what a URL names.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host lower-cased without www. and default port, fragment, tracking parameters and a final / dropped.

    Null or without :// is null: it names no page.
    """
    rest = F.regexp_extract(url, r"(?s)^.*?://([^#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING)))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then clash, the last value stays. Null is empty."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def merge_headers(stored: Column, renewed: Column) -> Column:
    """The stored headers with the permitted ones of a 304 laid over them."""
    allowed = F.map_filter(renewed, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve(records: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Of every revisit in records: record_id, url_key, captured_at, status, source_record_id, source_captured_at, headers.

    records: record_id long, url string, captured_at timestamp, kind string (response or revisit), http_status int,
    headers map<string,string>, digest string. Full responses are of kind response with status 200.
    Earlier is before in time; at equal times the larger record_id is the later. status is resolved, no_response (none is
    earlier) or changed (a validator differs: entity tag if both have one, else Last-Modified if both have it; and the
    payload digest if both have it). Only a resolved revisit gets headers. A null URL or time is no_response.
    Records that repeat in full give repeated result rows; other columns are ignored.

    The history of one URL may be most of the data, so it is cut into slices of time: inside a slice a window carries the
    latest response forward, and between slices only each slice's last response is handed on.
    """
    at = common.pick(records, "record_id", "url", "captured_at", "kind", "http_status", "headers", "digest")
    at = at.select("record_id", "captured_at", "kind", "http_status", "digest", canonical_url(F.col("url")).alias("url_key"), lower_keys(F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("http_status") == 200)
    revisit = F.col("kind") == "revisit"
    usable = at.where((full | revisit) & F.col("url_key").isNotNull() & F.col("captured_at").isNotNull())
    source = F.struct(F.col("captured_at").alias("t"), F.col("record_id").alias("id"), F.col("headers").alias("h"), F.col("digest").alias("d"))
    usable = common.materialize(usable, "captures")
    cut = usable.withColumns({"slice": F.floor(F.unix_seconds("captured_at") / slice_seconds), "response": F.when(full, source)})
    inside = Window.partitionBy("url_key", "slice").orderBy("captured_at", "record_id")
    near = cut.withColumns({"near": F.last("response", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))}).where(revisit)
    # at equal times nothing is earlier
    order = F.struct(F.col("response.t").alias("t"), F.col("response.id").alias("id"))
    last = cut.where("response is not null").groupBy("url_key", "slice").agg(F.max_by("response", order).alias("last"))
    asked = near.where("near is null").select("url_key", "slice").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    between = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    steps = last.unionByName(asked).groupBy("url_key", "slice").agg(F.max_by("last", F.col("last.t")).alias("last"))
    handed = steps.withColumn("far", F.last("last", ignorenulls=True).over(between)).select(F.col("url_key").alias("k"), F.col("slice").alias("s"), "far")
    found = near.join(handed, (near["url_key"] == handed["k"]) & (near["slice"] == handed["s"]), "left").withColumn("src", F.coalesce("near", "far"))
    h, s = F.col("headers"), F.col("src.h")
    tags = (h["etag"], s["etag"])
    dates = (h["last-modified"], s["last-modified"])
    valid = F.when(tags[0].isNotNull() & tags[1].isNotNull(), F.regexp_replace(tags[0], "^W/", "") == F.regexp_replace(tags[1], "^W/", "")).when(dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1]).otherwise(F.lit(True))
    valid = valid & F.coalesce(F.col("digest") == F.col("src.d"), F.lit(True))
    status = F.when(F.col("src").isNull(), "no_response").when(valid, "resolved").otherwise("changed")
    cols = ["record_id", "url_key", "captured_at", "status", "source_record_id", "source_captured_at", "headers"]
    out = found.withColumns({"status": status}).withColumns({
        "source_record_id": F.when(F.col("status") == "resolved", F.col("src.id")),
        "source_captured_at": F.when(F.col("status") == "resolved", F.col("src.t")),
        "headers": F.when(F.col("status") == "resolved", merge_headers(s, h)),
    }).select(*cols)
    lost = at.where(revisit & (F.col("url_key").isNull() | F.col("captured_at").isNull())).withColumns({"status": F.lit("no_response"), "source_record_id": F.lit(None).cast("long"), "source_captured_at": F.lit(None).cast("timestamp"), "headers": F.lit(None).cast("map<string,string>")}).select(*cols)
    return out.unionByName(lost)


def captures(pages: DataFrame) -> DataFrame:
    """Archive records derived from a page table (page_id, url, html), for tables that have no capture history of their own.

    Every page is a full response, captured page_id minutes after the start of 2024, and is asked for again 12 and 36 hours later
    (two revisits). The entity tag is the MD5 of the body. Every seventh page had changed by the second revisit. Every fifth
    server sends no entity tag but Last-Modified.
    """
    p = common.pick(pages, "page_id", "url", "html").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("body"))
    n = F.col("visit")
    tag = F.when((n == 2) & (F.pmod("page_id", F.lit(7)) == 0), F.md5(F.concat("body", F.lit("!")))).otherwise(F.col("body"))
    minutes = F.col("page_id") + F.element_at(F.array(F.lit(0), F.lit(720), F.lit(2160)), n + 1)
    stamp = F.timestamp_seconds(F.lit(1704067200) + minutes * 60)
    with_tag = F.pmod("page_id", F.lit(5)) != 0
    validator = F.when(with_tag, F.create_map(F.lit("ETag"), F.concat(F.lit('"'), "tag", F.lit('"')))).otherwise(F.create_map(F.lit("Last-Modified"), F.col("tag")))
    headers = F.map_concat(validator, F.create_map(F.lit("Date"), F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"), F.lit("Content-Length"), F.when(n == 0, F.lit("1")).otherwise("0")))
    return p.withColumn("visit", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumns({"captured_at": stamp, "tag": tag}).select(
        (F.col("page_id") * 3 + n).alias("record_id"), "url", "captured_at", F.when(n == 0, "response").otherwise("revisit").alias("kind"),
        F.when(n == 0, 200).otherwise(304).alias("http_status"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"),
    )


ORACLE = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS body, regexp_extract(url, '^[\s\S]*?://([^#]*)', 1) AS rest FROM pages),
k AS (SELECT page_id, body, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url_key
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN
    ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid', 'gclid'))) AS q FROM p)),
c AS (SELECT page_id * 3 + v AS record_id, page_id, url_key, v, page_id % 5 <> 0 AS tagged,
    make_timestamp((1704067200 + (page_id + [0, 720, 2160][v + 1]) * 60) * 1000000) AS captured_at,
    CASE WHEN v = 2 AND page_id % 7 = 0 THEN md5(body || '!') ELSE body END AS tag
  FROM k, (SELECT unnest([0, 1, 2]) AS v)),
r AS (SELECT v.record_id, v.url_key, v.captured_at, v.tagged, v.tag, max_by(s, s.record_id) AS s FROM
  (SELECT a.*, max(b.captured_at) AS t FROM c a LEFT JOIN c b ON b.v = 0 AND b.url_key = a.url_key AND (b.captured_at < a.captured_at OR b.captured_at = a.captured_at AND b.record_id < a.record_id)
    WHERE a.v > 0 GROUP BY ALL) v
  LEFT JOIN c s ON s.v = 0 AND s.url_key = v.url_key AND s.captured_at = v.t AND (s.captured_at < v.captured_at OR s.record_id < v.record_id) GROUP BY ALL),
j AS (SELECT *, CASE WHEN s.record_id IS NULL THEN 'no_response' WHEN tagged = s.tagged AND tag <> s.tag THEN 'changed' ELSE 'resolved' END AS status FROM r)
SELECT record_id, url_key, captured_at, status, CASE WHEN status = 'resolved' THEN s.record_id END AS source_record_id,
  CASE WHEN status = 'resolved' THEN s.captured_at END AS source_captured_at,
  CASE WHEN status = 'resolved' THEN array_to_string(list_sort(list_filter([
    'content-length=1', 'date=' || strftime(captured_at, '%Y-%m-%d %H:%M:%S'),
    CASE WHEN tagged THEN 'etag="' || tag || '"' WHEN s.tagged THEN 'etag="' || s.tag || '"' END,
    CASE WHEN NOT tagged THEN 'last-modified=' || tag WHEN NOT s.tagged THEN 'last-modified=' || s.tag END], lambda x: x IS NOT NULL)), ';') END AS headers
FROM j
"""
