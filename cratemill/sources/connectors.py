"""Readers and writers: CSV, JSON lines, XML dumps, HTML pages, canonical Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratemill.functions import catalogue as C
from cratemill.functions import notes
from cratemill.streaming.incremental import shared_path


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower() for c in df.columns))


def read_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Headers lower-cased, all text; quotes inside fields are kept.

    line_breaks: fields may hold line breaks. Then every file is one task; without, large files are split.
    """
    return lower_headers(spark.read.csv(path, header=True, escape='"', multiLine=line_breaks))


def load_usage(spark: SparkSession, path: str) -> DataFrame:
    """Collection or wantlist: release_id stands for album_id, rows without a key go, ids are text."""
    df = read_csv(spark, path)
    if "album_id" not in df.columns:
        df = df.withColumnRenamed("release_id", "album_id")
    return df.select("user_id", "album_id").dropna()


def load_ratings(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    return df.select("user_id", "album_id", F.col("rating").try_cast("double").alias("rating")).dropna(subset=["user_id", "album_id"])


def load_albums(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path).withColumn("album_id", F.col("album_id").cast("string"))


def rescaled(df: DataFrame, column: str) -> DataFrame:
    """Ratings out of 100 to 0..5: if any is above 10, all are divided by 20; then clipped."""
    top = df.agg(F.max(column).alias("__top"))
    x = F.when(F.col("__top") > 10, F.col(column) / 20).otherwise(F.col(column))
    return df.join(F.broadcast(top)).withColumn(column, F.least(F.greatest(x, F.lit(0.0)), F.lit(5.0))).drop("__top")


def scraped_albums(df: DataFrame) -> DataFrame:
    """Album metadata: the title from the first of several columns that is there and filled, optional columns with defaults."""
    title = [F.nullif(F.trim(c), F.lit("")) for c in ("album_title", "title", "album", "name") if c in df.columns]
    opt = lambda c, t: (F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c)
    return df.select(F.col("album_id").cast("string").alias("album_id"), F.coalesce(*title, F.lit("")).alias("album_title"), opt("artist", "string"), opt("genre", "string"), opt("year", "int"), opt("avg_rating", "double"))


DOCUMENT = "id string, title string, name string, critic_score double, user_score double, rating double, genres array<string>, release_date string"


def document_albums(df: DataFrame) -> DataFrame:
    """Album documents: title fallback, the mean of both scores without a rating of its own, genres as text, year from the date."""
    scores = F.array_compact(F.array("critic_score", "user_score"))
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / F.size(scores))
    out = df.select(F.col("id").alias("album_id"), F.coalesce("title", "name").alias("album_title"), F.coalesce("rating", mean).alias("avg_rating"), F.array_join("genres", ", ").alias("genre"), C.year_of(F.col("release_date")).alias("year"))
    return rescaled(out, "avg_rating")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the malformed ones in column _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


RELEASE_XML = (
    "_id string, _status string, title string, country string, year string, released string, master_id string, genres struct<genre:array<string>>, styles struct<style:array<string>>, "
    "artists struct<artist:array<struct<id:string,name:string>>>, labels struct<label:array<struct<_id:string,_name:string,_catno:string,id:string,name:string,catno:string>>>, "
    "formats struct<format:array<struct<_name:string,_qty:string,descriptions:struct<description:array<string>>>>>"
)
MASTER_XML = "_id string, main_release string, title string, year string, data_quality string, genres struct<genre:array<string>>, styles struct<style:array<string>>, artists struct<artist:array<struct<id:string,name:string>>>"


def _filled(list_: Column) -> Column:
    """The texts of a list without blanks at their ends; empty ones go, and a missing list is empty."""
    return F.coalesce(F.filter(F.transform(list_, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), F.array().cast("array<string>"))


def _json(list_: Column) -> Column:
    return F.when(F.size(list_) > 0, F.to_json(list_))


def release_rows(xml: DataFrame) -> DataFrame:
    """Feature rows of a release dump: deleted releases and ids that are no numbers go.

    The year is the four digits that the element year starts with, else those of released, else 0; the decade is 0 with it. Lists are JSON
    text, null if empty: artists only with a number as id, labels by their attributes or else their elements. A format's text is its name
    and its descriptions, formats are joined by commas; flags are read from that text, the first pressing from the descriptions.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    either = lambda x, k: F.when(text(x[f"_{k}"]) != "", text(x[f"_{k}"])).otherwise(text(x[k]))
    digits = lambda c: F.nullif(F.regexp_extract(F.trim(c), r"^(\d{4})", 1), F.lit("")).cast("int")
    lists = {
        "genres": _filled(F.col("genres.genre")),
        "styles": _filled(F.col("styles.style")),
        "artists": F.transform(F.filter("artists.artist", lambda a: F.rlike(text(a["id"]), F.lit("^[0-9]+$"))), lambda a: F.struct(text(a["id"]).alias("id"), text(a["name"]).alias("name"))),
        "labels": F.filter(F.transform("labels.label", lambda x: F.struct(*(either(x, k).alias(k) for k in ("id", "name", "catno")))), lambda x: F.concat(x["id"], x["name"], x["catno"]) != ""),
        "formats": F.transform("formats.format", lambda f: F.struct(text(f["_name"]).alias("name"), text(f["_qty"]).alias("qty"), _filled(f["descriptions"]["description"]).alias("descriptions"))),
    }
    rows = xml.where((text(F.col("_status")) != "Deleted") & F.rlike(text(F.col("_id")), F.lit("^[0-9]+$"))).withColumns({f"__{k}": v for k, v in lists.items()})
    parts = F.transform("__formats", lambda f: F.trim(F.concat_ws(" ", f["name"], F.array_join(f["descriptions"], " "))))
    rows = rows.withColumns({
        "__year": F.coalesce(digits(F.col("year")), digits(F.col("released")), F.lit(0)),
        "__desc": F.nullif(F.array_join(F.filter(parts, lambda p: p != ""), ", "), F.lit("")),
        "__json": _json(F.col("__formats")),
    })
    return rows.select(
        text(F.col("_id")).alias("release_id"), F.nullif(F.trim("master_id"), F.lit("")).alias("master_id"), F.get("__genres", F.lit(0)).alias("genre"), F.get("__styles", F.lit(0)).alias("style"),
        F.col("__year").alias("year"), (F.floor(F.col("__year") / 10) * 10).cast("int").alias("decade"), F.trim("country").alias("country"), F.lit(0).alias("label_tier"),
        C.is_original(F.col("__json"), F.col("__desc")).alias("is_original_pressing"), *(v.alias(k) for k, v in C.text_flags(F.col("__desc")).items()), F.col("__desc").alias("format_desc"),
        *(_json(F.col(f"__{k}")).alias(f"{k}_json") for k in ("artists", "labels", "genres", "styles")), F.col("__json").alias("formats_json"),
    )


def write_xml(df: DataFrame, path: str, tag: str, root: str, rows_per_file: int = 20_000) -> None:
    """df as a dump of rowTag elements in files of at most so many rows: the reader can't split an XML file, so a file is what one task reads."""
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt.write.format("xml").option("rowTag", tag).option("rootTag", root).option("maxRecordsPerFile", rows_per_file).save(path)


def read_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """A dump of rowTag elements. A file is read by one task; what a gzip file holds is dealt out before it is worked on."""
    df = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if path.endswith(".gz") else df


def master_rows(xml: DataFrame) -> DataFrame:
    first = lambda c: F.get(c, F.lit(0))
    return xml.select(
        F.col("_id").alias("master_id"), F.col("main_release").alias("main_release_id"), "title", F.col("year").try_cast("int").alias("year"), first("artists.artist")["id"].alias("primary_artist_id"),
        first("artists.artist")["name"].alias("primary_artist_name"), first("genres.genre").alias("primary_genre"), first("styles.style").alias("primary_style"), "data_quality",
    )


API_RELEASE = "id long, master_id long, title string, year int, country string, genres array<string>, styles array<string>, formats array<struct<name:string,qty:string,descriptions:array<string>>>, artists array<struct<id:long,name:string>>"


def api_rows(df: DataFrame, column: str) -> DataFrame:
    """Feature rows of API-shaped JSON text."""
    j = df.select(F.from_json(column, API_RELEASE).alias("j")).where("j.id is not null")
    y = F.col("j.year")
    return j.select(
        F.col("j.id").cast("string").alias("release_id"), F.col("j.master_id").cast("string").alias("master_id"), F.get("j.genres", F.lit(0)).alias("genre"), F.get("j.styles", F.lit(0)).alias("style"),
        F.when(y > 0, y).alias("year"), F.when(y > 0, (F.floor(y / 10) * 10).cast("int")).alias("decade"), "j.country", F.to_json("j.formats").alias("formats_json"),
    )


def canonical(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in their order; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def parquet_round_trip(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_round_trip(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "csv")
    df.write.csv(path, header=True, escape='"', emptyValue='""', nullValue="\\N")
    return df.sparkSession.read.schema(df.schema).csv(path, header=True, escape='"', emptyValue="", nullValue="\\N")


def write_map(df: DataFrame, path: str, key: str, value: str) -> None:
    """A key-value map as JSON lines, null values left out, sorted within files."""
    df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value")).repartitionByRange("key").sortWithinPartitions("key").write.json(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value string").json(path)


def linked_ids(pages: DataFrame, pattern: str = r'href="/release/(\d+)') -> DataFrame:
    """(page_id, release_id, pos): distinct ids linked from every page, in the order seen."""
    ids = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("pos", "release_id"))
    return ids.groupBy("page_id", "release_id").agg(F.min("pos").alias("pos"))


def sale_source(sales: DataFrame, fetches: DataFrame | None, keys: list[str], limit: int | None = None, seed: int | None = None) -> DataFrame:
    """Sales as a source of listings: only of releases whose fetch is ok, if fetches are given; all of them unless limit is.

    A limit takes the first by release and keys, or with a seed a random sample that reruns repeat.
    """
    rows = sales if fetches is None else sales.join(fetches.where("status = 'ok'").select("release_id").distinct(), "release_id", "left_semi")
    if limit is None:
        return rows
    text = F.concat_ws("/", F.lit(str(seed)), "release_id", *(F.col(k).cast("string") for k in keys))
    order = [F.col("release_id").cast("long"), *keys] if seed is None else [F.md5(text), "release_id", *keys]
    return rows.orderBy(*order).limit(limit)


def sale_as_listing(df: DataFrame, *keep: str) -> DataFrame:
    """A sale row in the shape of an inventory listing; the prefix Comments: goes."""
    return df.select(
        *keep,
        F.concat_ws("-", "release_id", "l_orderkey", "l_linenumber").alias("id"), F.col("media_condition").alias("condition"), "sleeve_condition", F.trim(F.regexp_replace(F.coalesce("seller_comments", F.lit("")), r"(?i)^\s*comments:\s*", "")).alias("comments")
    )


#: Condition names of listings and the grades they stand for.
CONDITION_GRADES = {
    "mint (m)": "Mint", "near mint (nm or m-)": "Near Mint", "very good plus (vg+)": "Very Good Plus", "very good (vg)": "Very Good", "vg": "Very Good",
    "good plus (g+)": "Good", "good (g)": "Good", "fair (f)": "Poor", "poor (p)": "Poor", "generic": "Generic", "no cover": "Generic",
}
#: Grade tokens of auction listings, the grade and the trust in it.
AUCTION_GRADES = {"S": ("Mint", 1.0), "M-": ("Near Mint", 1.0), "E+": ("Near Mint", 0.95), "E": ("Excellent", 0.95), "E-": ("Excellent", 0.85), "VG+": ("Very Good Plus", 0.95), "VG": ("Very Good", 0.95)}


def grade_of(condition: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in CONDITION_GRADES.items() for x in kv))
    return F.try_element_at(table, F.lower(F.trim(condition)))


def unified_listings(df: DataFrame) -> DataFrame:
    """Records of inventory listings: item_id, source, text, labels and raw grades, confidence and metadata.

    df: id, condition, sleeve_condition, comments and, where known, artist, title, year, country, format. Seller comments are cleaned
    of links, pictures and boilerplate. Grades that the condition map lacks are null; blank metadata is an empty text.
    """
    filled = lambda c: (F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("")) if c in df.columns else F.lit("")).alias(c)
    text = notes.without_boilerplate(notes.seller_text(F.coalesce("comments", F.lit(""))))
    return df.select(
        F.col("id").alias("item_id"), F.lit("inventory").alias("source"), text.alias("text"), grade_of(F.col("condition")).alias("media_label"), grade_of(F.col("sleeve_condition")).alias("sleeve_label"),
        F.lit(1.0).alias("label_confidence"), filled("artist"), filled("title"), (F.col("year") if "year" in df.columns else F.lit(None)).cast("int").alias("year"), filled("country"), filled("format"),
        F.col("condition").alias("raw_media"), F.col("sleeve_condition").alias("raw_sleeve"),
    )


_GRADE = r"^(?i)(VG\+|VG|E\+|E-|E|M-|S)(?![a-z])"


def auction_grade(token: Column) -> tuple[Column, Column]:
    """Grade and confidence of an auction's grade token (the longest token that the text starts with)."""
    t = F.upper(F.regexp_extract(F.trim(token), _GRADE, 1))
    grade = F.create_map(*(F.lit(x) for k, (g, _) in AUCTION_GRADES.items() for x in (k, g)))
    trust = F.create_map(*(F.lit(x) for k, (_, c) in AUCTION_GRADES.items() for x in (k, c)))
    return F.try_element_at(grade, t), F.try_element_at(trust, t)


def auction_items(df: DataFrame, media_field: str, sleeve_field: str) -> DataFrame:
    """df (aspects: array of name and value) with raw and graded media and sleeve, what follows their tokens, and label_confidence.

    Names are compared without letter case; of equal ones the last counts. The confidence of a record is the lower of both.
    """
    of = lambda name: F.get(F.filter(F.reverse("aspects"), lambda a: F.lower(F.trim(a["name"])) == name.lower()), F.lit(0))["value"]
    raw = {"media": of(media_field), "sleeve": of(sleeve_field)}
    out = df.withColumns({f"raw_{k}": v for k, v in raw.items()})
    graded = {k: auction_grade(F.col(f"raw_{k}")) for k in raw}
    suffix = lambda k: F.when(graded[k][0].isNotNull(), F.trim(F.regexp_replace(F.trim(f"raw_{k}"), _GRADE, ""))).otherwise("")
    return out.withColumns({f"{k}_label": graded[k][0] for k in raw} | {f"{k}_suffix": suffix(k) for k in raw} | {"label_confidence": F.least(graded["media"][1], graded["sleeve"][1])})


def ingest(sources: dict[str, list[tuple[str, Callable[[], DataFrame] | None]]]) -> dict[str, tuple[str, DataFrame]]:
    """Of every kind of input the first source that is there and has rows, else the last one that is there: its name and its rows."""
    chosen = {}
    for kind, options in sources.items():
        there = [(name, load()) for name, load in options if load is not None]
        chosen[kind] = next(((name, df) for name, df in there if not df.isEmpty()), there[-1])
    return chosen


def ingest_report(chosen: dict[str, tuple[str, DataFrame]], mapped: dict[str, DataFrame]) -> DataFrame:
    """(kind, origin, n, dropped): where each input came from, its rows after the mapping of ids, and how many that lost."""
    out = None
    for kind, (origin, df) in chosen.items():
        count = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
        row = count(mapped.get(kind, df), "n").join(F.broadcast(count(df, "raw"))).select(F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), "n", (F.col("raw") - F.col("n")).alias("dropped"))
        out = row if out is None else out.unionByName(row)
    return out
