"""Column expressions over catalogue rows: artists, formats, flags, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTISTS = "array<struct<id:string,name:string>>"
LABELS = "array<struct<id:string,name:string,catno:string>>"
FORMATS = "array<struct<name:string,qty:string,descriptions:array<string>>>"
#: Fixed value: the catalogue's id of the collective artist Various.
VARIOUS_ID = "194"
#: Patterns that tell the kind of medium in lower-case format text.
MEDIUM = {
    "is_lp": r"\blp\b",
    "is_7inch": r'7\s*"|\b7\s*inch\b',
    "is_10inch": r'10\s*"|\b10\s*inch\b',
    "is_12inch": r'1\s*2\s*"|\b12\s*inch\b',
    "is_cd": r"\bcd\b|compact disc",
}
#: Patterns of boxes and of several discs.
BOX, SEVERAL = "box set", r"\b[2-9]\s*x\s*vinyl\b|(double|triple) vinyl|quad.*vinyl|vinyl.*quad"
#: Words of format text that tell special pressings.
PRESSINGS = {"is_colored_vinyl": ("colored", "coloured", "color vinyl"), "is_picture_disc": ("picture disc", "pic disc"), "is_promo": ("promo", "white label")}


def artists(json: Column) -> Column:
    return F.from_json(json, ARTISTS)


def formats(json: Column) -> Column:
    return F.coalesce(F.from_json(json, FORMATS), F.array().cast(FORMATS))


def texts(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def first_artist_id(json: Column) -> Column:
    return F.get(artists(json), F.lit(0))["id"]


def first_label_id(json: Column) -> Column:
    return F.get(F.from_json(json, LABELS), F.lit(0))["id"]


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def has_single_artist(json: Column) -> Column:
    """Rows to keep: the first artist is neither Various nor unknown; rows without artists are kept."""
    first = F.get(artists(json), F.lit(0))
    name = F.trim(_low(first["name"]))
    blank = json.isNull() | (F.trim(json) == "")
    return blank | (~F.contains(name, F.lit("various")) & (name != "unknown artist") & (F.coalesce(first["id"], F.lit("")) != VARIOUS_ID))


def _any(json: Column, name: Column | None, description) -> Column:
    """Whether any format's name or any of its descriptions fits."""
    fits = lambda f: F.exists(F.coalesce(f["descriptions"], F.array().cast("array<string>")), lambda d: description(_low(d)))
    named = (lambda f: F.trim(_low(f["name"])).isin(*name)) if name else (lambda f: F.lit(False))
    return F.exists(formats(json), lambda f: named(f) | fits(f))


def not_digital(json: Column, desc: Column) -> Column:
    """Rows to keep: no format called File, by its name or in the text's comma list."""
    t = F.trim(_low(desc))
    in_text = (t == "file") | t.startswith("file,") | t.endswith(", file") | F.contains(t, F.lit(", file,"))
    return ~F.exists(formats(json), lambda f: F.trim(_low(f["name"])) == "file") & ~in_text


def official(json: Column, desc: Column) -> Column:
    """Rows to keep: nothing says unofficial release."""
    phrase = F.lit("unofficial release")
    return ~F.contains(_low(desc), phrase) & ~_any(json, None, lambda d: F.contains(d, phrase))


def _spaced(desc: Column) -> Column:
    return F.concat(F.lit(" "), F.translate(_low(desc), ",;", "  "), F.lit(" "))


def format_rank(json: Column, desc: Column) -> Column:
    """4 LP, 3 twelve inch, 2 ten inch, 1 seven inch or other vinyl, 0 none; the first tier that fits."""
    t = _low(desc)
    lp_text = F.contains(_spaced(desc), F.lit(" lp ")) | F.contains(F.trim(t), F.lit(", lp"))
    lp = lp_text | _any(json, ("lp",), lambda d: F.contains(F.concat(F.lit(" "), d, F.lit(" ")), F.lit(" lp ")))

    def inch(n: str) -> Column:
        signs = (f'{n}"', f"{n} inch")
        within = lambda c: F.contains(c, F.lit(signs[0])) | F.contains(c, F.lit(signs[1]))
        return within(t) | _any(json, (signs[0],), within)

    vinyl = F.contains(t, F.lit("vinyl")) | _any(json, ("vinyl", "lp"), lambda d: F.contains(d, F.lit("vinyl")))
    return F.when(lp, 4).when(inch("12"), 3).when(inch("10"), 2).when(inch("7") | vinyl, 1).otherwise(0)


def is_vinyl(json: Column, desc: Column) -> Column:
    return F.when(format_rank(json, desc) > 0, 1).otherwise(0)


def albumish(json: Column, desc: Column) -> Column:
    """Whether the text or a description has the word album or lp."""
    word = r"(^|[^a-z0-9])(album|lp)([^a-z0-9]|$)"
    return F.rlike(_low(desc), F.lit(word)) | _any(json, None, lambda d: F.rlike(d, F.lit(word)))


def queue_filter() -> Column:
    c = F.col
    return has_single_artist(c("artists_json")) & not_digital(c("formats_json"), c("format_desc")) & official(c("formats_json"), c("format_desc"))


def text_flags(desc: Column) -> dict[str, Column]:
    t = _low(desc)
    return {name: F.rlike(t, F.lit("|".join(words))).cast("int") for name, words in PRESSINGS.items()}


def is_original(json: Column, desc: Column) -> Column:
    """0 if a format carries the description Repress (without formats: the text has the word), else 1."""
    listed = F.exists(formats(json), lambda f: F.exists(F.coalesce(f["descriptions"], F.array().cast("array<string>")), lambda d: F.trim(F.lower(d)) == "repress"))
    return F.when(F.size(formats(json)) > 0, (~listed).cast("int")).otherwise((~F.rlike(_low(desc), F.lit(r"\brepress\b"))).cast("int"))


def medium_flags(json: Column, desc: Column) -> dict[str, Column]:
    """Kinds of medium as 0/1, and one ordinal: 5 box or several discs, 4 LP, 3 ten or twelve inch, 2 seven inch, 1 CD."""
    parts = F.flatten(F.transform(formats(json), lambda f: F.concat(F.array(F.coalesce(f["name"], F.lit(""))), F.coalesce(f["descriptions"], F.array().cast("array<string>")))))
    t = F.lower(F.concat(F.array_join(parts, " "), F.lit(" "), F.coalesce(desc, F.lit(""))))
    has = lambda pattern: F.rlike(t, F.lit(pattern))
    quantity = F.aggregate(formats(json), F.lit(0.0), lambda acc, f: acc + F.greatest(F.coalesce(F.floor(f["qty"].try_cast("double")), F.lit(0)), F.lit(0)))
    box, several = has(BOX), has(SEVERAL) | (quantity >= 2)
    kinds = {name: has(pattern) for name, pattern in MEDIUM.items()} | {"is_box_set": box, "is_multi_disc": several & ~box}
    family = F.when(box | several, 5).when(kinds["is_7inch"], 2).when(kinds["is_10inch"] | kinds["is_12inch"], 3).when(kinds["is_lp"], 4).when(kinds["is_cd"], 1).otherwise(0)
    return {k: v.cast("int") for k, v in kinds.items()} | {"format_family": family}


def counts() -> dict[str, Column]:
    c = F.col
    listed = lambda json, single: F.when(F.size(texts(c(json))) > 0, F.size(texts(c(json)))).otherwise((F.coalesce(c(single), F.lit("")) != "").cast("int"))
    size = lambda col: F.coalesce(F.size(col), F.lit(0))
    return {
        "genre_count": listed("genres_json", "genre"),
        "style_count": listed("styles_json", "style"),
        "artist_count": F.when(c("artists_json").isNull(), 0).otherwise(size(artists(c("artists_json")))),
        "label_count": F.when(c("labels_json").isNull(), 0).otherwise(size(F.from_json(c("labels_json"), LABELS))),
        "format_count": F.size(formats(c("formats_json"))),
    }


def year_of(text: Column) -> Column:
    """A year from 1800 to 2100: a whole number, or the first date token that starts with one."""
    number = text.try_cast("int")
    token = F.nullif(F.regexp_extract(text, r"(^|[^0-9])(1[89]\d\d|20\d\d|2100)([^0-9]|$)", 2), F.lit("")).cast("int")
    return F.when(number.between(1800, 2100), number).otherwise(token)
