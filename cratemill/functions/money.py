"""Column expressions over money texts, conditions and price ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Condition names and their ordinals, in the order in which they are looked for inside a text.
CONDITIONS: list[tuple[str, float]] = [
    ("mint (m)", 8.0), ("mint", 8.0), ("m", 8.0), ("near mint (nm or m-)", 7.0), ("near mint", 7.0), ("nm", 7.0), ("m-", 7.0),
    ("very good plus (vg+)", 6.0), ("very good plus", 6.0), ("vg+", 6.0), ("very good (vg)", 5.0), ("very good", 5.0), ("vg", 5.0),
    ("good plus (g+)", 4.0), ("good plus", 4.0), ("g+", 4.0), ("good (g)", 3.0), ("good", 3.0), ("g", 3.0),
    ("fair (f)", 2.0), ("fair", 2.0), ("f", 2.0), ("poor (p)", 1.0), ("poor", 1.0), ("p", 1.0),
    ("generic", 0.0), ("not graded", -1.0), ("no cover", -2.0),
]
LADDER = "map<string,struct<value:double,currency:string>>"


def condition_ordinal(text: Column) -> Column:
    """8 (mint) to -2 (no cover): the name itself, else the first name that contains or is contained, else -1."""
    t = F.lower(F.trim(text))
    out = F.when(t.isNull() | (t == ""), -1.0)
    for name, value in CONDITIONS:
        out = out.when(t == name, value)
    for name, value in CONDITIONS:
        out = out.when(F.contains(t, F.lit(name)) | F.contains(F.lit(name), t), value)
    return out.otherwise(-1.0)


def number(raw: Column) -> Column:
    """A number as written: one comma and no point is a decimal comma, other commas group digits."""
    return F.replace(F.regexp_replace(raw, "^([^,.]*),([^,.]*)$", "$1.$2"), F.lit(",")).try_cast("double")


def _after(sign: str, text: Column) -> Column:
    raw = F.regexp_extract(F.replace(text, F.lit(" "), F.lit(" ")), rf"{sign}\s*(\d[\d.,]*)", 1)
    # a filter of one value, so that the pattern is searched once and not once for each use of it
    return F.get(F.filter(F.array(number(raw)), lambda v: v > 0), F.lit(0))


def usd(text: Column) -> Column:
    """A dollar amount; null for other currencies, also other dollars (A$, CA$)."""
    foreign = F.contains(text, F.lit("€")) | F.trim(text).startswith("£")
    return F.when(~foreign, _after(r"(?<![A-Za-z])\$", text))


def gbp(text: Column) -> Column:
    return _after("£", text)


def eur(text: Column) -> Column:
    return _after("€", text)


def loose(text: Column) -> Column:
    """Any amount: all but digits, points, commas and minus signs is dropped first."""
    return number(F.nullif(F.regexp_replace(text, r"[^\d.,-]", ""), F.lit("")))


def as_text(amount: Column) -> Column:
    return F.when(amount.isNotNull(), F.format_string("$%.2f", amount))


def ladder(json: Column) -> Column:
    """The positive values of a ladder by grade; empty for null or malformed text."""
    parsed = F.coalesce(F.from_json(json, LADDER), F.create_map().cast(LADDER))
    values = F.transform_values(parsed, lambda k, v: v["value"])
    return F.map_filter(values, lambda k, v: v > 0)


def rung(values: Column, label: Column) -> Column:
    """The value of a grade: the same name, else in other letter case, else the first name that contains it or is contained."""
    want = F.lower(F.trim(label))
    entries = F.map_entries(values)
    low = lambda e: F.lower(F.trim(e["key"]))
    first = lambda cond: F.get(F.filter(entries, cond), F.lit(0))["value"]
    return F.coalesce(F.try_element_at(values, label), first(lambda e: low(e) == want), F.when(want != "", first(lambda e: F.contains(low(e), want) | F.contains(want, low(e)))))


def top_rung(values: Column) -> Column:
    return F.array_max(F.map_values(values))


def mint_rung(values: Column) -> Column:
    """The first rung that says mint and not near mint."""
    mint = F.filter(F.map_entries(values), lambda e: F.contains(F.lower(e["key"]), F.lit("mint")) & ~F.contains(F.lower(e["key"]), F.lit("near mint")) & ~F.contains(F.lower(e["key"]), F.lit("(nm")))
    return F.get(mint, F.lit(0))["value"]
