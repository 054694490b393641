"""Column expressions over condition notes: cleaning, evidence, quality, rules. Word lists are parameters with short defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is cut out of seller comments (underlines, labels of links, URLs), and pictures.
SELLER_NOISE = (r"_{3,}", r"(?i)\blinks:\s*", r"(?i)https?://\S+", r"(?i)\bwww\.\S+")
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]+"


@dataclass(frozen=True)
class Vocabulary:
    """Word lists by which notes are read; a user passes their own guidelines here."""

    unverified: tuple[str, ...] = ("untested", "unplayed", "not play tested", "ungraded")
    sealed: tuple[str, ...] = ("sealed", "factory sealed")
    playback: tuple[str, ...] = ("plays", "skips", "surface noise", "hairlines", "tested")
    subjects: tuple[str, ...] = ("vinyl", "record", "label", "disc")
    conditions: tuple[str, ...] = ("scratch", "marks", "wear", "warp", "noise")
    generic: tuple[str, ...] = ("generic sleeve", "generic white sleeve", "plain white sleeve")
    sleeve: tuple[str, ...] = ("sleeve", "cover", "jacket", "seam", "ring wear", "crease")
    boilerplate: tuple[str, ...] = ("visit my store", "combined shipping", "as pictured")
    abbreviations: tuple[tuple[str, str], ...] = (("vg\\+\\+", "very good plus plus"), ("vg\\+", "very good plus"), ("\\bvg\\b", "very good"), ("\\bnm\\b", "near mint"))
    protected: tuple[str, ...] = ("sealed", "scratch", "seam split", "ring wear", "hairlines")
    fallback_chars: int = 60


VOCABULARY = Vocabulary()


def low(t: Column) -> Column:
    return F.lower(F.coalesce(t, F.lit("")))


def has_any(t: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(t, F.lit(w))
    return out


def hits(t: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))


def seller_text(t: Column) -> Column:
    """Underlines, links: labels, URLs and pictures out; spaces collapsed."""
    for pattern in (*SELLER_NOISE, EMOJI):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def without_boilerplate(t: Column, v: Vocabulary = VOCABULARY) -> Column:
    """Sentences that are only boilerplate go; in others the phrases go."""
    phrase = "(?i)(" + "|".join(re.escape(p) for p in v.boilerplate) + ")"
    parts = F.transform(F.split(t, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, phrase, " "), r"\s+", " ")))
    return F.array_join(F.filter(parts, lambda s: F.rlike(s, F.lit(r"[\p{L}\p{N}]"))), " ")


def promo_free(t: Column, v: Vocabulary = VOCABULARY) -> Column:
    """Starred, hashed and bracketed blocks go unless a protected word is inside."""
    guard = "(?![^{0}]*(?i:" + "|".join(re.escape(p) for p in v.protected) + "))"
    for a, b, cls in ((r"\*\*", r"\*\*", "*"), ("##", "##", "#"), (r"\[", r"\]", r"\]")):
        t = F.regexp_replace(t, f"{a}{guard.replace('{0}', cls)}[^{cls}]*{b}", " ")
    return t


def clean(t: Column, v: Vocabulary = VOCABULARY) -> Column:
    """Lower case, promotion out, spaces collapsed, a leading index digit out, abbreviations written out."""
    t = F.trim(F.regexp_replace(F.lower(promo_free(t, v)), r"\s+", " "))
    t = F.regexp_replace(t, r"^\d{1,2}\s+(?=(sealed|new|nm|mint|vg|ex|poor|good)\b)", "")
    for short, long in v.abbreviations:
        t = F.regexp_replace(t, f"{short}(?=[a-z])", long + " ")
        t = F.regexp_replace(t, short, long)
    return t


def cues(t: Column, v: Vocabulary = VOCABULARY) -> Column:
    """What a note says, as one struct: looked up once, used by every rule below. Select it as a column of its own."""
    t = low(t)
    return F.struct(
        has_any(t, v.unverified).alias("unverified"), has_any(t, v.sealed).alias("sealed"), hits(t, v.playback).alias("playback"),
        has_any(t, v.subjects).alias("subjects"), has_any(t, v.conditions).alias("conditions"),
    )


def verifiable_by(q: Column) -> Column:
    return ~q["unverified"] & (q["sealed"] | (q["playback"] >= 1) | (q["subjects"] & q["conditions"]))


def evidence_by(q: Column) -> Column:
    strong = (q["playback"] >= 2) | ((q["playback"] >= 1) & (q["subjects"] | q["conditions"]))
    return F.when(q["unverified"], "none").when(strong, "strong").when((q["subjects"] & q["conditions"]) | q["sealed"], "weak").otherwise("none")


def media_verifiable(t: Column, v: Vocabulary = VOCABULARY) -> Column:
    return verifiable_by(cues(t, v))


def evidence(t: Column, v: Vocabulary = VOCABULARY) -> Column:
    """none, weak or strong: how directly the media's condition is described."""
    return evidence_by(cues(t, v))


def generic_sleeve(t: Column, v: Vocabulary = VOCABULARY) -> Column:
    return has_any(low(t), v.generic)


#: What to ask the seller for where a note says too little.
PROMPTS = {"sleeve": "Describe the sleeve: seams, corners, wear, writing.", "media": "Describe the record: how it looks under light and how it plays."}


def with_quality(df: DataFrame, raw: str, cleaned: str, v: Vocabulary = VOCABULARY) -> DataFrame:
    """df with sleeve_note_adequate, media_note_adequate, adequate_for_training, gaps, prompts, needs_richer_note and cues."""
    text = F.lower(F.trim(F.coalesce(cleaned, F.lit(""))))
    out = df.withColumn("cues", cues(F.col(raw), v)).withColumn("__text", text)
    out = out.withColumn("sleeve_note_adequate", has_any(F.col("__text"), v.sleeve) | (F.length("__text") >= v.fallback_chars)).withColumn("media_note_adequate", evidence_by(F.col("cues")) != "none")
    missing = lambda give: F.array_compact(F.array(*(F.when(~F.col(f"{k}_note_adequate"), F.lit(give[k])) for k in ("sleeve", "media"))))
    both = F.col("sleeve_note_adequate") & F.col("media_note_adequate")
    return out.withColumns({"adequate_for_training": both, "gaps": missing({"sleeve": "sleeve", "media": "media"}), "prompts": missing(PROMPTS), "needs_richer_note": ~both}).drop("__text")


def lost_terms(raw: Column, cleaned: Column, v: Vocabulary = VOCABULARY) -> Column:
    """Protected words of the note that cleaning took away."""
    words = F.array(*(F.lit(p) for p in v.protected))
    return F.filter(words, lambda p: F.contains(low(raw), p) & ~F.contains(low(cleaned), p))


@dataclass(frozen=True)
class GradeRule:
    """How one grade is told from a note. Hard: one strict signal, or two distinct signals of both lists. Soft: enough supporting ones."""

    grade: str
    strict: tuple[str, ...] = ()
    cosignal: tuple[str, ...] = ()
    supporting: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()
    least: int = 1
    most: int = 99
    confidence: float = 0.85
    only_downgrade: bool = False
    targets: tuple[str, ...] = ("sleeve", "media")


@dataclass(frozen=True)
class Rules:
    #: The order of condition grades, best first.
    order: tuple[str, ...] = ("Mint", "Near Mint", "Excellent", "Very Good Plus", "Very Good", "Good", "Poor")
    hard: tuple[GradeRule, ...] = (
        GradeRule("Poor", strict=("water damage", "deep scratch"), cosignal=("skips", "surface noise"), forbidden=("no water damage",), exceptions=("water damage free",)),
        GradeRule("Generic", strict=("generic sleeve", "generic white sleeve"), forbidden=("original cover",), targets=("sleeve",)),
    )
    soft: tuple[GradeRule, ...] = (
        GradeRule("Near Mint", supporting=("hairlines", "plays perfectly", "never opened"), forbidden=("scratch",), least=1, most=2),
        GradeRule("Very Good Plus", supporting=("light", "small crease"), forbidden=("seam split",), confidence=0.7),
        GradeRule("Very Good", supporting=("seam split", "ring wear"), least=2, confidence=0.8, only_downgrade=True),
        GradeRule("Good", supporting=("surface noise",), confidence=0.6),
    )
    most_upgrade: int = 1
    pairs: tuple[tuple[str, str], ...] = (("sealed", "plays"), ("mint", "water damage"), ("unplayed", "hairlines"))
    #: What keeps a sleeve from Near Mint, what is only a small split, and what else is then a defect.
    splits: tuple[str, ...] = ("seam split", "spine split")
    small_splits: tuple[str, ...] = ("small seam split", "small top seam split", "small seam split along", "small seam split on top", "small spine split", "small top spine split")
    split_defects: tuple[str, ...] = (
        "scratch", "scratches", "scuff", "scuffs", "wear", "wrinkle", "wrinkles", "ring wear", "ringwear", "stain", "stains", "foxing", "mold", "water damage",
        "corner", "bump", "cutout", "cut out", "tear", "tears", "fade", "writing", "sticker", "gouge", "gouges",
    )
    #: A grade that is not given out, and the one that stands for it.
    collapse: tuple[str, str] | None = ("Excellent", "Near Mint")

    def signals(self) -> tuple[str, ...]:
        """Every phrase that some rule looks for."""
        own = (w for r in (*self.hard, *self.soft) for words in (r.strict, r.cosignal, r.supporting, r.forbidden) for w in words)
        return tuple(dict.fromkeys((*own, *(w for p in self.pairs for w in p), *self.splits, *self.small_splits, *self.split_defects)))


RULES = Rules()
_LISTS = ("strict", "cosignal", "supporting", "forbidden", "exceptions")


def rules_from_table(table: DataFrame, base: Rules = RULES) -> Rules:
    """Rules from a guideline table: grade, list, value (strings) and place (int); it is configuration and read on the driver.

    list is one of strict, cosignal, supporting, forbidden, exceptions, targets (a value each row), least, most, confidence,
    only_downgrade (one row), pair (two signals with a bar between), small_split, split_defect, split, order, hard or soft (the grades
    in the order in which they are tried). What the table does not have is taken from base. Nulls are left out.
    """
    rows = sorted(((r["place"] or 0, r["grade"], r["list"], r["value"]) for r in table.select("place", "grade", "list", "value").collect() if r["list"] and r["value"]), key=lambda r: r[0])
    of = lambda name, grade=None: tuple(v for _, g, n, v in rows if n == name and (grade is None or g == grade))
    kinds = {"least": int, "most": int, "confidence": float, "only_downgrade": lambda v: v.strip().lower() == "true"}

    def rule(grade: str) -> GradeRule:
        one = {k: make(of(k, grade)[0]) for k, make in kinds.items() if of(k, grade)}
        return GradeRule(grade, **{k: of(k, grade) for k in _LISTS}, **one, targets=of("targets", grade) or ("sleeve", "media"))

    given = {"hard": tuple(map(rule, of("hard"))), "soft": tuple(map(rule, of("soft"))), "pairs": tuple((a, b) for a, _, b in (v.partition("|") for v in of("pair")))}
    given |= {"order": of("order"), "splits": of("split"), "small_splits": of("small_split"), "split_defects": of("split_defect")}
    return replace(base, **{k: v for k, v in given.items() if v})


def signal(t: Column, s: str) -> Column:
    """The signal as whole words of lower-case text; the cheap search decides in nearly all cases."""
    return F.contains(t, F.lit(s)) & F.rlike(t, F.lit(rf"(^|[^a-z0-9]){re.escape(s)}([^a-z0-9]|$)"))


def signals_in(t: Column, words: tuple[str, ...]) -> Column:
    """The words that stand in lower-case text t, in the order of the list. Select it as a column of its own."""
    return F.array_compact(F.array(*(F.when(signal(t, w), F.lit(w)) for w in words))) if words else F.array().cast("array<string>")


def _list(words: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def count_of(found: Column, words: tuple[str, ...]) -> Column:
    """How many distinct ones of the words were found."""
    return F.size(F.array_intersect(found, _list(words)))


def any_of(found: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(found, _list(words)) if words else F.lit(False)


def _blocked(t: Column, found: Column, r: GradeRule) -> Column:
    """A forbidden signal stands in the text once the rule's exceptions are taken out."""
    if not r.exceptions:
        return any_of(found, r.forbidden)
    excepted = t
    for e in r.exceptions:
        excepted = F.replace(excepted, F.lit(e), F.lit(" "))
    # taking phrases out can only bring forbidden ones together where an exception stands
    return F.when(has_any(t, r.exceptions), F.size(signals_in(excepted, r.forbidden)) > 0).otherwise(any_of(found, r.forbidden))


def hard_by(t: Column, found: Column, target: str, rules: Rules = RULES, forbid: bool = True) -> Column:
    """struct(grade, tier, signal) of the first hard-owned grade that fires, or null."""
    out = []
    for r in rules.hard:
        if target not in r.targets:
            continue
        strict, co = any_of(found, r.strict), any_of(found, r.cosignal) & (count_of(found, tuple({*r.strict, *r.cosignal})) >= 2)
        first = lambda words: F.get(F.filter(_list(words), lambda w: F.array_contains(found, w)), F.lit(0))
        hit = F.struct(F.lit(r.grade).alias("grade"), F.when(strict, "strict").otherwise("cosignal").alias("tier"), F.when(strict, first(r.strict)).otherwise(first(r.cosignal)).alias("signal"))
        out.append(F.when((strict | co) & ~_blocked(t, found, r) if forbid else strict | co, hit))
    return F.coalesce(*out) if out else F.lit(None).cast("struct<grade:string,tier:string,signal:string>")


def hard_match(t: Column, r: GradeRule) -> Column:
    """Whether the grade's hard signals are there, whatever forbids it."""
    found = signals_in(t, (*r.strict, *r.cosignal))
    return any_of(found, r.strict) | (any_of(found, r.cosignal) & (count_of(found, tuple({*r.strict, *r.cosignal})) >= 2))


def hard_grade(t: Column, target: str, rules: Rules = RULES) -> Column:
    """The first hard-owned grade that fires; Generic is for sleeves only."""
    return hard_by(low(t), signals_in(low(t), rules.signals()), target, rules)["grade"]


def ordinal(grade: Column, rules: Rules = RULES) -> Column:
    out = F.when(F.lit(False), 0)
    for i, g in enumerate(rules.order):
        out = out.when(grade == g, i)
    return out.otherwise(99)


def soft_by(t: Column, found: Column, target: str | None, predicted: Column, confidence: Column, rules: Rules = RULES, differ: bool = False) -> Column:
    at, tries = ordinal(predicted, rules), []
    for r in rules.soft:
        if target is not None and target not in r.targets:
            continue
        n, here = count_of(found, r.supporting), rules.order.index(r.grade)
        ok = (n >= r.least) & (n <= r.most) & ~_blocked(t, found, r) & (confidence < r.confidence) & ~((at > here) & (at - here > rules.most_upgrade))
        ok = ok & F.coalesce(predicted != r.grade, F.lit(True)) if differ else ok
        tries.append(F.when(ok & (at < here) if r.only_downgrade else ok, r.grade))
    return F.coalesce(*tries, F.lit(None).cast("string"))


def soft_grade(t: Column, predicted: Column, confidence: Column, rules: Rules = RULES) -> Column:
    """The best grade whose conditions all hold: signals within bounds, none forbidden, an unsure model, no large upgrade."""
    return soft_by(low(t), signals_in(low(t), rules.signals()), None, predicted, confidence, rules)


def contradicts(found: Column, rules: Rules = RULES) -> Column:
    out = F.lit(False)
    for a, b in rules.pairs:
        out = out | (F.array_contains(found, F.lit(a)) & F.array_contains(found, F.lit(b)))
    return out


def contradiction(t: Column, rules: Rules = RULES) -> Column:
    """Both signals of some pair are there."""
    return contradicts(signals_in(low(t), rules.signals()), rules)


def with_signals(df: DataFrame, text: str, rules: Rules = RULES) -> DataFrame:
    """df with the lower-case text (__low) and the signals found in it (__found): every text is searched once."""
    return df.withColumn("__low", low(F.col(text))).withColumn("__found", signals_in(F.col("__low"), rules.signals()))


def split_grade(found: Column, rules: Rules = RULES) -> Column:
    """What a split seam leaves of Near Mint: Very Good Plus if it is small and nothing else is wrong, else Very Good; null without one."""
    small = any_of(found, rules.small_splits) & ~any_of(found, rules.split_defects)
    return F.when(any_of(found, rules.splits), F.when(small, "Very Good Plus").otherwise("Very Good"))


def apply_rules(df: DataFrame, text: str, predicted: dict[str, str], confidence: dict[str, str], rules: Rules = RULES) -> DataFrame:
    """df with, for each target of predicted: {target}_final, {target}_tier, {target}_signal; and contradiction, overridden, collapsed.

    A contradiction suspends all rules. Else a target's grade is that of the seam-split guardrail (a sleeve predicted Near Mint), of
    a hard rule, or of a soft one; a small split alone does not take Very Good Plus to Very Good. tier and signal tell which hard
    rule fired. overridden and collapsed list the targets whose grade was changed by a rule, or by the grade that is not
    given out. predicted and confidence name columns; a null prediction stays null unless a rule fires.
    """
    out = with_signals(df, text, rules)
    t, found = F.col("__low"), F.col("__found")
    out = out.withColumn("contradiction", contradicts(found, rules)).withColumn("__split", split_grade(found, rules))
    for target, name in predicted.items():
        was, split = F.col(name), F.col("__split")
        guard = F.when(F.lit(target == "sleeve") & (was == "Near Mint"), split)
        out = out.withColumn("__hard", F.when(guard.isNull() & ~F.col("contradiction"), hard_by(t, found, target, rules)))
        # a soft rule that arrives at the grade there was is no override, and worse grades are tried
        grade = F.coalesce(guard, F.col("__hard.grade"), soft_by(t, found, target, was, F.col(confidence[target]), rules, differ=True))
        grade = F.when(~F.coalesce((grade == "Very Good") & (was == "Very Good Plus") & (split == "Very Good Plus"), F.lit(False)), grade)
        out = out.withColumns({f"__{target}": F.when(~F.col("contradiction"), grade), f"{target}_tier": F.col("__hard.tier"), f"{target}_signal": F.col("__hard.signal")}).drop("__hard")
    finals = {k: F.coalesce(F.col(f"__{k}"), F.col(v)) for k, v in predicted.items()}
    some = lambda marks: F.array_compact(F.array(*(F.when(m, F.lit(k)) for k, m in marks.items())))
    gone, stands = rules.collapse or (None, None)
    collapsed = {k: v == gone if gone else F.lit(False) for k, v in finals.items()}
    out = out.withColumns({f"{k}_final": F.when(collapsed[k], F.lit(stands)).otherwise(v) for k, v in finals.items()} | {"overridden": some({k: F.col(f"__{k}").isNotNull() for k in predicted}), "collapsed": some(collapsed)})
    return out.drop("__low", "__found", "__split", *(f"__{k}" for k in predicted))


def drop_reason(t: Column, sleeve: Column, media: Column, least: int) -> Column:
    """Why a listing is not used, or null."""
    text = F.trim(F.coalesce(t, F.lit("")))
    return F.when(text == "", "missing_notes").when(F.length(text) < least, "short_notes").when(sleeve.isNull(), "missing_sleeve").when(media.isNull(), "missing_media").when(generic_sleeve(text), "generic_note")
