"""URL filters: pattern rules found by their rarest literal token.

Only DataFrame operations are used. Rules come from the caller's program, so their number is the caller's; URLs are the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """regex is searched in host + path; tokens are literals (lower case, as between other characters) in every URL it fits."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int


def host_path_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with path; a longer rule ranks higher."""
    cut = path.rsplit("/", 1)[0]  # the last part may go on in the URL, so it is no whole token
    tokens = tuple(sorted({t for t in re.split(r"[^a-z0-9]+", f"{host}/{cut}".lower()) if t}))
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, 1_000_000 + len(host + path))


def host_word_rule(word: str) -> Rule:
    """Blocks hosts that have the word between dots, hyphens or their ends."""
    return Rule(f"~{word}", "block", rf"^(?:[^/]*[.\-])?{re.escape(word)}(?:[.\-:][^/]*)?(?:/|$)", (word,), len(word))


#: The rules of the contract (verdict, host, path).
BASE_RULES = [
    host_path_rule("allow", "org", "/"),
    host_path_rule("block", "example.org", "/es/"),
    host_path_rule("block", "example.org", "/en/1"),
    host_path_rule("allow", "com", "/fr/"),
    host_path_rule("block", "com", "/de/"),
]
#: Words that mark unwanted hosts; they judge where no host and path rule fits.
PATTERN_RULES = [host_word_rule(w) for w in ("casino", "adult", "porn", "xxx", "sex", "poker", "bet", "viagra", "pills", "warez", "malware", "phishing", "spam")]


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def tokens(host_and_path: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(host_and_path), "[^a-z0-9]+")), "")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table: its size is known to the planner, which then decides how to join it."""
    names = [c.split()[0] for c in schema.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(",")) + " WHERE false")
    lit = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)} AS t({', '.join(names)})")


def index(rules: list[Rule], urls: DataFrame) -> dict[str, list[Rule]]:
    """Rules by their rarest literal token, as counted over all URLs (column subject). Ties: the smaller token."""
    wanted = _table(urls.sparkSession, [(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    seen = urls.select(F.explode(tokens(F.col("subject"))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").count().collect()  # one row for each token of a rule
    count = {r["token"]: r["count"] for r in seen}
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(min(r.tokens, key=lambda t: (count.get(t, 0), t)), []).append(r)
    return by


def judge(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """Of every row of pages (page_id, url): page_id, url, host, path, rule, verdict, pattern.

    The tokens of a URL fetch the rules indexed under them and only those run their regular expressions. The highest rank wins
    (ties: the smaller name): host and path rules by length, then patterns; rule names the former, pattern the
    latter. A null URL or one without :// has empty host and path, no rule and the default verdict. Repeated rows give
    repeated result rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    rules = [*BASE_RULES, *PATTERN_RULES] if rules is None else rules
    rows = common.pick(pages, "page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    urls = rows.select("page_id", "url", F.concat("host", "path").alias("subject"))
    by = index(rules, urls)
    table = _table(spark, [(t, r.name, r.verdict, r.regex, r.rank) for t, rs in sorted(by.items()) for r in rs], "token string, name string, rule_verdict string, regex string, rank int")
    candidates = urls.withColumn("token", F.explode(tokens(F.col("subject")))).join(table, "token")
    fits = candidates.where(F.regexp_like("subject", "regex"))
    best = fits.groupBy("page_id", "url").agg(F.max_by(F.struct("name", "rule_verdict", "rank"), F.struct("rank", F.expr("transform(split(name, ''), c -> -ascii(c))"))).alias("best"))
    best = best.select(F.col("page_id").alias("p"), F.col("url").alias("u"), "best.*")
    joined = rows.join(best, common.same(rows["page_id"], best["p"]) & common.same(rows["url"], best["u"]), "left")
    ruled = F.col("rank") >= 1_000_000
    return joined.select(
        "page_id", "url", "host", "path",
        F.when(ruled, F.col("name")).alias("rule"),
        F.coalesce("rule_verdict", F.lit(default)).alias("verdict"),
        F.when(~ruled, F.col("name")).alias("pattern"),
    )


def oracle() -> str:
    base = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, '{r.verdict}' AS v, '{r.name.split('/')[0]}' AS rh, '{'/' + r.name.split('/', 1)[1]}' AS rp" for r in BASE_RULES)
    blocked = "|".join(r.tokens[0] for r in PATTERN_RULES)
    return f"""
WITH r AS ({base}),
u AS (SELECT page_id, url, position('://' IN coalesce(url, '')) AS p FROM pages),
v AS (SELECT page_id, url, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM v),
m AS (SELECT h.page_id, h.url, max_by(struct_pack(rule := r.rule, v := r.v), len(r.rule)) AS best FROM h JOIN r
  ON (h.host = r.rh OR ends_with(h.host, '.' || r.rh)) AND starts_with(h.path, r.rp) GROUP BY ALL)
SELECT h.page_id, h.host, h.path, m.best.rule AS rule,
  coalesce(m.best.v, CASE WHEN regexp_matches(h.host, '(^|[.\\-])({blocked})([.:\\-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m ON h.page_id IS NOT DISTINCT FROM m.page_id AND h.url IS NOT DISTINCT FROM m.url
"""
