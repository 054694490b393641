"""Queries of drift statistics and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratemill.operators import drift as D
from cratemill.plans.registry import query
from cratemill.sources.views import sql, table, view

c = F.col
_ref, _cur = (lambda s, d: view(s, d, "reference_side")), (lambda s, d: view(s, d, "current_side"))
_EDGES = [1960.0, 1970.0, 1980.0, 1990.0]
_BIN = " + ".join(f"(year > {e})::INT" for e in _EDGES)
_PSI = "t AS (SELECT *, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM k), psi AS (SELECT sum((greatest(c / nc, 1e-6) - greatest(r / nr, 1e-6)) * ln(greatest(c / nc, 1e-6) / greatest(r / nr, 1e-6))) AS psi FROM t)"


def _k(expr: str, extra: str = "") -> str:
    return f"k AS (SELECT bin, count(*) FILTER (WHERE side = 0)::DOUBLE AS r, count(*) FILTER (WHERE side = 1)::DOUBLE AS c FROM (SELECT 0 AS side, {expr} AS bin FROM reference_side {extra} UNION ALL SELECT 1, {expr} FROM current_side {extra}) q GROUP BY 1)"


def _r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("AGG30", f"WITH {_k(_BIN)}, {_PSI} SELECT round(psi, 6) AS psi FROM psi")
def _(s, d):
    return _r6(D.psi(D.side_counts(_ref(s, d), _cur(s, d), D.edges_bin(c("year"), _EDGES))), "psi")


_CUTS = "cuts AS (SELECT list_distinct(quantile_cont(pred, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS qs FROM reference_side)"


@query("AGG31", f"WITH {_CUTS}, {_k('len(list_filter(qs, lambda e: pred > e))', ', cuts')}, {_PSI} SELECT round(psi, 6) AS psi FROM psi")
def _(s, d):
    return _r6(D.psi(D.decile_counts(_ref(s, d), _cur(s, d), "pred")), "psi")


@query("AGG32", """WITH u AS (SELECT year AS v, 1 AS r, 0 AS c FROM reference_side UNION ALL SELECT year, 0, 1 FROM current_side), g AS (SELECT v, sum(r) AS r, sum(c) AS c FROM u GROUP BY 1),
w AS (SELECT sum(r) OVER (ORDER BY v) AS cr, sum(c) OVER (ORDER BY v) AS cc, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM g) SELECT round(max(abs(cr::DOUBLE / nr - cc::DOUBLE / nc)), 6) AS statistic, max(nr)::BIGINT AS nr, max(nc)::BIGINT AS nc FROM w""")  # fmt: skip
def _(s, d):
    return _r6(D.ks(_ref(s, d), _cur(s, d), "year"), "statistic")


_TOP = "top AS (SELECT genre AS g FROM reference_side GROUP BY 1 ORDER BY count(*) DESC, genre LIMIT 4)"
_GEN = "CASE WHEN genre IN (SELECT g FROM top) THEN genre ELSE 'other' END"


@query("AGG33", f"WITH {_TOP}, {_k(_GEN)}, {_PSI} SELECT round(psi, 6) AS psi FROM psi")
def _(s, d):
    return _r6(D.psi(D.top_k_counts(_ref(s, d), _cur(s, d), "genre", 4)), "psi")


@query("AGG34", f"WITH {_TOP}, {_k(_GEN)}, t AS (SELECT *, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM k) SELECT round(sum(pow(r - (r + c) * nr / (nr + nc), 2) / ((r + c) * nr / (nr + nc)) + pow(c - (r + c) * nc / (nr + nc), 2) / ((r + c) * nc / (nr + nc))), 6) AS statistic, count(*) - 1 AS dof FROM t")
def _(s, d):
    return _r6(D.chi_square(D.top_k_counts(_ref(s, d), _cur(s, d), "genre", 4)), "statistic")


@query("AGG35", "WITH p AS (SELECT (SELECT avg(flag) FROM reference_side) AS p, (SELECT avg(flag) FROM current_side) AS q, (SELECT count(*) FROM reference_side) AS n, (SELECT count(*) FROM current_side) AS m) SELECT round((q - p) * ln(q / p) + (p - q) * ln((1 - q) / (1 - p)), 6) AS psi, round((q - p) / sqrt(((p * n + q * m) / (n + m)) * (1 - (p * n + q * m) / (n + m)) * (1.0 / n + 1.0 / m)), 6) AS z FROM p")
def _(s, d):
    return _r6(D.binary_shift(_ref(s, d), _cur(s, d), "flag"), "psi", "z")


@query("AGG36", """WITH a AS (SELECT avg((release_id IS NOT NULL)::INT) AS id_set, avg(coalesce(year BETWEEN 1950 AND 1998, false)::INT) AS year_range, avg(coalesce(decade = floor(year / 10) * 10, false)::INT) AS decade_fits, avg((genre IS NOT NULL)::INT) AS genre_set FROM releases)
SELECT "check", share, share >= CASE "check" WHEN 'year_range' THEN 0.95 WHEN 'decade_fits' THEN 0.9 ELSE 1 END AS ok FROM (UNPIVOT a ON id_set, year_range, decade_fits, genre_set INTO NAME "check" VALUE share) q""")  # fmt: skip
def _(s, d):
    checks = {"id_set": (c("release_id").isNotNull(), 1.0), "year_range": (c("year").between(1950, 1998), 0.95), "decade_fits": (c("decade") == F.floor(c("year") / 10) * 10, 0.9), "genre_set": (c("genre").isNotNull(), 1.0)}
    return D.integrity(view(s, d, "releases"), checks)


@query("AGG37", f"WITH {_k(_BIN)}, {_PSI} SELECT 'year_psi' AS metric, round(psi, 6) AS value, CASE WHEN psi >= 0.25 THEN 'fail' WHEN psi >= 0.1 THEN 'warn' ELSE 'pass' END AS verdict FROM psi")
def _(s, d):
    m = D.psi(D.side_counts(_ref(s, d), _cur(s, d), D.edges_bin(c("year"), _EDGES))).select(F.lit("year_psi").alias("metric"), F.round("psi", 6).alias("value"))
    return D.verdicts(m, s.sql("SELECT * FROM VALUES ('year_psi', 0.1D, 0.25D), ('genre_psi', 0.1D, 0.25D) AS t(metric, warn, fail)"))


@query("STR03", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, (value >= 10)::INT + (value >= 30)::INT + (value >= 60)::INT AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    from cratemill.streaming.incremental import stream_drift

    return stream_drift(s, d, [10.0, 30.0, 60.0])


_EVENT_BIN = "(value >= 10)::INT + (value >= 30)::INT + (value >= 60)::INT"


@query("STR03_psi", f"""WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, {_EVENT_BIN} AS bin, event_type FROM events), r AS (SELECT bin, count(*) AS r FROM e WHERE event_type = 'view' GROUP BY 1), t AS (SELECT sum(r) AS nr FROM r), c AS (SELECT day, bin, count(*) AS c FROM e GROUP BY 1, 2), w AS (SELECT day, sum(c) AS nc FROM c GROUP BY 1),
x AS (SELECT day, nc, greatest(coalesce(r, 0)::DOUBLE / nr, 1e-6) AS p, greatest(coalesce(c, 0)::DOUBLE / nc, 1e-6) AS q FROM w CROSS JOIN (SELECT DISTINCT bin FROM e) b CROSS JOIN t LEFT JOIN c USING (day, bin) LEFT JOIN r USING (bin)) SELECT day, round(sum((q - p) * ln(q / p)), 6) AS psi, max(nc)::BIGINT AS n FROM x GROUP BY 1""")  # fmt: skip
def _(s, d):
    """Every day of the stream against what views have."""
    from cratemill.streaming.incremental import stream_drift

    bin_ = sum((c("value") >= e).cast("int") for e in (10.0, 30.0, 60.0))
    reference = table(s, d, "events").where("event_type = 'view'").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _r6(D.psi_by(stream_drift(s, d, [10.0, 30.0, 60.0]), reference, "day"), "psi")


@query("SNK02", "SELECT release_id, master_id, genre, style, decade, year, country, label_tier, format_desc FROM releases")
def _(s, d):
    from cratemill.sources.connectors import canonical

    return canonical(view(s, d, "releases"), ["release_id", "master_id", "genre", "style", "decade", "year", "country", "label_tier", "format_desc"])
