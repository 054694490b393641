"""How far the word use of each source lies from that of other sources of its language.

Terms are counted inside tasks in numpy: those of up to 8 bytes become one big-endian word, those of up to 16 bytes two; both are sorted by
radix (stable passes over 16-bit digits), so the rows of equal terms stay in order and run lengths are counts. Longer terms lie in a bucket for each
length and are sorted as bytes. Counts per source and term are summed by Spark; shares are integers, so all sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, textscan

#: Texts are counted in groups of rows of about this many bytes (a longer single text is a group of its own).
GROUP_BYTES = 1 << 24
#: Shares are parts of this many.
UNIT = 1_000_000_000
#: Occurrences that each term gets besides its own.
PRIOR = 5
#: Groups up to this many are broadcast with their totals (some 100 bytes each); more are joined by shuffle.
FEW_GROUPS = 1 << 16

#: Letters A-Z, a-z and all characters outside ASCII belong to terms.
LETTERS = textscan.byte_table(lambda b: b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Which bytes of a big-endian word a term of 0 to 8 bytes fills.
_MASKS = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * n)) - 1) for n in range(9)], dtype=np.uint64)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by several uint64 columns, the first of which matters most: passes over 16-bit digits, the last first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(new_term: np.ndarray, row: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, docs) of every run of one term and group: the run's first place, its length and its number of rows.

    new_term says where a term differs from the one before; inside a term rows and their groups ascend.
    """
    new_row, new_run = new_term.copy(), new_term.copy()
    new_row[1:] |= row[1:] != row[:-1]
    new_run[1:] |= group[1:] != group[:-1]
    first = np.flatnonzero(new_run)
    return first, np.diff(np.append(first, len(row))), np.add.reduceat(new_row.astype(np.int64), first) if len(first) else first


def _strings(matrix: np.ndarray) -> pa.Array:
    """Rows of bytes, padded with zeros, as strings."""
    used = matrix != 0
    ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix[used])])


def count_terms(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, n, docs): how often every term occurs in the rows of a group, and in how many rows. Rows must be sorted by group."""
    data, offsets = textscan.buffers(texts)
    data = _LOWER[data]
    inside = LETTERS[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    start, end = np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & edge[1:]) + 1
    length = end - start
    row = np.searchsorted(offsets, start, side="right") - 1
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 9,), dtype=">u8", buffer=padded, strides=(1,))
    for n_words in (1, 2):
        at = np.flatnonzero((length > 8 * n_words - 8) & (length <= 8 * n_words))
        words = [eight[start[at] + 8 * i].astype(np.uint64) & _MASKS[np.minimum(length[at] - 8 * i, 8)] for i in range(n_words)]
        order = radix_order(words)
        words, rows = [w[order] for w in words], row[at[order]]
        new = np.ones(len(at), dtype=bool)
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        first, n, docs = runs(new, rows, group[rows])
        yield _strings(np.stack([w[first] for w in words], axis=1).astype(">u8").view(np.uint8).reshape(-1, 8 * n_words)), group[rows[first]], n, docs
    for size in np.unique(length[length > 16]):
        at = np.flatnonzero(length == size)
        matrix = np.lib.stride_tricks.sliding_window_view(data, size)[start[at]]
        order = np.argsort(matrix.view(f"S{size}").ravel(), kind="stable")
        matrix, rows = matrix[order], row[at[order]]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (matrix[1:] != matrix[:-1]).any(axis=1)
        first, n, docs = runs(new, rows, group[rows])
        yield _strings(matrix[first]), group[rows[first]], n, docs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of batches of (lang, source, text)."""
    for batch in batches:
        for lo, hi in textscan.row_groups(batch.column(2), GROUP_BYTES):
            part = batch.slice(lo, hi - lo)
            langs, sources = (part.column(i).dictionary_encode() for i in (0, 1))
            code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            code = code[order]
            for terms, group, n, docs in count_terms(part.column(2).take(pa.array(order)), code):
                which_lang, which_source = np.divmod(group, max(len(sources.dictionary), 1))
                cols = [langs.dictionary.take(pa.array(which_lang)), sources.dictionary.take(pa.array(which_source)), terms.cast(pa.string()), pa.array(n), pa.array(docs)]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """(lang, source, term, n, n_lang): occurrences in the source and in the whole lang, for the terms of least_docs rows of the lang or more.

    docs: lang, source, text without nulls. A task has summed up its rows before they move; then all sources of a term meet (a task's sums, not rows).
    """
    partial = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    summed = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return summed.withColumns({"n_lang": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term)}).where(F.col("docs") >= least_docs).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)); null if there are no terms."""
    over = (n + PRIOR).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", over, F.nullif((total + F.lit(PRIOR) * terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))


def _distances(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, a, b, value): for every two sources a < b the sum of |p_a - p_b| over the terms of one block. groups: lang, block, source, p0."""
    names = groups.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    place = {names[i]: at for at, i in enumerate(order)}
    p0 = groups.column("p0").fill_null(0).to_numpy()[order]
    terms = counts.column("term").combine_chunks().dictionary_encode()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    p = np.repeat(p0[:, None], len(terms.dictionary), axis=1)
    if len(counts):
        p[[place[s] for s in counts.column("source").to_pylist()], terms.indices.to_numpy()] = counts.column("p").to_numpy()
    left, right, value = [], [], []
    for i in range(len(order) - 1):
        value.append(np.abs(p[i + 1 :] - p[i]).sum(axis=1))
        left.append(np.full(len(order) - 1 - i, i))
        right.append(np.arange(i + 1, len(order)))
    sorted_names = pa.array([names[i] for i in order], pa.string())
    none = np.zeros(0, dtype=np.int64)
    a, b, v = (np.concatenate(x) if x else none for x in (left, right, value))
    lang = pa.array([groups.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table([lang, sorted_names.take(pa.array(a)), sorted_names.take(pa.array(b)), pa.array(v.astype(np.int64))], ["lang", "a", "b", "value"])


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, block_terms: int = 128) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Part `pair`: how far a source is from each other source of its lang, the sum of |p - q| over the lang's kept terms. Part `term`: the
    `top` terms that a source uses more than its lang does. p and q are shares in whole billionths, smoothed by 5 occurrences of each kept term.
    Null text, lang and source count as empty ones. A group without kept terms takes part with count zero; a lang without any has pairs of
    distance 0. A lang of one source has no pairs. Repeated rows count as rows. Ties rank by item. Empty tables give no rows.

    Pairs come from blocks of terms: each block is a table of sources by terms in numpy, in which missing terms have count zero. A block
    holds block_terms terms, fewer where a lang has many sources.
    """
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs = common.pick(docs, "lang", "source", "text").select(*blank)
    kept = common.materialize(term_counts(docs, least_docs), "terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).withColumnsRenamed({"lang": "l", "source": "s"})
    langs = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy(F.col("lang").alias("vl")).agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(totals, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").join(langs, F.col("lang") == F.col("vl"), "left")
    groups = common.materialize(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total"))), "groups")
    few = groups.count() <= FEW_GROUPS
    own = groups.withColumnsRenamed({"lang": "l", "source": "s"})
    counted = kept.join(F.broadcast(own) if few else own, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = counted.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    terms = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    size = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("terms").alias("terms"))
    room = F.greatest(F.lit(1), F.least(F.lit(block_terms), F.floor(F.lit(1 << 21) / F.col("sources"))))
    blocks = size.select(F.col("lang").alias("bl"), F.greatest(F.lit(1), F.ceil(F.col("terms") / room)).cast("long").alias("blocks"))  # one row for each lang
    number = F.pmod(F.xxhash64("term"), F.col("blocks"))
    cells = counted.withColumn("p", p).join(F.broadcast(blocks) if few else blocks, F.col("lang") == F.col("bl")).select("lang", number.alias("block"), "source", "term", "p")
    bases = groups.join(F.broadcast(blocks) if few else blocks, F.col("lang") == F.col("bl"))
    bases = bases.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", share(F.lit(0), F.col("total"), F.col("terms")).alias("p0"))
    parts = cells.groupBy("lang", "block").cogroup(bases.groupBy("lang", "block")).applyInArrow(_distances, "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    pairs = sums.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
occ AS (SELECT nr, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY lang, term HAVING count(DISTINCT nr) >= 30),
cnt AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occ o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY 1, 2, 3),
grp AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
tot AS (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY 1, 2),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 5)) // (coalesce(t.n, 0) + 5 * v.v) AS p, 1 + (1000000000 * (k.n::HUGEINT + 5)) // (v.n + 5 * v.v) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(d.value), 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) d
    ON d.lang = a.lang AND d.source = a.source AND d.other = b.source GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms QUALIFY rank <= 50
"""
