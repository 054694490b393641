"""The registered queries on the smallest tables, their SQL, and the pipeline against its operators' plain versions."""

import duckdb
import pytest

import corpus_pipeline
from cratemill.llm import queries

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]}) q").fetchall()
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(str, want))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows[name] = (before, docs.collect())
    before, after = rows["exact dedup"]
    assert {r["doc_id"] for r in after} == {max(x["doc_id"] for x in before if x["text"] == t) for t in {r["text"] for r in before}}
    before, after = rows["simhash near-dedup"]
    ids = [r["doc_id"] for r in before]
    roots = brute.components([(r["doc_id"], brute.fingerprint(r["text"])) for r in before])
    assert {r["doc_id"] for r in after} == {i for i, c in zip(ids, roots) if i == c}
    before, after = rows["benchmark decontamination"]
    items = [(i, t, set(zip(*[brute.ALNUM.findall(brute.low(t))[j:] for j in range(5)]))) for i, t in bench]
    leaks = set()
    for r in before:
        w = brute.ALNUM.findall(brute.low(r["text"]))
        grams = set(zip(*[w[j:] for j in range(5)]))
        leaks |= {r["doc_id"] for i, t, g in items if g & grams and brute.tiling(r["text"], t, 5) >= 0.8}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - leaks
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() == docs.count()


def test_run_is_repeatable(spark):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and a


def _tables(spark, root, docs, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(docs, schema).write.parquet(f"{root}/documents.parquet")
    labels = [(1, 1, 0), (2, 1, None), (3, 0, 0), (None, 1, 0), (4, 1, 0), (4, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and very long texts, further columns with names that operators use inside."""
    texts = [(1, "plain words of a text"), (2, None), (None, "no id at all"), (3, ""), (4, "alpha beta gamma delta epsilon zeta"), (5, "long " * 30000), (5, "long " * 30000), (6, "other words"), (None, None)]
    docs = [(i, t, None, "src" if n % 2 else None, None, "x", n) for n, (i, t) in enumerate(texts)]
    _tables(spark, tmp_path, docs, "doc_id long, text string, lang string, source string, n_chars long, tag string, digest int")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        assert {(r["doc_id"], r["text"]) for r in out.collect()} <= set(texts)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got]
    assert 4 not in ids and ids.count(5) <= 1 and len(got) <= 6


def test_pipeline_on_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_leaves_only_its_last_tables(spark, tmp_path):
    """What stages made and read is deleted once the next result is written."""
    import os

    from cratemill.llm import common

    root = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, SF).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before if x.startswith("cratemill-")}
    assert not left & {"cratemill-quality-classifier", "cratemill-exact-dedup", "cratemill-simhash-near-dedup", "cratemill-dedup-input", "cratemill-dedup-state", "cratemill-fingerprints", "cratemill-importance"}
    assert "cratemill-benchmark-decontamination" in left
