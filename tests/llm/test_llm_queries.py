"""Every query over the smallest tables; those with SQL against it; the pipeline's stages."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from rankweave.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables here")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    frame = queries.queries()[name](spark, DIR)
    got = sorted(repr([plain(r[c]) for c in sorted(frame.columns)]) for r in frame.collect())
    assert got
    if name in queries.oracle_sql():
        base = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
            base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        found = base.execute(queries.oracle_sql()[name])
        names = [c[0] for c in found.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(frame.columns)
        assert got == sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DIR)
        found = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(found) <= ids and len(found) == len(set(found))
        assert i == 3 or docs.columns == columns
        ids = set(found)
    out = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id for r in out.collect()} == ids and "repeats" in out.columns


ODD = [(1, None, None), (2, "", "a"), (None, "lost id here now and some more words", None), (5, "x" * 100_000, "b"), (6, "same words again and again in a row", "b"), (7, "same words again and again in a row", "b"), (7, "same words again and again in a row", "b"), (7, "yet another text under the same id, quite unlike", None)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    names = "doc_id long, text string, source string, key string, node int, root string, bits string, hash string, size int, repeats int, mix_key string, kept_key string, leak_key string"
    docs = spark.createDataFrame([(*r, "k", 1, "r", "b", "h", 2, 3, "m", "q", "l") for r in rows], names)
    spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the one item of this small benchmark here"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[:13] == [n.split()[0] for n in names.split(", ")] and len(docs.columns) == 13 + (i == 3)
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        if i in (1, 2) and rows:
            assert sorted(kept, key=repr) == sorted([(1, None), ODD[2][:2], ODD[3][:2], ODD[4][:2], ODD[7][:2]], key=repr)
    assert bool(kept) == bool(rows)
