"""Every query of the library over the smallest tables, against its SQL; the entry points without the optional part."""

import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import duckdb
import pytest

from rankweave.plans import skill_queries, text_queries

DIR, ROOT = "/root/testdata/sf0.001", Path(__file__).resolve().parents[1]
QUERIES = skill_queries.query.queries | text_queries.query.queries
ORACLES = skill_queries.query.oracles | text_queries.query.oracles
pytestmark = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables here")


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def base():
    found = duckdb.connect()
    for path in Path(DIR).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


@pytest.fixture(scope="module", autouse=True)
def generated(spark):
    """Queries run as they are shipped, with generated code."""
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "screened_corpus"])
def test_query(spark, base, name):
    frame = QUERIES[name](spark, DIR)
    got = sorted(repr([plain(r[c]) for c in sorted(frame.columns)]) for r in frame.collect())
    if name in ORACLES:
        found = base.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(frame.columns)
        assert got == sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())


def test_entry_without_the_optional_part(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules['rankweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries()); assert not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_every_supplier_is_loaded(spark, tmp_path):
    rows = [(i, f"Supplier#{i:09d}", i + 0.25) for i in range(1, 46)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    out = QUERIES["load_files"](spark, str(tmp_path)).collect()
    assert sorted((r.path, r.text, r.source_format, r.n_spans) for r in out) == [(f"{n}.txt", f"{n}\nbalance {b}", "txt", 2) for _, n, b in rows]


def test_suppliers_are_few_files(spark, tmp_path):
    """3,000 suppliers, two of one name: archives, not a folder each; all are read back."""
    rows = [(i, f"Supplier#{i % 2999:09d}", i + 0.25) for i in range(3000)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    out = QUERIES["load_files"](spark, str(tmp_path)).collect()
    assert sorted((r.path, r.text) for r in out) == sorted((f"{n}.txt", f"{n}\nbalance {b}") for _, n, b in rows)
    folder = next(p for p in reversed(spark.sparkContext._rankweave_paths) if "/suppliers-" in p)
    assert sum(p.is_file() for p in Path(folder.removeprefix("file:")).rglob("*")) < 50


def test_the_pipeline_ranks_every_supplier_for_every_region(spark, base):
    """Hidden text, which every fifth resume has, is found in these, and each region's list is whole."""
    rows = QUERIES["screened_corpus"](spark, DIR).select("job_id", "candidate_id", "rank", "flagged").collect()
    keys = [k for (k,) in base.execute("SELECT s_suppkey FROM supplier").fetchall()]
    regions = [r for (r,) in base.execute("SELECT lower(r_name) FROM region").fetchall()]
    assert sorted((r.job_id, r.candidate_id) for r in rows) == sorted((j, f"s{k}") for j in regions for k in keys)
    assert all(sorted(r.rank for r in rows if r.job_id == j) == list(range(1, len(keys) + 1)) for j in regions)
    assert {r.candidate_id for r in rows if r.flagged} == {f"s{k}" for k in keys if k % 5 == 0}


def test_a_skill_is_encoded_once_for_all_candidates(spark):
    """40 candidates claim the same three skills: the encoder gets three questions, and every candidate its evidence."""
    import pandas as pd
    from pyspark.sql import functions as F

    from rankweave.plans import pipeline

    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def encoder(texts: pd.Series) -> pd.Series:
        asked.add(int(texts.str.contains("experience using", regex=False).sum()))
        return texts.map(lambda t: [float(len(t)), 1.0])

    ranker = pipeline.HybridRanker(skill_queries.ONTOLOGY, embedder=encoder, grounding=replace(pipeline.DEFAULT_GROUNDING, query_template="experience using {skill}"))
    rows = [(f"c{i}", "EXPERIENCE\nwe wrote many other things here", ["python", "sql", "docker"]) for i in range(40)]
    resumes = spark.createDataFrame(rows, "candidate_id string, text string, skills_expanded array<string>").withColumn("sections", pipeline.tx.segment_sections(F.col("text")))
    found = ranker.evidence(resumes)[0].select("candidate_id", "skill").collect()
    assert len(set(found)) == len(found) == 120 and 0 < asked.value <= 12
