"""Features of attacked copies from counts against those of texts that were built."""

import pytest
from pyspark.sql import functions as F

from rankweave.operators import attacks, integrity, rankers

DOCS = [(1, "red fox runs in the red wood while the old fox sleeps", True), (2, "a hen and C++ tools, node.js", False), (3, None, True), (4, "", None), (5, "wood", True), (6, "red fox runs", False)]
LONG = "the red fox runs in the wood and sees a hen that runs from the old fox who sleeps in the old wood by the red hen house and waits for the night to come"
JOBS = [(1, LONG), (2, "c++ hen"), (3, "unknownword"), (4, ""), (5, None), (6, "red wood red wood")]


def built(spark):
    docs = spark.createDataFrame(DOCS, "candidate_id long, text string, attacked boolean")
    jobs = spark.createDataFrame([(j, t, attacks.first_half(t or "")) for j, t in JOBS], "job_id int, job_text string, half string")
    body = F.coalesce("text", F.lit(""))
    kinds = F.array(F.struct(F.lit("paste").alias("attack"), F.col("job_text").alias("more")), F.struct(F.lit("half").alias("attack"), F.col("half").alias("more")))
    copies = docs.where("attacked").withColumn("text", body).crossJoin(jobs.where("job_text IS NOT NULL")).withColumn("k", F.explode(kinds))
    return copies.select("job_id", "candidate_id", "k.attack", F.concat("text", F.lit("\n"), "k.more").alias("text"), "job_text")


@pytest.mark.parametrize("chars,cells", [(10**6, 10**6), (20, 10)])
def test_copies_score_as_their_texts(spark, monkeypatch, chars, cells):
    monkeypatch.setattr(attacks, "JOB_CHARS", chars)
    monkeypatch.setattr(attacks, "CELLS", cells)
    docs = spark.createDataFrame(DOCS, "candidate_id long, text string, attacked boolean")
    jobs = spark.createDataFrame(JOBS, "job_id int, text string")
    found = attacks.features(docs, jobs)
    rows = {(r.job_id, r.candidate_id, r.attack): r for r in found.collect()}
    copies = built(spark)
    keys = ("job_id", "candidate_id", "attack")
    plain = docs.select("candidate_id", F.coalesce("text", F.lit("")).alias("text"))
    want = {tuple(r[k] for k in keys): r.score for r in rankers.Bm25Ranker().raw_scores(copies, jobs, corpus=plain, keys=keys, own="job_id").collect()}
    want |= {(r.job_id, r.candidate_id, None): r.score for r in rankers.Bm25Ranker().raw_scores(plain, jobs).collect()}
    assert rows.keys() == want.keys() and any(k[2] == "half" for k in want)
    assert all(rows[k].bm25 == pytest.approx(want[k]) for k in want)
    echo = {tuple(r[k] for k in keys): r.e for r in copies.select(*keys, integrity.echo_ratio(F.col("text"), F.col("job_text")).alias("e")).collect()}
    assert any(e for e in echo.values())
    assert all(rows[k].echo == (None if echo[k] is None else pytest.approx(echo[k])) for k in rows if k[2])
    tfidf = {(r.job_id, r.candidate_id): r.score for r in rankers.TfidfRanker().score_all(plain, jobs.where("text IS NOT NULL")).collect()}
    assert all(rows[k].tfidf == pytest.approx(tfidf.get(k[:2], 0.0)) for k in rows if k[2] is None)
    paste = rows[1, 5, "paste"]
    assert paste.coverage == pytest.approx(1) and paste.grounded == pytest.approx(0.4 + 0.6 * rows[1, 5, None].coverage)
    assert paste.experience > rows[1, 5, None].experience and 0.9 < paste.dense <= 1
    assert attacks.features(docs.limit(0), jobs).count() == attacks.features(docs, jobs.limit(0)).count() == 0


def test_systems_are_rows_of_weights(spark):
    rows = [(1, 10, None, 1.0, 0.2, 0.5, 1.0, 0.4, 1.0, 0.1), (1, 11, None, 0.5, 0.9, 0.4, 0.2, 0.2, 0.1, None), (1, 11, "paste", 0.9, 0.8, 0.6, 1.0, 0.5, 0.3, 1.0)]
    frame = spark.createDataFrame(rows, "job_id long, candidate_id long, attack string, " + ", ".join(f"{f} double" for f in attacks.FEATURES))
    found = {(r.system, r.candidate_id, r.attack): (round(r.total, 6), r.rank, r.n) for r in attacks.ranked(frame).collect()}
    assert len(found) == 21 and {s for s, _, _ in found} == {s.name for s in attacks.SYSTEMS}
    assert found["tfidf", 11, None] == (0.9, 1, 3) and found["bm25", 11, "paste"] == (0.9, 2, 3)
    plain = 0.1 * 0.9 + 0.4 * 0.6 + 0.3 * 1.0 + 0.2 * 0.3
    assert found["hybrid_plain", 11, "paste"][0] == pytest.approx(plain) and found["hybrid_detector_only", 11, "paste"][0] == pytest.approx(plain - 0.35 * 0.2)
    assert found["hybrid_full", 11, "paste"][0] == pytest.approx(plain - 0.3 * 0.5 - 0.35 * 0.2)
    gated = (0.05 + 0.16 + 0.06 + 0.02) * (0.25 + 0.75 * 0.4)
    assert found["hybrid_plain", 11, None][0] == pytest.approx(gated)
