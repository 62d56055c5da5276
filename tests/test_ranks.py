"""Exact ranks of long lists, what is counted down them, and TF-IDF norms looked up in rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankweave.operators import integrity, metrics, rankers, ranks
from rankweave.runtime import materialize


@pytest.fixture(scope="module")
def lists():
    """One list holds most rows, many rows are equal in score, one list's key is null."""
    draw = random.Random(4)
    rows = [("hot" if draw.random() < 0.7 else draw.choice(("a", "b", None)), i, draw.choice((0.0, 0.5, draw.random())), draw.randrange(4)) for i in range(3000)]
    return [*rows, ("one", 9000, 0.1, 3)]


def slow_ranks(rows):
    by = {}
    for job, who, score, _ in rows:
        by.setdefault(job, []).append((-score, who))
    return {(job, who): (i + 1, len(found)) for job, found in by.items() for i, (_, who) in enumerate(sorted(found))}


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_ranks_of_any_length(spark, lists, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(lists, "job_id string, candidate_id long, score double, rel int")
        found = ranks.rank_all(frame, size="n")
        assert found.columns == ["job_id", "candidate_id", "score", "rel", "rank", "n"]
        assert {(r.job_id, r.candidate_id): (r.rank, r.n) for r in found.collect()} == slow_ranks(lists)
        assert ranks.rank_all(frame.limit(0)).count() == 0
        plan = found._jdf.queryExecution().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lists_past_the_broadcast(spark, lists, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_LISTS", 2)
    frame = spark.createDataFrame(lists, "job_id string, candidate_id long, score double, rel int")
    assert {(r.job_id, r.candidate_id): (r.rank, r.n) for r in ranks.rank_all(frame, size="n").collect()} == slow_ranks(lists)


def test_metrics_count_down_whole_lists(spark, lists):
    ranking = ranks.rank_all(spark.createDataFrame([r for r in lists if r[0]], "job_id string, candidate_id long, score double, rel int"))
    found = {r.job_id: r for r in metrics.per_query(ranking, ["job_id"]).collect()}
    place = slow_ranks([r for r in lists if r[0]])
    for job in ("hot", "a", "b", "one"):
        order = [rel for _, rel in sorted((place[job, who][0], rel) for j, who, _, rel in lists if j == job)]
        hits = [i + 1 for i, rel in enumerate(order) if rel >= 2]
        assert found[job].reciprocal_rank == pytest.approx(1 / hits[0] if hits else 0)
        assert found[job].average_precision == pytest.approx(sum((i + 1) / r for i, r in enumerate(hits)) / len(hits) if hits else 0)
        assert found[job].precision_at_k == pytest.approx(sum(rel >= 2 for rel in order[:5]) / len(order[:5]))


def test_fusion_of_lists_ranked_together(spark):
    one = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.5), (2, "x", 0.1)], "job_id long, candidate_id string, score double")
    two = spark.createDataFrame([(1, "y", 7.0), (2, "x", 0.0), (2, "z", 3.0)], "job_id long, candidate_id string, score double")
    fused = {(r.job_id, r.candidate_id): r.score for r in rankers.fuse_ranked(rankers.rank_systems({"a": one, "b": two})).collect()}
    assert fused == pytest.approx({(1, "x"): 1 / 61, (1, "y"): 1 / 62 + 1 / 61, (2, "x"): 1 / 61 + 1 / 62, (2, "z"): 1 / 61})
    with pytest.raises(ValueError, match="one system"):
        rankers.rank_systems({})


TEXTS = ["the red fox and a red hen", "a fox, the hen; fox runs", None, "", "red red red", "of the and", "Zebra C++ zebra c++ runs", "red fox red fox runs"]
JOBS = ["red fox wanted", "zebra c++ hen", "the of", None]


def slow_tfidf(texts, jobs):
    stop = set(rankers.english_stop_words())

    def terms(text):
        words = [w for w in re.findall(r"[a-z0-9+#.]{2,}", (text or "").lower()) if w not in stop]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])

    out = {}
    for j, job in enumerate(jobs):
        corpus = [terms(t) for t in [*texts, job]]
        df = Counter(t for c in corpus for t in c)
        weighed = [{t: (1 + math.log(n)) * (math.log((1 + len(corpus)) / (1 + df[t])) + 1) for t, n in c.items()} for c in corpus]
        norm = [math.sqrt(sum(x * x for x in w.values())) for w in weighed]
        for i in range(len(texts)):
            if common := set(weighed[i]) & set(weighed[-1]):
                out[j, i] = sum(weighed[i][t] * weighed[-1][t] for t in common) / (norm[i] * norm[-1])
    return out


@pytest.mark.parametrize("terms,blocks", [(10**6, 8), (3, 8), (3, 1)])
def test_tfidf_norms_in_blocks_and_past_them(spark, monkeypatch, terms, blocks):
    monkeypatch.setattr(rankers, "MAX_TERMS", terms)
    monkeypatch.setattr(rankers, "MAX_BLOCKS", blocks)
    texts = spark.createDataFrame([*enumerate(TEXTS)], "candidate_id long, text string")
    jobs = spark.createDataFrame([*enumerate(JOBS)], "job_id long, text string")
    found = rankers.TfidfRanker().score_all(texts, jobs)
    assert {(r.job_id, r.candidate_id): r.score for r in found.collect()} == pytest.approx(slow_tfidf(TEXTS, JOBS))


def test_tfidf_moves_a_term_of_a_row_once(spark, monkeypatch):
    """Whatever the vocabulary, documents are written with jobs' terms alone; the others meet packed."""
    seen = {}
    monkeypatch.setattr(rankers, "materialize", lambda frame, name, *a: seen.setdefault(name, materialize(frame, name, *a)))
    monkeypatch.setattr(rankers, "_HELD", 3)
    texts = spark.createDataFrame([*enumerate(TEXTS)], "candidate_id long, text string")
    jobs = spark.createDataFrame([*enumerate(JOBS)], "job_id long, text string")
    found = rankers.TfidfRanker().score_all(texts, jobs, first=2)
    want = slow_tfidf(TEXTS, JOBS)
    assert {t for r in seen["tfidf-terms"].collect() for t in r.terms} == {"red", "fox", "red fox", "zebra", "c++", "zebra c++", "hen"}
    kept = {(r.job_id, r.candidate_id): r.score for r in found.collect()}
    first = {(j, i) for j in range(len(JOBS)) for i in sorted((i for i in range(len(TEXTS)) if (j, i) in want), key=lambda i: (-round(want[j, i], 9), i))[:2]}
    assert first <= kept.keys() and kept == pytest.approx({k: want[k] for k in kept})


def test_tasks_keep_the_first_of_each_job(spark):
    rows = [(j, c, round((c * 37 % 101) / 101, 2)) for j in (1, 2, 3) for c in range(300)] + [(1, 1000, None)]
    frame = spark.createDataFrame(rows, "job_id long, candidate_id long, score double").repartition(3)
    kept = rankers.first_of_tasks(frame, 4)
    key = lambda r: (r.job_id, r.candidate_id, r["rank"])
    assert kept.count() < 100 and sorted(map(key, rankers.top_k(kept, 4).collect())) == sorted(map(key, rankers.top_k(frame, 4).collect()))


def test_top_terms_are_counted_in_the_row(spark):
    rows = [(1, "beta alpha beta alpha gamma"), (2, None), (3, "of the a"), (1, "alpha"), (4, "word " * 50_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, n int")
    found = integrity.top_terms(frame, "id", "text")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "alpha", 1), (1, 5, "beta", 2), (4, 50_000, "word", 50_000)]
    assert "Exchange" not in found._jdf.queryExecution().toString()
