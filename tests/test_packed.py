"""Ranks from packed keys against lists that are sorted whole."""

import pytest
from pyspark.sql import functions as F

from rankweave.operators import attacks, packed, rankers

WORDS = "red fox runs in the wood while old hen sleeps and waits for night to come".split()
DOCS = [(i, " ".join(WORDS[(i * k) % 15] for k in range(1, 3 + i % 7)), i % 3 == 0, i % 4) for i in range(40)] + [(40, None, True, 1), (41, "zebra", True, 3)]
JOBS = [(1, " ".join(WORDS * 2)), (2, "fox hen"), (3, ""), (4, None), (5, "red wood red wood")]
NAMES = tuple(s.name for s in attacks.SYSTEMS)


def whole(spark, docs, jobs):
    scored = attacks.features(docs, jobs).withColumnRenamed("bm25", "score")
    rows = attacks.ranked(rankers.scale_by_max(scored).withColumnRenamed("score", "bm25")).collect()
    return {(r.system, r.job_id, r.candidate_id, r.attack): (r["rank"], r.n) for r in rows}


@pytest.mark.parametrize("piece,held,chars,name", [(10**6, 10**6, 10**6, lambda c: c), (20, 50, 40, lambda c: c), (20, 50, 10**6, lambda c: F.concat(F.lit("d"), F.lpad(c.cast("string"), 3, "0")))])
def test_ranks_are_those_of_whole_lists(spark, monkeypatch, piece, held, chars, name):
    monkeypatch.setattr(packed, "PIECE", piece)
    monkeypatch.setattr(packed, "HELD", held)
    monkeypatch.setattr(attacks, "JOB_CHARS", chars)
    docs = spark.createDataFrame(DOCS, "candidate_id long, text string, attacked boolean, grade int").withColumn("candidate_id", name(F.col("candidate_id")))
    jobs = spark.createDataFrame(JOBS, "job_id int, text string")
    lists = attacks.packed_lists(docs, jobs, NAMES, lambda f: attacks.damped(f, attacks.SYSTEMS), rankers.TfidfRanker())
    want = whole(spark, docs.drop("grade"), jobs)
    pieces = lists.rows.select("piece").distinct().count()
    assert pieces > 1 if piece < 10**6 else pieces == 1
    attack = {packed.CONTROL: None, packed.PLAIN: None, 2: "half", 3: "half", 4: "paste", 5: "paste"}
    found = {(r.system, r.job_id, r.candidate_id, attack[r.kind]): (r["rank"], r.n) for r in lists.named(packed.places(lists, lambda kind: kind >= 0)).collect()}
    assert found == want and len(found) > 500
    for r in packed.sums(lists, (packed.CONTROL, packed.HALF, packed.PASTE)).collect():
        mine = {k[2:]: v[0] for k, v in want.items() if k[:2] == (r.system, r.job_id)}
        pairs = {a: [(mine[c, None], mine[c, a]) for c, x in mine if x == a and (c, None) in mine] for a in attacks.ATTACKS}
        assert (r.n, r.half, r.paste) == (len(mine), *(sum(c > x for c, x in pairs[a]) for a in ("half", "paste")))
        assert [r.n1, r.sum1, r.sum3, r.sum5] == [len(pairs["half"]), sum(c for c, _ in pairs["half"]), *(sum(x for _, x in pairs[a]) for a in ("half", "paste"))]
    honest = attacks.packed_lists(docs, jobs, NAMES, lambda f: attacks.damped(f, attacks.SYSTEMS), rankers.TfidfRanker(), ranked_copies=False)
    grade = {r.candidate_id: r.grade for r in docs.collect()}
    precise, top = packed.precision(honest, 2, 10)
    tops = {(r.system, r.job_id, r["rank"]): r.rel for r in top.collect()}
    for r in precise.collect():
        order = [grade[k[2]] for k in sorted((k for k in want if k[:2] == (r.system, r.job_id) and k[3] is None), key=want.get)]
        hits = [i + 1 for i, g in enumerate(order) if g >= 2]
        assert r.average_precision == pytest.approx(sum((h + 1) / at for h, at in enumerate(hits)) / len(hits)) and r.reciprocal_rank == pytest.approx(1 / hits[0])
        assert [tops[r.system, r.job_id, i + 1] for i in range(min(10, len(order)))] == order[:10]


def test_no_documents_or_jobs_give_no_lists(spark):
    docs = spark.createDataFrame(DOCS[:3], "candidate_id long, text string, attacked boolean, grade int")
    jobs = spark.createDataFrame(JOBS[:2], "job_id int, text string")
    for some, asked in ((docs.limit(0), jobs), (docs, jobs.limit(0))):
        assert packed.sums(attacks.packed_lists(some, asked, ("bm25",), lambda f: attacks.guarded(f)[:1]), (packed.CONTROL,)).count() == 0


@pytest.mark.parametrize("k", [2, 100])
def test_fused_ranks_are_those_of_whole_lists(spark, monkeypatch, k):
    monkeypatch.setattr(packed, "HELD", 50)
    docs = spark.createDataFrame(DOCS, "candidate_id long, text string, attacked boolean, grade int")
    jobs = spark.createDataFrame(JOBS, "job_id int, text string").where("text IS NOT NULL")
    lists = attacks.packed_lists(docs, jobs, ("bm25", "tfidf"), lambda f: [(f["met"], f["bm25"]), (f["shared"], f["tfidf"])], rankers.TfidfRanker(), copies=False, ranked_copies=False, echo=False)
    scores = {"bm25": rankers.Bm25Ranker().score_all(docs, jobs), "tfidf": rankers.TfidfRanker().score_all(docs, jobs)}
    ranked = rankers.rank_systems({n: s.withColumn("score", F.round("score", 9)) for n, s in scores.items()})
    grade = {r.candidate_id: r.grade for r in docs.collect()}
    hits, sums = {}, {}
    for r in ranked.collect():
        sums.setdefault(r.job_id, {}).setdefault(r.candidate_id, []).append(1 / (1 + r["rank"]))
        if grade[r.candidate_id] >= 2:
            hits[r.system, r.job_id] = min(r["rank"], hits.get((r.system, r.job_id), 99))
    want = {job: sorted(((round(sum(v), 9), c, grade[c]) for c, v in mine.items()), key=lambda x: (-x[0], x[1]))[:k] for job, mine in sums.items()}
    assert packed.fused(lists, k, constant=1) == want
    assert packed.first_hits(lists, 2) == hits
