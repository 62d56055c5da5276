"""Scoring, gate, weights and metrics against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.config import AntiGamingConfig, GroundingConfig, PrerequisiteGate, ScoringWeights, WeightError
from rankweave.operators import bitsets, metrics, scoring


@pytest.fixture(scope="module")
def value(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first().x


def sets(*names):
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def test_weights():
    assert ScoringWeights().total == pytest.approx(1)
    assert ScoringWeights.rescaled(2, 2, 2, 2).semantic == 0.25
    assert ScoringWeights().with_(semantic=0).total == pytest.approx(1)
    for bad in ((0.5, 0.5, 0.5, 0.5), (-0.1, 0.5, 0.4, 0.2)):
        with pytest.raises(WeightError):
            ScoringWeights(*bad)
    for bad in ((0, 0, 0, 0), (-1, 1, 1, 1)):
        with pytest.raises(WeightError):
            ScoringWeights.rescaled(*bad)


@pytest.mark.parametrize("make", [lambda: AntiGamingConfig(signal_weights=(1.0,)), lambda: AntiGamingConfig(signal_weights=(0.5,) * 5), lambda: PrerequisiteGate(threshold=0), lambda: PrerequisiteGate(floor=1.5), lambda: GroundingConfig(floor=-1), lambda: GroundingConfig(semantic_ceiling=0.4)])
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_sets(value):
    assert value(scoring.coverage_score(sets("a"), sets("a"), sets("b"))) == pytest.approx(1 / 1.5)
    assert value(scoring.coverage_score(sets("a"), sets(), sets())) == 1.0
    assert value(scoring.coverage_score(sets("a", "z", "y"), sets("a", "b"), sets("b"))) == 0.5
    assert value(scoring.dice_score(sets(), sets())) == 0.0
    assert value(scoring.dice_score(sets("a", "b"), sets("b", "c"))) == 0.5
    assert value(scoring.required_coverage(sets("a"), sets("a", "b", "c"))) == pytest.approx(1 / 3)
    assert value(scoring.required_coverage(sets("a"), sets())) == 1.0
    with pytest.raises(ValueError):
        scoring.skill_score(sets(), sets(), sets(), "cosine")


def test_grounded_coverage(value):
    strong = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(0.0))
    assert value(scoring.grounded_coverage(sets("a", "b"), sets("a", "b"), sets(), strong)) == pytest.approx((1 + 0.4) / 2)
    full = GroundingConfig(floor=1.0)
    assert value(scoring.grounded_coverage(sets("a", "b"), sets("a", "c"), sets("b"), strong, full)) == pytest.approx(value(scoring.coverage_score(sets("a", "b"), sets("a", "c"), sets("b"))))
    assert value(scoring.grounded_coverage(sets("a"), sets(), sets(), strong)) == 1.0
    assert value(scoring.grounded_coverage(sets("x"), sets("x"), sets(), strong)) == 0.4


def test_experience_and_education(value):
    x = lambda a, b: value(scoring.experience_score(F.lit(float(a)), F.lit(float(b))))
    assert [x(3, 6), x(30, 5), x(0, 5), x(0, 0)] == [0.5, 1.0, 0.0, 1.0]
    assert value(scoring.experience_score(F.lit(None).cast("double"), F.lit(2.0))) is None
    e = lambda a, b: value(scoring.education_score(F.lit(a), F.lit(b)))
    assert [e(2, 3), e(4, 3), e(0, 2), e(0, 0)] == [pytest.approx(2 / 3), 1.0, 0.0, 1.0]


def test_gate_and_total(value):
    gate = PrerequisiteGate()
    for c in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
        assert value(scoring.gate_multiplier(F.lit(c))) == pytest.approx(gate.multiplier(c))
    assert value(scoring.gate_multiplier(F.lit(0.0))) == 0.25 and value(scoring.gate_multiplier(F.lit(0.0), PrerequisiteGate(enabled=False))) == 1.0
    one = F.lit(1.0)
    assert value(scoring.combine(one, one, one, one, 0.25)).total == pytest.approx(0.75)
    assert value(scoring.combine(one, one, one, one, 0.9, gate=0.25)).total == 0.0
    parts = value(scoring.contributions(scoring.combine(one, one, one, one)))
    assert sum(parts) == pytest.approx(1.0)


def test_bit_sets_agree_with_arrays(spark):
    rng = np.random.default_rng(3)
    names = [f"s{i:03d}" for i in range(150)]
    rows = [(int(k), names[i]) for k in range(20) for i in rng.choice(150, rng.integers(1, 90), replace=False)]
    frame = spark.createDataFrame(rows + rows[:50], "k long, s string")
    known = bitsets.vocabulary(frame, "s")
    k = bitsets.words(known)
    bits = bitsets.encode(frame, "k", "s", known, "a")
    other = bitsets.encode(frame, "k", "s", known, "b").withColumnRenamed("k", "j")
    got = {(r.k, r.j): (r.n, r.m) for r in bits.crossJoin(other).select("k", "j", bitsets.common("a", "b", k).alias("n"), bitsets.size("a", k).alias("m")).collect()}
    own = {i: {s for x, s in rows if x == i} for i in range(20)}
    assert got == {(i, j): (len(own[i] & own[j]), len(own[i])) for i in own for j in own}
    assert bitsets.vocabulary(frame, "s", 10) is None


def ranking(spark, rels, system="s", job=1):
    return spark.createDataFrame([(system, job, f"c{i:02d}", i + 1, r) for i, r in enumerate(rels)], "system string, job_id int, candidate_id string, rank int, rel int")


def test_ranking_metrics(spark):
    one = lambda frame, name: frame.first()[name]
    assert one(metrics.dcg(ranking(spark, [3, 2]), 2, ["system"]), "dcg") == pytest.approx(8.8927893)
    labels = ranking(spark, [3, 2, 1, 0]).select("job_id", "rel")
    assert one(metrics.ndcg(ranking(spark, [3, 2, 0, 1]), labels, 4, ["system", "job_id"]), "ndcg") == pytest.approx(0.992620, abs=1e-6)
    per = lambda rels, k=5: metrics.per_query(ranking(spark, rels), ["system"], k).first()
    assert per([0, 1, 2, 3]).reciprocal_rank == pytest.approx(1 / 3) and per([1, 1, 1]).reciprocal_rank == 0
    assert per([3, 0, 2, 0]).average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert per([3, 0, 2, 0, 0]).precision_at_k == pytest.approx(0.4) and per([3]).precision_at_k == 1.0


def test_detector_scores(spark):
    rows = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, True)] * 2 + [(None, None)], "flagged boolean, truth boolean")
    r = metrics.detector_scores(rows).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 1, 2, 1) and r.precision == 0.75 and r.recall == 0.6 and r.f1 == pytest.approx(2 / 3)
    assert metrics.detector_scores(rows.limit(0)).first().f1 == 0.0


def test_resampling(spark):
    assert metrics.bootstrap_ci([0.5]) == (0.5, 0.5) and all(map(math.isnan, metrics.bootstrap_ci([])))
    low, high = metrics.bootstrap_ci(list(range(20)), seed=1)
    assert low < 9.5 < high and metrics.bootstrap_ci(list(range(20)), seed=1) == (low, high)
    assert metrics.sign_flip_p(np.array([1.0, 2.0, 1.5, 1.2, 2.2, 1.1, 1.9, 1.4, 1.3, 1.8])) < 0.01
    assert metrics.sign_flip_p(np.array([1.0, -1.0])) == 1.0
    t = spark.createDataFrame([("a", i, i + 1.0) for i in range(8)], "attack string, pair int, gain double")
    r = metrics.paired_difference(t, t.withColumn("gain", F.col("gain") - 1), ["attack"], "pair", "gain").first()
    assert (r.n, r["mean"], r.lo, r.hi) == (8, 1.0, 1.0, 1.0) and r.p < 0.05


def test_pairs_past_the_bit_sets(spark, tmp_path):
    """5,000 part names: the arrays' way gives what the bits give where they are allowed."""
    from datetime import date

    from rankweave.plans import skill_queries

    parts = [(i, f"part {i}", "b", i % 50) for i in range(5000)]
    orders = [(i, i % 7, date(2020 + i % 3, 1 + i % 12, 1)) for i in range(60)]
    lines = [(i % 60, (i * 37) % 5000, i % 5, 38 + i % 13) for i in range(2000)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = lambda most: {(r.job_id, r.candidate_id): tuple(r)[2:] for r in skill_queries.pairs(spark, str(tmp_path), most).collect()}
    by_array = rows(4096)
    held, req, pref = ({} for _ in range(3))
    for o, p, s, q in lines:
        held.setdefault(o % 7, set()).add(p)
        if q >= 45:
            req.setdefault(s, set()).add(p)
        elif q >= 40:
            pref.setdefault(s, set()).add(p)
    assert len(by_array) == 35
    for (job, who), (_, both, wished, n_req, n_pref, n_held) in by_array.items():
        wish = pref[job] - req[job]
        assert (both, wished, n_req, n_pref, n_held) == (len(held[who] & req[job]), len(held[who] & wish), len(req[job]), len(wish), len(held[who]))
    assert skill_queries.query.queries["rank_by_coverage"](spark, str(tmp_path)).count() == 35


def test_equal_rows_meet_once(spark, tmp_path):
    """Copies of customers and suppliers under other keys make no more kinds, and means don't change; the best ten go by id among equals."""
    from rankweave.plans import skill_queries

    lines = [(o, p, s, q) for o, (c, ps) in enumerate([(0, "ab"), (5, "ac"), (10, "b")]) for s, p in enumerate(ps) for q in (45.0, 41.0)]
    every = [(o + 3 * i, "abc".index(p), s + 12 * i, q) for i in range(7) for o, p, s, q in lines]
    orders = [(o + 3 * i, c + 15 * i) for i in range(7) for o, c in enumerate((0, 5, 10))]
    spark.createDataFrame(every, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").selectExpr("*", "timestamp_ntz'1999-05-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "a", "x", 1), (1, "b", "x", 1), (2, "c", "x", 1)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    query, d = skill_queries.query.queries, str(tmp_path)
    candidates, own, *_ = skill_queries._education(spark, d)
    rows, kinds = skill_queries._kinds(candidates, "candidate_id", own, "who")
    assert rows.count() == 21 and sorted((r.kind, r.n) for r in kinds.select("kind", "n").collect()) == [(0, 7), (5, 7), (10, 7)]
    dice = {(r.job_id % 12, tuple(r)[1:]) for r in query["skill_dice"](spark, d).collect()}
    # Three customers hold ab, ac and b; job 0 asks for ab, job 1 for bc.
    assert dice == {(0, (0.722222, 1.0, 0.5)), (1, (0.555556, 0.666667, 0.5))}
    best = query["rank_by_coverage"](spark, d).filter("job_id = 0").orderBy("rank").select("candidate_id").collect()
    assert [r[0] for r in best[:7]] == [15 * i for i in range(7)] and len(best) == 10


def test_best_pairs_are_found_in_blocks(spark, monkeypatch):
    """Sets of three words against the scores of every pair; the registered query makes no pair a row."""
    from rankweave.operators import best_pairs, bitsets, rankers
    from rankweave.plans import skill_queries

    draw = np.random.default_rng(7)
    word = lambda n: [int(x) for x in draw.integers(-(1 << 63), (1 << 63) - 1, n)]
    who = list(zip(range(80), [float(x) for x in draw.integers(0, 60, 80) / 12], [int(x) for x in draw.integers(0, 5, 80)], *[word(80) for _ in range(3)], strict=True))
    who += [(100 + i, *row[1:]) for i, row in enumerate(who[:40])]  # equals: the smaller id comes first
    asked = [word(30) for _ in range(3)]
    wished = [[a & ~r for a, r in zip(word(30), x, strict=True)] for x in asked]
    jobs = list(zip(range(30), [float(i % 6) for i in range(30)], [i % 4 for i in range(30)], *asked, *wished, strict=True))
    candidates = spark.createDataFrame(who, "candidate_id long, years double, degree int, held0 long, held1 long, held2 long")
    jobs = spark.createDataFrame(jobs, "job_id long, min_years double, min_degree int, req0 long, req1 long, req2 long, pref0 long, pref1 long, pref2 long")
    counts = {"both": bitsets.common("held", "req", 3), "wished": bitsets.common("held", "pref", 3), "n_req": bitsets.size("req", 3), "n_pref": bitsets.size("pref", 3), "n_held": bitsets.size("held", 3)}
    s = F.col("scores")
    every = candidates.crossJoin(jobs).select("job_id", "candidate_id", skill_queries._scores(counts).alias("scores"))
    every = every.select("job_id", "candidate_id", *[F.round(x, 6).alias(n) for n, x in (("total", s.total), ("skill", s.skill), ("coverage", s.required_coverage), ("gate", s.gate))])
    rows = lambda frame: sorted(map(tuple, rankers.top_k(frame, 10, "total").collect()))
    got = best_pairs.best(candidates, jobs, 10, 3)
    assert rows(got) == rows(every) and len(rows(got)) == 300
    monkeypatch.setattr(skill_queries, "_crossed", None)
    assert skill_queries.query.queries["rank_by_coverage"](spark, "/root/testdata/sf0.001").count() > 0


def test_contributions_need_no_pairs(spark, tmp_path, monkeypatch):
    """Means over all pairs are what each pair by itself gives, and no pair is made."""
    from rankweave.plans import skill_queries

    lines = [(i % 40, (i * 7 + i // 40) % 9, i * 5 % 13, 36 + i * 11 % 15) for i in range(300)]
    orders = [(o, o * 3 % 11, f"{1999 + o % 4}-{1 + o % 12:02}-01") for o in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").selectExpr("o_orderkey", "o_custkey", "CAST(o_orderdate AS DATE) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"part {i}", "x", 1) for i in range(9)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    held, req, pref, months = ({} for _ in range(4))
    for o, c, day in orders:
        first = int(day[:4]) * 12 + int(day[5:7])
        months.setdefault(c, set()).update(range(first, first + 4))
    for o, p, j, q in lines:
        held.setdefault(o * 3 % 11, set()).add(p)
        (req if q >= 45 else pref if q >= 40 else {}).setdefault(j, set()).add(p)
    want = {}
    for j in req:
        wish, each = pref.get(j, set()) - req[j], []
        for c, skills in held.items():
            years, n = round(len(months[c]) / 12, 2), len(skills & req[j])
            experience = 1.0 if j % 6 == 0 else min(1.0, years / (j % 6))
            education = 1.0 if j % 4 == 0 else min(1.0, c % 5 / (j % 4))
            each.append((0.4 * 2 * n / (len(skills) + len(req[j])), 0.3 * (n + len(skills & wish) / 2) / (len(req[j]) + len(wish) / 2), 0.2 * experience, 0.1 * education))
        want[j] = pytest.approx([sum(x) / len(each) for x in zip(*each, strict=True)], abs=1e-6)
    monkeypatch.setattr(skill_queries, "_crossed", None)
    got = {r.job_id: [r.semantic, r.skill, r.experience, r.education] for r in skill_queries.query.queries["contributions"](spark, str(tmp_path)).collect()}
    assert len(want) > 5 and got == want


def test_grounded_sums_need_no_pairs(spark, tmp_path):
    """A row a job, with the sums of its pairs, customers without any asked skill left out; strengths over 1 are cut pair by pair."""
    from rankweave.plans import skill_queries

    lines = [(0, 0, 0, 50.0), (0, 1, 0, 25.0), (1, 0, 1, 50.0), (2, 2, 1, 10.0), (2, 1, 1, 41.0)]
    for name, factor in (("one", 1), ("two", 2)):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame([(o, p, s, q if o != 1 else q * factor) for o, p, s, q in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
        spark.createDataFrame([(i, i) for i in range(3)], "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
        spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "p_partkey long, p_name string").selectExpr("*", "'x' AS p_brand", "1 AS p_size").write.parquet(f"{d}/part.parquet")
    found = {r.job_id: (r.w, r.n, r.met, round(r.met_g, 9)) for r in skill_queries._grounded(spark, f"{tmp_path}/one").collect()}
    assert found == {0: (1.0, 2, 2.0, 2.0), 1: (1.5, 3, 3.0, round(1 + 0.25 + 1 + 0.41, 9))}
    mean = {r.job_id: (r.mean_grounded, r.n) for r in skill_queries.query.queries["skill_grounded"](spark, f"{tmp_path}/two").collect()}
    assert mean[0] == (1.0, 2)  # a strength of 2 earns no more than the whole
