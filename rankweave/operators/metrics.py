"""Ranking quality and detector quality over (system, job_id, candidate_id, rank, rel) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.ranks import running_hits
from rankweave.runtime import ship

RELEVANT = 2
RESAMPLES = 10_000


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def dcg(ranking: DataFrame, k: int, by: list[str]) -> DataFrame:
    return ranking.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("rank") <= k, gain(F.col("rel"), F.col("rank")))), F.lit(0.0)).alias("dcg"))


def ndcg(ranking: DataFrame, labels: DataFrame, k: int, by: list[str], relevance: str = "rel") -> DataFrame:
    """DCG over that of the best order of all the job's labels (job_id, rel); 0 where that is 0."""
    best = Window.partitionBy("job_id").orderBy(F.desc(relevance))  # its first k: the limit is pushed below the shuffle
    ideal = labels.select("job_id", F.col(relevance).alias("rel"), F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k)
    ideal = dcg(ideal, k, ["job_id"]).withColumnRenamed("dcg", "ideal")
    return dcg(ranking, k, by).join(ideal, "job_id", "left").select(*by, F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"))


def per_query(ranking: DataFrame, by: list[str], k: int = 5, relevant: int = RELEVANT) -> DataFrame:
    """reciprocal_rank, average_precision and precision_at_k of each ranking."""
    hit = F.col("rel") >= relevant
    # Precision at a hit is its number among the hits over its rank: only hits are numbered, whatever the length of a list.
    hits = running_hits(ranking.select(*by, "rank", "rel"), hit, by).groupBy(*by).agg((F.lit(1.0) / F.min("rank")).alias("reciprocal_rank"), F.avg(F.col("hit_number") / F.col("rank")).alias("average_precision"))
    first = ranking.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("rank") <= k, hit.cast("double"))), F.lit(0.0)).alias("precision_at_k"))
    zero = lambda name: F.coalesce(name, F.lit(0.0)).alias(name)
    return first.join(hits, by, "left").select(*by, zero("reciprocal_rank"), zero("average_precision"), "precision_at_k")


def stuffing_advantage(ranking: DataFrame, meta: DataFrame, by: list[str]) -> DataFrame:
    """Mean rank percentile of honest rows less that of stuffed ones, among the lowest tier of the job's role; null without either."""
    sizes = ranking.groupBy(*by).agg(F.count("*").alias("_size"))
    placed = ranking.join(sizes, by).withColumn("percentile", (F.col("rank") - 1) / F.col("_size"))
    rows = placed.join(meta.filter("tier = 1"), (placed.candidate_id == meta.candidate_id) & (placed.job_id == meta.role)).drop(meta.candidate_id)
    mean = lambda stuffed: F.avg(F.when(F.col("stuffed") == stuffed, F.col("percentile")))
    return rows.groupBy(*by).agg((mean(False) - mean(True)).alias("advantage"))


def detector_scores(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of boolean columns flagged and truth."""
    flag, truth = F.coalesce("flagged", F.lit(False)), F.coalesce("truth", F.lit(False))
    cells = {"tp": flag & truth, "fp": flag & ~truth, "fn": ~flag & truth, "tn": ~flag & ~truth}
    out = rows.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def attack_gain(ranking: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, attack, control_id, gain): how much higher, as a share of the list, an attacked copy ranks than its control."""
    sizes = ranking.groupBy(*by).agg(F.count("*").alias("n"))
    placed = ranking.select(*by, "candidate_id", "rank").join(sizes, by)
    control = placed.select(*by, F.col("candidate_id").alias("control_id"), F.col("rank").alias("control_rank"))
    return placed.join(pairs.select("candidate_id", "control_id", "attack"), "candidate_id").join(control, [*by, "control_id"]).select(*by, "attack", "control_id", ((F.col("control_rank") - F.col("rank")) / F.col("n")).alias("gain"))


def attack_gains(ranked: DataFrame, by: list[str], control: str, attack: str) -> DataFrame:
    """(by, attack, control, gain) over rows (by, attack, control, rank, n) in which controls have no attack: one join on the control."""
    controls = ranked.filter(F.col(attack).isNull()).select(*by, control, F.col("rank").alias("control_rank"))
    copies = ranked.filter(F.col(attack).isNotNull())
    return copies.join(controls, [*by, control]).select(*by, attack, control, ((F.col("control_rank") - F.col("rank")) / F.col("n")).alias("gain"))


def bootstrap_ci(values: list[float] | np.ndarray, alpha: float = 0.05, seed: int = 0, resamples: int = RESAMPLES) -> tuple[float, float]:
    """Percentile interval of the mean, in blocks of resamples so that memory doesn't follow their number."""
    sample = np.asarray(values, dtype=float)
    if sample.size < 2:
        return (float(sample[0]),) * 2 if sample.size else (float("nan"),) * 2
    rng = np.random.default_rng(seed)
    block = max(1, min(resamples, 4_000_000 // sample.size))
    means = np.concatenate([rng.choice(sample, size=(min(block, resamples - i), sample.size)).mean(axis=1) for i in range(0, resamples, block)])
    low, high = np.percentile(means, [50 * alpha, 100 - 50 * alpha])
    return float(low), float(high)


def sign_flip_p(differences: np.ndarray, seed: int = 0, resamples: int = RESAMPLES) -> float:
    """Two-sided permutation p: how often random signs give a mean as far from 0."""
    rng = np.random.default_rng(seed)
    block = max(1, min(resamples, 4_000_000 // differences.size))
    far = sum(int((np.abs((rng.choice([-1.0, 1.0], size=(min(block, resamples - i), differences.size)) * differences).mean(axis=1)) >= abs(differences.mean()) - 1e-12).sum()) for i in range(0, resamples, block))
    return far / resamples


def paired_difference(treatment: DataFrame, baseline: DataFrame, by: list[str], pair: str, value: str, seed: int = 0) -> DataFrame:
    """(by, n, mean, lo, hi, p) over pairs that both have. Each group is one study's pairs, a few hundred values."""
    ship(treatment.sparkSession)
    both = treatment.select(*by, pair, F.col(value).alias("t")).join(baseline.select(*by, pair, F.col(value).alias("b")), [*by, pair])
    schema = ", ".join([f"{b} {dict(treatment.dtypes)[b]}" for b in by] + ["n long", "mean double", "lo double", "hi double", "p double"])

    def study(frame: pd.DataFrame) -> pd.DataFrame:
        d = frame.sort_values(pair).eval("t - b").to_numpy(dtype=float)
        lo, hi = bootstrap_ci(d, seed=seed)
        return pd.DataFrame([[*frame[by].iloc[0], d.size, d.mean(), lo, hi, sign_flip_p(d, seed)]], columns=[*by, "n", "mean", "lo", "hi", "p"])

    return both.groupBy(*by).applyInPandas(study, schema)


def mean_with_ci(gains: DataFrame, by: list[str], pair: str, value: str, seed: int = 0) -> DataFrame:
    """(by, n, mean, lo, hi)."""
    ship(gains.sparkSession)
    schema = ", ".join([f"{b} {dict(gains.dtypes)[b]}" for b in by] + ["n long", "mean double", "lo double", "hi double"])

    def study(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values(pair)[value].to_numpy(dtype=float)
        return pd.DataFrame([[*frame[by].iloc[0], v.size, v.mean(), *bootstrap_ci(v, seed=seed)]], columns=[*by, "n", "mean", "lo", "hi"])

    return gains.groupBy(*by).applyInPandas(study, schema)


def as_rows(frame: DataFrame) -> Iterator[dict]:
    """Rows of an aggregated report, as dicts."""
    return (r.asDict() for r in frame.toLocalIterator())
