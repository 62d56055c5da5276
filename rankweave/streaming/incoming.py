"""Documents that arrive one after another: scored against fixed jobs as they come, and flags counted by time window.

An extension: there are no streams in batch ranking. Scoring a row needs no other row, so it is stateless;
statistics that compare a row with its batch (density z-scores, ranks) stay with batches, one a micro-batch
through ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.config import DEFAULT_ANTIGAMING, AntiGamingConfig
from rankweave.functions import text as tx
from rankweave.operators import integrity


def echoes(stream: DataFrame, jobs: DataFrame, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> DataFrame:
    """Arriving texts (candidate_id, text, ts) with the ids of jobs that they echo. Jobs' trigrams are a static table joined to the stream's."""
    wanted = jobs.select("job_id", F.explode(tx.trigrams(tx.tokens(F.col("text")))).alias("gram"))
    of = wanted.groupBy("job_id").agg(F.count("*").alias("of")).filter(F.col("of") >= config.jd_echo_min_trigrams)
    packed = wanted.join(of, "job_id").groupBy("job_id", "of").agg(F.collect_list("gram").alias("grams"))
    grams = tx.trigrams(tx.tokens(F.col("text")))
    ratio = F.size(F.array_intersect(F.col("grams"), grams)) / F.col("of")
    return stream.crossJoin(packed).withColumn("ratio", ratio).filter(F.col("ratio") > config.jd_echo_threshold).select("candidate_id", "ts", "job_id", "ratio")


def flagged_by_window(flags: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows (ts, flagged) counted by tumbling window; windows close ``late`` after the newest row."""
    timed = flags.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged")).select(F.col("w.start").alias("start"), "n", "n_flagged")


def batch_density(write: Callable[[DataFrame, int], None], config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: density signals of arriving resumes (skills, text) relative to their micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        stats = integrity.corpus_stats(batch, integrity.skill_density(F.col("skills"), F.col("text")))
        signal = integrity.skill_density_signal(F.col("skills"), F.col("text"), F.col("density_mean"), F.col("density_std"), F.col("usable"), config)
        write(batch.crossJoin(stats).withColumn("density", signal), number)

    return each
