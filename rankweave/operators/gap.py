"""Skill gaps: each requirement matched, transferable from a held neighbour, or missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.ontology import BRIDGE_HOPS, nearest_rows
from rankweave.schemas import GapStatus


def requirements(jobs: DataFrame) -> DataFrame:
    """(job_id, skill, required) from jobs with arrays; a skill asked both ways is required."""
    asked = lambda name, flag: jobs.select("job_id", F.explode(name).alias("skill"), F.lit(flag).alias("required"))
    return asked("required", True).unionByName(asked("preferred", False)).groupBy("job_id", "skill").agg(F.max("required").alias("required"))


def analyse(pairs: DataFrame, wanted: DataFrame, held: DataFrame, held_expanded: DataFrame, paths: DataFrame, max_hops: int = BRIDGE_HOPS) -> DataFrame:
    """(job_id, candidate_id, skill, required, status, via, path) for each requirement of each pair (job_id, candidate_id)."""
    rows = pairs.join(wanted, "job_id")
    has = held_expanded.select("candidate_id", "skill").distinct().withColumn("has", F.lit(True))
    rows = rows.join(has, ["candidate_id", "skill"], "left")
    open_ones = rows.filter("has IS NULL").select("candidate_id", F.col("skill").alias("target")).distinct()
    near = nearest_rows(open_ones, held.select("candidate_id", "skill").distinct(), paths, max_hops).select("candidate_id", F.col("target").alias("skill"), "via", "path")
    status = F.when(F.col("has"), GapStatus.MATCHED.value).when(F.col("via").isNotNull(), GapStatus.TRANSFERABLE.value).otherwise(GapStatus.MISSING.value)
    return rows.join(near, ["candidate_id", "skill"], "left").select("job_id", "candidate_id", "skill", "required", status.alias("status"), "via", "path")


def surplus(pairs: DataFrame, wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(job_id, candidate_id, skill): held skills that the job doesn't ask for."""
    return pairs.join(held, "candidate_id").join(wanted.select("job_id", "skill"), ["job_id", "skill"], "left_anti").select("job_id", "candidate_id", "skill").distinct()


def upskill_priorities(gaps: DataFrame, limit: int = 5) -> DataFrame:
    """Unmet items of each pair in the order to close them, the first ``limit``: required, transferable, near, by name."""
    order = (F.col("required").cast("int").desc(), (F.col("status") == GapStatus.TRANSFERABLE.value).cast("int").desc(), F.coalesce(F.size("path"), F.lit(0)), F.col("skill"))
    rank = F.row_number().over(Window.partitionBy("job_id", "candidate_id").orderBy(*order))
    return gaps.filter(F.col("status") != GapStatus.MATCHED.value).withColumn("priority", rank).filter(F.col("priority") <= limit)


def describe(skill: Column, status: Column, required: Column, via: Column, path: Column) -> Column:
    route = F.when(F.size(path) > 0, F.array_join(path, " -> ")).otherwise(F.concat_ws(" -> ", via, skill))
    return (
        F.when(status == GapStatus.MATCHED.value, F.concat(skill, F.lit(": held")))
        .when(status == GapStatus.TRANSFERABLE.value, F.concat(skill, F.lit(": transferable via "), via, F.lit(" ("), route, F.lit(")")))
        .otherwise(F.concat(skill, F.when(required, ": missing (required)").otherwise(": missing (preferred)")))
    )


def counts(gaps: DataFrame, extra: DataFrame) -> DataFrame:
    """matched, transferable, missing, missing_required, surplus, total_requirements and coverage of each pair."""
    key = ["job_id", "candidate_id"]
    is_ = lambda s: F.col("status") == s.value
    per = gaps.groupBy(*key).agg(
        F.count_if(is_(GapStatus.MATCHED)).alias("matched"), F.count_if(is_(GapStatus.TRANSFERABLE)).alias("transferable"), F.count_if(is_(GapStatus.MISSING)).alias("missing"),
        F.count_if(is_(GapStatus.MISSING) & F.col("required")).alias("missing_required"), F.count("*").alias("total_requirements"),
    )
    more = extra.groupBy(*key).agg(F.count("*").alias("surplus"))
    out = per.join(more, key, "full_outer").na.fill(0)
    return out.withColumn("coverage", F.coalesce(F.try_divide(F.col("matched").cast("double"), "total_requirements"), F.lit(0.0)))
