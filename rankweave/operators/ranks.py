"""Exact ranks of lists of any length: rows are dealt by ranges of (list, order), so no list has to fit a task.

A list here is what ``by`` names: a job's candidates under one system, say. Rows are range-partitioned by list and order and
sorted inside their partitions; a row's place in the whole is the rows of the partitions before its own plus its place in
there, and its rank is that less the place of its list's first row. What the driver sees is one count a partition; what is
joined back is one row a list. A list a hundred times longer takes a hundred times the partitions, not a longer task.

Defined cases: rows equal in all of ``order`` get different ranks, in no stated order (give an id to order by); null lists are one list; an empty
frame has no ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.runtime import materialize

#: Lists whose starts are broadcast at most: a row is its key and two numbers.
BROADCAST_LISTS = 200_000
_ROWS = 33  # bits of a row's place within its partition, as Spark numbers them


def positions(scores: DataFrame, order: Sequence[Column], by: Sequence[str] = ("job_id",), rank: str = "rank", size: str | None = None, written: bool = False) -> DataFrame:
    """``scores`` with ``rank`` (1 for the first of its list) and, where named, ``size``, the rows of the list.

    Ranges are found by a sample, which reads the rows once more: they are written first, unless ``written`` says that reading them is cheap.
    """
    columns, spark = scores.columns, scores.sparkSession
    rows = scores if written else materialize(scores, "rank-rows")
    keys = [F.col(b) for b in by]
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "rank-dealt")
    part = F.shiftright("_at", _ROWS)
    # A list's piece in a partition: combined before it moves, as many as there are lists and partitions together.
    pieces = dealt.groupBy(part.alias("_part"), *[F.col(b).alias(f"_{b}") for b in by]).agg(F.min("_at").alias("_at0"), F.count("*").alias("_rows"))
    pieces = materialize(pieces, "rank-pieces")
    counts = sorted(tuple(r) for r in pieces.groupBy("_part").agg(F.sum("_rows")).collect())  # one row a partition
    before = np.cumsum([0, *[n for _, n in counts]], dtype=np.int64)[:-1]
    starts = F.broadcast(spark.createDataFrame(pa.table({"_p": pa.array([p for p, _ in counts], pa.int64()), "_before": before})))
    place = F.col("_before") + F.col("_at0").bitwiseAND((1 << _ROWS) - 1)
    lists = pieces.join(starts, F.col("_part") == F.col("_p")).groupBy(*[f"_{b}" for b in by]).agg(F.min(place).alias("_first"), F.sum("_rows").alias("_size"))
    lists = materialize(lists, "rank-lists")
    few = F.broadcast(lists) if lists.limit(BROADCAST_LISTS + 1).count() <= BROADCAST_LISTS else lists
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    out = dealt.join(starts, part == F.col("_p")).join(few, same)
    rank_ = F.col("_before") + F.col("_at").bitwiseAND((1 << _ROWS) - 1) - F.col("_first") + 1
    return out.select(*columns, rank_.alias(rank), *([F.col("_size").alias(size)] if size else []))


def rank_all(scores: DataFrame, score: str = "score", by: Sequence[str] = ("job_id",), tie: Sequence[str] = ("candidate_id",), rank: str = "rank", size: str | None = None, written: bool = False) -> DataFrame:
    """The order of rankings: highest score first, ids ascending among equals."""
    return positions(scores, [F.desc(score), *map(F.col, tie)], by, rank, size, written)


def running_hits(ranking: DataFrame, hit: Column, by: Sequence[str], rank: str = "rank", out: str = "hit_number") -> DataFrame:
    """The rows of a ranking where ``hit`` holds, numbered within their list in its order: how many hits there are down to each."""
    return positions(ranking.where(hit), [F.col(rank)], by, out)
