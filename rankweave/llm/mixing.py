"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

A source may be read ``max_epochs`` times at most. Each source is clamped at that cap, and what a clamped
source can't take is shared out again by weight until no source is above its cap. With the sources in order
of cap over weight, the end of that loop has a closed form: the first source whose ratio reaches the level
``(total - caps before it) / (weights from it on)`` and all after it get ``level * weight``, those before it
their cap. So the loop is one window over one row a source.

A source's target over its size is its number of epochs: the whole part repeats every document, the
fraction goes to the documents with the lowest seeded hash, up to the hash at which the words taken come
nearest to the target. That hash is found without a window over a whole source: words are summed in 4096
hash buckets a source, the buckets are accumulated, and only the bucket in which the target falls is
accumulated by document.

Defined cases: a null source is a source of its own, after all others; a null or empty text has size 0 and
is taken 0 times its size; rows that share id and text share a hash and so a decision, all others, of null or
repeated ids too, are drawn each; a source of size 0 has target 0; an empty table gives an empty result. Only the columns
doc_id, source and text are read; other columns are carried by ``apply_mix`` as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.columns import fresh, pick
from rankweave.runtime import materialize

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
VOLUME = 1.5
MAX_EPOCHS = 2.0
SEED = 17
#: The hash has 60 bits; its upper 12 number the buckets.
_BUCKET_BITS, _HASH_BITS = 12, 60


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded hash of 60 bits for each document's id and text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, size) a document -> (source, source_size, target), one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on: the windows below never see documents.
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(all_rows) * F.lit(float(volume)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # Levels fall from the first fitting source on, so the largest of them is the first one's.
    fits = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(all_rows)
    found = F.when(F.col("cap") / F.col("weight") < F.coalesce(fits, F.lit(float("inf"))), F.col("cap")).otherwise(fits * F.col("weight"))
    return per.select("source", "source_size", F.least(found, F.col("cap")).alias("target"))


def plan(documents: DataFrame, weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, source, size, draw; a row for each source with target, whole epochs and the last hash of the fraction)."""
    narrow = pick(documents, doc_id="long", source="string", text="string").select("doc_id", "source", words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    narrow = materialize(narrow, "mix-sizes")
    goal = materialize(
        targets(narrow, weights, volume, max_epochs)
        .withColumn("whole", F.floor(F.try_divide("target", F.col("source_size"))))
        .withColumn("whole", F.coalesce(F.col("whole"), F.lit(0)))
        .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))  # null is a key of its own
    goal = goal.withColumn("key", named)
    marked = narrow.withColumn("key", named).withColumn("bucket", F.shiftright("draw", _HASH_BITS - _BUCKET_BITS))
    buckets = marked.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
    edge = (
        buckets.join(goal.select("key", "part"), "key")
        .filter((F.col("part") > F.col("before")) & (F.col("part") <= F.col("before") + F.col("bucket_size")))
        .select("key", "bucket", "before", "part")
    )
    edge = materialize(edge, "mix-edges")
    within = Window.partitionBy("key").orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    steps = marked.join(edge, ["key", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(within))
    # Of the hashes in this bucket, and the end of the bucket before, the one whose words come nearest.
    start = edge.select("key", "part", (F.shiftleft(F.col("bucket").cast("long"), _HASH_BITS - _BUCKET_BITS) - 1).alias("draw"), F.col("before").alias("upto"))
    near = steps.select("key", "part", "draw", "upto").unionByName(start)
    last = near.groupBy("key").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("part")).alias("off"), F.col("draw"))).getField("draw").alias("last"))
    goal = goal.join(last, "key", "left").select("key", "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last"))
    return narrow.withColumn("key", named), materialize(goal, "mix-plan")


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    narrow, goal = plan(documents, weights, volume, max_epochs, seed)
    times = F.col("whole") + (F.col("draw") <= F.col("last")).cast("long")
    return narrow.join(goal, "key").select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def apply_mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, all their columns, and ``repeats``: how often each is read."""
    _, goal = plan(documents, weights, volume, max_epochs, seed)
    key, repeats = fresh(documents, "mix_key"), fresh(documents, "repeats")
    keyed = documents.withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")))
    goal = goal.select(F.col("key").alias(key), F.col("whole").alias(f"{key}_whole"), F.col("last").alias(f"{key}_last"))
    times = F.col(f"{key}_whole") + (draw(F.col("doc_id").cast("long"), F.col("text").cast("string"), seed) <= F.col(f"{key}_last")).cast("long")
    taken = keyed.join(goal, key).withColumn(repeats, times.cast("int")).filter(F.col(repeats) > 0)
    return taken.select(*[F.col(f"`{c}`") for c in documents.columns], repeats)


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
d AS (
  SELECT *, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest), 1, 15) AS BIGINT) AS draw FROM s),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM per),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, max(CASE WHEN cap / weight >= level THEN level END) OVER () AS fits FROM l),
t AS (
  SELECT source, source_size, least(CASE WHEN cap / weight < coalesce(fits, 'inf'::DOUBLE) THEN cap ELSE fits * weight END, cap) AS target FROM f),
g AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
p AS (SELECT *, target - whole * source_size AS part FROM g),
c AS (
  SELECT d.source, draw, part, sum(size) OVER (PARTITION BY d.source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
near AS (
  SELECT source, draw, abs(upto - part) AS off FROM c UNION ALL SELECT source, -1, part FROM p),
last AS (SELECT source, arg_min(draw, (off, draw)) AS last FROM near GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN draw <= last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN last ON d.source IS NOT DISTINCT FROM last.source
"""
