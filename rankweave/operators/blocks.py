"""Candidates against a stated set of jobs, in blocks: sparse terms or dense vectors times the jobs' matrix.

The jobs' side is cut into blocks of bounded size by a hash of job_id, and each block is broadcast alone: one block is
a pass over the candidates that needs no shuffle; where there are more, each pass is a written table before the
next begins, so one block at a time is in memory. Candidates stay where they are, row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.runtime import materialize, small_batches

#: Entries of a block of postings (about 24 bytes each), jobs of a block, and numbers of a block of vectors.
MAX_POSTINGS = 2_000_000
MAX_JOBS = 5_000
MAX_NUMBERS = 4_000_000
_STEP = 1 << 21  # products held at once

Values = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def _passes(jobs: DataFrame, n: int, one: Callable[[DataFrame], DataFrame]) -> DataFrame:
    if n <= 1:
        return one(jobs)
    parts = [materialize(one(jobs.filter(F.pmod(F.xxhash64("job_id"), F.lit(n)) == i)), "block") for i in range(n)]
    return reduce(DataFrame.unionByName, parts)


def _schema(rows: DataFrame, keys: list[str], jobs: DataFrame, more: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([f"job_id {dict(jobs.dtypes)['job_id']}", *[f"`{k}` {kinds[k]}" for k in keys], more])


def sparse_products(rows: DataFrame, keys: list[str], terms: str, postings: DataFrame, weights: list[str], values: Values | str, powers: tuple[float, ...] | None = None, own: str | None = None) -> DataFrame:
    """(job_id, keys, s0, s1, ...) of pairs with a common term: sums of a candidate's value times the job's weight over their common terms.

    ``rows`` has an array of terms a candidate, ``postings`` (job_id, term, weights) a row for each different term of a job. ``values`` gives
    the value for each of the weights by how often a term occurs in the array and the array's length; or it names an array of numbers
    beside the terms, which then are different ones, and each weight takes these to its power. ``own`` names the key that is the only job a
    candidate is scored for. Null and empty arrays meet nothing.
    """
    spark = rows.sparkSession
    named = isinstance(values, str)
    asked = materialize(postings.select("job_id", "term", *dict.fromkeys(weights)), "postings")
    n = -(-max(asked.count(), asked.select("job_id").distinct().count() * (MAX_POSTINGS // MAX_JOBS)) // MAX_POSTINGS)
    picked = rows.select(*keys, terms, *([values] if named else []))
    shown = [k for k in keys if k != "job_id"]
    schema = _schema(rows, shown, asked, ", ".join(f"s{i} double" for i in range(len(weights))))

    def one(block: DataFrame) -> DataFrame:
        table = block.toArrow().combine_chunks()
        term, job = (table.column(c).combine_chunks().dictionary_encode() for c in ("term", "job_id"))
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        starts = np.searchsorted(term.indices.to_numpy()[order], np.arange(len(term.dictionary) + 1))
        known = spark.sparkContext.broadcast((term.dictionary, starts, job.dictionary, job.indices.to_numpy()[order].astype(np.int64), [table.column(w).to_numpy().astype(float)[order] for w in weights]))
        small_batches(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, starts, job_ids, jobs, loads = known.value
            for batch in batches:
                lists = batch.column(len(keys))
                length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), length)
                at = pc.index_in(lists.flatten(), words)
                held = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                row, at = row[held], at.take(pa.array(held)).to_numpy(zero_copy_only=False).astype(np.int64)
                if named:
                    value = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False)[held]
                    worth = tuple(value**p for p in powers or (1,) * len(loads))
                else:
                    code, times = np.unique(row * len(words) + at, return_counts=True)
                    row, at = np.divmod(code, max(1, len(words)))
                    worth = values(times, length[row])
                size = starts[at + 1] - starts[at]
                mine = None if own is None else pc.fill_null(pc.index_in(batch.column(keys.index(own)), job_ids), -1).to_numpy(zero_copy_only=False)
                total = [np.zeros(batch.num_rows * len(job_ids)) for _ in range(len(loads))]
                met = np.zeros(batch.num_rows * len(job_ids), dtype=bool)
                for part in np.array_split(np.arange(row.size), -(-int(size.sum()) // _STEP) or 1):
                    n = size[part]
                    which = np.repeat(part, n)
                    place = np.arange(which.size) - np.repeat(np.cumsum(n) - n, n) + starts[at[which]]
                    if mine is not None:
                        wanted = jobs[place] == mine[row[which]]
                        which, place = which[wanted], place[wanted]
                    cell = row[which] * len(job_ids) + jobs[place]
                    met[cell] = True
                    for out, load, v in zip(total, loads, worth, strict=True):
                        out += np.bincount(cell, load[place] * v[which], out.size)
                cell = np.flatnonzero(met)
                who, which = np.divmod(cell, max(1, len(job_ids)))
                taken = pa.array(who)
                yield pa.record_batch([job_ids.take(pa.array(which)), *[batch.column(keys.index(k)).take(taken) for k in shown], *[pa.array(t[cell]) for t in total]], names=["job_id", *shown, *[f"s{i}" for i in range(len(total))]])

        return picked.mapInArrow(run, schema)

    return _passes(asked, n, one)


#: Rows of either side of a segment that meet in one block.
SIDE_ROWS = 4_096


def segment_best(left: DataFrame, right: DataFrame, segment: str, item: str, place: str, vector: str = "vector", places: int = 12, apart: bool = False, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(segment, item, similarity, place): of each item (segment, item, vector) the most similar place (segment, place, vector) of its segment, the
    smallest of equals after rounding to ``places``; ``apart``: a place whose number is the item's own isn't compared.

    Both sides are dealt by segment and multiplied in blocks, which keep a running best for each item: no pair is a row. A segment of more
    than ``side_rows`` rows on a side is cut on that side by a hash, and the other side goes to each of its pieces, so tasks hold blocks of
    bounded size. Vectors that are null, of another length than the block's first item's, or of norm 0 have similarity 0; items of a
    segment without places are left out.
    """
    spark = left.sparkSession
    kinds = dict(left.dtypes) | dict(right.dtypes)
    small_batches(spark)

    def cuts(rows: DataFrame, column: str) -> DataFrame:
        found = rows.groupBy(F.col(segment).alias("_s")).agg(F.count("*").alias("n")).where(F.col("n") > side_rows)
        return materialize(found.select("_s", F.ceil(F.col("n") / side_rows).cast("int").alias(column)), "segment-cuts")  # long segments only: rows / side_rows of them at most

    lefts, rights = cuts(left, "_l"), cuts(right, "_r")
    few = lambda frame: F.broadcast(frame) if frame.limit(100_001).count() <= 100_000 else frame
    lefts, rights = few(lefts), few(rights)

    def dealt(rows: DataFrame, side: int, name: str) -> DataFrame:
        both = rows.select(F.col(segment).alias("_g"), F.col(name).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
        both = both.join(lefts, F.col("_g") == F.col("_s"), "left").drop("_s").join(rights, F.col("_g") == F.col("_s"), "left").drop("_s")
        own, other = ("_l", "_r") if side == 0 else ("_r", "_l")
        mine = F.pmod(F.xxhash64("_id"), F.coalesce(own, F.lit(1))).cast("int")
        all_ = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        cut = both.select("_g", "_id", "_v", mine.alias("a"), all_.alias("b"))
        a, b = ("a", "b") if side == 0 else ("b", "a")
        item_ = F.col("_id") if side == 0 else F.lit(None).cast(kinds[item])
        place_ = F.col("_id") if side == 1 else F.lit(None).cast(kinds[place])
        return cut.select("_g", F.col(a).alias("_a"), F.col(b).alias("_b"), F.lit(side).alias("_side"), item_.alias("_item"), place_.alias("_place"), "_v")

    rows = dealt(left, 0, item).unionByName(dealt(right, 1, place)).where("_g IS NOT NULL")
    sorted_ = rows.repartition("_g", "_a", "_b").sortWithinPartitions("_g", "_a", "_b", "_side", "_place")

    def matrix(lists: pa.Array, width: int) -> np.ndarray:
        fits = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), width))
        if width and fits.any():
            out[fits] = np.nan_to_num(lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, items, units, best, at = None, [], None, None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if at is not None:
                met = pa.array(np.array([x is not None for x in at]))
                segments = pa.array([group[0]] * len(at), kinds_[0])
                yield pa.record_batch([segments.filter(met), items.filter(met), pa.array(best).filter(met), pa.array(at, kinds_[1]).filter(met)], names=["segment", "item", "similarity", "place"])

        kinds_ = None
        for batch in batches:
            kinds_ = kinds_ or (batch.schema.field(0).type, batch.schema.field(5).type)
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for first, stop in zip(starts, [*starts[1:], len(keys)], strict=True):
                *mine, side = keys[first]
                part = batch.slice(first, stop - first)
                if mine != group:
                    yield from out()
                    group, held, items, units, best, at = mine, [], None, None, None, None
                if side == 0:
                    held.append(part)
                    continue
                if not held:
                    continue  # places of a segment without items
                if units is None:
                    items = pa.concat_arrays([p.column(4) for p in held])
                    lists = pa.concat_arrays([p.column(6) for p in held])
                    units = matrix(lists, next((n for n in pc.list_value_length(lists).to_pylist() if n is not None), 0))
                    best, at = np.full(len(units), -1.0), [None] * len(units)
                found = np.round(np.clip(units @ matrix(part.column(6), units.shape[1]).T, 0, 1), places)
                where = part.column(5).to_pylist()
                if apart:
                    found[np.array(items.to_pylist(), dtype=object)[:, None] == np.array(where, dtype=object)[None]] = -1.0
                top = found.argmax(1)  # places come in order: the first of equals
                value = found[np.arange(len(top)), top]
                for i in np.flatnonzero(value > best):
                    best[i], at[i] = value[i], where[top[i]]
        yield from out()

    found = sorted_.mapInArrow(run, f"segment {kinds[segment]}, item {kinds[item]}, similarity double, place {kinds[place]}")
    # Pieces of long segments: the best of each item's bests.
    top = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("place").alias("p")))
    return found.groupBy("segment", "item").agg(top.alias("t")).select(F.col("segment").alias(segment), F.col("item").alias(item), (-F.col("t.s")).alias("similarity"), F.col("t.p").alias(place))


def dense_cosines(rows: DataFrame, keys: list[str], vector: str, jobs: DataFrame) -> DataFrame:
    """(job_id, keys, score) of every candidate and job (job_id, vector): cosines clamped to [0, 1], 0 where a norm is 0 or a vector is null or of another length."""
    spark = rows.sparkSession
    asked = materialize(jobs.select("job_id", F.col(vector).cast("array<double>").alias("vector")), "job-vectors")
    count, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(0))), F.lit(0))).first()
    picked = rows.select(*keys, F.col(vector).cast("array<double>").alias("vector"))

    def unit(lists: pa.Array, width: int) -> np.ndarray:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        fits = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), width))
        if width and fits.any():
            out[fits] = np.nan_to_num(lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def one(block: DataFrame) -> DataFrame:
        table = block.toArrow()
        width = max([0, *filter(None, pc.list_value_length(table.column("vector")).to_pylist())])
        known = spark.sparkContext.broadcast((table.column("job_id").combine_chunks(), unit(table.column("vector"), width).T.copy(), width))
        small_batches(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            job_ids, matrix, width = known.value
            for batch in batches:
                score = np.clip(unit(batch.column(len(keys)), width) @ matrix, 0, 1)
                who, which = pa.array(np.repeat(np.arange(batch.num_rows), len(job_ids))), pa.array(np.tile(np.arange(len(job_ids)), batch.num_rows))
                yield pa.record_batch([job_ids.take(which), *[batch.column(i).take(who) for i in range(len(keys))], pa.array(score.ravel())], names=["job_id", *keys, "score"])

        return picked.mapInArrow(run, _schema(rows, keys, asked, "score double"))

    return _passes(asked, -(-max(numbers, count * (MAX_NUMBERS // MAX_JOBS)) // MAX_NUMBERS), one)
