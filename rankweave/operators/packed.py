"""Whole lists as packed keys: every row of every list is one long, and what is asked of its rank is found where the keys meet.

A list is what one system makes of one job's documents and attacked copies. A row's key sorts as the list does: its total to nine places, highest
first, then the document's number (numbers follow ids), then its kind; the last bits are the kind, what a caller wants to know of the row. Documents
are read once, as counts of jobs' words (``attacks.facts``); totals, keys and which copies pass their document are made in the task, and a list's keys
move once, without ids, names or features. Lists of more than ``PIECE`` rows are cut into pieces by keys of a sample, which decides how
work is dealt and no result: a rank is the rows of the pieces before plus the place in its own.

Defined cases: a null total counts as 0; at most 2 ** 29 documents (checked) and totals from -0.14 to 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rankweave.operators.ranks import positions
from rankweave.runtime import materialize, packed_groups, small_batches

SCALE = 1_000_000_000
KIND_BITS, NUMBER_BITS = 3, 29
KIND = (1 << KIND_BITS) - 1
#: Rows of a list's piece, keys that a task holds before it passes them on.
PIECE = 4_000_000
HELD = 4_000_000
SCHEMA = "piece int, keys array<long>, half long, paste long"
#: Kinds of attacked lists: a document, one with copies, a copy without its document in the list, a copy. Codes of half sort before those of paste.
PLAIN, CONTROL, HALF, PASTE = 0, 1, 3, 5


def keys_of(total: np.ndarray, number: np.ndarray, kind: np.ndarray) -> np.ndarray:
    whole = np.nan_to_num(total) * SCALE
    whole = np.copysign(np.floor(np.abs(whole) + 0.5), whole).astype(np.int64)  # half away from 0
    return SCALE - whole << KIND_BITS + NUMBER_BITS | number << KIND_BITS | kind


def numbers_of(keys: np.ndarray) -> np.ndarray:
    return keys >> KIND_BITS & (1 << NUMBER_BITS) - 1


def numbered(texts: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``texts`` with ``number``, which follows candidate_id, and what gives a frame with numbers its ids back. Whole numbers of a narrow range number themselves."""
    kind = dict(texts.dtypes)["candidate_id"]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        low, high, some = texts.agg(F.min("candidate_id"), F.max("candidate_id"), F.count_if(F.col("candidate_id").isNull())).first()
        if not some and (low is None or high - low < 1 << NUMBER_BITS):
            low = low or 0
            return texts.withColumn("number", F.col("candidate_id") - F.lit(low)), lambda frame: frame.withColumn("candidate_id", (F.col("number") + F.lit(low)).cast(kind)).drop("number")
    ids = positions(texts.select(F.lit(0).alias("_all"), "candidate_id").distinct(), [F.col("candidate_id")], ["_all"], "number")
    ids = materialize(ids.select(F.col("candidate_id").alias("_id"), "number"), "numbers")
    if ids.count() >= (1 << NUMBER_BITS) - 1:
        raise ValueError(f"more than {(1 << NUMBER_BITS) - 2} documents don't fit a key")
    given = lambda frame: frame.join(ids, "number").withColumnRenamed("_id", "candidate_id").drop("number")
    return texts.join(ids, F.col("candidate_id").eqNullSafe(F.col("_id"))).drop("_id"), given


@dataclass(frozen=True)
class Lists:
    """``rows``: (system, job_id, piece, keys, half, paste), the keys of a task for a piece of a list, and how many copies pass their document."""

    rows: DataFrame
    parts: int
    named: Callable[[DataFrame], DataFrame]

    def groups(self, each: Callable[[np.ndarray, list[pa.RecordBatch]], dict[str, list]], more: str) -> DataFrame:
        """(system, job_id, piece, more) of ``each`` over the sorted keys of a piece."""
        kind = self.rows.schema["job_id"].dataType
        schema = to_arrow_schema(self.rows.select("system", "job_id", "piece", *[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in more.split(", "))]).schema)

        def run(key: tuple, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([b.column(3).flatten().to_numpy(zero_copy_only=False) for b in batches])
            keys.sort()
            yield pa.RecordBatch.from_pydict({"system": [key[0]], "job_id": [key[1]], "piece": [key[2]], **each(keys, batches)}, schema=schema)

        return packed_groups(self.rows, ["system", "job_id", "piece"], self.parts, run, f"system string, job_id {kind.simpleString()}, piece int, {more}")


def _before(column: str) -> Column:
    """A sum over the pieces of a list before this one."""
    over = Window.partitionBy("system", "job_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(over), F.lit(0))


def sums(lists: Lists, kinds: tuple[int, ...]) -> DataFrame:
    """(system, job_id, n, half, paste and for each kind n<kind>, sum<kind>): a list's length, the copies that pass their document, and number and sum of
    ranks of the rows of each kind. One row a list; whole numbers, so exact."""

    def each(keys: np.ndarray, batches: list[pa.RecordBatch]) -> dict[str, list]:
        kind, out = keys & KIND, {"n": [len(keys)]}
        for k in kinds:
            at = np.flatnonzero(kind == k)
            out |= {f"n{k}": [len(at)], f"sum{k}": [int(at.sum()) + len(at)]}
        return out | {c: [sum(b.column(c).to_numpy().sum() for b in batches)] for c in ("half", "paste")}

    columns = ["n", *[f"{c}{k}" for k in kinds for c in ("n", "sum")], "half", "paste"]
    pieces = materialize(lists.groups(each, ", ".join(f"{c} long" for c in columns)), "list-sums").withColumn("before", _before("n"))
    moved = [F.sum(F.col(f"sum{k}") + F.col("before") * F.col(f"n{k}")).alias(f"sum{k}") for k in kinds]
    return pieces.groupBy("system", "job_id").agg(*[F.sum(c).alias(c) for c in columns if not c.startswith("sum")], *moved)


def places(lists: Lists, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(system, job_id, number, kind, rank, n) of the rows whose kind is ``wanted``."""

    def each(keys: np.ndarray, batches: list[pa.RecordBatch]) -> dict[str, list]:
        at = np.flatnonzero(wanted(keys & KIND))
        return {"n": [len(keys)], "at": [at.astype(np.int32)], "row": [(keys[at] & (1 << NUMBER_BITS + KIND_BITS) - 1)]}

    found = materialize(lists.groups(each, "n long, at array<int>, row array<long>"), "list-places", "zstd")
    sizes = found.select("system", "job_id", "piece", "n").withColumns({"before": _before("n"), "size": F.sum("n").over(Window.partitionBy("system", "job_id"))}).drop("n")
    rows = found.drop("n").join(F.broadcast(sizes), ["system", "job_id", "piece"]).select("system", "job_id", "before", "size", F.explode(F.arrays_zip("at", "row")).alias("x"))
    number, kind = F.shiftright("x.row", KIND_BITS), F.col("x.row").bitwiseAND(KIND)
    return rows.select("system", "job_id", number.alias("number"), kind.alias("kind"), (F.col("before") + F.col("x.at") + 1).alias("rank"), F.col("size").alias("n"))


def precision(lists: Lists, least: int, first: int) -> tuple[DataFrame, DataFrame]:
    """Kinds are grades. (system, job_id, average_precision, reciprocal_rank) of every list, a hit being a kind of ``least`` or more; and its ``first`` rows as (system, job_id, rank, rel)."""

    def each(keys: np.ndarray, batches: list[pa.RecordBatch]) -> dict[str, list]:
        kind = keys & KIND
        at = np.flatnonzero(kind >= least)
        return {"n": [len(keys)], "hits": [len(at)], "at": [at.astype(np.int32)], "top": [kind[:first].astype(np.int32)]}

    found = materialize(lists.groups(each, "n long, hits long, at array<int>, top array<int>"), "list-hits", "zstd")
    sizes = found.select("system", "job_id", "piece", "n", "hits").withColumns({"before": _before("n"), "hit": _before("hits")}).drop("n", "hits")
    placed = found.join(F.broadcast(sizes), ["system", "job_id", "piece"])
    schema = f"system string, job_id {lists.rows.schema['job_id'].dataType.simpleString()}, hits long, total double, first long"
    small_batches(lists.rows.sparkSession, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ends = batch.column(3), np.cumsum([0, *(len(x) for x in batch.column(3))])
            flat = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            before, hit = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            ranks = [flat[a:b] + r + 1 for a, b, r in zip(ends[:-1], ends[1:], before, strict=True)]
            total = [float(((h + 1 + np.arange(len(r))) / r).sum()) for r, h in zip(ranks, hit, strict=True)]
            first = [int(r[0]) if len(r) else None for r in ranks]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(total, pa.float64()), pa.array(first, pa.int64())], names=["system", "job_id", "hits", "total", "first"])

    parts = placed.select("system", "job_id", "hits", "at", "before", "hit").mapInArrow(run, schema)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each_ = parts.groupBy("system", "job_id").agg(zero(F.try_divide(F.sum("total"), F.sum("hits"))).alias("average_precision"), zero(F.lit(1.0) / F.min("first")).alias("reciprocal_rank"))
    top = placed.where(F.col("before") < first).select("system", "job_id", "before", F.posexplode("top").alias("i", "rel")).select("system", "job_id", (F.col("before") + F.col("i") + 1).alias("rank"), "rel")
    return each_, top.where(F.col("rank") <= first)


def _by_list(rows: list, column: str) -> dict[tuple, np.ndarray]:
    return {(r.system, r.job_id): np.unique(np.array(r[column], np.int64)) for r in rows}


def _scan(lists: Lists, each: Callable[[tuple, np.ndarray], np.ndarray | None], merge: Callable[[list[np.ndarray]], np.ndarray]) -> list:
    """(system, job_id, found) of ``each`` over the keys of every row, merged within a task and then by list: a few numbers a list."""
    schema = f"system string, job_id {lists.rows.schema['job_id'].dataType.simpleString()}, found array<long>"
    small_batches(lists.rows.sparkSession, 64)

    def joined(key: tuple, found: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch([pa.array([key[0]]), pa.array([key[1]], kind), pa.array([merge(found)], pa.list_(pa.int64()))], names=["system", "job_id", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, np.ndarray] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(1).type
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = each(key, batch.column(2)[i].values.to_numpy(zero_copy_only=False))
                if found is not None:
                    known[key] = merge([known[key], found]) if key in known else found
        for key, found in known.items():
            yield joined(key, [found], kind)

    def whole(key: tuple, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield joined(key, [x.values.to_numpy(zero_copy_only=False) for b in batches for x in b.column(2)], batches[0].schema.field(1).type)

    partly = lists.rows.select("system", "job_id", "keys").mapInArrow(run, schema)
    return packed_groups(partly, ["system", "job_id"], lists.rows.sparkSession.sparkContext.defaultParallelism, whole, schema).collect()


def first(lists: Lists, k: int) -> dict[tuple, np.ndarray]:
    """The first k keys of each list, sorted. Lists are a stated query set; their first rows come to the driver."""
    least = lambda found: np.sort(np.concatenate(found))[:k]
    return _by_list(_scan(lists, lambda key, keys: np.sort(keys)[:k], least), "found")


def first_hits(lists: Lists, least: int) -> dict[tuple, int]:
    """{(system, job_id): rank} of the first row whose kind is ``least`` or more, of the lists that have one."""
    found = _scan(lists, lambda key, keys: np.sort(keys[keys & KIND >= least])[:1], lambda found: np.sort(np.concatenate(found))[:1])
    return {key: ranks[0][1] for key, ranks in _ranks(lists, _by_list(found, "found")).items()}


def lookup(lists: Lists, numbers: dict) -> dict[tuple, list[tuple[int, int]]]:
    """{(system, job_id): [(key, rank), ...]} of the ``numbers`` of each job, in every list that has them: their keys are found, and then the rows before them counted."""
    known = lists.rows.sparkSession.sparkContext.broadcast(numbers)

    def find(key: tuple, keys: np.ndarray) -> np.ndarray | None:
        wanted = known.value.get(key[1])
        return None if wanted is None else keys[np.isin(numbers_of(keys), wanted)]

    return _ranks(lists, _by_list(_scan(lists, find, np.concatenate), "found"))


def _ranks(lists: Lists, held: dict[tuple, np.ndarray]) -> dict[tuple, list[tuple[int, int]]]:
    """The ranks of keys that lists have: each task counts its rows between them."""
    targets = lists.rows.sparkSession.sparkContext.broadcast(held)

    def ahead(key: tuple, keys: np.ndarray) -> np.ndarray | None:
        mine = targets.value.get(key)
        return None if mine is None else np.cumsum(np.bincount(np.searchsorted(mine, keys, side="right"), minlength=len(mine) + 1)[:-1])

    before = {(r.system, r.job_id): r.found for r in _scan(lists, ahead, lambda found: np.sum(found, axis=0))}
    # Rows up to and with a target's place: the keys below it, those that sort right of it are the next's.
    return {key: [(int(t), int(b) + 1) for t, b in zip(mine, before[key], strict=True)] for key, mine in held.items() if len(mine)}


def fused(lists: Lists, k: int, constant: int = 60, places_: int = 9) -> dict:
    """{job_id: [(score, number, kind), ...]}: the first k of each job by the sum of 1 / (constant + rank) over its lists, rounded, numbers ascending among equals.

    A row of the first k has at least 1 / (constant + k) if some list has k rows, so for s lists one of its ranks is below s * (constant + k): only
    rows that stand that high in some list are looked up in the others. Where every list is shorter, all rows are.
    """
    systems = lists.rows.select("system").distinct().count()
    high = first(lists, max(1, systems) * (constant + k) + k)
    numbers: dict = {}
    for (_, job), keys in high.items():
        numbers.setdefault(job, []).append(numbers_of(keys))
    ranks = lookup(lists, {job: np.unique(np.concatenate(n)) for job, n in numbers.items()})
    score: dict = {}
    for (_, job), found in sorted(ranks.items(), key=repr):
        mine = score.setdefault(job, {})
        for key, rank in found:
            number = int(numbers_of(key))
            mine[number] = (mine.get(number, (0.0,))[0] + 1.0 / (constant + rank), key & KIND)
    return {job: sorted(((round(s, places_), n, kind) for n, (s, kind) in mine.items()), key=lambda x: (-x[0], x[1]))[:k] for job, mine in score.items()}
