"""Vectors as four one-byte codes: product codebooks trained by Lloyd rounds that carry Hamerly's bounds.

Vectors become whole numbers, floor(1024 * x), cut into four parts; each part position has a codebook of up to 256 entries.
A written table holds, for each vector, its numbers and for each part the entry it is assigned to, an upper bound
of the distance to it and a lower bound of the distance to the second nearest. When entries move, the upper bound grows by its entry's way
and the lower one shrinks by the longest way of another. Only where the upper bound, made exact first, isn't strictly below the
lower one (or half the gap between its entry and the next entry) are all distances computed, in whole numbers, lower index first at
ties. Bounds are rounded outward, so no rounding hides a tie. Sums are kept as whole numbers and changed
only by the vectors that moved; a task sends one row for each part and entry at most.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are dropped, and so are vectors of another
length than that of the smallest vec_id; lengths are filled up with zeros to a multiple of four; components past 16,384 either way count as that
(2 ** 24 in whole numbers, so that no sum passes a long); null ids come last; repeated rows are vectors each, equal ids in the order of their components; fewer than 256
vectors make as many entries; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.runtime import drop, materialize, small_batches

#: Fixed values of the codes: parts, entries of a codebook, rounds, units of a component.
PARTS, ENTRIES, ROUNDS, UNITS = 4, 256, 4, 1024
#: Whole components lie within this; a squared distance over 4,096 of them still fits a long.
MOST = 1 << 24
#: Different labels up to which their sums are broadcast; past it they are joined by label and salt.
BROADCAST, SALTS = 100_000, 64
_STATE = "vec_id long, label {}, numbers array<int>, codes array<int>, was array<int>, upper array<double>, lower array<double>"


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, numbers) of the vectors that count, as a written table."""
    x = F.col("`embedding`").cast("array<double>")
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    number = lambda v: F.floor(F.greatest(F.least(v * UNITS, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    kept = vectors.where(finite & (F.size(x) > 0)).select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").alias("label"), F.transform(x, number).alias("numbers"))
    kept = materialize(kept, "codes-numbers")
    first = kept.select(F.min_by(F.size("numbers"), F.struct(F.col("vec_id").isNull(), "vec_id", "numbers"))).first()[0] or 0
    filled = F.concat("numbers", F.array_repeat(F.lit(0), -first % PARTS)) if first % PARTS else F.col("numbers")
    return kept.where(F.size("numbers") == first).withColumn("numbers", filled)


class Books(NamedTuple):
    """Codebooks as (part, entry, position), the way each entry moved last, and half the gap to its nearest other entry."""

    entries: np.ndarray
    moved: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Books:
        moved = np.zeros(entries.shape[:2]) if before is None else _up(np.sqrt(((entries - before) ** 2).sum(2).astype(float)))
        gaps = np.empty(entries.shape[:2])
        for part, book in enumerate(entries):
            far = distances(book, book).astype(float)
            np.fill_diagonal(far, np.inf)
            gaps[part] = _down(np.sqrt(far.min(1)) / 2)
        return cls(entries, moved, gaps)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x * (1 + 1e-12), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.nextafter(x * (1 - 1e-12), -np.inf))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, as whole numbers.

    Products of whole numbers are exact in doubles while no sum reaches 2 ** 53; past that, differences are summed as longs.
    """
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)


def assign(x: np.ndarray, books: Books, part: int, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """One part's assignment, in place; rows that were compared with all entries."""
    book, moved, gaps = books.entries[part], books.moved[part], books.gaps[part]
    order = np.argsort(moved)[::-1]
    second = moved[order[1]] if len(order) > 1 else 0.0
    upper[:] = _up(upper + moved[codes])
    lower[:] = _down(lower - np.where(codes == order[0], second, moved[order[0]]))
    open_ = np.flatnonzero(~(upper < np.maximum(lower, gaps[codes])))
    upper[open_] = _up(np.sqrt(((x[open_] - book[codes[open_]]) ** 2).sum(1).astype(float)))
    scan = open_[~(upper[open_] < np.maximum(lower[open_], gaps[codes[open_]]))]
    if len(scan):
        far = distances(x[scan], book)
        best, rows = far.argmin(1), np.arange(len(scan))  # the first of equal ones
        codes[scan], upper[scan] = best, _up(np.sqrt(far[rows, best].astype(float)))
        rest = far.astype(float)
        rest[rows, best] = np.inf
        lower[scan] = _down(np.sqrt(rest.min(1)))
    return len(scan)


def _lists(batch: pa.RecordBatch, name: str, kind: type, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _array(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(values.ravel(), kind))


def _assigned(state: DataFrame, books: Books, kind: str) -> DataFrame:
    """One pass over the state: new codes, those before, new bounds."""
    width = books.entries.shape[2]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lists(batch, "numbers", np.int64, PARTS * width).reshape(-1, PARTS, width)
            was, upper, lower = (_lists(batch, n, k, PARTS) for n, k in (("codes", np.int64), ("upper", float), ("lower", float)))
            codes = np.maximum(was, 0)
            for part in range(PARTS):
                c, u, v = codes[:, part].copy(), upper[:, part].copy(), lower[:, part].copy()
                assign(x[:, part], books, part, c, u, v)
                codes[:, part], upper[:, part], lower[:, part] = c, u, v
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("vec_id", "label", "numbers")]
            made = [_array(codes, pa.int32()), _array(was, pa.int32()), _array(upper, pa.float64()), _array(lower, pa.float64())]
            yield pa.record_batch([*kept, *made], names=["vec_id", "label", "numbers", "codes", "was", "upper", "lower"])

    return state.mapInArrow(step, _STATE.format(kind))


def _changes(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """What the last pass changed in the sums and counts of each part's entries: each task sends what its rows changed, an entry a row."""
    parts, entries, width = shape

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x = _lists(batch, "numbers", np.int64, parts * width).reshape(-1, parts, width)
            codes, was = _lists(batch, "codes", np.int64, parts), _lists(batch, "was", np.int64, parts)
            rows = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], 2)
            for part in range(parts):
                moved = codes[:, part] != was[:, part]
                np.add.at(sums[part], codes[moved, part], rows[moved, part])
                left = moved & (was[:, part] >= 0)
                np.subtract.at(sums[part], was[left, part], rows[left, part])
        at = np.argwhere(sums.any(2))
        if len(at):
            values = sums[at[:, 0], at[:, 1]]
            yield pa.record_batch([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), _array(values, pa.int64())], names=["part", "entry", "sums"])

    moved = state.where(F.exists(F.zip_with("codes", "was", lambda a, b: a != b), lambda c: c)).select("numbers", "codes", "was")
    each = moved.mapInArrow(local, "part int, entry int, sums array<long>").select("part", "entry", F.posexplode("sums").alias("at", "value"))
    sums = np.zeros((parts, entries, width + 1), np.int64)
    for part, entry, at, value in each.groupBy("part", "entry", "at").agg(F.sum("value")).collect():  # at most the codebooks' size
        sums[part, entry, at] = value
    return sums[:, :, :-1], sums[:, :, -1]


def _next(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], entries)


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The assigned vectors (state of the last pass) and the codebooks; no entries where there is no vector."""
    spark, kind = vectors.sparkSession, vectors.select(F.col("`label`")).schema[0].dataType.simpleString()
    small_batches(spark, 4096)
    numbers = whole(vectors)
    first = [r.numbers for r in numbers.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").select("numbers").limit(ENTRIES).collect()]
    blank = lambda value, to: F.array_repeat(F.lit(value).cast(to), PARTS)
    state = numbers.select("vec_id", "label", "numbers", blank(-1, "int").alias("codes"), blank(-1, "int").alias("was"), blank(float("inf"), "double").alias("upper"), blank(0, "double").alias("lower"))
    if not first:
        return state, np.zeros((PARTS, 0, 0), np.int64)
    entries = np.array(first, np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    books, before = Books.of(entries), None
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)
    for round_ in range(rounds + 1):
        after = materialize(_assigned(state, books, kind), "codes-state")
        drop(before)  # the pass before isn't read any more: what follows reads the table just written
        state = before = after
        if round_ < rounds:
            more, n = _changes(state, entries.shape)
            sums, counts = sums + more, counts + n
            entries = _next(entries, sums, counts)
            books = Books.of(entries, books.entries)
    return state, entries


def checksum(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code (four bytes in hex), error, label_error, and the codebooks' checksum."""
    state, entries = train(vectors)
    width, kind = entries.shape[2], state.schema["label"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _lists(batch, "codes", np.int64, PARTS)
            x = _lists(batch, "numbers", np.int64, PARTS * width).reshape(-1, PARTS, width)
            chosen = np.stack([entries[p][codes[:, p]] for p in range(PARTS)], 1)
            text = [bytes(row).hex() for row in codes.astype(np.uint8)]
            made = [pa.array(text, pa.string()), pa.array(((x - chosen) ** 2).sum((1, 2)), pa.int64())]
            yield pa.record_batch([batch.column(batch.schema.get_field_index(n)) for n in ("vec_id", "label")] + made, names=["vec_id", "label", "code", "error"])

    each = state.mapInArrow(coded, f"vec_id long, label {kind}, code string, error long")
    found = with_label_errors(materialize(each, "codes-rows"))
    return found.withColumn("codebooks_sha256", F.lit(checksum(entries)))


def with_label_errors(rows: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """Rows with their label's error: sums are broadcast up to a number of labels, else joined by label and a salt, so that a
    frequent label is dealt out."""
    sums = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "codes-labels")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= broadcast:
        return rows.join(F.broadcast(sums), same).drop("of")
    salted = sums.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("deal"))).drop("of", "salt", "deal")


def oracle() -> str:
    """Every distance of every round, without bounds."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(
            f"""far{i} AS (SELECT p.r, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN book{i} b ON p.part = b.part),
a{i} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM far{i} GROUP BY r, part)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""flat{i} AS (SELECT part, entry, unnest(x) AS value, generate_subscripts(x, 1) AS pos FROM a{i}),
mean{i} AS (SELECT part, entry, list(value ORDER BY pos) AS e FROM (SELECT part, entry, pos, floor(sum(value)::DOUBLE / count(*))::BIGINT AS value FROM flat{i} GROUP BY part, entry, pos) GROUP BY part, entry),
book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book{i} b LEFT JOIN mean{i} m ON b.part = m.part AND b.entry = m.entry)"""
            )
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({UNITS} * x::DOUBLE)::BIGINT) AS n, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, n[part * len(n) // {PARTS} + 1 : (part + 1) * len(n) // {PARTS}] AS x FROM v, range({PARTS}) t(part)),
book0 AS MATERIALIZED (SELECT part, r AS entry, x AS e FROM p WHERE r < {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
summed AS (SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error FROM coded JOIN v USING (r))
SELECT *, (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256 FROM summed
"""
