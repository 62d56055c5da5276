"""The best candidates of each job where a pair's total follows from bit sets: blocks of candidates times blocks of jobs, no pair is a row.

Rows are packed, a block of them in one, and blocks meet in tasks of a grid: each task multiplies the sets of its candidates' and its jobs' blocks and keeps
the first k of each of its jobs. Most pairs are only bounded, in single precision: those that may be among the first k are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.config import DEFAULT_GATE, DEFAULT_WEIGHTS, PREFERRED_WEIGHT, PrerequisiteGate, ScoringWeights
from rankweave.runtime import materialize, small_batches

#: Rows of a packed block, and of the tiles that are multiplied at once.
BLOCK, TILE, TILE_JOBS = 16_384, 1_024, 512
#: What single precision may be off by, and more than rounding to six places adds.
SLACK = 2e-5


def packed(rows: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """Rows of numbers as rows of arrays: up to ``block`` to one, each column an array of its own. Written, as both sides are read often."""
    small_batches(rows.sparkSession, block)
    schema = ", ".join(f"{c} array<{t}>" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            columns = [c.chunk(0) for c in whole.columns]
            return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=whole.column_names)

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if held and n + part.num_rows > block:
                    yield out()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield out()

    return materialize(rows.mapInArrow(run, schema), name)


def _bits(words: list[np.ndarray], kind=np.float32) -> np.ndarray:
    """(rows, 64 k) of 0 and 1."""
    whole = np.ascontiguousarray(np.stack(words, 1).astype("<u8"))
    return np.unpackbits(whole.view(np.uint8), axis=1, bitorder="little").astype(kind)


def best(candidates: DataFrame, jobs: DataFrame, k: int, words: int, weights: ScoringWeights = DEFAULT_WEIGHTS, gate: PrerequisiteGate = DEFAULT_GATE, wish: float = PREFERRED_WEIGHT, block: int = BLOCK) -> DataFrame:
    """(job_id, candidate_id, total, skill, coverage, gate) of rows among which the first k of each job by total, then id, are: k a job and task at most.

    ``candidates`` has candidate_id, years, degree and the words held0, held1, ... of a set, ``jobs`` job_id, min_years, min_degree, req0, ... and pref0, ... .
    Totals and the rest are rounded to six places, half away from 0, before they are compared.
    """
    spark = candidates.sparkSession
    held, req, pref = ([f"{n}{j}" for j in range(words)] for n in ("held", "req", "pref"))
    left = candidates.select(F.col("candidate_id").cast("long"), F.col("years").cast("double"), F.col("degree").cast("int"), *held)
    right = jobs.select(F.col("job_id").cast("long"), F.col("min_years").cast("double"), F.col("min_degree").cast("int"), *req, *pref)
    cores = spark.sparkContext.defaultParallelism
    grid = max(2, int(np.ceil(np.sqrt(3 * cores))))
    # Blocks of even size, some for each row and column of the grid.
    even = lambda n: int(max(1, min(max(TILE, block // words), -(-n // grid))))
    left = packed(left.repartition(grid), "candidate-blocks", even(left.count()))
    right = packed(right.repartition(grid), "job-blocks", even(right.count()))
    met = left.repartition(grid).hint("shuffle_replicate_nl").crossJoin(right.repartition(grid))
    w, floor, threshold, on = [np.float64(getattr(weights, n)) for n in ("semantic", "skill", "experience", "education")], gate.floor, gate.threshold, gate.enabled
    small_batches(spark, 1)

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(y <= 0, 1.0, np.where(x <= 0, 0.0, np.where(x >= y, 1.0, x / np.where(y > 0, y, 1.0))))

    def exact(c: dict, j: dict, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        """Of pairs of rows a and b; the same sums in the same order as ``scoring.combine``."""
        both, wished = (sum(np.bitwise_count(x[a] & y[b]).astype(np.int64) for x, y in zip(c["words"], j[n], strict=True)) for n in ("req", "pref"))
        n_req, n_pref = j["n_req"][b], j["n_pref"][b]
        dice = 2.0 * both / (c["n"][a] + n_req)
        skill = np.minimum(1.0, (both + wish * wished) / (n_req + wish * n_pref))
        years, least = c["years"][a], j["min_years"][b]
        experience, education = of(years, least), of(c["degree"][a].astype(float), j["min_degree"][b].astype(float))
        coverage = both / n_req
        gated = floor + (1 - floor) * np.minimum(1.0, np.maximum(0.0, coverage) / threshold) if on else np.ones(len(a))
        total = (((0.0 + w[0] * dice) + w[1] * skill) + w[2] * experience + w[3] * education) * gated - 0.0
        found = {"total": np.clip(total, 0.0, 1.0), "skill": skill, "coverage": coverage, "gate": gated}
        return {n: half_up(v) for n, v in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, dict] = {}
        last, c = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                column = lambda n: batch.column(n)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                ids = column("candidate_id")
                if last is None or last[0] != ids[0] or len(last) != len(ids):
                    last = ids
                    c = {"id": ids, "years": column("years"), "degree": column("degree"), "words": [column(n).view(np.uint64) for n in held]}
                    c["n"] = sum(np.bitwise_count(x).astype(np.int64) for x in c["words"])
                at = int(column("job_id")[0])
                if at not in tops:
                    tops[at] = _jobs(column, req, pref, wish, k)
                _meet(c, tops[at], k, w, wish, of, exact)
        for j in tops.values():
            at = np.flatnonzero(j["who"] != _NONE)
            if len(at):
                row = at // k
                out = {"job_id": j["id"][row], "candidate_id": j["who"].ravel()[at], **{n: j[f"top_{n}"].ravel()[at] for n in _OUT}}
                yield pa.RecordBatch.from_pydict(out)

    schema = "job_id long, candidate_id long, " + ", ".join(f"{n} double" for n in _OUT)
    kinds = dict(jobs.dtypes) | dict(candidates.dtypes)
    found = met.mapInArrow(run, schema)
    return materialize(found.select(F.col("job_id").cast(kinds["job_id"]), F.col("candidate_id").cast(kinds["candidate_id"]), *_OUT), "best-pairs")


_OUT, _NONE = ("total", "skill", "coverage", "gate"), np.iinfo(np.int64).max


def half_up(x: np.ndarray, places: int = 6) -> np.ndarray:
    """Rounded half away from 0 by the decimals that a double is written with, as Spark rounds. Only near halves need these."""
    scaled = x * 10.0**places
    out = np.floor(scaled + 0.5) / 10.0**places
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(near):
        from decimal import ROUND_HALF_UP, Decimal

        step = Decimal(1).scaleb(-places)
        out[near] = [float(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP)) for v in x[near]]
    return out


def _jobs(column, req: list[str], pref: list[str], wish: float, k: int) -> dict:
    """A block of jobs (words unsigned: numpy counts the bits of a negative number's absolute value) with what its pairs need, and the first k so far."""
    j = {"id": column("job_id"), "min_years": column("min_years"), "min_degree": column("min_degree"), "req": [column(n).view(np.uint64) for n in req], "pref": [column(n).view(np.uint64) for n in pref]}
    j["n_req"], j["n_pref"] = (sum(np.bitwise_count(x).astype(np.int64) for x in j[n]) for n in ("req", "pref"))
    # Experience and education follow from a job's kind, of which there are few.
    j["kinds"], j["kind"] = np.unique(np.stack([j["min_years"], j["min_degree"].astype(float)]), axis=1, return_inverse=True)
    n = len(j["id"])
    j["who"] = np.full((n, k), _NONE)
    return j | {f"top_{x}": np.full((n, k), -1.0) for x in _OUT}


def _meet(c: dict, j: dict, k: int, w: list[np.float64], wish: float, of, exact) -> None:
    """Take a block of candidates into the first k of a block of jobs. The gate is 1 at most: without it, a total is bounded from above."""
    few = np.float32
    for a in range(0, len(j["id"]), TILE_JOBS):
        to = slice(a, a + TILE_JOBS)
        n_req, asked = j["n_req"][to], j["n_req"][to] + wish * j["n_pref"][to]
        req = _bits([x[to] for x in j["req"]]).T
        kinds, kind = np.unique(j["kind"][to], return_inverse=True)
        own = (np.arange(len(kinds))[:, None] == kind).astype(few)
        skill = np.concatenate([(req + wish * _bits([x[to] for x in j["pref"]]).T) * (w[1] / asked), own]).astype(few)
        req, share = np.ascontiguousarray(req), (2 * w[0] / np.maximum(1, np.arange(int(c["n"].max()) + 1)[:, None] + n_req)).astype(few)
        for b in range(0, len(c["id"]), TILE):
            part = slice(b, b + TILE)
            bits = _bits([x[part] for x in c["words"]])
            rest = w[2] * of(c["years"][part, None], j["kinds"][0, kinds][None]) + w[3] * of(c["degree"][part, None].astype(float), j["kinds"][1, kinds][None])
            bound = bits @ req
            bound *= share[c["n"][part]]
            bound += np.concatenate([bits, rest.astype(few)], axis=1) @ skill
            row, job = np.divmod(np.flatnonzero(bound >= (j["top_total"][to, -1] - SLACK).astype(few)), len(n_req))
            if len(row):
                _keep(c, j, k, row + b, job + a, exact)


def _keep(c: dict, j: dict, k: int, row: np.ndarray, job: np.ndarray, exact) -> None:
    """Score pairs exactly and keep the first k of each job among these and its own so far."""
    new = exact(c, j, row, job)
    better = new["total"] >= j["top_total"][job, -1]
    row, job, new = row[better], job[better], {n: v[better] for n, v in new.items()}
    touched = np.unique(job)
    every, who = np.concatenate([np.repeat(touched, k), job]), np.concatenate([j["who"][touched].ravel(), c["id"][row]])
    worth = {n: np.concatenate([j[f"top_{n}"][touched].ravel(), v]) for n, v in new.items()}
    order = np.lexsort((who, -worth["total"], every))
    start = np.searchsorted(every[order], touched)
    first = order[(start[:, None] + np.arange(k)).ravel()]  # each has k of its own at least
    j["who"][touched] = who[first].reshape(-1, k)
    for n, v in worth.items():
        j[f"top_{n}"][touched] = v[first].reshape(-1, k)
