"""Rankers: rows of (job_id, candidate_id, score) and the order by score, then id.

Lexical rankers take texts(candidate_id, text) and jobs(job_id, text). Their corpus is the batch. Candidates
are joined to jobs by terms, never crossed: a pair without a common term has score 0 and is filled in last.
"""

from __future__ import annotations

import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.text import rank_tokens
from rankweave.operators.blocks import dense_cosines, sparse_products
from rankweave.operators.ranks import rank_all
from rankweave.runtime import materialize, numbered_rows, packed_groups, ship, small_batches

#: Different terms of jobs up to which documents list only these; ranges of terms at least, and characters of texts for another one.
MAX_TERMS = 1_000_000
MAX_BLOCKS = 8
CHARS = 20_000_000
#: Rows' norms that are broadcast at most, occurrences that a task holds, bits of a row's place within its partition.
BROADCAST_ROWS = 1_000_000
_HELD = 1 << 20
_ROW_BITS = 33

#: Common English words, the TF-IDF ranker's list where no other is given.
ENGLISH_STOP_WORDS = tuple(
    "a about above across after again against all almost alone along already also although always am among an and another any anyone anything are around as at be became because become been before behind being below between both but by can cannot could did do does done down during each either else enough etc even ever every everyone everything few for from further get give go had has have he hence her here hers herself him himself his how however i if in indeed into is it its itself just last least less made many may me might mine more most much must my myself neither never nevertheless next no nobody none nor not nothing now of off often on once one only onto or other others our ours ourselves out over own per perhaps please put rather same she should since so some someone something still such than that the their them themselves then there therefore these they this those though through thus to together too toward under until up upon us very was we well were what whatever when where whether which while who whole whom whose why will with within without would yet you your yours yourself".split()
)


def english_stop_words(path: str | Path | None = None) -> tuple[str, ...]:
    """Words of a file; without a path scikit-learn's "english" list where that is installed, else the list here."""
    if path is not None:
        return tuple(Path(path).read_text(encoding="utf-8").split())
    try:
        from sklearn.feature_extraction.text import ENGLISH_STOP_WORDS as listed
    except ImportError:
        return ENGLISH_STOP_WORDS
    return tuple(sorted(listed))


class Ranker(Protocol):
    """Anything that scores texts for jobs can be ranked and fused."""

    def score_all(self, texts: DataFrame, jobs: DataFrame) -> DataFrame: ...


def rank(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``rank``: 1 for the highest score of a job, ids ascending among equals. Whole lists, dealt by ranges: see ``ranks``."""
    return rank_all(scores, score)


def top_k(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The first k of each job; the limit is pushed below the shuffle, so k rows a job and task move."""
    first = Window.partitionBy("job_id").orderBy(F.desc(score), "candidate_id")
    return scores.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def first_of_tasks(scores: DataFrame, k: int, score: str = "score", places: int = 9) -> DataFrame:
    """Rows (job_id, candidate_id, score) among which the first k of each job are: each task keeps k a job as they come, so that nothing is sorted
    or moved for ``top_k`` but these."""
    ship(scores.sparkSession)
    columns = scores.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if kept.num_rows > limit[0]:
                kept = cut(kept)
        if kept is not None:
            yield from cut(kept).combine_chunks().to_batches()

    limit = [200_000]

    def cut(rows: pa.Table) -> pa.Table:
        worth = np.nan_to_num(rows.column(score).to_numpy(), nan=-np.inf) * 10.0**places
        # Rounded down and less two: no row of a better rounded score is behind one of a worse.
        rows = rows.append_column("_down", pa.array(-np.floor(worth))).append_column("_at", pa.array(np.arange(rows.num_rows)))
        rows = rows.sort_by([("job_id", "ascending"), ("_down", "ascending"), ("candidate_id", "ascending")])
        code = rows.column("job_id").combine_chunks().dictionary_encode().indices
        code = np.asarray(code.to_numpy(zero_copy_only=False) if code.null_count == 0 else pc.fill_null(code, -1).to_numpy(zero_copy_only=False))
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(code)))
        down = rows.column("_down").to_numpy()
        last = np.repeat(down[np.minimum(starts + k, starts + sizes) - 1] if len(starts) else down[:0], sizes)
        rows = rows.filter(pa.array(down <= last + 2)).select(columns)
        limit[0] = max(200_000, 2 * rows.num_rows)
        return rows

    return scores.mapInArrow(run, scores.schema)


def scale_by_max(scores: DataFrame) -> DataFrame:
    """Score over the job's largest; all 0 where that isn't positive."""
    top = scores.groupBy("job_id").agg(F.max("score").alias("top"))  # combined before it moves; a window would bring all of a job to one task
    scaled = F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)
    return scores.join(top, "job_id").select(*[scaled.alias(c) if c == "score" else c for c in scores.columns])


def fill_pairs(scores: DataFrame, texts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every (job, candidate): 0 where no score is. The result itself is jobs x candidates; use it only where all rows are wanted."""
    pairs = texts.select("candidate_id").crossJoin(F.broadcast(jobs.select("job_id"))) if _small(jobs) else texts.select("candidate_id").crossJoin(jobs.select("job_id"))
    return pairs.join(scores, ["job_id", "candidate_id"], "left").select("job_id", "candidate_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _small(jobs: DataFrame, rows: int = 10_000) -> bool:
    """Ids of at most so many jobs are broadcast (1 MB at most); checked, not assumed."""
    return jobs.select("job_id").limit(rows + 1).count() <= rows


def few(terms: DataFrame, rows: int = 200_000) -> DataFrame:
    """Terms of jobs, broadcast if they are at most so many rows (about 10 MB); checked, not assumed."""
    return F.broadcast(terms) if terms.limit(rows + 1).count() <= rows else terms


@dataclass(frozen=True)
class Bm25Ranker:
    """Okapi BM25 over the batch; terms that occur twice in a job count twice; negative idf becomes ``epsilon`` times the mean.

    A candidate's words are counted inside its row; what moves is one partial count a term, for the idf.
    """

    k1: float = 1.2
    b: float = 0.75
    epsilon: float = 0.25
    scale: bool = True
    tokenise: Callable[[Column], Column] = rank_tokens

    def weights(self, known: DataFrame, jobs: DataFrame) -> tuple[DataFrame, float]:
        """(job_id, term, w) of jobs' terms that the corpus (words) has, and the mean length of its documents."""
        # Statistics in one pass: an empty term stands for the document itself.
        each = known.select(F.explode(F.concat(F.array_distinct("words"), F.array(F.lit("")))).alias("term"), F.size("words").alias("n"))
        df = materialize(each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("n"))).alias("words")), "bm25-terms")
        n_docs, length = df.filter("term = ''").select("df", F.col("words") / F.col("df")).first() or (0, 0.0)
        idf = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        terms = df.filter("term <> ''").select("term", idf.alias("idf"))
        mean = terms.agg(F.avg("idf")).first()[0] or 0.0
        query = jobs.select("job_id", F.explode(self.tokenise(F.col("text"))).alias("term")).groupBy("job_id", "term").agg(F.count("*").alias("qtf"))
        weight = F.col("qtf") * F.when(F.col("idf") < 0, self.epsilon * mean).otherwise(F.col("idf"))
        return terms.join(few(query), "term").select("job_id", "term", weight.alias("w")), length

    def raw_scores(self, texts: DataFrame, jobs: DataFrame, corpus: DataFrame | None = None, keys: tuple[str, ...] = ("candidate_id",), own: str | None = None) -> DataFrame:
        """(job_id, keys, score) of pairs with a common term, not scaled. ``corpus`` (text): what the statistics are of, if not the texts;
        ``own``: the key that names the one job a text is scored for."""
        words = texts.select(*keys, self.tokenise(F.col("text")).alias("words"))
        weighed, length = self.weights(words if corpus is None else corpus.select(self.tokenise(F.col("text")).alias("words")), jobs)
        k1, b = self.k1, self.b
        value = lambda tf, n: (tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / (length or 1.0))),)
        found = sparse_products(words, list(keys), "words", weighed, ["w"], value, own=own)
        return found.withColumnRenamed("s0", "score")

    def score_all(self, texts: DataFrame, jobs: DataFrame) -> DataFrame:
        scores = self.raw_scores(texts, jobs)
        return scale_by_max(materialize(scores, "bm25-scores")) if self.scale else scores  # read twice: for the largest, and to scale

    def first(self, texts: DataFrame, jobs: DataFrame, k: int) -> DataFrame:
        """The first k of each job with their ranks: cut before scaling, which doesn't change the order."""
        kept = top_k(self.raw_scores(texts, jobs), k)
        return scale_by_max(materialize(kept, "bm25-first")) if self.scale else kept


def _counted(rows: DataFrame, ranker: TfidfRanker, wanted: frozenset[str] | None = None) -> DataFrame:
    """Rows (keys, text) as (keys, terms, tf, squares): a text's different terms and 1 + ln(count) of each, counted inside the row, and the sum of all
    squares of these. With ``wanted`` only these terms are listed; the squares are those of all."""
    small_batches(rows.sparkSession)
    kinds = dict(rows.dtypes)
    keys = [c for c in rows.columns if c != "text"]
    terms, known = ranker.counter(), rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = known.value
        for batch in batches:
            counts = [terms(x) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            squares = [sum(v * _LOG[n] for n, v in Counter(c.values()).items()) if not c or max(c.values()) < len(_LOG) else sum((1 + math.log(n)) ** 2 for n in c.values()) for c in counts]
            if listed is not None:
                counts = [{t: n for t, n in c.items() if t in listed} for c in counts]
            ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
            every = pa.array([t for c in counts for t in c], pa.string())
            tf = 1 + np.log(np.fromiter((n for c in counts for n in c.values()), float, len(every)))
            made = [pa.ListArray.from_arrays(ends, every), pa.ListArray.from_arrays(ends, pa.array(tf)), pa.array(squares, pa.float64())]
            yield pa.record_batch([*[batch.column(batch.schema.get_field_index(k)) for k in keys], *made], names=[*keys, "terms", "tf", "squares"])

    return rows.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "terms array<string>", "tf array<double>", "squares double"]))


_LOG = [0.0, *[(1 + math.log(n)) ** 2 for n in range(1, 256)]]


def norms(texts: DataFrame, ranker: TfidfRanker, n: int) -> DataFrame:
    """(row, more) of written texts (row, text), rows numbered by ``monotonically_increasing_id``: what the terms of two documents or more add to
    the sum of squared weights tf * idf, taken with the idf of a term of one document. Rows to which they add nothing may be missing.

    Terms are the 64 bits of their XXH64 and are dealt by its first bits, packed: what moves of an occurrence is its term's 64 bits, the place of
    its row and its count, and then, for each range of terms, a sum a row. No task holds more than a range of terms or a partition's rows.
    Two terms of equal bits would count as one (expected below 0.03 pairs in a thousand million terms).
    """
    spark = texts.sparkSession
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = max(MAX_BLOCKS, spark.sparkContext.defaultParallelism, chars // CHARS).bit_length()
    ranges = 1 << bits
    terms, once = ranker.counter(), math.log((1.0 + n) / 2) + 1
    small_batches(spark)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            names = np.fromiter((xxhash.xxh64_intdigest(t) for c in counts for t in c), np.uint64, held)
            tf = np.fromiter((v for c in counts for v in c.values()), np.int32, held)
            at = np.repeat(np.array(rows, np.int64), [len(c) for c in counts])
            part = at >> _ROW_BITS
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                mine = mine[np.argsort(names[mine] >> np.uint64(64 - bits), kind="stable")]
                cuts = np.searchsorted(names[mine] >> np.uint64(64 - bits), np.arange(ranges + 1, dtype=np.uint64))
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                ends = pa.array([0, *cuts[full + 1].tolist()], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (names[mine].view(np.int64), (at[mine] & (1 << _ROW_BITS) - 1).astype(np.int32), tf[mine])]
                yield pa.record_batch([pa.array(full, pa.int32()), pa.array(np.full(len(full), p), pa.int64()), *lists], names=["range", "part", "term", "place", "n"])

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(row)
                counts.append(found := terms(text))
                held += len(found)
            if held >= _HELD:
                yield from out()
                rows, counts, held = [], [], 0
        if held:
            yield from out()

    def weigh(key: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda c: np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in batches])
        term, place, count = flat(2), flat(3), flat(4)
        row = np.repeat(np.concatenate([b.column(1).to_numpy() for b in batches]), np.concatenate([pc.list_value_length(b.column(2)).to_numpy() for b in batches])) << _ROW_BITS | place
        _, which, df = np.unique(term, return_inverse=True, return_counts=True)
        common = np.flatnonzero(df[which] > 1)
        if not len(common):
            return
        row, idf = row[common], np.log((1.0 + n) / (1 + df[which[common]])) + 1
        more = (1 + np.log(count[common])) ** 2 * (idf * idf - once * once)
        rows, back = np.unique(row, return_inverse=True)
        sums, part = np.bincount(back, more, len(rows)), rows >> _ROW_BITS
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = pa.array([*first.tolist(), len(rows)], pa.int32())
        yield pa.record_batch([pa.array(part[first], pa.int64()), pa.ListArray.from_arrays(ends, pa.array((rows & (1 << _ROW_BITS) - 1).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(sums))], names=["part", "place", "more"])

    def add(key: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, more = (np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in batches]) for c in (1, 2))
        total = np.bincount(place, more)
        yield pa.record_batch([pa.array(key << _ROW_BITS | np.arange(len(total), dtype=np.int64)), pa.array(total)], names=["row", "more"])

    spelled = texts.select("row", "text").mapInArrow(spell, "range int, part long, term array<long>, place array<int>, n array<int>")
    weighed = packed_groups(spelled, ["range"], ranges, weigh, "part long, place array<int>, more array<double>")
    return packed_groups(weighed, ["part"], ranges, add, "row long, more double")


@dataclass(frozen=True)
class TfidfRanker:
    """Cosine of TF-IDF vectors: 1 + ln(tf), smoothed idf over the batch and the job together. ``stop_words``: unless given, see ``english_stop_words``."""

    ngram_range: tuple[int, int] = (1, 2)
    stop_words: tuple[str, ...] | None = None
    pattern: str = r"[a-z0-9+#.]{2,}"

    def stopped(self) -> tuple[str, ...]:
        return english_stop_words() if self.stop_words is None else self.stop_words

    def counter(self) -> Callable[[str | None], Counter[str]]:
        """How often a text has each of its terms."""
        find, stop, (low, high) = re.compile(self.pattern).findall, frozenset(self.stopped()), self.ngram_range

        def terms(text: str | None) -> Counter[str]:
            words = [w for w in find((text or "").lower()) if w not in stop]
            found: Counter[str] = Counter()
            for n in range(low, high + 1):
                found.update(words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
            return found

        return terms

    def asked(self, jobs: DataFrame) -> tuple[DataFrame, frozenset[str] | None]:
        """Jobs' terms (job_id, term, tf), written; and these terms alone, None where they are more than ``MAX_TERMS``."""
        counted = _counted(jobs.select("job_id", "text"), self)
        query = materialize(counted.select("job_id", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("job_id", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf")), "tfidf-asked")
        different = query.select("term").distinct()
        return query, frozenset(r[0] for r in different.collect()) if different.limit(MAX_TERMS + 1).count() <= MAX_TERMS else None

    def weights(self, query: DataFrame, docs: DataFrame, n: int) -> DataFrame:
        """Jobs' terms (job_id, term, wq, idf0, idf1), written. ``docs`` lists the jobs' terms that each document has."""
        # What moves of the corpus: one partial count of a job's term and task.
        df = materialize(docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "tfidf-vocabulary")
        # idf of a term for a job: its documents, and one more if the job has it.
        idf = lambda has: F.log(F.lit(1.0 + n) / (1 + F.coalesce(F.col("df"), F.lit(0)) + has)) + 1
        held = df.join(few(query.select("term").distinct()), "term")
        weighed = query.join(held, "term", "left").select("job_id", "term", (F.col("tf") * idf(1)).alias("wq"), idf(0).alias("idf0"), idf(1).alias("idf1"))
        return materialize(weighed, "tfidf-jobs")

    def with_norms(self, docs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
        """``docs`` (row, squares) with ``base``, the square of their norm; ``texts`` (row, text) are the same rows' texts, written."""
        once = math.log((1.0 + n) / 2) + 1
        more = materialize(norms(texts, self, n), "tfidf-norms")
        return docs.join(few(more, BROADCAST_ROWS), "row", "left").withColumn("base", F.col("squares") * (once * once) + F.coalesce("more", F.lit(0.0))).drop("more")

    def prepared(self, texts: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Documents (keys, terms, tf, base): the jobs' terms that each has, and the square of its norm; jobs' terms (job_id, term, wq, idf0, idf1)."""
        query, wanted = self.asked(jobs)
        texts = numbered_rows(texts, "tfidf-texts")
        docs = materialize(_counted(texts, self, wanted), "tfidf-terms")
        n = docs.count() + 1  # the job is in its own corpus
        return self.with_norms(docs, texts, n).drop("row", "squares"), self.weights(query, docs, n)

    def score_all(self, texts: DataFrame, jobs: DataFrame, first: int | None = None) -> DataFrame:
        """``first``: only so many of each job and task, the highest rounded to nine places, ids ascending among equals."""
        docs, query = self.prepared(texts.select("candidate_id", "text"), jobs)
        job_norm = query.groupBy("job_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("job_norm"))
        # A common term weighs less with the job in the corpus; the norm is corrected for those terms alone.
        weighed = query.select("job_id", "term", (F.col("wq") * F.col("idf1")).alias("dot"), (F.col("idf1") * F.col("idf1") - F.col("idf0") * F.col("idf0")).alias("change"))
        sums = sparse_products(docs, ["candidate_id", "base"], "terms", weighed, ["dot", "change"], "tf", powers=(1, 2)).withColumnsRenamed({"s0": "dot", "s1": "change"})
        full = sums.join(few(job_norm), "job_id")
        scores = full.select("job_id", "candidate_id", F.coalesce(F.try_divide("dot", F.sqrt(F.greatest(F.col("base") + F.col("change"), F.lit(0.0))) * F.col("job_norm")), F.lit(0.0)).alias("score"))
        return scores if first is None else first_of_tasks(scores, first)


@dataclass(frozen=True)
class DenseRanker:
    """Cosine of vectors that ``texts`` and ``jobs`` carry. All candidates against all jobs: jobs are a stated query set, taken in blocks."""

    vector: str = "vector"

    def score_all(self, texts: DataFrame, jobs: DataFrame) -> DataFrame:
        return dense_cosines(texts, ["candidate_id"], self.vector, jobs)


def rank_systems(systems: dict[str, DataFrame], score: str = "score") -> DataFrame:
    """(system, job_id, candidate_id, score, rank): the lists of all systems, ranked together in one deal."""
    if not systems:
        raise ValueError("ranking needs one system at least: without any there are no columns to return")
    parts = [materialize(frame.select(F.lit(name).alias("system"), "job_id", "candidate_id", score), "system-scores") for name, frame in systems.items()]
    return rank_all(reduce(DataFrame.unionByName, parts), score, ("system", "job_id"), written=True)


def fuse_ranked(ranked: DataFrame, k: int = 60) -> DataFrame:
    """(job_id, candidate_id, score) of lists in one frame: the sum of 1 / (k + rank) over a job's lists."""
    return ranked.groupBy("job_id", "candidate_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(job_id, candidate_id, score) of rankings with a column ``rank``: the sum of 1 / (k + rank)."""
    if not rankings:
        raise ValueError("fusion needs one ranking at least: without any there are no columns to return")
    one = rankings[0].select("job_id", "candidate_id", "rank")
    for other in rankings[1:]:
        one = one.unionByName(other.select("job_id", "candidate_id", "rank"))
    # Dealt out anew: rankings are partitioned by job already, but adaptive plans may merge each one's partitions differently.
    dealt = one.repartition("job_id", "candidate_id") if len(rankings) > 1 else one
    return dealt.groupBy("job_id", "candidate_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


@dataclass(frozen=True)
class FusionRanker:
    """Reciprocal ranks of other rankers, summed."""

    rankers: tuple[Ranker, ...]
    k: int = 60

    def score_all(self, texts: DataFrame, jobs: DataFrame) -> DataFrame:
        systems = {str(i): fill_pairs(r.score_all(texts, jobs), texts, jobs) for i, r in enumerate(self.rankers)}
        return fuse_ranked(rank_systems(systems), self.k)


@dataclass
class TimedRanking:
    rows: int
    elapsed: float
    frame: DataFrame = field(repr=False)

    @property
    def ms_per_resume(self) -> float:
        return self.elapsed * 1000 / max(1, self.rows)


def timed_rank(ranker: Ranker, texts: DataFrame, jobs: DataFrame) -> TimedRanking:
    """Ranks once into a sink that keeps nothing and takes the time."""
    n, frame, began = texts.count(), rank(ranker.score_all(texts, jobs)), time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return TimedRanking(n, time.perf_counter() - began, frame)
