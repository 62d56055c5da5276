"""Attacked copies of documents, scored without their texts: what a copy holds is its document's counts plus what was added.

An attack adds the job's text to a document: all of it (``paste``) or the first half of its words (``half``). Words, terms, letters and runs of
three words of a copy are sums over its two parts, so one pass over the documents gives every feature of every document and of every
copy for every job. Documents stay in their rows; jobs are a stated query set, taken in blocks of bounded size. Systems to compare are rows of
weights over these features: all are ranked from the same table.

Defined cases: null texts are empty; jobs without words meet nothing; a row is kept where document or copy has one of the job's words; an
empty frame gives no rows. TF-IDF counts no pair of words across the seam of a copy, the echo of trigrams does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict, astuple, dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankweave.config import DEFAULT_ANTIGAMING, DEFAULT_GATE, DEFAULT_GROUNDING
from rankweave.functions.vectors import clamp
from rankweave.operators import integrity, packed, scoring
from rankweave.operators.blocks import _passes
from rankweave.operators.embedder import load_letters
from rankweave.operators.rankers import BROADCAST_ROWS, Bm25Ranker, TfidfRanker, few, norms
from rankweave.operators.ranks import positions
from rankweave.runtime import materialize, numbered_rows, small_batches

ATTACKS = ("paste", "half")
#: Numbers of one array of products held at once, and characters of jobs in a block.
CELLS = 1_000_000
JOB_CHARS = 4_000_000
#: Words that a document counts as fully experienced with.
LONG = 300
_WORDS = re.compile(r"[a-z0-9][a-z0-9+#.\-]*")
_TOKENS = re.compile(r"[a-z][a-z+#.]{1,}")
FEATURES = ("bm25", "tfidf", "dense", "coverage", "grounded", "experience", "echo")


def first_half(text: str) -> str:
    words = text.split(" ")
    return " ".join(words[: len(words) // 2])


class _Postings:
    """The different terms of a block of jobs, job by job, each with weights; sums over a job's terms."""

    def __init__(self, of_job: list[list[str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.term = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for terms in of_job for t in terms], np.int64)
        sizes = np.array([len(t) for t in of_job], np.int64)
        self.jobs = len(of_job)
        self.held = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.held]
        self.size = sizes

    def values(self, counts: list[dict[str, float]]) -> np.ndarray:
        """Rows of counts, a column for each posting."""
        found = np.zeros((len(counts), max(1, len(self.vocabulary))))
        for i, row in enumerate(counts):
            for term, n in row.items():
                at = self.vocabulary.get(term)
                if at is not None:
                    found[i, at] = n
        return found[:, self.term]

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), self.jobs))
        if len(self.held):
            out[:, self.held] = np.add.reduceat(values, self.starts, axis=1)
        return out


def _grams(tokens: list[str]) -> set[str]:
    return {" ".join(g) for g in zip(tokens, tokens[1:], tokens[2:], strict=False)}


class _Block:
    """A block of jobs as the workers need it."""

    def __init__(self, jobs: list[tuple], weights: dict, query: dict, length: float, ranker: Bm25Ranker, tfidf: TfidfRanker, floor: float) -> None:
        self.ids = [j for j, _ in jobs]
        texts = [t or "" for _, t in jobs]
        added = {"paste": texts, "half": [first_half(t) for t in texts]}
        self.length, self.k1, self.b, self.floor = length or 1.0, ranker.k1, ranker.b, floor
        self.words = _Postings([[t for t, _ in weights.get(j, ())] for j in self.ids])
        self.weight = np.array([w for j in self.ids for _, w in weights.get(j, ())])
        self.terms = _Postings([[t for t, *_ in query.get(j, ())] for j in self.ids])
        self.wq, self.idf0, self.idf1 = (np.array([q[i] for j in self.ids for q in query.get(j, ())]) for i in (1, 2, 3))
        self.norm = np.sqrt(self.terms.sums((self.wq * self.wq)[None])[0])
        grams = [_grams(_TOKENS.findall(t.lower())) for t in texts]
        self.grams = _Postings([sorted(g) for g in grams])
        self.many = self.grams.size >= DEFAULT_ANTIGAMING.jd_echo_min_trigrams
        letters = load_letters("cpu")
        self.letters = letters(texts)
        count = tfidf.counter()
        self.more: dict[str, tuple] = {}
        for attack, parts in added.items():
            tokens = [_TOKENS.findall(t.lower()) for t in parts]
            own_words, own_terms = [Counter(_WORDS.findall(t.lower())) for t in parts], [count(t) for t in parts]
            self.more[attack] = (
                self._own(self.words, own_words), np.array([sum(c.values()) for c in own_words], float), self._own(self.terms, own_terms),
                self._own(self.grams, [dict.fromkeys(_grams(t), 1) for t in tokens]), tokens, letters(parts),
            )

    @staticmethod
    def _own(postings: _Postings, counts: list[dict]) -> np.ndarray:
        """For each posting, how often its own job's addition has the term."""
        job = np.repeat(np.arange(postings.jobs), postings.size)
        names = list(postings.vocabulary)
        return np.array([counts[j].get(names[t], 0) for j, t in zip(job, postings.term, strict=True)], float)

    def step(self) -> int:
        return max(1, CELLS // max(1, len(self.words.term), len(self.terms.term), len(self.grams.term)))

    def features(self, docs: _Documents, attack: str | None) -> tuple[np.ndarray, ...]:
        """Which pairs have a word in common, and the features, each documents x jobs."""
        words, grams, terms = docs.words, docs.grams, docs.terms
        length = docs.length[:, None]
        letters = docs.letters
        own = words > 0
        if attack:
            more_words, more_length, more_terms, more_grams, tokens, more_letters = self.more[attack]
            words, length, terms, grams = words + more_words, length + more_length, terms + more_terms, np.maximum(grams, more_grams)
            grams = self._seams(grams, docs.ends, tokens)
        else:
            length = np.broadcast_to(length, (len(letters), self.words.jobs))
        job = np.repeat(np.arange(self.words.jobs), self.words.size)
        damp = self.k1 * (1 - self.b + self.b * length / self.length)
        bm25 = self.words.sums(self.weight * words * (self.k1 + 1) / (words + damp[:, job]))
        met, n = self.words.sums((words > 0).astype(float)), np.maximum(1, self.words.size)
        shown = self.words.sums(own.astype(float))
        x = np.where(terms > 0, 1 + np.log(np.maximum(terms, 1)), 0.0)
        x0 = np.where(docs.terms > 0, 1 + np.log(np.maximum(docs.terms, 1)), 0.0)
        norm = np.sqrt(np.maximum(0, docs.base[:, None] - self.terms.sums((x0 * self.idf0) ** 2) + self.terms.sums((x * self.idf1) ** 2))) * self.norm
        dot = self.terms.sums(x * self.idf1 * self.wq)
        tfidf = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
        if attack:
            top = letters @ self.letters.T + (more_letters * self.letters).sum(1)
            square = (letters**2).sum(1)[:, None] + 2 * letters @ more_letters.T + (more_letters**2).sum(1)
        else:
            top, square = letters @ self.letters.T, np.broadcast_to((letters**2).sum(1)[:, None], met.shape)
        both = np.sqrt(square) * np.sqrt((self.letters**2).sum(1))
        dense = np.clip(np.divide(top, both, out=np.zeros_like(top), where=both > 0), 0, 1)
        echo = np.where(self.many, self.grams.sums(grams) / np.maximum(1, self.grams.size), np.nan)
        return met > 0, bm25, tfidf, dense, met / n, (self.floor * met + (1 - self.floor) * shown) / n, np.minimum(1.0, length / LONG), echo

    def _seams(self, grams: np.ndarray, ends: list[list[str]], tokens: list[list[str]]) -> np.ndarray:
        """Runs of three words across the seam between a document and what was added."""
        first = np.cumsum(self.grams.size) - self.grams.size
        places = [{int(t): int(first[j]) + i for i, t in enumerate(self.grams.term[first[j] : first[j] + self.grams.size[j]])} for j in range(self.grams.jobs)]
        for j, added in enumerate(tokens):
            for i, end in enumerate(ends):
                run = [*end, *added[:2]]
                for a in range(len(run) - 2):
                    at = self.grams.vocabulary.get(" ".join(run[a : a + 3]))
                    if at is not None and at in places[j]:
                        grams[i, places[j][at]] = 1
        return grams


class _Documents:
    def __init__(self, block: _Block, texts: list[str], counts: list[dict[str, float]], base: np.ndarray) -> None:
        low = [t.lower() for t in texts]
        words = [_WORDS.findall(t) for t in low]
        tokens = [_TOKENS.findall(t) for t in low]
        self.words, self.length = block.words.values([Counter(w) for w in words]), np.array([len(w) for w in words], float)
        self.grams = block.grams.values([dict.fromkeys(_grams(t), 1) for t in tokens])
        self.ends = [t[-2:] for t in tokens]
        self.terms, self.base, self.letters = block.terms.values(counts), base, load_letters("cpu")(texts)

    @classmethod
    def read(cls, block: _Block, batch: pa.RecordBatch, once: float) -> _Documents:
        """Of a batch of ``facts``."""
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}

        def values(postings: _Postings, terms: str, counts: str) -> np.ndarray:
            names = list(postings.vocabulary)
            out = np.zeros((batch.num_rows, max(1, len(names))))
            lists = column[terms]
            at = pc.index_in(lists.flatten(), pa.array(names, pa.string()))
            held = at.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            out[row[held], at.drop_null().to_numpy()] = column[counts].flatten().to_numpy()[held] if counts else 1
            return out[:, postings.term]

        out = object.__new__(cls)
        out.words, out.length, out.grams, out.terms = values(block.words, "words", "word_n"), column["length"].to_numpy().astype(float), values(block.grams, "grams", ""), values(block.terms, "terms", "term_n")
        out.ends, out.letters = column["ends"].to_pylist(), column["letters"].flatten().to_numpy().reshape(-1, block.letters.shape[1]).astype(float)
        out.base = column["squares"].to_numpy() * once * once + pc.fill_null(column["more"], 0.0).to_numpy()
        return out

    def of(self, rows: np.ndarray) -> _Documents:
        out = object.__new__(_Documents)
        out.words, out.length, out.grams, out.terms, out.base, out.letters = (getattr(self, n)[rows] for n in ("words", "length", "grams", "terms", "base", "letters"))
        out.ends = [self.ends[i] for i in rows]
        return out


def features(texts: DataFrame, jobs: DataFrame, ranker: Bm25Ranker | None = None, tfidf: TfidfRanker | None = None, floor: float = DEFAULT_GROUNDING.floor) -> DataFrame:
    """(job_id, candidate_id, attack, features) of documents (candidate_id, text, attacked: whether copies are made of it) and their copies.

    ``attack`` is null for a document itself. bm25 isn't scaled; echo is null for jobs with too few trigrams. Statistics of words are those of the documents
    alone. grounded counts a job's word that only the addition has at the floor.
    """
    ranker, tfidf, spark = ranker or Bm25Ranker(), tfidf or TfidfRanker(), texts.sparkSession
    body = F.coalesce("text", F.lit(""))
    docs, query = tfidf.prepared(texts.select("candidate_id", F.coalesce("attacked", F.lit(False)).alias("attacked"), body.alias("body"), body.alias("text")), jobs)
    weights, length = ranker.weights(docs.select(ranker.tokenise(F.col("body")).alias("words")), jobs)
    weights = materialize(weights, "attack-words")
    chars = jobs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    kind, job_kind, job_type = dict(texts.dtypes)["candidate_id"], dict(jobs.dtypes)["job_id"], to_arrow_type(jobs.schema["job_id"].dataType)
    schema = f"job_id {job_kind}, candidate_id {kind}, attack string, " + ", ".join(f"{f} double" for f in FEATURES)

    def one(part: DataFrame) -> DataFrame:
        asked = sorted((tuple(r) for r in part.select("job_id", "text").collect()), key=repr)
        mine = part.select("job_id")
        by_job: tuple[dict, dict] = ({}, {})
        for found, frame, columns in zip(by_job, (weights, query), (("term", "w"), ("term", "wq", "idf0", "idf1")), strict=True):
            for r in frame.join(F.broadcast(mine), "job_id", "left_semi").select("job_id", *columns).orderBy("job_id", "term").collect():
                found.setdefault(r[0], []).append(tuple(r)[1:])
        known = spark.sparkContext.broadcast(_Block(asked, *by_job, length, ranker, tfidf, floor))
        small_batches(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = known.value
            for whole in batches:
                for at in range(0, whole.num_rows, block.step()):
                    batch = whole.slice(at, block.step())
                    column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                    # What was counted is 1 + ln(count): counts come back exactly.
                    counts = [dict(zip(t, np.rint(np.exp(np.array(v) - 1)), strict=True)) for t, v in zip(column["terms"].to_pylist(), column["tf"].to_pylist(), strict=True)]
                    docs = _Documents(block, column["body"].to_pylist(), counts, column["base"].to_numpy(zero_copy_only=False))
                    low = np.flatnonzero(column["attacked"].to_numpy(zero_copy_only=False))
                    for attack in (None, *ATTACKS):
                        rows = np.arange(batch.num_rows) if attack is None else low
                        if not len(rows):
                            continue
                        met, *found = block.features(docs if attack is None else docs.of(rows), attack)
                        i, j = np.nonzero(met)
                        echo = found.pop()[i, j]
                        made = [pa.array([block.ids[x] for x in j], job_type), column["candidate_id"].take(pa.array(rows[i])), pa.array([attack] * len(i), pa.string()), *[pa.array(f[i, j]) for f in found], pa.array(echo, mask=np.isnan(echo))]
                        yield pa.record_batch(made, names=["job_id", "candidate_id", "attack", *FEATURES])

        return docs.select("candidate_id", "attacked", "body", "terms", "tf", "base").mapInArrow(run, schema)

    return _passes(jobs.where("text IS NOT NULL"), max(1, -(-chars // JOB_CHARS)), one)


@dataclass(frozen=True)
class System:
    """A ranker as weights of features; ``gate`` damps by coverage, ``guard`` takes the integrity penalty off."""

    name: str
    bm25: float = 0.0
    tfidf: float = 0.0
    dense: float = 0.0
    coverage: float = 0.0
    grounded: float = 0.0
    experience: float = 0.0
    gate: bool = False
    guard: bool = False


_HYBRID = {"bm25": 0.1, "dense": 0.4, "experience": 0.2, "gate": True}
#: Three plain rankers, and the hybrid without defence, with either and with both.
SYSTEMS = (
    System("tfidf", tfidf=1.0),
    System("bm25", bm25=1.0),
    System("dense", dense=1.0),
    System("hybrid_plain", coverage=0.3, **_HYBRID),
    System("hybrid_detector_only", coverage=0.3, guard=True, **_HYBRID),
    System("hybrid_grounded_only", grounded=0.3, **_HYBRID),
    System("hybrid_full", grounded=0.3, guard=True, **_HYBRID),
)


def penalty(echo: Column) -> Column:
    return integrity.penalty([F.lit(0.0)] * 3 + [integrity.jd_echo_signal(echo).getField("severity"), F.lit(0.0)])


def ranked(scored: DataFrame, systems: tuple[System, ...] = SYSTEMS, places: int = 9) -> DataFrame:
    """(system, job_id, attack, candidate_id, total, rank, n): every system's list of every job, documents and copies together. ``scored`` has the
    features, bm25 scaled to the job's largest, as a written table."""
    names = [f.name for f in fields(System)]
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, astuple(s), strict=True)]) for s in systems])
    each = scored.withColumn("penalty", penalty(F.col("echo"))).withColumn("s", F.explode(rows))
    weighed = sum((F.col(f"s.{f}") * F.col(f) for f in FEATURES[:-1]), F.lit(0.0))
    gate = F.when(F.col("s.gate"), scoring.gate_multiplier(F.col("coverage"), DEFAULT_GATE)).otherwise(1.0)
    total = clamp(weighed * gate - F.when(F.col("s.guard"), F.col("penalty")).otherwise(0.0))
    lists = each.select(F.col("s.name").alias("system"), "job_id", "attack", "candidate_id", F.round(total, places).alias("total"))
    return positions(lists, [F.desc("total"), F.col("candidate_id"), F.coalesce("attack", F.lit(""))], ["system", "job_id"], size="n")


def facts(texts: DataFrame, jobs: list[tuple], tfidf: TfidfRanker | None, echo: bool) -> DataFrame:
    """What is scored of ``texts`` (row, candidate_id, number, attacked, grade, text) for ``jobs``: counts of their words, terms and runs of three words, and the text's length, letters and ends."""
    spark = texts.sparkSession
    bodies = [t or "" for _, t in jobs]
    count = tfidf.counter() if tfidf else lambda text: Counter()
    asked = (frozenset(w for t in bodies for w in _WORDS.findall(t.lower())), frozenset(w for t in bodies for w in count(t)), frozenset(g for t in bodies for g in _grams(_TOKENS.findall(t.lower()))) if echo else frozenset())
    known, letters = spark.sparkContext.broadcast(asked), load_letters("cpu")
    kinds = dict(texts.dtypes)
    keys = ("row", "candidate_id", "number", "attacked", "grade")
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "words array<string>, word_n array<int>, length int, terms array<string>, term_n array<int>, squares double, grams array<string>, ends array<string>, letters array<int>"])
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, terms, grams = known.value
        strings, whole = pa.list_(pa.string()), pa.list_(pa.int32())
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keys)).to_pylist()]
            low = [t.lower() for t in texts]
            found = [_WORDS.findall(t) for t in low]
            own = [Counter(w for w in f if w in words) for f in found]
            every = [count(t) for t in texts]
            mine = [{t: n for t, n in c.items() if t in terms} for c in every]
            tokens = [_TOKENS.findall(t) for t in low] if echo else [[]] * len(low)
            squares = [sum(v * (1 + math.log(n)) ** 2 for n, v in Counter(c.values()).items()) for c in every]
            columns = {
                "words": pa.array([list(c) for c in own], strings), "word_n": pa.array([list(c.values()) for c in own], whole), "length": pa.array([len(f) for f in found], pa.int32()), "terms": pa.array([list(c) for c in mine], strings),
                "term_n": pa.array([list(c.values()) for c in mine], whole), "squares": pa.array(squares, pa.float64()), "grams": pa.array([list(_grams(t) & grams) for t in tokens], strings), "ends": pa.array([t[-2:] for t in tokens], strings),
                "letters": pa.array(letters(texts if echo else [""] * len(texts)).astype(np.int32).tolist(), whole),
            }
            yield pa.record_batch({k: batch.column(i) for i, k in enumerate(keys)} | columns)

    return texts.select(*keys, "text").mapInArrow(run, schema)


Score = Callable[[dict[str, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]


def taken_off(f: dict[str, np.ndarray]) -> np.ndarray:
    """``penalty`` of arrays."""
    signals = DEFAULT_ANTIGAMING
    limit = signals.jd_echo_threshold
    echo = np.nan_to_num(f["echo"])
    severity = np.where(echo > limit, np.clip((echo - limit) / max(1e-9, 1 - limit), 0, 1), 0.0)
    return np.minimum(signals.max_penalty, signals.max_penalty * signals.signal_weights[3] * severity)


def damped(f: dict[str, np.ndarray], systems: tuple[System, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Members and totals of ``systems``, as ``ranked`` has them."""
    gate, off = DEFAULT_GATE, taken_off(f)
    open_ = gate.floor + (1 - gate.floor) * np.minimum(1.0, np.maximum(0.0, f["coverage"]) / gate.threshold) if gate.enabled else 1.0
    out = []
    for s in systems:
        weighed = sum((w * f[n] for n, w in asdict(s).items() if n in FEATURES and w), np.zeros_like(f["bm25"]))
        out.append((f["met"], np.clip(weighed * (open_ if s.gate else 1.0) - (off if s.guard else 0.0), 0, 1)))
    return out


def guarded(f: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """BM25 without and with the penalty taken off, which may end below 0."""
    return [(f["met"], f["bm25"]), (f["met"], f["bm25"] - taken_off(f))]


def packed_lists(texts: DataFrame, jobs: DataFrame, names: tuple[str, ...], score: Score, tfidf: TfidfRanker | None = None, copies: bool = True, ranked_copies: bool = True, echo: bool = True, kind: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None, ranker: Bm25Ranker | None = None, floor: float = DEFAULT_GROUNDING.floor) -> packed.Lists:
    """The lists of every system and job over documents (candidate_id, text, attacked, grade) and, with ``copies``, the copies of attacked ones. ``score`` gives each system's
    members and totals by the features (met: a word in common, shared: a term in common). ``tfidf`` only where a system weighs it. Without ``ranked_copies`` copies
    count for the largest BM25 alone. Kinds of documents are their grades, unless ``kind`` says otherwise or copies are ranked."""
    ranker, spark = ranker or Bm25Ranker(), texts.sparkSession
    rows, named = packed.numbered(texts)
    grade = F.coalesce(F.col("grade"), F.lit(0)) if "grade" in texts.columns else F.lit(0)
    rows = rows.select("candidate_id", F.col("number").cast("long").alias("number"), F.coalesce("attacked", F.lit(False)).alias("attacked") if "attacked" in texts.columns else F.lit(False).alias("attacked"), grade.cast("int").alias("grade"), F.coalesce("text", F.lit("")).alias("text"))
    rows = numbered_rows(rows, "list-texts") if tfidf else rows.withColumn("row", F.lit(0).cast("long"))
    weights, length = ranker.weights(rows.select(ranker.tokenise(F.col("text")).alias("words")), jobs)
    weights = materialize(weights, "list-words")
    total, low = rows.agg(F.count("*"), F.count_if("attacked")).first()
    n, most = total + 1, total + (len(ATTACKS) * low if ranked_copies else 0)
    once = math.log((1.0 + n) / 2) + 1
    more = materialize(norms(rows, tfidf, n), "list-norms") if tfidf else None
    asked_terms = tfidf.asked(jobs)[0] if tfidf else None
    chars, n_jobs = jobs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-most * n_jobs * len(names) // packed.PIECE))
    job_type = to_arrow_type(jobs.schema["job_id"].dataType)
    schema = f"system string, job_id {dict(jobs.dtypes)['job_id']}, {packed.SCHEMA}"

    def one(part: DataFrame) -> DataFrame:
        asked = sorted((tuple(r) for r in part.select("job_id", "text").collect()), key=repr)
        docs = materialize(facts(rows, asked, tfidf, echo), "list-facts", "zstd")
        found = [(weights, ("term", "w"))] + ([(tfidf.weights(asked_terms, docs, n), ("term", "wq", "idf0", "idf1"))] if tfidf else [])
        by_job: tuple[dict, dict] = ({}, {})
        for into, (frame, columns) in zip(by_job, found, strict=False):
            for r in frame.join(F.broadcast(part.select("job_id")), "job_id", "left_semi").select("job_id", *columns).orderBy("job_id", "term").collect():
                into.setdefault(r[0], []).append(tuple(r)[1:])
        block = spark.sparkContext.broadcast(_Block(asked, *by_job, length, ranker, tfidf or TfidfRanker(), floor))
        docs = docs.join(few(more, BROADCAST_ROWS), "row", "left") if tfidf else docs.withColumn("more", F.lit(0.0))
        small_batches(spark)

        def steps(batches: Iterator[pa.RecordBatch], attacks: bool) -> Iterator[tuple]:
            for whole in batches:
                for at in range(0, whole.num_rows, block.value.step()):
                    batch = whole.slice(at, block.value.step())
                    read = _Documents.read(block.value, batch, once)
                    low = np.flatnonzero(batch.column(batch.schema.get_field_index("attacked")).to_numpy(zero_copy_only=False))
                    for attack in (None, *ATTACKS) if attacks and len(low) else (None,):
                        mine = read.of(low) if attack else read
                        made = dict(zip(("met", *FEATURES), block.value.features(mine, attack), strict=True))
                        yield batch, low, attack, made | {"shared": block.value.terms.sums((mine.terms > 0).astype(float)) > 0}

        def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = np.full(len(block.value.ids), -np.inf)
            for _, _, _, f in steps(batches, copies):
                top = np.maximum(top, np.where(f["met"], f["bm25"], -np.inf).max(axis=0, initial=-np.inf))
            yield pa.record_batch({"i": pa.array(range(len(top)), pa.int32()), "top": pa.array(top, pa.float64())})

        tops = np.zeros(len(asked))
        for i, top in docs.mapInArrow(highest, "i int, top double").groupBy("i").agg(F.max("top")).collect():  # one row a job
            tops[i] = max(0.0, top)
        tops_ = np.where(tops > 0, tops, np.inf)

        def keyed(frame: DataFrame, cuts: dict[tuple, np.ndarray]) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids = block.value.ids
                held: list[list[np.ndarray]] = [[] for _ in names]
                passed = np.zeros((len(names), len(ids), 2), np.int64)
                size, control = 0, None

                def out() -> Iterator[pa.RecordBatch]:
                    made = []
                    for s, name in enumerate(names):
                        every = np.concatenate(held[s]).T
                        for j, job in enumerate(ids):
                            mine = np.sort(every[j][every[j] >= 0])
                            bounds = [0, *np.searchsorted(mine, cuts.get((name, job), ())).tolist(), len(mine)]
                            half, paste = passed[s, j].tolist()
                            for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                                if b > a or (piece == 0 and (half or paste)):
                                    made.append((name, job, piece, mine[a:b], half if piece == 0 else 0, paste if piece == 0 else 0))
                    for at in range(0, len(made), 64):
                        some = made[at : at + 64]
                        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(m[3]) for m in some)]), pa.int32()), pa.array(np.concatenate([m[3] for m in some])))
                        first, job, piece, _, half, paste = zip(*some, strict=True)
                        yield pa.record_batch([pa.array(first), pa.array(job, job_type), pa.array(piece, pa.int32()), lists, pa.array(half, pa.int64()), pa.array(paste, pa.int64())], names=["system", "job_id", "piece", "keys", "half", "paste"])

                for batch, low, attack, f in steps(batches, ranked_copies):
                    f["bm25"] = f["bm25"] / tops_
                    number = batch.column(batch.schema.get_field_index("number")).to_numpy()[:, None]
                    if attack:
                        number = number[low]
                        code = packed.HALF if attack == "half" else packed.PASTE
                    elif ranked_copies:
                        own = np.zeros(len(number), np.int64)
                        own[low] = packed.CONTROL
                    else:
                        own = batch.column(batch.schema.get_field_index("grade")).to_numpy().astype(np.int64)
                    control = [None] * len(names) if attack is None else control
                    for s, (member, value) in enumerate(score(f)):
                        if attack is None:
                            keys = np.where(member, packed.keys_of(value, number, kind(f) if kind else own[:, None]), -1)
                            control[s] = keys[low]
                        else:
                            known = control[s] >= 0  # copies whose document isn't in the list count, but aren't compared
                            keys = np.where(member, packed.keys_of(value, number, np.where(known, code, code - 1)), -1)
                            passed[s, :, 0 if attack == "half" else 1] += (known & (keys >= 0) & (keys < control[s])).sum(axis=0)
                        held[s].append(keys)
                        size += keys.size
                    if size >= packed.HELD:
                        yield from out()
                        held, size = [[] for _ in names], 0
                        passed[:] = 0
                if size:
                    yield from out()

            return frame.mapInArrow(run, schema)

        pieces, cuts = -(-most // packed.PIECE), {}
        if pieces > 1:
            share = max(1, total // (2_000 * pieces))
            sample = packed.Lists(keyed(docs.where(F.pmod(F.xxhash64("number"), F.lit(share)) == 0), {}), parts, named)
            even = lambda keys, batches: {"cuts": [keys[np.arange(1, pieces) * len(keys) // pieces] if len(keys) else keys]}
            cuts = {(r.system, r.job_id): np.unique(r.cuts) for r in sample.groups(even, "cuts array<long>").collect()}  # a few keys a list
        return keyed(docs, cuts)

    return packed.Lists(_passes(jobs.where("text IS NOT NULL"), max(1, -(-chars // JOB_CHARS)), one), parts, named)
