"""Quality classifier by nearest-neighbour voting among latent-semantic vectors.

Terms of a text, counted over the whole text: its character trigrams (bytes of the lower-cased text, hashed to
``_HASHED`` terms: pieces of words, and whole characters of other scripts), the trigrams of its characters' classes
(lower, upper, digit, space, line end, single punctuation marks, ...), and a few terms of word repetition: a word
equal to the one, two or three words before it, and words seen before. Weights are square roots of relative
frequencies times the inverse document frequency. Training takes labelled documents (at most ``max_per_label`` of each label, those
with the smallest seeded hash: a bounded sample, a documented parameter), decomposes their term matrix by
singular values (subspace iteration) and keeps ``dims`` dimensions: latent vectors, normalised. Scoring projects every document and
takes its cosines to all labelled vectors by one matrix product a block of documents, exactly; the ``neighbours``
largest vote with weight similarity^``power``, each label's votes divided by its share of the sample.

What is broadcast is bounded by the parameters: terms x dims + 2 x max_per_label x dims floats (1.8 MB).
Documents are scored where they are, with no shuffle.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0; labels, lang, source and doc_id
are never inputs of a score. Defined cases: null and empty texts have no terms and so no cosine; they go by the
nearest labelled texts in length, that is the ``neighbours`` shortest (all of the length of the last), whose votes count alike. Without labels of
both kinds everything scores 0.5. A null doc_id is held out; rows without a label or a doc_id, and doc_ids with
both labels, are not learned from; of rows that share a doc_id the text with the smallest hash is; repeated rows
are scored each; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.columns import pick
from rankweave.runtime import small_batches

MAX_PER_LABEL = 1500
DIMS = 48
NEIGHBOURS = 24
POWER = 4.0
CUT = 0.3
FOLDS = 5
SEED = 11
#: Dimensions beyond ``dims`` that the subspace iteration carries, and its turns.
EXTRA, TURNS = 16, 8
#: Terms: trigrams of 16 classes, then repetition terms, then hashed trigrams of characters.
_CLASSES = 16
_REPEATS = _CLASSES**3
_HASHED = 1 << 11
_TERMS = _REPEATS + 4 + _HASHED
_PRIME = np.uint32(2654435761)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_BLOCK = 256


def _class_table() -> np.ndarray:
    """A byte's class: 0 for other control bytes, 15 for bytes of letters beyond ASCII."""
    table = np.zeros(256, dtype=np.int64)
    for i, members in enumerate((b"\n\r", b" \t", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"|", b"*", b"#$%&", b"<>{}[]()", b"-_=+~^\\/", b":;'\"`@"), start=1):
        table[list(members)] = i
    table[128:] = 15
    return table


_CLASS = _class_table()


def terms(text: str | None) -> np.ndarray:
    """Square roots of the relative frequencies of a text's terms; all zero for an empty text."""
    out = np.zeros(_TERMS)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not raw.size:
        return out
    c = _CLASS[raw]
    c = np.concatenate(([1], c, [1]))
    grams = np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES**3)
    out[:_REPEATS] = np.sqrt(grams / grams.sum())
    low = _LOWER[np.concatenate(([32], raw, [32]))]
    hashed = ((low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * _PRIME) >> np.uint32(21)
    out[_REPEATS + 4 :] = np.sqrt(np.bincount(hashed, minlength=_HASHED) / hashed.size)
    words = text.split()
    for k in (1, 2, 3):
        if len(words) > k:
            out[_REPEATS + k - 1] = np.sqrt(sum(map(eq, words, words[k:])) / (len(words) - k))
    out[_REPEATS + 3] = np.sqrt(1 - len(set(words)) / len(words)) / 2 if words else 0.0
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # idf of each term
    basis: np.ndarray  # terms x dims
    vectors: np.ndarray  # labelled vectors, dims x n
    votes: np.ndarray  # n x 2: a vote's weight for either label
    neighbours: int
    power: float
    empty: float  # the score of a text without terms

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The score of each row of term weights."""
        latent = (rows * self.weights) @ self.basis
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        near = np.clip(np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 1e-12) @ self.vectors, 0, 1)
        k = min(self.neighbours, near.shape[1])
        if k == 0:
            return np.full(len(rows), 0.5)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.take_along_axis(near, top, axis=1) ** self.power
        votes = np.einsum("ij,ijk->ik", weight, self.votes[top])
        total = votes.sum(axis=1)
        return np.where(total > 1e-12, votes[:, 1] / np.where(total > 1e-12, total, 1), self.empty)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled(documents: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> pa.Table:
    """The bounded sample to learn from, one row a doc_id, in a fixed order: doc_id, quality, length in bytes, places and weights of its terms."""
    marks = pick(labels, doc_id="long", quality="int").filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(fold(F.col("doc_id")) != 0)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    order = (F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"))
    chosen = None
    for label in (0, 1):  # two bounded top-k selections: no window over a label's rows
        part = marks.filter(F.col("quality") == label).orderBy(*order).limit(max_per_label).select("doc_id", "quality")
        chosen = part if chosen is None else chosen.unionByName(part)
    docs = pick(documents, doc_id="long", text="string")
    # 2 x max_per_label ids of 12 bytes at most: bounded by the parameter.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    small_batches(documents.sparkSession)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the weights of a row's terms come back, not its text: 4 bytes a term, 25 KB at most
            texts = batch.column(2).to_pylist()
            found = [terms(t).astype(np.float16) for t in texts]
            places = [np.flatnonzero(x).astype(np.uint16) for x in found]
            yield pa.record_batch({
                "doc_id": batch.column(0), "quality": batch.column(1), "length": pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                "places": pa.array([p.tobytes() for p in places], pa.binary()), "weights": pa.array([x[p].tobytes() for x, p in zip(found, places, strict=True)], pa.binary()),
            })

    got = rows.mapInArrow(reduce, "doc_id long, quality int, length long, places binary, weights binary").toArrow()
    return got.sort_by("doc_id")


def train(documents: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL, dims: int = DIMS, neighbours: int = NEIGHBOURS, power: float = POWER) -> Model:
    sample = labelled(documents, labels, max_per_label)
    x = np.zeros((sample.num_rows, _TERMS), np.float32)
    for i, (places, weights) in enumerate(zip(sample.column("places"), sample.column("weights"), strict=True)):
        x[i, np.frombuffer(places.as_py(), np.uint16)] = np.frombuffer(weights.as_py(), np.float16)
    return fit(x, sample.column("quality").to_numpy().astype(np.int64), sample.column("length").to_numpy(), dims, neighbours, power)


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, dims: int = DIMS, neighbours: int = NEIGHBOURS, power: float = POWER) -> Model:
    """The model of term weights ``x``, labels ``y`` and the texts' lengths."""
    if len(set(y.tolist())) < 2:
        return Model(np.ones(_TERMS, np.float32), np.zeros((_TERMS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros((0, 2)), neighbours, power, 0.5)
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) / 2 + 1).astype(np.float32)
    weights[_REPEATS : _REPEATS + 4] = 2.0  # repetition occurs in every long text a little: its frequency tells, not its presence
    x *= weights
    # Right singular vectors by subspace iteration from a seeded start: nothing larger than the term matrix is made.
    wide = min(dims + EXTRA, *x.shape)
    basis = np.random.default_rng(SEED).standard_normal((x.shape[1], wide)).astype(np.float32)
    for _ in range(TURNS):
        basis = np.linalg.qr(x.T @ np.linalg.qr(x @ basis)[0])[0]
    _, values, turned = np.linalg.svd(x @ basis, full_matrices=False)
    right = (basis @ turned.T)[:, : int((values[:dims] > 1e-3).sum())]
    latent = x @ right
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    vectors = np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 1e-12)
    votes = np.zeros((len(y), 2))
    votes[np.arange(len(y)), y] = 1 / np.bincount(y, minlength=2)[y]
    near = votes[lengths <= np.sort(lengths)[min(neighbours, len(lengths)) - 1]].sum(axis=0)
    return Model(weights, np.ascontiguousarray(right), np.ascontiguousarray(vectors.T), votes, neighbours, power, float(near[1] / near.sum()))


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    parts = [model.score(np.stack([terms(t) for t in texts[i : i + _BLOCK]]).astype(np.float32)) for i in range(0, len(texts), _BLOCK)]
    return np.concatenate(parts) if parts else np.empty(0)


def classify(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(model.value, batch.column(2).to_pylist())
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= cut).astype(np.int32))})

    rows = pick(documents, doc_id="long", text="string").select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame, cut: float = CUT, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents that score ``cut`` or more, with all their columns, in one pass without a join."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents if learn_from is None else learn_from, labels))
    small_batches(documents.sparkSession)
    at = [c.lower() for c in documents.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(model.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array(scores >= cut))

    return documents.mapInArrow(run, documents.schema)
