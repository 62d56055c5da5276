"""Near copies: SimHash trie links, made whole by an exact search at Jaccard similarity 0.8 of five-word shingles.

A text with A-Z lower-cased is the set of its 5-word shingles (XXH64, seed 42). Two texts link where their sets'
Jaccard similarity is 0.8 or more; a component is what links reach. ``simhash.links`` finds candidates by the trie
self-join over fingerprints of the sets, but many pairs of this similarity differ in more bits than a budget that
blocks can carry, so a prefix-filter search finds the rest, and every candidate's sets are compared in full.

Plan. (1) Texts of equal sets are one node. (2) Under any one order of shingles, linked sets of n shingles share
one among their first n - ceil(0.8 n) + 1. The order is by hash, shingles that many texts have last, so common
lines seldom bring unlike texts together; they are counted in a pass over all texts. Nodes that share a prefix
shingle are a group; the group of a shingle that more than ``BLOCK`` texts have is dealt out as pairs of its
chunks, so no task gets more than two chunks of one: frequent shingles as they are counted, any other one whose group is
over three times that large, by the nodes of one in ``COUNTED`` (an estimate that decides how work is dealt, and no result). (3) A node carries parity bits, 512 in the search and two a shingle after
it, each that of the shingles hashed to it. Sets that differ in d shingles differ in d parity bits at most, and 0.8 allows (n1 + n2) / 9:
pairs beyond that budget are dropped, which loses none. (4) First each node of a group goes with the nearest
earlier one alone, at most one pair a row, and these and the trie's links are compared: dense groups become
components. (5) Then pairs in different components that the budget allows are compared. Unlike variants of one text share
most of their prefixes, so a group leaves a pair to an earlier one where it can tell that both are there: rows carry
the ``PRIOR`` group keys before theirs. The first group of a pair can't, so none is lost. (6) Components by
``simhash.connected``.

Nothing that grows with the corpus comes to the driver but shingles that a share ``OFTEN`` of texts have: by
counting at most the mean number of shingles over ``OFTEN``. Joins are broadcast only if a checked count is small.
Defined cases: a text of fewer than 5 words has one shingle, all its words; null and empty texts are one node
that links with nothing else; a null doc_id is the last of its component; repeated rows, and rows that share a
doc_id but not a text, are documents each; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm import simhash
from rankweave.llm.simhash import _LOWER, SEED, connected, keep_first, keyed
from rankweave.runtime import materialize, small_batches

SHINGLE = 5
#: Shingles that this share of texts have come last in the order.
OFTEN = 3e-4
#: Nodes of one chunk of a group.
BLOCK = 4096
#: A node in so many counts for the size of groups; nodes are digests.
COUNTED = 64
#: Nodes or shingles whose ids are broadcast at most.
BROADCAST = 200_000
#: Keys of a node's earlier groups that its row in a group carries.
PRIOR = 4
_WORDS = 8  # of 64 parity bits
_BITS = tuple(f"b{i}" for i in range(_WORDS))
_BEFORE = tuple(f"p{i}" for i in range(PRIOR))
_PAIRS = 1 << 18
_LOW = np.uint64(1 << 63)


def shingles(text: str | None) -> np.ndarray:
    """The text's distinct shingle hashes, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    at = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(at + 1) - 1
    starts = ends - at
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), dtype=np.uint64))


def node_of(found: np.ndarray) -> int:
    """A set's digest, as a signed long; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64)) if found.size else 0


def parity(found: np.ndarray) -> np.ndarray:
    """512 bits or the next power of 2 from two a shingle: how often, odd or even, the set's shingles fall on each.

    Halves put together by exclusive or are the bits of half the size.
    """
    size = max(64 * _WORDS, 1 << int(2 * found.size - 1).bit_length())
    at = (found >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).view(np.int64)


def prefix(found: np.ndarray, often: np.ndarray, counts: np.ndarray | None = None, node: int = 0) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of the set by (often, hash); a crowded shingle as one key for each pair of its chunks."""
    n = found.size
    most = n - -(-4 * n // 5) + 1
    if not often.size:
        return found[:most]
    at = np.minimum(np.searchsorted(often, found), often.size - 1)
    late = often[at] == found
    head = np.concatenate([found[~late], found[late]])[:most]
    first_late = int((~late).sum())
    if counts is None or first_late >= head.size or not (crowd := counts[np.searchsorted(often, head[first_late:])] > BLOCK).any():
        return head
    keys = [head[:first_late], head[first_late:][~crowd]]
    for s in head[first_late:][crowd].tolist():
        n_chunks = -(-int(counts[np.searchsorted(often, np.uint64(s))]) // BLOCK)
        own = node % n_chunks
        keys.append(np.array([xxhash.xxh64_intdigest(f"{s}:{min(own, o)}:{max(own, o)}", SEED) for o in range(n_chunks)], np.uint64))
    return np.concatenate(keys)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(counts), minlength=found.size).astype(np.int64)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the lower half of hashes (a prefix seldom reaches further) that a share ``OFTEN`` of texts have, and how many.

    Each task reports those that it meets in two texts and in that share of its own; a shingle rarer than that in a task isn't
    counted there, which makes groups larger and results no different.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, held, size, texts = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0, 0

        def merge(least: float) -> tuple[np.ndarray, np.ndarray]:
            every, n = _merged([known, *held], [times, *[np.ones(h.size, np.int64) for h in held]])
            return every[n >= least], n[n >= least]

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = shingles(text)
                held.append(found := found[: np.searchsorted(found, _LOW)])
                size += found.size
                texts += 1
            if size > 1 << 21:
                known, times = merge(texts * OFTEN / 2)
                held, size = [], 0
        known, times = merge(max(2, texts * OFTEN))
        yield pa.record_batch({"s": pa.array(known.view(np.int64)), "n": pa.array(times)})

    least = max(3, docs.count() * OFTEN)
    counted = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    got = counted.toArrow()
    often, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(often)
    return often[order], n[order]


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's hash), node and, where a task sees the node for the first time, its size, fingerprint, parity bits, 512 of them, and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))
    new = ("n", "fp", *_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, facts, heads, bits = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                nodes.append(node := node_of(found))
                if node in seen:
                    facts.append((None,) * len(new))
                    heads.append(None)
                    bits.append(None)
                    continue
                seen.add(node)
                bits.append(parity(found))
                facts.append((found.size, simhash.signed(simhash.majority(found)), *np.bitwise_xor.reduce(bits[-1].reshape(-1, _WORDS)).tolist()))
                heads.append(prefix(found, *sent.value, node).view(np.int64) if found.size else None)
            columns = {name: pa.array(c, pa.int64()) for name, c in zip(new, zip(*facts, strict=True), strict=True)} if facts else {name: pa.array([], pa.int64()) for name in new}
            yield pa.record_batch({"doc_id": batch.column(0), "key": batch.column(1), "node": pa.array(nodes, pa.int64())} | columns | {"bits": pa.array(bits, pa.list_(pa.int64())), "head": pa.array(heads, pa.list_(pa.int64()))})

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, node long, " + ", ".join(f"{c} long" for c in new) + ", bits array<long>, head array<long>")


def _dealt(rows: DataFrame) -> DataFrame:
    """(s, node) with the groups of crowded shingles dealt out: a node goes under the pairs of its chunk with every chunk."""
    sample = rows.filter(F.pmod("node", F.lit(COUNTED)) == 0).groupBy("s").agg((F.count("*") * COUNTED).alias("size"))
    chunks = F.ceil(F.col("size") * 1.25 / BLOCK).cast("int")
    crowded = materialize(sample.filter(F.col("size") > 3 * BLOCK).select("s", chunks.alias("chunks")), "crowded")
    n = crowded.count()
    if not n:
        return rows
    placed = rows.join(F.broadcast(crowded) if n <= BROADCAST else crowded, "s", "left")
    own, other = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), F.col("other")
    each = placed.select("s", "node", "chunks", F.when(F.col("chunks").isNotNull(), own).alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))).alias("other"))
    return each.select(F.when(F.col("chunks").isNull(), F.col("s")).otherwise(F.xxhash64("s", F.least("own", other), F.greatest("own", other))).alias("s"), "node")


def _grouped(rows: DataFrame, each, schema: str, *order: str) -> DataFrame:
    """``each`` over whole runs of equal ``s``: arrays of all columns of one or more groups, sorted."""
    dealt = rows.repartition("s").sortWithinPartitions("s", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            changes = np.flatnonzero(part[0][1:] != part[0][:-1]) + 1
            first = 0 if held and held[-1][0][-1] == part[0][0] else None
            if first == 0 and not changes.size:
                held.append(part)
                continue
            cut = int(changes[-1]) if changes.size else 0
            held.append([c[:cut] for c in part])
            yield from each([np.concatenate(c) for c in zip(*held, strict=True)])
            held = [[c[cut:].copy() for c in part]]
        if held:
            yield from each([np.concatenate(c) for c in zip(*held, strict=True)])

    return dealt.mapInArrow(run, schema)


def _shared(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of groups of two nodes or more; a node that several tasks saw counts once."""
    s, node = columns
    if not s.size:
        return
    once = np.concatenate(([True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])))
    s, node = s[once], node[once]
    same = s[1:] == s[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    if keep.any():
        yield pa.record_batch({"s": pa.array(s[keep]), "node": pa.array(node[keep])})


def _allowed(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing parity bits) of pairs i < j of one group whose sizes and parity bits allow the similarity and whose roots differ.

    Rows are sorted by group, then size; step after step each row meets the one ``step`` behind it, so the work is the pairs alone.
    """
    s, n, _, root, *bits = columns[: 4 + _WORDS]
    bits = np.ascontiguousarray(np.stack(bits, axis=1).view(np.uint64))
    left, step = np.arange(s.size), 0
    while left.size:
        step += 1
        left = left[left + step < s.size]
        left = left[(s[left] == s[left + step]) & (5 * n[left] >= 4 * n[left + step])]
        for i in np.array_split(left, -(-left.size // _PAIRS) or 1):
            i = i[root[i] != root[i + step]]
            d = np.bitwise_count(bits[i] ^ bits[i + step]).sum(axis=1, dtype=np.int64)
            near = 9 * d <= n[i] + n[i + step]
            if near.any():
                yield i[near], i[near] + step, d[near]


def _pairs(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(np.minimum(node[i], node[j])), "b": pa.array(np.maximum(node[i], node[j]))})


def _nearest(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each row with the nearest earlier one of its group by parity bits, where one is allowed."""
    none = np.iinfo(np.int64).max
    best = np.full(columns[0].size, none)
    for i, j, d in _allowed(columns):
        best[j] = np.minimum(best[j], d << 40 | i)
    j = np.flatnonzero(best != none)
    if j.size:
        yield _pairs(columns[2], best[j] & (1 << 40) - 1, j)


def _crossing(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Allowed pairs of a group whose roots differ, but those of which an earlier group is known to hold both."""
    s, before = columns[0], columns[4 + _WORDS :]
    out, held = [], 0
    for i, j, _ in _allowed(columns):
        told = np.zeros(i.size, bool)
        for p in before:
            for q in before:
                told |= (p[i] == q[j]) & (p[i] != s[i])  # a row without so many earlier ones has its own key there
        i, j = i[~told], j[~told]
        if not i.size:
            continue
        out.append((i, j))
        held += i.size
        if held >= _PAIRS:
            yield _pairs(columns[2], *map(np.concatenate, zip(*out, strict=True)))
            out, held = [], 0
    if out:
        yield _pairs(columns[2], *map(np.concatenate, zip(*out, strict=True)))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that all their parity bits allow, written."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    half = lambda c, k: F.zip_with(F.slice(c, F.lit(1), k), F.slice(c, k + 1, k), lambda p, q: p.bitwiseXOR(q))
    to_size_of = lambda c, other: F.when(F.size(c) > F.size(other), half(c, F.size(other))).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(to_size_of("x", "y"), to_size_of("y", "x"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)
    sizes = 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")  # so the bits of one are at most twice those of the other
    likely = pairs.join(one, "a").join(two, "b").filter(sizes).filter(9 * differ <= F.col("na") + F.col("nb"))
    return materialize(likely.select("a", "b"), "likely")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity, written."""
    spark = docs.sparkSession
    pairs = _likely(pairs, nodes)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(wanted.join(nodes.select("node", F.col("first.doc_id").alias("of_id"), F.col("first.key").alias("of_key")), "node"), "wanted")
    few = wanted.count() <= BROADCAST
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            kept: dict[int, np.ndarray] = {}
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node not in seen and node_of(found := shingles(text)) == node:  # texts of one hash may differ
                    kept[node] = found.view(np.int64)
                    seen.add(node)
            yield pa.record_batch({"node": pa.array(list(kept), pa.int64()), "held": pa.array(list(kept.values()), pa.list_(pa.int64()))})

    texts = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(wanted["of_id"]) & (docs["key"] == wanted["of_key"])).select("node", "text")
    sets = materialize(texts.mapInArrow(run, "node long, held array<long>"), "sets")
    one, two = sets.select(F.col("node").alias("a"), F.col("held").alias("x")), sets.select(F.col("node").alias("b"), F.col("held").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    close = pairs.select("a", "b").join(one, "a").join(two, "b").filter(9 * both >= 4 * (F.size("x") + F.size("y")))
    return materialize(close.select("a", "b").distinct(), "links")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes from the trie self-join of their fingerprints: the links' first nodes, and nodes of one fingerprint with its first."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "fingerprints")
    small_batches(nodes.sparkSession, 65536)
    met = simhash.links(first.select("fp"))
    one, two = first.select(F.col("fp").alias("a"), F.col("lead").alias("x")), first.select(F.col("fp").alias("b"), F.col("lead").alias("y"))
    twins = nodes.join(first, "fp").filter("node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    every = met.join(one, "a").join(two, "b").select("x", "y").unionByName(twins)
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _named(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, key, node and root: nodes of one component share a root."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = materialize(_marked(docs), "shingles")
    nodes = materialize(marked.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("first"), *[F.min(c).alias(c) for c in ("n", "fp", "bits", *_BITS)]), "nodes")
    rows = marked.filter("head IS NOT NULL").select(F.explode("head").alias("s"), "node")
    small_batches(spark, 65536)
    shared = _grouped(_dealt(rows), _shared, "s long, node long", "node")
    earlier = Window.partitionBy("node").orderBy("s")
    shared = shared.withColumns({c: F.coalesce(F.lag("s", k + 1).over(earlier), "s") for k, c in enumerate(_BEFORE)})
    placed = materialize(shared.join(nodes.select("node", "n", *_BITS), "node"), "shared")
    wide = lambda root: (F.col("s"), F.col("n"), F.col("node"), root.alias("root"), *map(F.col, _BITS))
    pair, order = "a long, b long", ("n", "node")
    nearest = _grouped(placed.select(*wide(F.col("node"))), _nearest, pair, *order)
    dense = _links(materialize(nearest.unionByName(_fingerprint_pairs(nodes)).distinct(), "nearest"), docs, nodes)
    roots = materialize(connected(dense), "dense")
    small_batches(spark, 65536)
    crossing = _grouped(placed.join(roots, "node", "left").select(*wide(F.coalesce("root", "node")), *_BEFORE), _crossing, pair, *order)
    links = _links(materialize(crossing.distinct(), "pairs"), docs, nodes).unionByName(dense)
    joined = materialize(connected(links), "roots")
    return marked.select("doc_id", "key", "node").join(joined, "node", "left").select("doc_id", "key", "node", F.coalesce("root", "node").alias("root"))


def components(documents: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable, null if all are null) of every row."""
    named = materialize(_named(keyed(documents)), "components")
    return named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents less near copies, all columns: of each component the row that ``simhash.keep_first`` takes."""
    return keep_first(documents, _named(keyed(documents)))
