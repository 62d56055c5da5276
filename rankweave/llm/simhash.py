"""SimHash near-duplicates by a self-join of binary tries.

Fingerprint: the text with A-Z lower-cased, its words, all 4-word shingles with repeats, each hashed by
XXH64 (seed 42); a bit is 1 if it is set in over half of them. Two fingerprints link at 4 or fewer differing
bits; a component is what links reach.

Plan. (1) Fingerprints of all documents, one pass, written narrow. (2) Equal fingerprints become one node
with its smallest doc_id: thousands of exact copies are one row from here on. (3) 64 bits are cut into blocks
so that any two linked nodes agree on a whole key of blocks: 5 blocks, one equal; 6 blocks, two equal, and so on
where a key's values would get more than ``BUCKET`` nodes on average. Where single values have more than ``CROWD``
(texts of one boilerplate), their nodes' other bits are cut into 5 blocks in turn, so no task holds a crowd. (4) Nodes that share a key meet in one task, where their sorted
fingerprints are a binary trie (a prefix is a range). The trie is joined with itself: pairs of trie nodes go
down together, collect differing bits and are dropped beyond 4. Pairs of subtrees that are wholly in one
component already are dropped as well, and only links that join two components are emitted: at most one a
fingerprint and key, so a dense group of m near copies gives m - 1 links, not their square, and no
connection is lost. (5) Components over the links by alternating stars, each round a written table.

No fingerprints or links come to the driver. Defined cases: null and empty texts have fingerprint zero and
link like any other; texts of fewer than 4 words have one shingle, all their words; a null doc_id belongs to
its text's component but never names it (a component of null ids alone has a null component_id); repeated
rows give a row each; an empty table an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.columns import fresh, pick
from rankweave.runtime import materialize, small_batches

SHINGLE = 4
SEED = 42
ERRORS = 4
#: Nodes of a key's value on average, beyond which keys are wider, and of a single one, beyond which it is cut again.
BUCKET = 4_000
CROWD = 20_000
#: Crowded buckets that are broadcast at most, and how often a bucket is cut again.
FEW = 200_000
DEPTH = 3
#: Pairs of trie nodes that one step holds at most, and pairs of leaves compared at once.
_FRONTIER = 1 << 18
_LEAF = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    # bytes.split() cuts at space, \t, \n, \r, \f and \v: 0x20 and 0x09-0x0D.
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    at = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(at + 1) - 1
    starts = ends - at
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, -(-hashes.size // 65536) or 1):
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > hashes.size).tobytes(), "big")


def signed(bits: int) -> int:
    """64 bits as Spark's long."""
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, key (the text's hash), fp (the fingerprint's bits as a long) of every row."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "key": batch.column(2), "fp": pa.array(found.view(np.int64))})

    return keyed(documents).mapInArrow(run, "doc_id long, key long, fp long")


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.ascontiguousarray(a ^ b)
    return _POP[both.view(np.uint16)].reshape(-1, 4).sum(axis=1, dtype=np.int64)


class _Forest:
    """Union-find over positions; label[i] is the smallest position of i's component."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((i, j))

    def labels(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.parent))), dtype=np.int64, count=len(self.parent))


def trie_links(values: np.ndarray, errors: int = ERRORS) -> list[tuple[int, int]]:
    """Links (positions in ``values``, sorted distinct uint64) that span every component of the relation."""
    n = values.size
    forest = _Forest(n)
    if n < 2:
        return []
    # A frontier is (low a, high a, low b, high b, differing bits) of pairs of subtrees at one bit.
    start = np.array([[0, n, 0, n, 0]], dtype=np.int64)
    stack: list[tuple[int, np.ndarray]] = [(63, start)]
    labels, joined = np.arange(n), 0
    while stack:
        bit, pairs = stack.pop()
        if len(forest.links) != joined:
            labels, joined = forest.labels(), len(forest.links)
        pairs = pairs[~_same(labels, pairs)]
        if not len(pairs):
            continue
        if len(pairs) > _FRONTIER:
            for part in np.array_split(pairs, -(-len(pairs) // _FRONTIER)):
                stack.append((bit, part))
            continue
        sizes_a, sizes_b = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        leaf = (sizes_a * sizes_b <= _LEAF) if bit >= 0 else np.ones(len(pairs), dtype=bool)
        if leaf.any():
            _leaves(values, pairs[leaf], errors, forest)
            pairs = pairs[~leaf]
        if not len(pairs):
            continue
        mid_a, mid_b = _middle(values, pairs[:, 0], pairs[:, 1], bit), _middle(values, pairs[:, 2], pairs[:, 3], bit)
        twin = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
        a0, a1, b0, b1, d = pairs.T
        children = [np.stack(x, axis=1) for x in ((a0, mid_a, b0, mid_b, d), (mid_a, a1, mid_b, b1, d), (a0, mid_a, mid_b, b1, d + 1))]
        children.append(np.stack((mid_a, a1, b0, mid_b, d + 1), axis=1)[~twin])
        below = np.concatenate(children)
        keep = (below[:, 1] > below[:, 0]) & (below[:, 3] > below[:, 2]) & (below[:, 4] <= errors)
        stack.append((bit - 1, below[keep]))
    return forest.links


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the range's values, equal above ``bit``, turn from 0 to 1 in it."""
    first = (values[low] >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)
    return np.clip(np.searchsorted(values, first), low, high)


def _same(labels: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Pairs of subtrees that are in one component already, single values paired with themselves included."""
    ends = lambda lo, hi: (np.minimum.reduceat(padded, np.stack([lo, hi], 1).ravel())[::2], np.maximum.reduceat(padded, np.stack([lo, hi], 1).ravel())[::2])
    padded = np.append(labels, labels[-1])
    low_a, high_a = ends(pairs[:, 0], pairs[:, 1])
    low_b, high_b = ends(pairs[:, 2], pairs[:, 3])
    return (low_a == high_a) & (low_b == high_b) & (low_a == low_b)


def _leaves(values: np.ndarray, pairs: np.ndarray, errors: int, forest: _Forest) -> None:
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    which = np.repeat(np.arange(len(pairs)), sizes)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = (pairs[:, 3] - pairs[:, 2])[which]
    a, b = pairs[which, 0] + within // wide, pairs[which, 2] + within % wide
    linked = (a != b) & (_differ(values[a], values[b]) <= errors)
    forest.join(a[linked], b[linked])


Block = tuple[int, ...]  # bit positions


def _cut(bits: Block, pieces: int) -> list[Block]:
    edges = [round(i * len(bits) / pieces) for i in range(pieces + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _keys(count: int, errors: int) -> list[Block]:
    """Bits that make a key. Any two fingerprints that link agree on one of them."""
    equal = 1
    while count > BUCKET << (64 * equal // (errors + equal)) and equal < 4:
        equal += 1
    return [sum(c, ()) for c in combinations(_cut(tuple(range(64)), errors + equal), equal)]


def _value(key: Block) -> Column:
    """The bits of fp at the key's positions, as one number."""
    out, at, i = F.lit(0).cast("long"), 0, 0
    while i < len(key):
        n = 1
        while i + n < len(key) and key[i + n] == key[i] + n:
            n += 1
        piece = F.shiftrightunsigned("fp", key[i]).bitwiseAND(F.lit((1 << n) - 1)) if n < 64 else F.col("fp")
        out, at, i = out.bitwiseOR(F.shiftleft(piece, at)), at + n, i + n
    return out


def _bucketed(nodes: DataFrame, errors: int) -> DataFrame:
    """(bucket, fp): nodes by the values of keys on which linked ones agree; crowded values by further bits."""
    paths = [(key,) for key in _keys(nodes.count(), errors)]
    rows = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("path"), F.xxhash64(F.lit(i), _value(p[0])).alias("bucket")) for i, p in enumerate(paths)])).alias("k")).select("k.path", "k.bucket", "fp")
    done = None
    for _ in range(DEPTH):
        crowds = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("bucket")
        crowds = materialize(crowds, "crowds")
        n = crowds.count()
        if not n:
            break
        crowds = F.broadcast(crowds) if n <= FEW else crowds
        quiet = rows.join(crowds, "bucket", "left_anti").select("bucket", "fp")
        done = quiet if done is None else done.unionByName(quiet)
        further, names = [], []
        for i, path in enumerate(paths):
            left = tuple(b for b in range(64) if not any(b in key for key in path))
            blocks = _cut(left, errors + 1)
            names.append(F.when(F.col("path") == i, F.array(*[F.struct(F.lit(len(further) + j).alias("path"), F.xxhash64("bucket", F.lit(j), _value(block)).alias("bucket")) for j, block in enumerate(blocks)])))
            further += [(*path, block) for block in blocks]
        rows = rows.join(crowds, "bucket", "left_semi").select("fp", F.explode(F.coalesce(*names)).alias("k")).select("k.path", "k.bucket", "fp")
        rows, paths = materialize(rows, "crowded"), further
    last = rows.select("bucket", "fp")
    return last if done is None else done.unionByName(last)


def links(nodes: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(a, b): links between different fingerprints of ``nodes`` (a column fp) that span every component."""
    met = _bucketed(nodes, errors).repartition("bucket").sortWithinPartitions("bucket", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []

        def done() -> pa.RecordBatch | None:
            values = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
            found = trie_links(values, errors) if values.size > 1 else []
            if not found:
                return None
            at = np.array(found)
            return pa.record_batch({"a": pa.array(values[at[:, 0]].view(np.int64)), "b": pa.array(values[at[:, 1]].view(np.int64))})

        for batch in batches:
            names, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                if names[low] != bucket:
                    if out := done():
                        yield out
                    bucket, parts = names[low], []
                parts.append(fps[low:high].copy())
        if out := done():
            yield out

    return met.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): its component's smallest node, by alternating stars."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    before = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: greater neighbours move to the smallest neighbour.
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "stars")
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = materialize(small.filter("a <> b").distinct(), "stars")
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def _rooted(documents: DataFrame, errors: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key and fp of every row; fp, its smallest doc_id and root, the component's smallest fingerprint, of every fingerprint)."""
    marked = materialize(fingerprints(documents), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    small_batches(documents.sparkSession, 65536)
    joined = connected(links(nodes, errors))
    rooted = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return marked, materialize(rooted, "roots")


def near_duplicates(documents: DataFrame, errors: int = ERRORS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row."""
    marked, rooted = _rooted(documents, errors)
    names = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    named = materialize(rooted.join(names, "root").select("fp", "component_id"), "components")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and key (the text's hash) of every row: the first and last tell rows apart."""
    return pick(documents, doc_id="long", text="string").withColumn("key", F.xxhash64("text"))


def keep_first(documents: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of the rows of each component, told by rooted (doc_id, key, root), the one with the smallest doc_id, null last, then text hash; all columns.

    Rows that share both are told apart by the hash of all their columns; the first of them stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key")).alias("first")
    lost, id_, key, turn = (fresh(documents, f"kept_{name}") for name in ("lost", "id", "key", "turn"))
    told = lambda doc_id, text_key: {lost: doc_id.isNull(), id_: F.coalesce(doc_id.cast("long"), F.lit(0)), key: text_key}
    kept = rooted.groupBy("root").agg(first).select("first.doc_id", "first.key")
    kept = materialize(kept.select(*[c.alias(n) for n, c in told(F.col("doc_id"), F.col("key")).items()]), "kept")
    marked = documents.withColumns(told(F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))))
    hashable = [F.col(f"`{c}`") for c, kind in documents.dtypes if not kind.startswith(("map", "variant"))]
    once = Window.partitionBy(lost, id_, key).orderBy(F.xxhash64(*hashable))  # by the join's keys: no shuffle of its own
    stays = marked.join(kept, [lost, id_, key], "left_semi").withColumn(turn, F.row_number().over(once)).filter(F.col(turn) == 1)
    return stays.select(*[F.col(f"`{c}`") for c in documents.columns])


def keep_one(documents: DataFrame, errors: int = ERRORS) -> DataFrame:
    """The documents less near-duplicates, all columns: of each component the row that ``keep_first`` takes."""
    marked, rooted = _rooted(documents, errors)
    return keep_first(documents, marked.join(rooted, "fp").select("doc_id", "key", "root"))
