"""The pipeline's near copies against brute force: five-word shingles, Jaccard similarity 0.8."""

import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from rankweave.llm import near_copies

SF = "/root/testdata/sf0.01"


def shingled(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def smallest(rows):
    """The smallest doc_id of each component, by all pairs."""
    sets = {}
    for d, t in rows:
        key = frozenset(shingled(t))
        sets[key] = min(sets.get(key, d), d)
    nodes = list(sets)
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, where = 0, {}
    for i, a in enumerate(nodes):
        for j in {j for s in a for j in where.get(s, ())}:
            if 9 * len(a & nodes[j]) >= 4 * (len(a) + len(nodes[j])):
                links += 1
                parent[find(i)] = find(j)
        for s in a:
            where.setdefault(s, []).append(i)
    best = {}
    for i, k in enumerate(nodes):
        best[find(i)] = min(best.get(find(i), sets[k]), sets[k])
    return sorted(best.values()), links


def edited(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("often", "block"), [(1e-9, 8), (near_copies.OFTEN, near_copies.BLOCK), (0.02, 5)])
def test_keeps_one_of_each(spark, monkeypatch, often, block):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base = [text(rng.choice([12, 60, 150])) for _ in range(25)]
    line = "this very line stands in every one of these texts and says nothing at all"
    base[0] = text(150)
    texts = base + [edited(rng, b, rng.randint(1, 4)) for b in base for _ in range(4)] + [edited(rng, base[0], 2) for _ in range(60)]
    texts += [f"{text(40)} {line}" for _ in range(60)] + base[:5] + ["", None, "a b", "A  b", "a b c d e", "a b c d e f", "x y z u v w q r s t", "x y z u v w q r s"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    want, links = smallest(rows)
    kept = near_copies.keep_one(spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string"))
    assert links > 60 and sorted(r.doc_id for r in kept.collect()) == want  # the row without an id is a copy
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_of_a_crowded_group_meet():
    found = np.arange(1, 11, dtype=np.uint64) * np.uint64(10**18)
    often, counts = found[:2], np.array([3 * near_copies.BLOCK - 1, 5])
    heads = [set(near_copies.prefix(found[:2], often, counts, node).tolist()) for node in range(9)]
    assert all(a & b for a in heads for b in heads) and all(len(h) == 3 for h in heads)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64))
        b = np.union1d(a[rng.random(a.size) < 0.8], rng.integers(0, 1 << 63, 20).astype(np.uint64))
        bits = [near_copies.parity(x).view(np.uint64) for x in (a, b)]
        size = min(x.size for x in bits)
        one, two = (np.bitwise_xor.reduce(x.reshape(-1, size)) for x in bits)
        assert np.bitwise_count(one ^ two).sum() <= np.setxor1d(a, b).size


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")
def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, links = smallest([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert links and sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).select("doc_id").collect()) == want


def test_every_crowded_group_is_dealt_out(spark, monkeypatch):
    """One shingle that 20,000 nodes share, rare by its share of texts: no group over two chunks is left, all pairs still meet, other groups stay as they are."""
    monkeypatch.setattr(near_copies, "BLOCK", 1000)
    nodes = [int(x) for x in np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)]
    rows = spark.createDataFrame([(5, n) for n in nodes] + [(6, n) for n in nodes[:900]] + [(i + 100, nodes[i]) for i in range(50)], "s long, node long")
    dealt = near_copies._dealt(rows)
    found = {}
    for r in dealt.collect():
        found.setdefault(r.s, set()).add(r.node)
    assert found.pop(6) == set(nodes[:900]) and all(found.pop(i + 100) == {nodes[i]} for i in range(50))
    assert 5 not in found and max(map(len, found.values())) < 2400
    held = {}
    for s, group in found.items():
        for n in group:
            held.setdefault(n, set()).add(s)
    rng = random.Random(2)
    assert all(held[a] & held[b] for a, b in (rng.sample(nodes, 2) for _ in range(3000)))
    assert near_copies._dealt(rows.filter("s <> 5")).count() == 950


@pytest.mark.parametrize("often", [0.9, 1e-9])
def test_dealt_groups_lose_no_link(spark, monkeypatch, often):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    monkeypatch.setattr(near_copies, "BLOCK", 6)
    monkeypatch.setattr(near_copies, "COUNTED", 1)
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(6)]
    line = "all of these texts share one and the same rather long line of words"
    rows = list(enumerate([f"{edited(rng, b, rng.randint(0, 4))} {line}" for b in base for _ in range(20)]))
    want, links = smallest(rows)
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert links > 30 and sorted(r.doc_id for r in kept.collect()) == want


def test_a_pair_is_made_about_once(spark, monkeypatch):
    """Variants of one text that are no near copies share most of their prefixes: their pairs come from the first group, not from each."""
    raw, whole = [], near_copies._grouped

    def counted(rows, each, schema, *order):
        out = whole(rows, each, schema, *order)
        if each is near_copies._crossing:
            out = near_copies.materialize(out, "counted")
            raw.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(near_copies, "_grouped", counted)
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(90000)}" for _ in range(1500))
    rows = list(enumerate([edited(rng, base, 36) for _ in range(40)]))
    want, links = smallest(rows)
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == want and len(want) > 30
    ((made, different),) = raw
    assert different > 500 and made < 2 * different
