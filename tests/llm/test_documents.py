"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import hashlib
import io
import random
import re
import struct
import textwrap
import time
import zlib
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankweave.llm import leaks, licenses, media, mixing, near_copies, quality, queries, simhash, tokens
from rankweave.runtime import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, fp string, `key` string, repeats int, target string, `draw` string, label string, media string"


def documents(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names operators use inside."""
    full = [(d, t, "en", s, len(t or ""), 1, "s", "f", "k", 7, "t", "d", "l", "m") for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None, None), (2, "", "a"), (3, " \t\n ", "a"), (None, "lost id here now", None), (5, "x" * 200_000, "b"), (6, "same words again and again", "b"), (7, "same words again and again", "b"), (7, "same words again and again", "b")]


# Mixing.


def fill(sizes, weights=(5, 2, 1), volume=1.5, cap=2.0):
    """Targets by the loop itself: share out by weight, clamp, share the excess out again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), volume * sum(sizes.values())
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] = unit * weight[s]
            return target
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_targets_and_takes(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice([None, "a", "b", "c", "ä", "Z", "big", "big", "big", "big"])) for i in range(900)]
    out = mixing.mix(documents(spark, rows)).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want, source_of = fill(sizes), {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_of_null_and_repeated_ids_meets_its_target(spark):
    rows = [(None if i % 2 else 7, f"{i} a b c d e f g h", "a") for i in range(300)] + [(i, f"w {i} " * 50, "b") for i in range(40)]
    out = mixing.mix(documents(spark, rows)).collect()
    for source, low in (("a", lambda r: r["size"] == 9), ("b", lambda r: r["size"] == 100)):
        own = [r for r in out if low(r)]
        assert abs(sum(r.taken for r in own) - own[0].target) <= own[0]["size"], source


def test_mix_odd_rows(spark):
    out = mixing.mix(documents(spark, ODD)).collect()
    assert len(out) == len(ODD) and {r.taken for r in out if r["size"] == 0} == {0}
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, "", "a"), (2, None, None)])).agg(F.sum("taken")).first()[0] == 0
    kept = mixing.apply_mix(documents(spark, ODD))
    assert kept.columns[:-1] == documents(spark, []).columns and kept.columns[-1] == "repeats_1"


def test_mix_uses_no_python(spark):
    plan = mixing.mix(documents(spark, ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Token counts.


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder_for(tokens.default_path())


def whole(encoder, text):
    return len(encoder.library.encode(text, add_special_tokens=False))


def test_tokens_match_library(spark, encoder):
    texts = [None, "", "a", "It's <|endoftext|> now <|endoftext|>", "naïve 漢字 🙂  \n\n end  ", "spaces" + " " * 500 + "x", "z" * 30_000, "word " * 30_000]
    out = {r.doc_id: r for r in tokens.count_tokens(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), chunk=5000).collect()}
    for i, t in enumerate(texts):
        n = whole(encoder, t or "")
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (n, len((t or "").encode()), n > 512)
    assert tokens.count_tokens(documents(spark, [])).count() == 0


def test_chunks_splice_exactly(encoder):
    rng = random.Random(5)
    pieces = ["the", " and", "\n\n", "   ", "<|endoftext|>", "don't", " 12345", "…", "é", "x" * 90, " ", "<|endof", "\t"]
    for _ in range(60):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(50, 900)))
        assert tokens.count_long(text, encoder, rng.choice([64, 200, 700]), rng.choice([4, 30])) == whole(encoder, text)


# Media.


def test_text_media_round_trip(spark):
    rows = [(i, t, "a") for i, t in enumerate([None, "", "abc", "é" * 64, "long " * 20_000, "abc"])]
    out = {r.doc_id: r for r in media.text_media(documents(spark, rows), keep=True).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert media.decode(bytes(r.media)).tobytes() == padded and len(r.media) == r.media_bytes
    assert out[2][1:] == out[5][1:]


def test_query_stores_media_and_tiles(spark, tmp_path):
    documents(spark, [(i, t, "a") for i, t in enumerate([None, "abc", "long " * 5000])]).write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared_dir(spark).removeprefix("file:")) / "rankweave"
    before = set(folder.glob("media*"))
    out = {r.doc_id: r for r in queries.op5_media_tiles(spark, str(tmp_path)).collect()}
    stored, tiles = (spark.read.parquet(str(p)) for p in sorted(set(folder.glob("media*")) - before, key=lambda p: p.name.startswith("media-tiles")))
    images = {r.doc_id: media.decode(bytes(r.media)) for r in stored.collect()}
    found = {r.doc_id: np.load(io.BytesIO(bytes(r.tile))) for r in tiles.collect()}
    assert set(images) == set(found) == set(out) == {0, 1, 2}
    for i, image in images.items():
        assert out[i].payload_sha256 == hashlib.sha256(image.tobytes()).hexdigest()
        assert found[i].dtype == np.uint8 and (found[i] == np.rint(media.area_resize(image, 32, 32))).all()


def test_decoders():
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(b"P6 7 5 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(("P3\n# c\n7 5\n255\n" + " ".join(map(str, rgb.ravel()))).encode()) == rgb).all()
    assert media.decode(b"P1\n3 2\n101\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P5 2 2 255\n\0", b"BM", b"P7", b"P5 0 1 255\n"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_odd_headers_and_samples():
    began = time.perf_counter()
    for bad in (b"P5" + b" " * 100_000, b"P5" + b"#c\n" * 50_000, b"P5 1 1" + b" \n" * 50_000, b"P5 " + b"9" * 100_000, b"P1 2 1 2 3", b"P1 2 1 0 x", b"P2 1 1 15 99", b"P2 1 1 15 -1", b"P2 1 1 255 1e2", b"P2 1 1 255 " + b"1" * 10_000, b"P5 999999999 999999999 255 x"):
        with pytest.raises(ValueError):
            media.decode(bad)
    assert time.perf_counter() - began < 2
    head = struct.pack("<IHHIIiiHHIIiiII", 70, 0, 0, 66, 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0)
    for masks in ((0xFF, 0xFF00, 0xFF0000), (0xFF0000, 0xFF00, 0xFF), (0xFF00, 0xFF0000, 0xFF000000)):
        pixel = sum(v << (m.bit_length() - 8) for v, m in zip((10, 20, 30), masks, strict=True))
        assert media.decode(b"BM" + head + struct.pack("<IIII", *masks, pixel)).tolist() == [[[10, 20, 30]]]
    with pytest.raises(ValueError):
        media.decode(b"BM" + head + struct.pack("<IIII", 0x1F, 0x7E0, 0xF800, 0))


def slow_hash(payload):
    """The difference hash of a payload as an image 64 wide: means over exact areas, pixel by pixel, in fractions."""
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    high, wide = Fraction(len(rows), 8), Fraction(64, 9)

    def share(i, low, size):
        return max(Fraction(0), min(Fraction(i + 1), low + size) - max(Fraction(i), low))

    bits = ""
    for y in range(8):
        sums = []
        for x in range(9):
            down = [(r, s) for r in range(len(rows)) if (s := share(r, y * high, high))]
            across = [(c, s) for c in range(64) if (s := share(c, x * wide, wide))]
            sums.append(sum(rows[r][c] * a * b for r, a in down for c, b in across))
        bits += "".join(str(int(b > a)) for a, b in zip(sums, sums[1:], strict=False))
    return f"{int(bits, 2):016x}"


def test_features_match_brute_force(spark):
    rng = random.Random(14)
    rows = [(i, "".join(chr(rng.randrange(32, 600)) for _ in range(rng.randrange(1500))), "a") for i in range(12)] + [(99, "", "a")]
    got = {r.doc_id: r.feature for r in media.text_media(documents(spark, rows)).collect()}
    for i, text, _ in rows:
        raw = text.encode()
        assert got[i] == slow_hash(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))
    assert media.text_media(documents(spark, [])).count() == 0


def test_area_resize_is_exact():
    image = np.random.default_rng(2).integers(0, 256, (13, 17)).astype(np.uint8)
    fine = np.kron(image, np.ones((8, 9)))  # 104 x 153: cells of 13 x 17 pixels each
    want = fine.reshape(8, 13, 9, 17).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), want)


def test_images_in_a_column(spark):
    frame = spark.createDataFrame([(1, b"P5 2 2 255\n\x00\x01\x02\x03", "x"), (2, b"nonsense", "y"), (3, None, "z")], "id long, media binary, hash string")
    out = {r.id: r for r in media.media_features(frame, "id", "media").collect()}
    assert (out[1].height, out[1].width) == (2, 2) and out[2].hash is None and out[3].tile is None


# Quality.


def test_quality_learns_and_is_deterministic(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    bad = (lambda: " ".join(word().upper() + "!!" for _ in range(60)), lambda: " ".join([word()] * 60), lambda: " | ".join(word() for _ in range(60)))
    rows = [(i, good() if i % 4 else bad[i % 3](), "a") for i in range(400)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 400 and 40 < len(held) < 120
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95
    assert sorted(out) == sorted(quality.classify(docs, labels).collect())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.predicted}


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (6, 0), (6, 1)], "doc_id long, quality int")
    out = quality.classify(documents(spark, ODD), labels).collect()
    assert len(out) == len(ODD) and all(r.score == 0.5 and r.predicted == 1 for r in out)
    assert quality.classify(documents(spark, []), labels.limit(0)).count() == 0


def slow_terms(text):
    """The terms of a text one by one: trigrams of classes, repetition, hashed trigrams."""
    raw = text.encode()
    out = np.zeros(quality._TERMS)
    kinds = [1, *[int(quality._CLASS[b]) for b in raw], 1]
    low = [32, *[b + 32 if 65 <= b <= 90 else b for b in raw], 32]
    for i in range(len(raw)):
        out[(kinds[i] * 16 + kinds[i + 1]) * 16 + kinds[i + 2]] += 1 / len(raw)
        out[4100 + ((low[i] * 65536 + low[i + 1] * 256 + low[i + 2]) * 2654435761 % 2**32 >> 21)] += 1 / len(raw)
    words = text.split()
    for k in (1, 2, 3):
        if len(words) > k:
            out[4096 + k - 1] = sum(a == b for a, b in zip(words, words[k:], strict=False)) / (len(words) - k)
    out = np.sqrt(out)
    out[4099] = np.sqrt(1 - len(set(words)) / len(words)) / 2 if words else 0
    return out


def test_votes_match_brute_force():
    rng = random.Random(31)
    texts = ["".join(rng.choice("abc DE!|.9\né") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert all(np.allclose(quality.terms(t), slow_terms(t)) for t in texts)
    y = np.array([rng.randrange(2) for _ in texts])
    model = quality.fit(np.stack([quality.terms(t) for t in texts]).astype(np.float32), y, np.array([len(t.encode()) for t in texts]), dims=8, neighbours=5)
    for text in ["".join(rng.choice("abc DE!|.9\né") for _ in range(40)) for _ in range(20)]:
        latent = (slow_terms(text) * model.weights) @ model.basis
        latent /= np.linalg.norm(latent)
        near = sorted(((float(np.clip(latent @ model.vectors[:, i], 0, 1)), i) for i in range(len(texts))), reverse=True)[:5]
        share = [(y == 0).sum(), (y == 1).sum()]
        votes = [sum(s**quality.POWER / share[k] for s, i in near if y[i] == k) for k in (0, 1)]
        assert quality.score_texts(model, [text])[0] == pytest.approx(votes[1] / sum(votes), abs=1e-3)
    shortest = sorted(range(len(texts)), key=lambda i: len(texts[i].encode()))
    last = len(texts[shortest[4]].encode())
    few = [i for i in shortest if len(texts[i].encode()) <= last]
    votes = [sum(1 / share[k] for i in few if y[i] == k) for k in (0, 1)]
    assert quality.score_texts(model, ["", None]).tolist() == [pytest.approx(votes[1] / sum(votes))] * 2


def test_sample_has_one_row_an_id(spark):
    rows = [(i % 40, f"text {i} of a few words", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    sample = quality.labelled(documents(spark, rows), labels, 10)
    ids = sample.column("doc_id").to_pylist()
    assert ids == sorted(set(ids)) and 0 < len(ids) <= 20
    assert sample.equals(quality.labelled(documents(spark, rows[::-1]), labels, 10))


# SimHash.


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(values, errors=4):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= errors:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", [None, "", "One", "a B c", "A b\tc\nd", "A b c d e f g\x0bh " * 40, "é ü\u00a0x y z É"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_trie_join_keeps_all_connections():
    rng = random.Random(9)
    for turn in range(30):
        centres = [rng.getrandbits(64) for _ in range(6)]
        values = {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1}
        for _ in range(300):
            v = rng.choice(centres)
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randrange(64 if turn % 2 else 12)
            values.add(v)
        ordered = np.array(sorted(values), dtype=np.uint64)
        links = simhash.trie_links(ordered)
        assert all((int(ordered[a]) ^ int(ordered[b])).bit_count() <= 4 for a, b in links)
        want = components(values)
        assert len(links) == len(values) - len(set(want.values()))


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(300)) for _ in range(30)]
    texts = base + [b + " tail" for b in base[:20]] + [b.replace("w1", "w1x", 1) for b in base[:20]] + base[:10] * 5 + [None, "", " \n"]
    rows = [(1000 - i, t, "a") for i, t in enumerate(texts)] + [(None, base[0], "a"), (1000, base[0], "a")]
    out = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [slow_fingerprint(t) for _, t, _ in rows]
    root = components(prints)
    first = {}
    for (d, _, _), p in zip(rows, prints, strict=True):
        if d is not None:
            first[root[p]] = min(first.get(root[p], d), d)
    want = sorted(((d, f"{p:016x}", first[root[p]]) for (d, _, _), p in zip(rows, prints, strict=True)), key=repr)
    assert sorted(map(tuple, out), key=repr) == want
    kept = simhash.keep_one(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values()))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("bucket", "crowd"), [(4000, 20_000), (0, 20_000), (4000, 30), (4000, 4)])
def test_links_with_wide_keys_and_crowds(spark, monkeypatch, bucket, crowd):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    assert [len(k) for k in simhash._keys(10, 4)][0] == (13 if bucket else 32)
    rng = random.Random(17)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 2**63}
    centre = rng.getrandbits(64)
    for _ in range(150):  # a crowd that shares bits
        v = centre
        for _ in range(rng.randint(0, 12)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in sorted(values)], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(nodes).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in found:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {v: root(v) for v in values} == components(values)


def test_one_stays_of_rows_that_share_an_id(spark):
    one, two = "a text about one thing and no other, told at some length", "words on quite another matter, which no one would call alike"
    rows = [(1, one, "a"), (1, two, "b"), (1, one, "c"), (2, two, "a"), (None, "lost and alone among the others here", "a"), (None, "lost and alone among the others here", "b"), (3, None, "a"), (4, "", "b")]
    for keep in (simhash.keep_one, near_copies.keep_one):
        kept = keep(documents(spark, rows))
        assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == sorted([(1, one), (1, two), (None, rows[4][1]), (3, "")], key=repr)
        assert kept.columns == documents(spark, []).columns
        again = keep(documents(spark, rows[::-1]))
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, again.collect()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 80)] + [(900, 901), (901, 900), (7, 7)]
    out = dict(simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {out[i] for i in range(1, 61)} == {0} and {out[500 + i] for i in range(1, 80)} == {500} and out[901] == 900


# Licenses.


def test_license_rules(spark):
    grant, keep, asis = (next(s for s, i in licenses.SENTENCES.items() if i == name) for name in ("mit-grant", "mit-keep", "mit-asis"))
    cases = [
        (None, "", ""), ("", "", ""), ("prose.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0", "apache-notice"), (f"MIT License\n\n{grant.upper()}:\n{keep}. Other words. {asis}.", "MIT", "mit-text"),
        (f"{asis}. {keep}. {grant}.", "", ""), ("Released under the MIT License. This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only,MIT", "gpl3-notice,mit-notice"),
        ("We saw that it was released under the MIT License yesterday.", "", ""), ("Licensed under CC BY-NC 4.0.\n" * 3, "CC-BY-NC-4.0", "ccbync-notice"), ("x " * 100_000 + "\nReleased under the MIT License.", "MIT", "mit-notice"),
    ]
    docs = documents(spark, [(i, t, "a") for i, (t, _, _) in enumerate(cases)])
    out = {r.doc_id: (r.licenses, r.rules) for r in licenses.scan(docs).collect()}
    assert out == {i: (lic, rule) for i, (_, lic, rule) in enumerate(cases)}
    assert not re.search("Python|Pandas|Arrow", licenses.scan(docs)._jdf.queryExecution().toString())
    assert licenses.scan(documents(spark, [])).count() == 0


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
""",
    "GPL-3.0-or-later": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
}


def test_wrapped_license_texts(spark):
    lines = "some words\nReleased under the MIT License\nother words on a line"
    cases = [*WRAPPED.items(), *[(k, v.replace("\n", "\r\n")) for k, v in WRAPPED.items()], ("MIT", lines)]
    out = {r.doc_id: (r.licenses, r.rules) for r in licenses.scan(documents(spark, [(i, t, "a") for i, (_, t) in enumerate(cases)])).collect()}
    rules = {"MIT": "mit-text", "Apache-2.0": "apache-header", "GPL-3.0-or-later": "gpl3-header", "BSD-2-Clause": "bsd2-text"}
    assert out == {i: (k, "mit-notice" if t == lines else rules[k]) for i, (k, t) in enumerate(cases)}


FULL = {
    "ISC": ("isc-text", "ISC License\n\nCopyright (c) 2020, Somebody\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."),
    "LGPL-2.1-or-later": ("lgpl2-1-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "AGPL-3.0-or-later": ("agpl3-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0-or-later": ("gpl2-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "MPL-2.0": ("mpl-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": ("unlicense-text", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "Zlib": ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    "BSD-3-Clause": ("bsd3-text", "Copyright 2020 Somebody\nAll rights reserved.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "MIT": ("mit-text", WRAPPED["MIT"].replace("MIT License\n\n", "").replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n").replace("Somebody\n\nPermission", "Somebody\nPermission")),
}


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for para in text.split("\n") for line in (textwrap.wrap(para, width) or [""]))


def test_license_texts_at_any_width(spark):
    """Originals, wrapped at several widths, plain and in comments: the same answer; and the SQL agrees."""
    cases = [(lic, rule, form) for lic, (rule, text) in FULL.items() for form in (text, wrapped(text, 60), wrapped(text, 79), wrapped(text, 70, "# "), wrapped(text, 66, " * "), wrapped(text, 72).replace("\n", "\r\n"), f"/*\n{wrapped(text, 75, ' * ')}\n */\nint main()\n")]
    cases += [(tag, f"spdx-{tag.lower().replace('.', '-')}", f"{head}SPDX-License-Identifier: {tag}{tail}\nmore words") for tag in licenses._TAGS for head, tail in (("", ""), ("// ", ""), ("/* ", " */"), ("x\n# Copyright 2020 Me\n# ", ""))]
    cases += [("Apache-2.0,MIT", "spdx-apache-2-0,spdx-mit", "# SPDX-License-Identifier: MIT OR Apache-2.0"), ("", "", "spdx-license-identifier: nothing"), ("GPL-3.0-only", "gpl3-text", "   GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\nCopyright"), ("Apache-2.0", "apache-text", "Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.")]
    out = {r.doc_id: (r.licenses, r.rules) for r in licenses.scan(documents(spark, [(i, t, "a") for i, (_, _, t) in enumerate(cases)])).collect()}
    assert {i: v for i, v in out.items() if v != cases[i][:2]} == {}
    base = duckdb.connect()
    every = [*[t for _, _, t in cases], *WRAPPED.values(), None, "", "a.b. C; d\n\n\ne"]
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(every)))
    want = sorted(base.execute(licenses.oracle()).fetchall())
    names = [d[0] for d in base.description]
    got = licenses.scan(documents(spark, [(i, t, "a") for i, t in enumerate(every)])).select(*names).collect()
    assert sorted(map(tuple, got)) == want


# Leaks.

ITEM = "Alice has 12 red apples and Bob has 7 green pears, so how many fruits do Alice and Bob hold in 3 baskets of 5 kg"
OTHER = "the quick brown fox jumps over the lazy dog while nine wise owls watch quietly from old trees"


def bench(spark, rows=((1, ITEM), (2, OTHER), (3, None), (4, "too short"), (2, OTHER))):
    return spark.createDataFrame([(i, t, "c") for i, t in rows], "item_id long, text string, coverage string")


def found(spark, texts, items=None):
    out = leaks.leaks(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench(spark) if items is None else items)
    return sorted((r.doc_id, r.item_id) for r in out.collect())


def test_leaks(spark):
    changed = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "31").replace("7", "8")
    mixed = ITEM.replace("Alice has", "Carol has")  # Alice is Carol here and Alice there
    texts = [None, "", f"Intro words. {ITEM}. More.", f"x {changed} y", OTHER.upper(), "before " + " ".join(OTHER.split()[2:16]) + " after", "unrelated words about nothing at all " * 50, "the quick brown fox is here", "1 2 3 4 5 6 7 8 9 10 11 12", f"{ITEM} {OTHER}", "pad " * 50_000 + OTHER]
    assert found(spark, texts) == [(2, 1), (3, 1), (4, 2), (5, 2), (9, 1), (9, 2), (10, 2)]
    flags = {r.doc_id: r.changed for r in leaks.leaks(documents(spark, [(0, ITEM, "a"), (1, changed, "a")]), bench(spark)).collect()}
    assert flags == {0: False, 1: True}
    assert leaks.leaks(documents(spark, [(0, mixed, "a")]), bench(spark, [(1, ITEM)])).first().coverage < 1
    kept = leaks.drop_leaked(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 6, 7, 8] and kept.columns == documents(spark, []).columns


def test_leaks_in_blocks_and_empty(spark):
    assert found(spark, [ITEM, OTHER], bench(spark, ())) == []
    docs = documents(spark, [(0, ITEM, "a"), (1, OTHER, "a")])
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs, bench(spark, ((1, ITEM), (2, OTHER))), common=0).collect()) == [(0, 1), (1, 2)]
    assert leaks.leaks(documents(spark, []), bench(spark)).count() == 0


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"t{c}" for c in "abcdefghijkl"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(12)]
    texts = []
    for _ in range(150):
        at, n = rng.randrange(20), rng.randint(3, 20)
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(30)] + rng.choice(items).split()[at : at + n] + [rng.choice(vocabulary) for _ in range(30)]))
    got = found(spark, texts, bench(spark, list(enumerate(items))))
    assert got
    for number, t in enumerate(texts):
        words, want = t.split(), set()
        for k, item in enumerate(items):
            own = item.split()
            for shift in range(-len(own), len(words)):
                same = [0 <= i + shift < len(words) and words[i + shift] == w for i, w in enumerate(own)]
                covered = [any(all(same[s : s + 8]) for s in range(max(0, i - 7), min(i, 12) + 1)) for i in range(20)]
                if sum(covered) >= 10:
                    want.add(k)
        assert {i for d, i in got if d == number} == want


SUMS = ("Compute 12 + 7 * 30 - 45 / 9 and 18 * 2 - 6", "Convert 5 km 300 m 20 cm 7 mm to 14 inches", "3 9 27 81 243 729 2187 6561", "If 4 of 9 boxes hold 7 kg and 5 of 9 hold 12 kg, how many kg are in all 9 boxes")


def test_number_heavy_items_match_brute_force(spark):
    rng = random.Random(11)
    items = bench(spark, list(enumerate(SUMS)))
    texts, want = [], []
    for number in range(120):
        k = rng.randrange(len(SUMS))
        own = leaks.tokens(SUMS[k])
        at, n = rng.randrange(len(own)), rng.randint(3, len(own))
        texts.append(" ".join([f"pad{rng.choice('abc')}" for _ in range(9)] + own[at : at + n] + ["end", "of", "text"]))
        covered = [any(at <= s and s + 8 <= min(at + n, len(own)) for s in range(max(0, i - 7), i + 1)) for i in range(len(own))]
        want.append((k, sum(covered) * 2 >= len(own) or sum(covered) >= 13))
    got = set(found(spark, texts, items))
    assert all(((number, k) in got) == leaks_in for number, (k, leaks_in) in enumerate(want))
    assert found(spark, [f"x {item} y" for item in SUMS], items) == [(k, k) for k in range(len(SUMS))]
    assert found(spark, ["1 2 3 4 5 6 7 8 9 10 11 12 and 5 6 7 8"], items) == []
    (row,) = leaks.leaks(documents(spark, [(0, SUMS[3].replace("9", "8").replace("12", "31"), "a")]), items).collect()
    assert (row.item_id, row.changed) == (3, True)


def templated(rng):
    """A question with slots, its text for given slot values, and the number of different slots."""
    words = [f"{rng.choice('abcdef')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(14)]
    slots = rng.sample(range(14), 4)
    return lambda values: " ".join(values[slots.index(i) % len(values)] if i in slots else w for i, w in enumerate(words))


def test_slots_match_brute_force(spark):
    """Items whose slots are changed: found if and only if one assignment of values explains them."""
    rng = random.Random(21)
    makers = [templated(rng) for _ in range(15)]
    items = [m(["12", "Anna", "7", "Bert"]) for m in makers]
    texts, want = [], []
    for k, m in enumerate(makers):
        for values in (["31", "Cara", "8", "Dave"], ["12", "Anna", "7", "Bert"], ["12", "Bert", "7", "Anna"], ["5", "Eva", "6", "Finn"]):
            want.append((len(texts), k, values != ["12", "Anna", "7", "Bert"]))
            texts.append(f"before it {m(values)} after it")
        for values in (["8", "Cara", "8", "Dave"], ["31", "Cara", "9", "Cara"]):  # two slots, one value: not the same question throughout
            texts.append(f"before it {m(values)} after it")
    out = leaks.leaks(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench(spark, list(enumerate(items)))).collect()
    got = {(r.doc_id, r.item_id): r for r in out}
    for d, k, changed in want:
        assert got[d, k].coverage == 1 and got[d, k].changed == changed
    clashing = set(range(len(texts))) - {d for d, _, _ in want}
    assert all(r.coverage < 1 for r in out if r.doc_id in clashing)
    assert all(r.item_id == r.doc_id // 6 for r in out)


def test_short_items_and_unspaced_scripts(spark):
    han = "\u6211\u4eec\u5728\u82b1\u56ed\u91cc\u770b\u5230\u4e00\u53ea\u5f88\u5927\u7684\u767d\u8272\u732b\u5750\u5728\u6811\u4e0b\u7761\u89c9"
    items = bench(spark, [(1, "Paris"), (2, "New York"), (3, "?!"), (4, han), (5, ""), (None, "one two three four five")])
    texts = ["paris", "Paris is a city", "new york", "York new", f"\u4ed6\u8bf4{han}\u3002", "\u6211\u4eec\u5728\u5bb6", "?!", "so one two three four five it is"]
    assert sorted(((r.doc_id, r.item_id) for r in leaks.leaks(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), items).collect()), key=repr) == [(0, 1), (2, 2), (4, 4), (7, None)]
    lost = spark.createDataFrame([(None, "so one two three four five it is", "x"), (None, "clean", "y")], "doc_id long, text string, key string")
    assert [r.text for r in leaks.drop_leaked(lost, items).collect()] == ["clean"] and leaks.drop_leaked(lost, items).columns == lost.columns


def test_common_phrases_join_nothing_but_leaks(spark):
    stock = "choose the one correct answer from the list of options below"
    rng = random.Random(5)
    items = [f"{stock} " + " ".join(f"v{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{n}x" for n in "qwertyuiopas") for _ in range(30)]
    benchmark = bench(spark, [*enumerate(items), (99, stock)])
    sought = leaks.item_windows(leaks._items(benchmark), common=5)
    assert sought.filter("item_id < 99 AND place < 4").count() == 0 and sought.filter("item_id = 99").count() > 0
    texts = [f"well {stock} and so on", items[3], f"{stock} then {items[7][len(stock) :]}"]
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in leaks.leaks(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), benchmark, common=5).collect())
    every = sorted((r.doc_id, r.item_id, r.coverage) for r in leaks.leaks(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), benchmark).collect())
    assert got == every and [g[:2] for g in got] == [(0, 99), (1, 3), (1, 99), (2, 7), (2, 99)]


def test_items_of_one_pattern_are_judged_once(spark):
    """5,000 items of one pattern and 1,000 texts: no row for every pair, and each text still names what it holds."""
    name = lambda n: "".join("ABCDEFGHIJ"[int(c)] if i == 0 else "abcdefghij"[int(c)] for i, c in enumerate(f"{n:04}"))
    question = "what is the capital of the old province {} and which long river runs through it today"
    items = [(n, question.format(name(n))) for n in range(5000)]
    texts = [f"so {question.format(name(n) if n % 2 else 'Zzz' + name(n).lower())} then" for n in range(1000)]
    docs, benchmark = documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench(spark, items)
    kinds, _ = leaks._sought(leaks._items(benchmark))
    assert kinds.count() == 1 and leaks.item_windows(kinds).count() < 40
    assert leaks._met(leaks._keyed(docs), leaks.item_windows(kinds)).count() == 1000
    got = {(r.doc_id, r.item_id, r.changed, r.n_items) for r in leaks.leaks(docs, benchmark).collect()}
    assert got == {(n, n if n % 2 else 0, n % 2 == 0, 5000) for n in range(1000)}
    assert {tuple(r) for r in leaks.classes(benchmark).collect()} == {(n, 0) for n in range(5000)}


def test_names_of_any_number_of_words_match_brute_force(spark):
    """Every occurrence of a name becomes one of one to three words, in words before and after it; found, whole, if one assignment explains all."""
    rng = random.Random(31)
    names = ["Paris", "New York", "Rio de Janeiro".title(), "Oslo", "San Marino City", "Los Angeles"]
    word = lambda: f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}"
    items, texts, want = [], [], []
    for k in range(20):
        body = [word() for _ in range(24)]
        for at, slot in zip(sorted(rng.sample(range(2, 22, 3), 4)), "XYXZ", strict=True):
            body[at] = slot
        fill = lambda x, y, z, again=None: " ".join({"X": x if i < body[::-1].index("Z") or again is None else again, "Y": y, "Z": z}.get(w, w) for i, w in enumerate(body))  # noqa: E731, B023
        items.append((k, fill("Anna", "Bert", "Carl")))
        for _ in range(4):
            x, y, z = rng.sample(names, 3)
            want.append((len(texts), k, 1.0))
            texts.append(f"before this {fill(x, y, z)} after that")
    out = {(r.doc_id, r.item_id): r for r in leaks.leaks(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench(spark, items)).collect()}
    assert set(out) == {(d, k) for d, k, _ in want} and all(out[d, k].coverage == c and out[d, k].changed for d, k, c in want)
    (item,) = [[(0, "the town of Anna lies north of Bert while the road to Anna passes the mill and the hill")]]
    same = "the town of New York lies north of Oslo while the road to New York passes the mill and the hill"
    other = same.replace("road to New York", "road to San Marino")
    rows = {r.doc_id: r.coverage for r in leaks.leaks(documents(spark, [(0, same, "a"), (1, other, "a")]), bench(spark, item)).collect()}
    assert rows[0] == 1 and rows.get(1, 0) < 1


def test_number_words_are_numbers(spark):
    item = "if sixty boxes hold twenty one red balls each then how many balls do all sixty boxes hold"
    texts = [item.replace("sixty", "60"), item.replace("sixty", "forty five").replace("twenty one", "300"), item.replace("twenty one", "21"), item.replace("all sixty", "all 60"), item.replace("all sixty", "all 61")]
    out = {r.doc_id: (r.coverage == 1, r.changed) for r in leaks.leaks(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench(spark, [(1, item)])).collect()}
    assert {d: out[d] for d in range(4)} == {0: (True, False), 1: (True, True), 2: (True, False), 3: (True, False)} and not out.get(4, (False,))[0]
