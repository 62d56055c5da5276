"""The rule ledger, spelling variants and vector codes against slow versions, on odd and on random rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankweave.llm import rule_ledger as rules
from rankweave.llm import spelling, vector_codes

# --- rule ledger


def test_measurements_by_hand():
    text = "• a #b c\na b c d...\n\t\n• a #b c\nx y 12"
    got = dict(zip(rules.MEASURES, rules.measure(text), strict=True))
    # Words: • a #b c a b c d... • a #b c x-y 12; the windows "• a #b" and "a #b c" stand twice.
    assert got == {
        "n_words": 14, "word_chars": 22, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 8, "n_lines": 4, "n_bullets": 2, "n_ellipses": 1, "n_letter_words": 11, "line_chars": 32, "dup_line_chars": 8,
    }
    assert rules.measure("") == (0,) * len(rules.MEASURES)


@pytest.mark.parametrize("seed", range(20))
def test_repeated_words(seed):
    draw = random.Random(seed)
    words = [draw.choice("abcd") for _ in range(draw.randrange(60))]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    slow = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    assert rules.measure(" ".join(words))[4] == len(slow)


def test_judge_takes_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None, 5), (2, "", 5), (None, good, 5), (3, good, 5), (3, good, 5), (4, "x" * 300_000, 5), (5, " ".join(["same old words"] * 40), 5), (6, good + "\n" + "# " * 60, 5), (7, good + " 　é ", 5)]
    found = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, failed int")).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and sum(r.doc_id == 3 for r in found) == 2
    assert [by[i].kept for i in (1, 2, None, 3, 4, 5, 6, 7)] == [False, False, True, True, False, False, False, True]
    assert by[1].sole_rule == by[2].sole_rule == "few_words" and by[1].n_sole == 2 and by[6].sole_rule is None
    assert (by[4].n_words, by[4].word_chars, by[4].base_failed) == (1, 300_000, True) and by[7].n_words == 81
    assert rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_policies_and_ablation_read_bits_only(spark):
    draw = random.Random(3)
    sets = [draw.randrange(1 << 4) for _ in range(400)]
    known = tuple(rules.Rule(n, "n_words", 1, "<", 1) for n in "abcd")
    policies = {"one": ("a", "b"), "two": ("b", "c", "d")}
    entries = spark.createDataFrame(list(enumerate(sets)), "doc_id long, failed long")
    kept = {r.doc_id: (r.kept_by, r.sole_rule) for r in rules.apply(entries, policies, known).collect()}
    for i, bits in enumerate(sets):
        names = {n for j, n in enumerate("abcd") if bits >> j & 1}
        against = names & set(policies["two"])
        assert kept[i] == ([v for v, p in policies.items() if not names & set(p)], against.pop() if len(against) == 1 else None)
    found = {(r.policy, r.rule): tuple(r)[2:] for r in rules.ablate(entries, policies, known).collect()}
    assert set(found) == {(v, n) for v, p in policies.items() for n in p}
    for (version, rule), counts in found.items():
        each = [({n for j, n in enumerate("abcd") if b >> j & 1}, set(policies[version])) for b in sets]
        assert counts == (
            400,
            sum(rule in names for names, _ in each),
            sum(names & asked == {rule} for names, asked in each),
            sum(not names & asked for names, asked in each),
            sum(not names & (asked - {rule}) for names, asked in each),
        )
    assert rules.ablate(entries.limit(0), policies, known).count() == 0
    with pytest.raises(ValueError, match="no rule named"):
        rules.mask(("a", "z"), known)


# --- spelling variants


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) - len(short) == 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


@pytest.fixture(scope="module")
def vocabulary():
    draw = random.Random(7)
    return sorted({"".join(draw.choice("abé") for _ in range(draw.choice((7, 7, 8, 9)))) for _ in range(700)})


def test_the_automaton_numbers_its_words(vocabulary):
    automaton = spelling.Automaton(vocabulary)
    assert len(automaton) == len(vocabulary)
    assert [automaton.number(w) for w in vocabulary] == list(range(len(vocabulary)))
    assert automaton.number("aaaaaaaaaaaa") == automaton.number("") == -1
    trie = {w[:i] for w in vocabulary for i in range(len(w) + 1)}
    # Minimal: as many states as there are different sets of endings.
    endings = {frozenset(w[len(p) :] for w in vocabulary if w.startswith(p)) for p in trie}
    assert len(automaton.edges) == len(endings) < len(trie)
    for w in vocabulary[::7]:
        assert {vocabulary[i] for i in automaton.one_error(w, 0, len(w))} == {v for v in vocabulary if one_apart(w, v)}


@pytest.mark.parametrize("crowded", [10**6, 40, 3])
def test_near_words_whatever_is_crowded(spark, vocabulary, crowded):
    draw = random.Random(crowded)
    counts = {w: draw.randrange(2, 60) for w in vocabulary} | {"x" * 5000: 9, "x" * 4999: 3}
    found = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), block=50, crowded=crowded)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in found.collect()}
    want = {}
    for w in counts:
        if near := [v for v in counts if one_apart(w, v)]:
            best = min(near, key=lambda v: (-counts[v], v))
            want[w] = (len(near), counts[best], best)
    assert got == want


def test_crowded_parts_end_at_one_code_point():
    for length in range(7, 40):
        paths = [""]
        while paths:
            path = paths.pop()
            front, back = spelling.cut(length, path)
            if length - front - back > 1:
                for turn in "01":
                    assert sum(spelling.cut(length, path + turn)) > front + back
                    paths.append(path + turn)
                # One of the two keeps what stands outside an error at any place between the exact parts.
                assert spelling.cut(length, path + "0")[0] == length - spelling.cut(length, path + "1")[1]


def slow_variants(rows):
    counts: Counter[str] = Counter()
    for doc_id, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch <= "Z" else ch
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    counts = Counter({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    near = defaultdict(list)
    for w in counts:
        near[w] = [v for v in counts if one_apart(w, v)]
    form = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if counts[f] >= 10 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def test_variants_of_texts(spark):
    draw = random.Random(11)
    stems = ["Strasse", "straßen", "étranger", "Variation", "ÀÉÎÕÜÿ×÷", "separate", "separat"]
    rows = [(i, " ".join(draw.choice(stems) for _ in range(200)) + draw.choice(("", " 12,seperate", "\nseparatee"))) for i in range(60)]
    chain = " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200 + ["abcdefghij"] * 2000 + ["abcdefghijk"] * 20000)
    rows += [(None, None), (None, "separate separate"), (61, ""), (62, chain), (62, chain), (63, "y" * 50_000), (64, "y" * 50_000), (64, "Ÿstrasse 1strasse2")]
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n int, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(docs).collect()}
    want = slow_variants(rows)
    assert got == want and any(f for f, *_ in want.values())
    assert len({f[1] for w, f in want.items() if w.startswith("abcdefg")}) < len([w for w in want if w.startswith("abcdefg")])
    assert spelling.group_variants(docs.limit(0)).count() == 0


# --- vector codes


def slow_codes(rows):
    def part(v, p):
        return v[p * len(v) // 4 : (p + 1) * len(v) // 4]

    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]

    def nearest(v, book):
        return min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v, book[e], strict=True)), e))

    for turn in range(5):
        codes = [[nearest(part(v, p), books[p]) for p in range(4)] for _, v, _ in kept]
        if turn < 4:
            for p in range(4):
                for e in range(len(books[p])):
                    mine = [part(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                    if mine:
                        books[p][e] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    errors = [sum(sum((a - b) ** 2 for a, b in zip(part(v, p), books[p][c[p]], strict=True)) for p in range(4)) for (_, v, _), c in zip(kept, codes, strict=True)]
    by = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return Counter((i, bytes(c).hex(), e, by[label], sha) for (i, _, label), c, e in zip(kept, codes, errors, strict=True))


@pytest.mark.parametrize("spread", [0.02, 0.9, 3000.0])
def test_codes_by_brute_force(spark, spread):
    draw = random.Random(int(spread * 100))
    # Coarse values make ties and equal entries; some vectors stand many times.
    vectors = [[round(draw.uniform(-spread, spread), 2 if spread < 1 else 0) for _ in range(8)] for _ in range(330)]
    rows = [(draw.randrange(400), draw.choice(vectors), draw.choice((None, 1, 2))) for _ in range(420)]
    rows += [(None, vectors[0], 2), (-5, vectors[1], None), (-5, vectors[1], None)]
    odd = [(1, None, 1), (2, [0.1] * 7 + [None], 1), (3, [0.1] * 7 + [float("nan")], 1), (4, [float("-inf")] + [0.0] * 7, 1), (5, [], 1), (6, [0.5] * 9, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, code string, error int")
    found = vector_codes.compress(frame).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == slow_codes(rows)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>, label string"
    one = vector_codes.compress(spark.createDataFrame([(9, [0.25, -0.5, 1.0], "a")], schema)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(9, "00000000", 0, 0)]
    far = vector_codes.compress(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], None), (2, [-1e30, 0.0, 0.0, 0.0], None)], schema)).collect()
    assert sorted((r.code, r.error) for r in far) == [("00000000", 0), ("01000000", 0)]
    for rows in ([], [(1, None, "a"), (2, [], None)]):
        assert vector_codes.compress(spark.createDataFrame(rows, schema)).count() == 0


def test_bounds_save_work_and_keep_ties():
    draw = np.random.default_rng(5)
    centres = draw.integers(-900, 900, (12, 6))
    x = centres[draw.integers(0, 12, 600)] + draw.integers(-40, 40, (600, 6))
    entries = x[None, :12].copy()
    codes, upper, lower = np.zeros(600, np.int64), np.full(600, np.inf), np.zeros(600)
    books, scans = vector_codes.Books.of(entries), []
    for _ in range(6):
        scans.append(vector_codes.assign(x, books, 0, codes, upper, lower))
        exact = ((x[:, None] - books.entries[0]) ** 2).sum(2)
        assert (codes == exact.argmin(1)).all()
        assert (upper**2 >= exact[np.arange(600), codes]).all()
        exact[np.arange(600), codes] = 1 << 40
        assert (lower**2 <= exact.min(1)).all()
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)
        np.add.at(sums[0], codes, x)
        np.add.at(counts[0], codes, 1)
        books = vector_codes.Books.of(vector_codes._next(books.entries, sums, counts), books.entries)
    assert scans[0] > 590 and scans[-1] < 200


def test_label_errors_past_the_broadcast(spark):
    rows = [(i, f"{i % 256:02x}000000", i, None if i % 3 == 0 else i % 5) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, code string, error long, label int")
    few, many = (vector_codes.with_label_errors(frame, n).collect() for n in (100, 0))
    totals = Counter()
    for _, _, e, label in rows:
        totals[label] += e
    assert sorted(r.vec_id for r in many) == list(range(300))
    assert all(r.label_error == totals[r.label] for r in [*few, *many])
