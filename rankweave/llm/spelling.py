"""Spelling variants: words at one error from another, each led to its most frequent neighbour and on to a root.

A word at one error from another keeps one half of it: where the error lies in the second half, the first half stands
unchanged at the front; else the second half stands at the end. So words meet by exact halves: a word is put under
the halves that words of its length, one less and one more would have. A task takes the words that met, builds their
minimal acyclic automaton, of the words as they are for front halves and of the reversed words for back halves, and
walks every asking word's half exactly, then the rest with one error. Automata number their words without gaps
(a perfect hash), so frequencies and spellings are looked up by number. A pair that both directions find counts
with the first.

Halves that more than ``CROWDED`` words share are cut again: the part that may hold the error is halved, and words meet by
the front or the back of it as well. That ends, without a cap, where one code point is left between the exact parts.

Defined cases: null texts have no words; a null doc_id is an empty string in the checksum; repeated rows count each; runs of
any length are words; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.columns import pick
from rankweave.runtime import materialize, small_batches

#: Code points a word has at least, occurrences, one misspelt run in so many, times a form is as frequent.
SHORTEST, OFTEN, MISSPELT, STRONGER = 7, 2, 31, 10
#: Words of one automaton at most, and words sharing their exact parts from which these are cut again.
BLOCK = 40_000
CROWDED = 40_000
#: Different words that a task counts before it hands on what it has.
HELD = 400_000
#: Crowded keys up to which the list is broadcast; each is a few dozen bytes.
BROADCAST = 50_000
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
_OFFER = "path string, length int, head string, tail string, word string, n long"


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, every 31st by checksum misspelt by a lost code point, of 7 code points and 2 occurrences."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall((text or "").encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % MISSPELT == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < SHORTEST:
                            continue
                    found[word] += n
                if len(found) > HELD:
                    yield from _batches(found)
                    found.clear()
        yield from _batches(found)

    parts = pick(docs, doc_id="string", text="string").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _batches(found: Counter[str]) -> Iterator[pa.RecordBatch]:
    words, counts = list(found), list(found.values())
    for i in range(0, len(words), 20_000):
        yield pa.record_batch({"word": pa.array(words[i : i + 20_000], pa.string()), "n": pa.array(counts[i : i + 20_000], pa.int64())})


@lru_cache(100_000)
def cut(length: int, path: str) -> tuple[int, int]:
    """Code points at the front and at the back of a word of this length that are matched exactly; path says, step by step,
    whether the front (0) or the back (1) of what was left joins the exact part."""
    front = back = 0
    for turn in path:
        left = length - front - back
        if turn == "0":
            front += left // 2
        else:
            back += left - left // 2
    return front, back


class Automaton:
    """The minimal acyclic automaton of sorted, different words. ``edges[state][letter]`` is (next state, words that come before)."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        # States along the last word that may still grow: finals, and letters with the states they lead to.
        ends, letters = [False], [[]]
        last = ""

        def close(depth: int) -> None:
            while len(letters) - 1 > depth:
                state = self._state(known, ends.pop(), tuple(letters.pop()))
                letters[-1].append((last[len(letters) - 1], state))

        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            close(same)
            last = word
            for _ in range(len(word) - same):
                ends.append(False)
                letters.append([])
            ends[-1] = True
        close(0)
        self.start = self._state(known, ends[0], tuple(letters[0]))

    def _state(self, known: dict[tuple, int], end: bool, children: tuple[tuple[str, int], ...]) -> int:
        state = known.get((end, children))
        if state is None:
            state = known[end, children] = len(self.edges)
            before, out = int(end), {}
            for letter, child in children:
                out[letter] = (child, before)
                before += self._size[child]
            self.edges.append(out)
            self.final.append(end)
            self._size.append(before)
        return state

    def __len__(self) -> int:
        return self._size[self.start]

    def number(self, word: str, state: int | None = None, before: int = 0) -> int:
        """How many words come before this one, or -1 where it isn't one; from a state on."""
        state, edges = self.start if state is None else state, self.edges
        for letter in word:
            step = edges[state].get(letter)
            if step is None:
                return -1
            state, before = step[0], before + step[1]
        return before if self.final[state] else -1

    def one_error(self, word: str, exact: int, stop: int) -> set[int]:
        """Numbers of words that differ from this one by one inserted, deleted or replaced code point at or after ``exact``,
        before or at ``stop``; what lies outside is matched as it is."""
        found, edges, state, before = set(), self.edges, self.start, 0
        for letter in word[:exact]:
            step = edges[state].get(letter)
            if step is None:
                return found
            state, before = step[0], before + step[1]
        for at in range(exact, stop + 1):
            letter, after, rest = word[at : at + 1], word[at + 1 :], word[at:]
            inside = at < stop
            if inside:  # deleted
                found.add(self.number(after, state, before))
            for other, (child, skipped) in edges[state].items():
                if other != letter or not inside:  # an inserted letter that equals the next one is found behind it
                    if inside and after[:1] in edges[child] or inside and not after:
                        found.add(self.number(after, child, before + skipped))
                    if rest[:1] in edges[child] or not rest:
                        found.add(self.number(rest, child, before + skipped))
            step = edges[state].get(letter)
            if step is None or not inside:
                break
            state, before = step[0], before + step[1]
        found.discard(-1)
        return found


def _offers(word: str, path: str, lengths: Iterator[int]) -> Iterator[tuple[str, int, str, str]]:
    """What a word is put under, for each length that an asking word can have."""
    for length in lengths:
        for turn in "01":
            front, back = cut(length, path + turn)
            yield path + turn, length, word[:front], word[len(word) - back :]


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (*offer, word, n)
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True)
            for offer in _offers(word, "", range(max(SHORTEST, len(word) - 1), len(word) + 2))
        ]
        yield _rows(rows)


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("path", "length", "word", "n")]
        yield _rows([(*offer, word, n) for path, length, word, n in zip(*columns, strict=True) for offer in _offers(word, path, (length,))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "length", "head", "tail", "word", "n"])


def _twice(path: str, asking: str, other: str) -> bool:
    """Whether a pair that meets on this path also meets where a turn goes to the front instead."""
    for i, turn in enumerate(path):
        if turn == "1" and other.startswith(asking[: cut(len(asking), path[:i] + "0")[0]]):
            return True
    return False


def _answers(rows: list[tuple]) -> Iterator[tuple[str, int, int | None, str | None]]:
    """(word, near words, the best one's n, the best one) of every asking row; rows (path, length, head, tail, word, n) in order, all of one direction."""
    backward = rows[0][0][0] == "1"
    counts = {r[4]: r[5] for r in rows}
    keyed = sorted((w[::-1], w) for w in counts) if backward else sorted((w, w) for w in counts)
    automaton = Automaton([k for k, _ in keyed])
    words = [w for _, w in keyed]
    for path, length, head, tail, word, _ in rows:
        if len(word) != length:
            continue
        if backward:
            numbers = automaton.one_error(word[::-1], len(tail), length - len(head))
        else:
            numbers = automaton.one_error(word, len(head), length - len(tail))
        near = [words[i] for i in numbers]
        if "1" in path:
            near = [w for w in near if not _twice(path, word, w)]
        if near:
            best = min(near, key=lambda w: (-counts[w], w))
            yield word, len(near), counts[best], best


def _search(block: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*_answers(rows), strict=True))
            if columns:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "near", "best_n", "best"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("path", "length", "head", "tail", "word", "n")), strict=True):
                # An automaton ends between keys; both directions never share one.
                if rows and row[:4] != rows[-1][:4] and (len(rows) >= block or row[0][0] != rows[-1][0][0]):
                    yield from out()
                    rows.clear()
                rows.append(row)
        if rows:
            yield from out()

    return search


def near_words(words: DataFrame, block: int = BLOCK, crowded: int = CROWDED) -> DataFrame:
    """(word, n_near, best_n, best) of words that have near ones; best is the most frequent, then the first in code-point order."""
    small_batches(words.sparkSession)
    key = ["path", "length", "head", "tail"]
    offers, ready = materialize(words.mapInArrow(_first, _OFFER), "spelling-offers"), []
    # More than one code point is left between the exact parts: these can be cut again.
    open_ = F.col("length") - F.length("head") - F.length("tail") > 1
    while True:
        full = materialize(offers.groupBy(*key).agg(F.count("*").alias("rows")).where((F.col("rows") > crowded) & open_).drop("rows"), "spelling-crowded")
        if not (n := full.count()):
            break
        full = F.broadcast(full) if n <= BROADCAST else full
        ready.append(offers.join(full, key, "left_anti"))
        offers = materialize(offers.join(full, key, "left_semi").select(*offers.columns).mapInArrow(_deeper, _OFFER), "spelling-offers")
    for part in ready:
        offers = offers.unionByName(part)
    dealt = offers.repartition(*key).sortWithinPartitions("path", "head", "tail", "length", "word")
    found = dealt.mapInArrow(_search(block), "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("at")).select("word", "n_near", (-F.col("at.n")).alias("best_n"), F.col("at.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last. Each form is over ten times as frequent, so chains are short;
    every round doubles how far each word has been led."""
    led = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = led.select(F.col("word").alias("from"), F.col("root").alias("to"))
        step = led.join(on, led["root"] == on["from"], "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved"))
        step = materialize(step, "spelling-roots")
        led = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return led


def group_variants(docs: DataFrame) -> DataFrame:
    """Every word with its form, root, frequency, number of near words and the form's frequency."""
    words = materialize(count_words(docs), "spelling-words")
    near = near_words(words)
    strong = F.col("best_n") >= F.lit(STRONGER) * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")
    )
    found = materialize(found, "spelling-forms")
    led = roots(found.where("form is not null"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
