"""Benchmark decontamination by template canonicalisation.

Texts become tokens; two templates are read from them. In the plain one numbers, in digits or words, are
``<number>``, words that name units ``<unit>``, and all other words themselves in lower case. In the named one
capitalised words are ``<name>`` as well, and a run of names, or of number words, is one token, so that a name may
have any number of words. Scripts without spaces give a token a character. Windows of 8 template tokens (all of a
shorter item, of 3 at least) are hashed. Windows of fewer than half plain words say nothing in the named template
and are left out of it; those of fewer than a quarter have placeholders in the plain one for too much, and are
looked up as they stand instead, numbers and units included (the literal template). Where windows match, item
and document are laid side by side on that diagonal (position in the document less position in the item; in the
named template positions of its tokens, which stand for one or several diagonals of words), and the
slots of all windows that match there are compared: an item's number, name or unit must stand for one value of
the document wherever it occurs, and different values for different ones ("sixty" is 60). Windows that break that
are dropped. What is left leaks if it covers half of the item, or 13 tokens in a row.

Plan. (1) Items that no text can tell apart but by the values of their slots are one class ("What is the capital of
X?"): the same named template, names of as many words, equal slots in the same places. A class is looked for and
judged once, by its smallest item; items with windows that only the plain or the literal template takes share a
class only with items equal there too. The classes' windows are a written table. A window that more than ``COMMON``
classes have is no help in finding one: unless such windows could make a leak of an item by themselves, it is looked
for by its others alone, so a stock phrase doesn't join every text that has it with every item that has it. (2)
Documents' windows that a Bloom filter of the classes' windows takes are joined to those by hash: (document, class,
diagonal). The filter has ``FILTER_BITS`` bits at most, whatever the benchmark's length: a longer one only lets more
windows into the join, which decides. (3) The texts of what met are sent once, with their classes, and compared in full.

Defined cases: null and empty texts leak nothing and are never leaked; items of one or two tokens leak into
texts that have just these; items without a token are left out; a null doc_id or item_id is carried as it is;
rows that share doc_id and text are one document; a repeated item is one item, equal items of several ids are a
class; no benchmark, no leaks; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.columns import fresh, pick
from rankweave.runtime import materialize, small_batches

WINDOW = 8
LEAST = 3
COVER = 0.5
RUN = 13
#: Items that share a window beyond which it is no help in finding them.
COMMON = 50
FILTER_BITS = 1 << 28
#: Documents whose ids are broadcast at most.
BROADCAST = 200_000
_PROBES = 3
_WORD = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*")
_ASCII = re.compile(r"[A-Za-z]+|[0-9]+(?:[.,:/][0-9]+)*")  # the same in an ASCII text
#: Scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han).
_UNSPACED = re.compile("[ก-໿က-႟ក-៿ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_EITHER = re.compile(rf"{_UNSPACED.pattern}|(?:(?!{_UNSPACED.pattern})[^\W\d_])+|\d+(?:[.,:/]\d+)*")
#: Names of units.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l dl liter liters litre litres gallon gallons pint pints s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent kmh mph hz khz mhz ghz kb mb gb tb bit bits byte bytes w kw v volt volts watt watts degree degrees celsius fahrenheit kelvin joule joules newton newtons".split()
)
#: Number words and what they count.
NUMBERS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBERS |= {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
NUMBERS |= {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
_LITERAL, _PLAIN, _NAMED, _JOINS = range(4)  # the last: which words make runs
_NUMBER, _UNIT, _NAME = 1, 2, 3  # ids of placeholders; words have their hash, which is larger
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_KNOWN = 1_000_000


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text)
    return _EITHER.findall(text) if _UNSPACED.search(text) else _WORD.findall(text)


class Codes(dict):
    """Token -> its place in a table of literal, plain and named ids and kinds of run, which grows with the tokens met."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[tuple[int, int, int, int]] = []
        self.table = np.empty((0, 4), np.uint64)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        own = xxhash.xxh64_intdigest(low) | 1 << 62
        spelled = low in NUMBERS
        plain = _NUMBER if spelled or low[0].isdigit() else _UNIT if low in UNITS else own
        named = _NAME if token[0].isupper() and not spelled else plain
        self.new.append((own, plain, named, _NUMBER if spelled else _NAME if named == _NAME else 0))
        self[token] = place = len(self)
        return place

    def templates(self, words: list[str]) -> np.ndarray:
        """Four rows: literal, plain and named ids of the words, and their kinds of run."""
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new, dtype=np.uint64)])
            self.new.clear()
        found = np.ascontiguousarray(self.table[at].T)
        if len(self) > _KNOWN:
            self.clear()
            self.table = self.table[:0]
        return found


def _sums(flags: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[size:] - total[:-size] if flags.size >= size else np.empty(0, dtype=np.int64)


def _used(ids: np.ndarray, size: int) -> np.ndarray:
    """Which windows are looked up in which template of words: each in the literal or the plain one."""
    enough = _sums(ids[_PLAIN] > _NAME, size) * 4 >= size
    return np.stack([~enough, enough])


def _begins(joins: np.ndarray, first: np.ndarray | int = 0) -> np.ndarray:
    """Places of words at which a token of the named template begins; texts begin at ``first``."""
    new = joins == 0
    new[1:] |= joins[1:] != joins[:-1]
    new[first] = True
    return np.flatnonzero(new)


def _hashes(rows: np.ndarray, size: int, used: np.ndarray, first: int = _LITERAL) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the used windows, template by template, from the template ``first`` on."""
    found, places = [], []
    for template, (row, mine) in enumerate(zip(rows, used, strict=True), first):
        at = np.flatnonzero(mine)
        if 4 * at.size < mine.size:  # few of them: one by one
            parts = [row[at + i] for i in range(size)]
            out = np.full(at.size, template + 8 * size, dtype=np.uint64)
        else:
            parts = [row[i : i + mine.size] for i in range(size)]
            out = np.full(mine.size, template + 8 * size, dtype=np.uint64)
        for part in parts:
            out ^= part
            out *= _PRIME
            out ^= out >> np.uint64(29)
        found.append(out if out.size == at.size else out[at])
        places.append(at)
    return np.concatenate(found), np.concatenate(places)


def _whole(words: list[str]) -> int:
    """The hash of a text of one or two tokens, as a whole."""
    return xxhash.xxh64_intdigest("\0".join(["whole", *map(str.lower, words)]))


def _exact(words: list[str]) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str.lower, words))) >> 1


def _value(words: list[str]) -> str:
    """What a run of words stands for: a number word its number, anything else itself."""
    low = [w.lower() for w in words]
    if any(w not in NUMBERS for w in low):
        return " ".join(low)
    done, part = 0, 0
    for w in low:
        n = NUMBERS[w]
        if n < 100:
            part += n
        elif n == 100:
            part = max(part, 1) * n
        else:
            done, part = done + max(part, 1) * n, 0
    return str(done + part)


def _pairs(own: list[str], theirs: list[str]) -> set[tuple[str, str]]:
    """Which value stands for which: word by word in names of one length, else run for run."""
    if len(own) == len(theirs) and own[0].lower() not in NUMBERS:
        return {(_value([a]), _value([b])) for a, b in zip(own, theirs, strict=True)}
    return {(_value(own), _value(theirs))}


class Laid:
    """A text's words and templates: of an item with the windows by which it is looked for."""

    def __init__(self, words: list[str], codes: Codes) -> None:
        self.words, self.ids = words, codes.templates(words)
        self.begins = _begins(self.ids[_JOINS]) if words else np.empty(0, np.int64)
        self.ends = np.append(self.begins[1:], len(words))
        self.named = self.ids[_NAMED][self.begins]

    def looked_for(self) -> Laid:
        self.size, self.named_size = min(WINDOW, len(self.words)), min(WINDOW, self.named.size)
        self.used = _used(self.ids, self.size)
        if self.named_size < LEAST:
            self.named_used = np.empty(0, bool)
        else:
            self.named_used = _sums(self.named > _NAME, self.named_size) * 2 >= self.named_size
        self.of = np.repeat(np.arange(self.begins.size), self.ends - self.begins)  # the named token of each word
        self.slots = [(i, a, b) for i, (a, b, n) in enumerate(zip(self.begins.tolist(), self.ends.tolist(), self.named.tolist(), strict=True)) if n <= _NAME]
        return self

    def kind(self) -> int:
        """The item's class: equal for items that every text leaks alike, but for the values of slots."""
        parts = [self.named.tobytes(), self.ends.tobytes()]
        if not (self.named_used.size and self.named_used.all()):
            parts.append(self.ids[_LITERAL if self.used[_LITERAL].any() else _PLAIN].tobytes())
        values = [v for _, a, b in self.slots for v in (_value(self.words[a:b]), *map(str.lower, self.words[a:b]))]
        seen: dict[str, int] = {}
        parts.append(repr([seen.setdefault(v, n) for n, v in enumerate(values)]).encode())
        return xxhash.xxh64_intdigest(b"\0".join(parts)) >> 1


@dataclass(frozen=True, order=True)
class Judged:
    n_windows: int
    coverage: float
    changed: bool
    exact: int = 0


def judge(own: Laid, text: Laid, shifts: list[int], named_shifts: list[int]) -> Judged | None:
    """The best of the diagonals on which enough of the item ``own`` is found in ``text``."""
    if len(own.words) < LEAST:
        return Judged(1, 1.0, False, _exact(own.words)) if list(map(str.lower, own.words)) == list(map(str.lower, text.words)) else None
    found = []
    for shift in sorted(shifts):
        # the named diagonal of most of these words
        at = np.searchsorted(text.begins, own.begins + shift)
        fit = (at < text.begins.size) & (text.begins[np.minimum(at, text.begins.size - 1)] == own.begins + shift)
        across = np.flatnonzero(fit)
        found.append((np.full(len(own.words), shift), _mode(at[across] - across) if across.size else None))
    for named in sorted(named_shifts):
        i = np.arange(max(0, -named), min(own.begins.size, text.begins.size - named))
        along = np.full(own.begins.size, np.iinfo(np.int64).max)
        along[i] = text.begins[i + named] - own.begins[i]
        found.append((along[own.of], named))
    judged = [j for j in (_agreeing(own, text, along, named) for along, named in found) if j]
    return max(judged, default=None)


def _mode(values: np.ndarray) -> int:
    seen, times = np.unique(values, return_counts=True)
    return int(seen[times.argmax()])


def _agreeing(own: Laid, text: Laid, along: np.ndarray, named: int | None) -> Judged | None:
    """The windows of one diagonal whose slots agree, literal ones first, if they cover enough of the item.

    ``along``: the shift of each word of the item; ``named``: that of the named template's tokens.
    """
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    covered = np.zeros(len(own.words), dtype=bool)
    n, changed, most = 0, False, own.begins.size - 1

    def agree(pairs: set[tuple[str, str]], first: int, last: int) -> None:
        nonlocal n, changed
        if all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs) and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            there.update(pairs)
            back.update((b, a) for a, b in pairs)
            covered[first:last] = True
            n += 1
            changed = changed or any(a != b for a, b in pairs)

    matches = []
    for shift in np.unique(along).tolist():
        first, last = max(0, -shift), min(len(own.words), len(text.words) - shift)
        if last - first < own.size:
            continue
        theirs = text.ids[:2, first + shift : last + shift]
        same = np.stack([_sums(a == b, own.size) == own.size for a, b in zip(own.ids[:2, first:last], theirs, strict=True)])
        template, at = np.nonzero(same & own.used[:, first : last - own.size + 1] & (along[first : last - own.size + 1] == shift))
        matches += [(kind, place, shift) for kind, place in zip(template.tolist(), (at + first).tolist(), strict=True)]
    for _, place, shift in sorted(matches):
        last = place + own.size
        pairs = set()
        for _, a, b in own.slots:
            if a < last and b > place:
                if own.ids[_PLAIN, a] == _NUMBER:  # the whole number, whatever of it the window covers
                    run = int(np.searchsorted(text.begins, a + shift, "right")) - 1
                    c, d = int(text.begins[run]), int(text.ends[run])
                else:
                    a, b = max(a, place), min(b, last)
                    c, d = a + shift, b + shift
                pairs |= _pairs(own.words[a:b], text.words[c:d])
        agree(pairs, place, last)
    first, last = (0, 0) if named is None else (max(0, -named), min(own.begins.size, text.begins.size - named))
    if own.named_used.size and last - first >= own.named_size:
        same = _sums(own.named[first:last] == text.named[first + named : last + named], own.named_size) == own.named_size
        for place in (np.flatnonzero(same & own.named_used[first : last - own.named_size + 1]) + first).tolist():
            pairs = set()
            for i, a, b in own.slots:
                if place <= i < place + own.named_size:
                    c, d = int(text.begins[i + named]), int(text.ends[i + named])
                    if i == 0:  # what stands before the item may have joined its first run, what follows its last
                        c = max(c, d - (b - a))
                    elif i == most:
                        d = min(d, c + (b - a))
                    pairs |= _pairs(own.words[a:b], text.words[c:d])
            agree(pairs, int(own.begins[place]), int(own.ends[place + own.named_size - 1]))
    if not n:
        return None
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    if int((edges[1::2] - edges[::2]).max()) < RUN and covered.mean() < COVER:
        return None
    shift = _mode(along[along < np.iinfo(np.int64).max])
    inside = 0 <= shift <= len(text.words) - len(own.words)
    return Judged(n, float(covered.mean()), changed, _exact(text.words[shift : shift + len(own.words)]) if inside else 0)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_key (the text's hash) and text of each different item."""
    return pick(benchmark, item_id="long", text="string").filter("text IS NOT NULL").withColumn("item_key", F.xxhash64("text")).distinct()


_SOUGHT = "hash long, named boolean, place long, size long, first long, last long, n_tokens long"


def _classes(items: DataFrame) -> DataFrame:
    """item_id, item_key, kind (the class) and exact (the words' hash) of the items that have a token."""
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            cut = [tokens(t) for t in batch.column("text").to_pylist()]
            rows = pa.array([i for i, words in enumerate(cut) if words], pa.int64())
            kinds = [Laid(words, codes).looked_for().kind() if len(words) >= LEAST else _whole(words) >> 1 for words in cut if words]
            yield pa.record_batch({"item_id": batch.column("item_id").take(rows), "item_key": batch.column("item_key").take(rows), "kind": pa.array(kinds, pa.int64()), "exact": pa.array([_exact(words) for words in cut if words], pa.int64())})

    return items.select("item_id", "item_key", "text").mapInArrow(run, "item_id long, item_key long, kind long, exact long")


def classes(benchmark: DataFrame) -> DataFrame:
    """item_id and class_id, the smallest id of its class (null last), for every item that has a token: what ``leaks`` names but once."""
    found = _classes(_items(benchmark))
    first = found.groupBy("kind").agg(F.min(_id_last("item_id")).alias("first"))
    return found.join(first, "kind").select("item_id", F.col("first.id").alias("class_id")).distinct()


def _id_last(name: str) -> Column:
    return F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("id"))


def _sought(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kinds: kind, item_id, item_key, n_items and text of each class's smallest item; members: kind, exact and the smallest id of equal items), both written."""
    found = materialize(_classes(items), "classes")
    first = found.groupBy("kind").agg(F.min(F.struct(_id_last("item_id").alias("o"), "item_key")).alias("m"), F.count_distinct(_id_last("item_id")).alias("n_items"))
    first = first.select("kind", F.col("m.o.id").alias("item_id"), F.col("m.item_key").alias("item_key"), "n_items")
    texts = items.select(F.col("item_id").alias("i_id"), F.col("item_key").alias("i_key"), "text")
    kinds = first.join(texts, F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item_key") == F.col("i_key"))).drop("i_id", "i_key")
    members = found.groupBy("kind", "exact").agg(F.min(_id_last("item_id")).alias("member"))
    return materialize(kinds, "kinds"), materialize(members, "members")


def item_windows(items: DataFrame, common: int = COMMON) -> DataFrame:
    """The windows that items are looked for by, written: item_id and item_key, hash, template (named or of words), place in it, size, and the words they cover."""
    small_batches(items.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for item_id, item_key, text in zip(*[batch.column(c).to_pylist() for c in ("item_id", "item_key", "text")], strict=True):
                words = tokens(text)
                parts = []
                if 0 < len(words) < LEAST:
                    parts.append((np.array([_whole(words)], np.uint64), False, np.zeros(1, np.int64), len(words), np.zeros(1, np.int64), np.full(1, len(words))))
                elif words:
                    own = Laid(words, codes).looked_for()
                    hashes, at = _hashes(own.ids[:2], own.size, own.used)
                    parts.append((hashes, False, at, own.size, at, at + own.size))
                    if own.named_used.any():
                        hashes, at = _hashes(own.named[None], own.named_size, own.named_used[None], _NAMED)
                        parts.append((hashes, True, at, own.named_size, own.begins[at], own.ends[at + own.named_size - 1]))
                for hashes, named, at, size, first, last in parts:
                    n = hashes.size
                    yield pa.record_batch({
                        "item_id": pa.array([item_id] * n, pa.int64()), "item_key": pa.array([item_key] * n, pa.int64()), "hash": pa.array(hashes.view(np.int64)), "named": pa.array([named] * n, pa.bool_()),
                        "place": pa.array(at, pa.int64()), "size": pa.array([size] * n, pa.int64()), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64()), "n_tokens": pa.array([len(words)] * n, pa.int64()),
                    })

    schema = f"item_id long, item_key long, {_SOUGHT}"
    every = materialize(items.select("item_id", "item_key", "text").mapInArrow(cut, schema), "item-windows")
    often = every.select("hash", "item_id", "item_key").distinct().groupBy("hash").count().filter(F.col("count") > common).select("hash", F.lit(True).alias("often"))
    marked = every.join(often, "hash", "left").withColumn("often", F.coalesce("often", F.lit(False))).select(*every.columns, "often")

    def helpful(frame: pd.DataFrame) -> pd.DataFrame:
        covered = np.zeros(int(frame["n_tokens"].iloc[0]) + 1, dtype=np.int64)
        for first, last in frame.loc[frame["often"], ["first", "last"]].itertuples(index=False):
            covered[first:last] = 1
        run = max(map(len, "".join(map(str, covered)).split("0")))
        alone = run >= RUN or covered.sum() >= COVER * (covered.size - 1)  # common windows could make a leak by themselves
        return frame if alone else frame[~frame["often"]]

    return materialize(marked.groupBy("item_id", "item_key").applyInPandas(helpful, schema + ", often boolean").drop("often", "n_tokens", "first", "last"), "sought")


def _filter(sought: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the windows, 32 bits a window where that is not more than ``most``; as 64-bit words."""
    n = sought.select("hash").distinct().count()
    bits = min(most, 1 << max(10, (32 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_probes(batch.column(0).to_numpy().view(np.uint64), bits))
            place, back = np.unique(at >> np.uint64(6), return_inverse=True)
            words = np.zeros(place.size, np.uint64)
            np.bitwise_or.at(words, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.record_batch({"place": pa.array(place.astype(np.int64)), "bits": pa.array(words.view(np.int64))})

    small_batches(sought.sparkSession, 65536)
    found = sought.select("hash").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return words


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_probe(hashes, bits, i) for i in range(_PROBES)]


def _probe(hashes: np.ndarray, bits: int, number: int) -> np.ndarray:
    turn = hashes >> np.uint64(32) | np.uint64(1)
    return (hashes + np.uint64(number) * turn) & np.uint64(bits - 1)


def _taken(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter takes; each probe looks at what the one before it took."""
    left = np.arange(hashes.size)
    for number in range(_PROBES):
        at = _probe(hashes[left] if number else hashes, 64 * words.size, number)
        left = left[(words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1]
    return left


def _met(docs: DataFrame, sought: DataFrame) -> DataFrame:
    """doc_id, key, item_id, item_key, shifts and named_shifts (diagonals of words and of named tokens) of documents and classes that share a window."""
    sizes = sorted(r["size"] for r in sought.filter(F.col("size") >= LEAST).select("size").distinct().collect())  # 3 to 8
    sent = docs.sparkSession.sparkContext.broadcast(_filter(sought))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            cut = [tokens(t) for t in batch.column(2).to_pylist()]
            lengths = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
            starts = np.cumsum(lengths) - lengths
            whose = np.repeat(np.arange(len(cut)), lengths)
            ids = codes.templates([w for words in cut for w in words])
            short = np.flatnonzero((lengths > 0) & (lengths < LEAST))
            found = [(np.array([_whole(cut[i]) for i in short.tolist()], np.uint64), short, np.zeros(short.size, np.int64))]
            begins = _begins(ids[_JOINS], starts[lengths > 0]) if whose.size else np.empty(0, np.int64)
            named, of = ids[_NAMED][begins], whose[begins]
            named_starts = np.searchsorted(begins, starts)
            for size in sizes:
                if ids.shape[1] >= size:
                    inside = whose[size - 1 :] == whose[: whose.size - size + 1]
                    hashes, at = _hashes(ids[:2], size, _used(ids, size) & inside)
                    hit = _taken(hashes, sent.value)
                    row = whose[at[hit]]
                    found.append((hashes[hit], row, at[hit] - starts[row]))
                if named.size >= size:
                    used = (_sums(named > _NAME, size) * 2 >= size) & (of[size - 1 :] == of[: of.size - size + 1])
                    hashes, at = _hashes(named[None], size, used[None], _NAMED)
                    hit = _taken(hashes, sent.value)
                    row = of[at[hit]]
                    found.append((hashes[hit], row, at[hit] - named_starts[row]))
            hashes, row, place = map(np.concatenate, zip(*found, strict=True))
            rows = pa.array(row)
            yield pa.record_batch({"doc_id": batch.column(0).take(rows), "key": batch.column(1).take(rows), "hash": pa.array(hashes.view(np.int64)), "at": pa.array(place)})

    looked = docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, hash long, at long")
    met = looked.join(sought, "hash").select("doc_id", "key", "item_id", "item_key", "named", (F.col("at") - F.col("place")).alias("shift"))
    only = lambda named: F.collect_set(F.when(F.col("named") == F.lit(named), F.col("shift")))
    return met.groupBy("doc_id", "key", "item_id", "item_key").agg(only(False).alias("shifts"), only(True).alias("named_shifts"))


def _keyed(documents: DataFrame) -> DataFrame:
    return pick(documents, doc_id="long", text="string").withColumn("key", F.xxhash64("text"))


def leaks(documents: DataFrame, benchmark: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, changed, n_items for every document and class of items that leaks into it.

    item_id: the class's item that the text holds word by word, else its smallest; n_items: the ids of the class, which ``classes`` lists.
    """
    return _leaks(documents, benchmark, common).drop("key").withColumn("coverage", F.round("coverage", 6))


def _leaks(documents: DataFrame, benchmark: DataFrame, common: int) -> DataFrame:
    spark = documents.sparkSession
    docs = _keyed(documents)
    kinds, members = _sought(materialize(_items(benchmark), "items"))
    met = materialize(_met(docs, item_windows(kinds, common)), "met")
    same = lambda a, b, c, d: F.col(a).eqNullSafe(F.col(b)) & (F.col(c) == F.col(d))
    sides = met.select(F.col("item_id").alias("m_id"), F.col("item_key").alias("m_key"), "doc_id", "key", "shifts", "named_shifts").join(kinds, same("m_id", "item_id", "m_key", "item_key"))
    lists = sides.groupBy(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key")).agg(F.collect_list(F.struct("kind", "text", "shifts", "named_shifts")).alias("sought"))
    lists = materialize(lists, "wanted")
    few = lists.count() <= BROADCAST and lists.agg(F.sum(F.size("sought"))).first()[0] in range(BROADCAST)
    small_batches(spark)
    near = F.broadcast(lists.select("of_id", "of_key")) if few else lists.select("of_id", "of_key")
    texts = docs.join(near, same("doc_id", "of_id", "key", "of_key"), "left_semi").dropDuplicates(["doc_id", "key"])
    both = texts.join(lists, same("doc_id", "of_id", "key", "of_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for number, (text, sought) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                laid = Laid(tokens(text), codes)
                judged = [(s["kind"], judge(Laid(tokens(s["text"]), codes).looked_for(), laid, s["shifts"], s["named_shifts"])) for s in sought]
                held = [(kind, j) for kind, j in judged if j]
                rows = pa.array([number] * len(held), pa.int64())
                yield pa.record_batch({
                    "doc_id": batch.column(0).take(rows), "key": batch.column(1).take(rows), "kind": pa.array([k for k, _ in held], pa.int64()), "n_windows": pa.array([j.n_windows for _, j in held], pa.int64()),
                    "coverage": pa.array([j.coverage for _, j in held], pa.float64()), "changed": pa.array([j.changed for _, j in held], pa.bool_()), "exact": pa.array([j.exact for _, j in held], pa.int64()),
                })

    schema = "doc_id long, key long, kind long, n_windows long, coverage double, changed boolean, exact long"
    found = both.select("doc_id", "key", "text", "sought").mapInArrow(run, schema)
    found = found.join(kinds.select("kind", "item_id", "n_items"), "kind").join(members, ["kind", "exact"], "left")
    held = F.col("member").isNotNull()
    item = F.when(held, F.col("member.id")).otherwise(F.col("item_id"))
    return found.select("doc_id", "key", item.alias("item_id"), "n_windows", "coverage", (F.col("changed") & ~held).alias("changed"), "n_items")


def drop_leaked(documents: DataFrame, benchmark: DataFrame, common: int = COMMON) -> DataFrame:
    """The documents into which no item leaks, with all their columns."""
    leaked = materialize(_leaks(documents, benchmark, common).select("doc_id", "key").distinct(), "leaked")
    key = fresh(documents, "leak_key")
    keyed = documents.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    few = leaked.count() <= BROADCAST
    out = keyed.join(F.broadcast(leaked) if few else leaked, keyed["doc_id"].cast("long").eqNullSafe(leaked["doc_id"]) & (keyed[key] == leaked["key"]), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])
