"""Many spellings in many texts: an Aho-Corasick automaton, broadcast, walks each text once whatever the number of spellings.

Hits are whole words, read from the left, the longest at each place, none inside another. White space in a spelling stands for any run of it in a
text; case doesn't count. A dictionary past ``SHARD_BYTES`` is cut into shards that are broadcast one at a time, each adding its
matches to the row; which of them stand is decided when all are there.

Texts of about ``PIECE_CHARS`` are walked as one string, in which the edges of words are marked: spellings inside longer words never match, and what
is left to do (places in the text, which match stands) is done on whole arrays.

Defined cases: null and empty texts have no hits; empty spellings and spellings of white space alone are left out; repeated spellings count once;
an empty dictionary finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from rankweave.runtime import materialize, small_batches

#: Bytes of spellings in one automaton; its states take about a hundred times that.
SHARD_BYTES = 4_000_000
#: Characters walked at once.
PIECE_CHARS = 1 << 20
MATCHES = "array<struct<surface:string,start:int>>"
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_KIND = pa.struct([("surface", pa.string()), ("start", pa.int32())])
#: Marks an edge of a word; stands between texts. Neither is left in a text, or in a spelling, whose white space is spaces.
_EDGE, _END = 9, 10


def folded(surface: str) -> str:
    return _SPACE.sub(" ", surface.lower()).strip(" ")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def _marked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes with a mark wherever a word begins or ends, and where each of the codes went."""
    word = np.zeros(len(codes) + 2, bool)
    word[1:-1] = (codes - 97 < 26) | (codes - 48 < 10)  # unsigned: what is less wraps around
    edge = word[1:] != word[:-1]
    before = np.cumsum(edge, dtype=np.int32)
    to = np.arange(len(codes), dtype=np.int32) + before[:-1]
    out = np.full(len(codes) + int(before[-1]), _EDGE, np.uint32)
    out[to] = codes
    return out, to


def _automaton(surfaces: Iterable[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for s in surfaces:
        key = _text(_marked(_codes(s))[0])
        found.add_word(key, len(key))
    found.make_automaton()
    return found


def raw_matches(automaton, joined: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in ``joined`` (lower-case texts with a character between two, at ``starts``) of every spelling that stands as whole words, inside others too."""
    none = np.zeros(0, np.int64)
    if not len(automaton) or not joined:
        return none, none
    codes = _codes(joined)
    space = (codes == 32) | (codes - 9 < 5)
    space[starts[1:] - 1] = False
    kept = ~space
    kept[0] = True
    kept[1:] |= ~space[:-1]  # a run's first
    codes = np.where(space, np.uint32(32), codes)
    codes[starts[1:] - 1] = _END
    at = np.flatnonzero(kept).astype(np.int32)
    marked, to = _marked(codes[at])
    flat = np.fromiter(chain.from_iterable(automaton.iter(_text(marked))), np.int64)
    ends = flat[::2] + 1
    begins = ends - flat[1::2]
    # Spellings whose first or last character is no word's begin or end with no mark; a word may not touch them there.
    framed = np.concatenate([[_END], marked, [_END]])
    stands = (framed[begins] != _EDGE) & (framed[ends + 1] != _EDGE)
    begins, ends = begins[stands], ends[stands]
    places = np.zeros(len(marked), np.int32)
    places[to] = at
    return places[begins + (marked[begins] == _EDGE)], places[ends - 1 - (marked[ends - 1] == _EDGE)] + 1


def chosen(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the left, the longest at each place, none that begins inside the one before."""
    order = np.lexsort((-ends, starts))
    starts, ends = starts[order], ends[order]
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] != starts[:-1]
    starts, ends = starts[first], ends[first]
    if (starts[1:] >= ends[:-1]).all():
        return starts, ends
    stands, free = [], 0
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if start >= free:
            stands.append(i)
            free = end
    return starts[stands], ends[stands]


def _pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch cut before the row at which another ``PIECE_CHARS`` bytes of text are full."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    full = np.cumsum(sizes, dtype=np.int64) // PIECE_CHARS
    cuts = [0, *(np.flatnonzero(full[1:] != full[:-1]) + 1).tolist(), len(full)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _spans(automaton, piece: pa.RecordBatch, text: str, spans: str | None) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The piece's lower-case texts joined, where each begins, and starts and ends of the automaton's matches and of those that ``spans`` holds."""
    low = [(t or "").lower() for t in piece.column(piece.schema.get_field_index(text)).to_pylist()]
    joined = "\n".join(low)
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
    begins = np.cumsum(sizes) - sizes
    starts, ends = raw_matches(automaton, joined, begins)
    if spans is None:
        return joined, begins, starts, ends
    held = piece.column(piece.schema.get_field_index(spans))
    rows = np.repeat(begins, pc.list_value_length(held).to_numpy(zero_copy_only=False))
    flat = held.flatten().to_numpy() + rows
    return joined, begins, np.concatenate([flat[::2], starts]), np.concatenate([flat[1::2], ends])


def _lists(begins: np.ndarray, starts: np.ndarray, values: pa.Array, each: int = 1) -> pa.ListArray:
    """One list a text of the values of its matches, ``each`` a match; ``starts`` ascend."""
    upto = np.append(np.searchsorted(starts, begins), len(starts)) * each
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values)


def add_matches(rows: DataFrame, text: str, surfaces: DataFrame | list[str], out: str = "matches", shard_bytes: int = SHARD_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``rows`` with an array of struct(surface, start): spellings as they stand in the lower-case text and where, counted from 0.

    ``surfaces`` is a list, or a frame whose first column holds them. ``keep`` names the columns to return, by default all: texts that nothing reads
    afterwards needn't come back from Python.
    """
    spark = rows.sparkSession
    small_batches(spark)
    if isinstance(surfaces, list):
        surfaces = spark.createDataFrame([(s,) for s in surfaces], "surface string")
    listed = surfaces.select(F.col(surfaces.columns[0]).cast("string").alias("surface")).where("surface IS NOT NULL").distinct()
    listed = materialize(listed, "dictionary")
    total = listed.agg(F.sum(F.octet_length("surface"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    keep = rows.columns if keep is None else keep
    held, spans = rows.select(*(f"`{c}`" for c in dict.fromkeys([*keep, text]))), None
    for i in range(shards):
        names = [folded(r[0]) for r in listed.where(F.pmod(F.xxhash64("surface"), F.lit(shards)) == i).collect()]  # bounded by shard_bytes
        known = spark.sparkContext.broadcast(sorted({n for n in names if n}))

        def walk(batches: Iterator[pa.RecordBatch], known=known, spans=spans, last=i == shards - 1) -> Iterator[pa.RecordBatch]:
            automaton = None
            for batch in batches:
                automaton = automaton if automaton is not None else _automaton(known.value)
                for piece in _pieces(batch, batch.schema.get_field_index(text)):
                    joined, begins, starts, ends = _spans(automaton, piece, text, spans)
                    if last:
                        starts, ends = chosen(starts, ends)
                        found = pa.array([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())
                        inside = starts - begins[np.searchsorted(begins, starts, "right") - 1]
                        hits = pa.StructArray.from_arrays([found, pa.array(inside, pa.int32())], fields=list(_KIND))
                        yield pa.record_batch([*(piece.column(piece.schema.get_field_index(c)) for c in keep), _lists(begins, starts, hits)], names=[*keep, out])
                    else:
                        order = np.argsort(starts, kind="stable")
                        starts, ends = starts[order], ends[order]
                        flat = np.stack([starts, ends], 1) - begins[np.searchsorted(begins, starts, "right") - 1][:, None]
                        columns = [c for c in piece.schema.names if c != spans]
                        yield pa.record_batch([*(piece.column(piece.schema.get_field_index(c)) for c in columns), _lists(begins, starts, pa.array(flat.ravel(), pa.int32()), 2)], names=[*columns, f"{out}_spans"])

        kinds = held.schema if spans is None else held.drop(spans).schema
        if i == shards - 1:
            fields = [f"`{c}` {kinds[c].dataType.simpleString()}" for c in keep]
            return held.mapInArrow(walk, ", ".join([*fields, f"`{out}` {MATCHES}"]))
        spans = f"{out}_spans"
        held = materialize(held.mapInArrow(walk, StructType([*kinds.fields, StructField(spans, ArrayType(IntegerType()))])), "dictionary-spans")
