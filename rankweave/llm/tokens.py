"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text over ``chunk`` characters is encoded in chunks that overlap. Both neighbours' tokens come with
offsets; the splice goes to a boundary that both have inside the overlap and that is proven stable: a place
between a character that isn't white space and one that is. The byte-level pattern starts a new piece there
whatever stands around it (white space occurs in a piece only at its start), pieces are encoded on their own,
and so tokens to the left depend on the left text alone and tokens to the right on the right text alone. Places
within a special token's length of a chunk's cut end don't count: there a cut could hide a special token.
Where the overlap has no such boundary, it is widened (doubled) up to the whole text.

Two encoders: the tokenizers library on its .json file, and the same file's vocabulary and merges run by
tiktoken's faster byte-pair code. The second is taken only if the file is a byte-level BPE with the usual
pattern whose merges are in the order of ids, and it agrees with the first on a probe of every category of
characters and white space when a worker starts; its failures on a text (its regular expression gives up on very long runs of blanks) are encoded by
the first.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts are special
tokens, as the library's default has it; repeated rows are counted each; other columns don't matter.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.llm.columns import pick, texts
from rankweave.runtime import small_batches

LIMIT = 512
#: Characters of one chunk and of the first overlap.
CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Fixed value: the byte-level pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STABLE = re.compile(r"(?<=\S)(?=\s)")


def _probe() -> str:
    """A text for comparing encoders: turns of phrase, and around letters, digits, marks and signs of every category every kind of white space."""
    kinds: dict[str, list[str]] = {}
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        if len(held := kinds.setdefault(unicodedata.category(c), [])) < 4 or c.isspace():
            held.append(c)
    spaces = [c for held in kinds.values() for c in held if c.isspace()]
    signs = [c for held in kinds.values() for c in held if not c.isspace()]
    turns = "It's 12,345 naïve cafés;  two\n\n\tlines…   漢字 🙂 don't WE'LL <|endoftext|>x  <|endoftext|>   end  "
    return turns + "".join(f"{c}a{c}{c}1{s}{c} {c}{s}b" for c, s in zip(spaces * len(signs), signs * len(spaces), strict=True)) + "".join(f"a{s}1{s}{s} 's{s}" for s in signs)


Ends = np.ndarray


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_to_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """count(text), and ends(text): the number of tokens and the character offset behind each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.margin = max([1, *map(len, self.special)])
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        """tiktoken on the same vocabulary, or None where it wouldn't be the same."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or not plain:
            return None
        back = {c: b for b, c in _bytes_to_chars().items()}
        extra = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            return None
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in extra}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            return None
        found = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=extra)
        if found.encode(probe := _probe(), allowed_special="all") != self.library.encode(probe, add_special_tokens=False).ids:
            return None
        return found

    def count(self, text: str) -> int:
        if self.fast is not None:
            try:
                return len(self.fast.encode(text, allowed_special="all"))
            except BaseException as e:  # the Rust side panics on what its pattern can't match
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return len(self.library.encode(text, add_special_tokens=False))

    def ends(self, text: str) -> Ends:
        return np.fromiter((e for _, e in self.library.encode(text, add_special_tokens=False).offsets), dtype=np.int64)


def count_long(text: str, encoder: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` by chunks spliced at stable boundaries; equal to encoding it whole."""
    total, start = 0, 0  # everything before start, a stable boundary or 0, is counted
    while len(text) - start > chunk:
        stop = start + chunk
        left = encoder.ends(text[start:stop]) + start
        width = overlap
        while True:
            low = max(start, stop - width)
            # What the left chunk says near its end isn't proven, nor what the right one says near its start.
            places = [m.start() for m in _STABLE.finditer(text, max(start + 1, low + encoder.margin), max(start + 1, stop - encoder.margin))]
            if places:
                right = encoder.ends(text[low : min(len(text), low + 2 * width + chunk // 4)]) + low
                both = np.intersect1d(np.intersect1d(np.array(places), left), right)
                both = [int(p) for p in both if not _inside_special(text, int(p), encoder)]
                if both:
                    break
            if low == start:  # nothing stable in the whole chunk: take a larger one
                stop, width = min(len(text), start + 2 * (stop - start)), overlap
                if stop == len(text):
                    return total + encoder.count(text[start:])
                left = encoder.ends(text[start:stop]) + start
                continue
            width *= 2
        splice = both[-1]
        total += int(np.searchsorted(left, splice, side="right"))
        start = splice
    return total + encoder.count(text[start:])


def _inside_special(text: str, at: int, encoder: Encoder) -> bool:
    near = text[max(0, at - encoder.margin) : at + encoder.margin]
    mid = at - max(0, at - encoder.margin)
    return any(s in near and any(m.start() < mid < m.end() for m in re.finditer(re.escape(s), near)) for s in encoder.special)


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(documents: DataFrame, path: str | Callable[[], str] = default_path, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. ``path``: the tokenizer's file on each worker."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path() if callable(path) else path)
        for batch in batches:
            rows = texts(batch, "text")
            counts = [encoder.count(t) if len(t) <= chunk else count_long(t, encoder, chunk) for t in rows]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in rows]
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([c > limit for c in counts], pa.bool_())})

    return pick(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
