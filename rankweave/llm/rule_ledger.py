"""Quality rules as a ledger: every rule is evaluated once a document, policies and ablations only read bits.

``ledger`` measures whole texts and keeps, for each document, its measurements and one long whose bit i says that
rule i fails. The ledger is a written table. A policy is a version and the rules that it asks for, so a mask:
``apply`` keeps documents without a failed bit of the mask, and ``ablate`` sums, over the few different bit sets
there are, what each rule rejects, what it alone rejects, and what a policy would keep without it. New policies need no text.

Defined cases: null and empty texts have no words and fail ``few_words``, the shares of nothing fail no rule; repeated rows
are judged each; an empty table gives an empty ledger; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.columns import pick, texts
from rankweave.runtime import materialize, small_batches, spread

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullets", "n_ellipses", "n_letter_words", "line_chars", "dup_line_chars")


class Rule(NamedTuple):
    """Fails where ``times * measure`` is more (or less) than ``limit * of``; without ``of``, than ``limit``. Whole numbers throughout."""

    name: str
    measure: str
    times: int
    sign: str
    limit: int
    of: str | None = None

    def fails(self) -> Column:
        left = F.col(self.measure) * self.times
        right = F.lit(self.limit) * F.col(self.of) if self.of else F.lit(self.limit)
        return left > right if self.sign == ">" else left < right


#: Rules by bit; a new one goes to the end, so that bits of written ledgers keep their meaning. Published limits of web-text filters.
RULES = (
    Rule("few_words", "n_words", 1, "<", 50),
    Rule("repeated_words", "n_repeat_words", 100, ">", 50, "n_words"),
    Rule("many_words", "n_words", 1, ">", 100_000),
    Rule("short_words", "word_chars", 1, "<", 3, "n_words"),
    Rule("long_words", "word_chars", 1, ">", 10, "n_words"),
    Rule("symbols", "n_symbols", 10, ">", 1, "n_words"),
    Rule("repeated_lines", "n_dup_lines", 10, ">", 3, "n_lines"),
    Rule("bullets", "n_bullets", 10, ">", 9, "n_lines"),
    Rule("ellipses", "n_ellipses", 10, ">", 3, "n_lines"),
    Rule("few_letters", "n_letter_words", 10, "<", 8, "n_words"),
    Rule("repeated_line_chars", "dup_line_chars", 5, ">", 1, "line_chars"),
)
BASE = ("few_words", "repeated_words")
#: Versions, oldest first; the last one decides. There, length has no upper limit, as a long text is no bad one, and repeated lines
#: weigh by their code points: a heading that stands again at the foot of three lines is a third of them, and little of the text.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "web": (*BASE, "many_words", "short_words", "long_words", "symbols", "repeated_lines", "bullets", "ellipses", "few_letters"),
    "chars": (*BASE, "short_words", "long_words", "symbols", "repeated_line_chars", "bullets", "ellipses", "few_letters"),
}

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
_LETTER = re.compile(r"[^\W\d_]")
_BULLETS = ("•", "-", "*", "·", "–", "‣", "▪")


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    data = text.encode()
    words = data.split()  # bytes: ASCII white space only
    lines = [line for line in text.split("\n") if line.encode().strip(_SPACES)]
    seen: set[str] = set()
    again = [len(line) for line in lines if line in seen or seen.add(line)]
    starts = [line.lstrip(" \t\v\f\r") for line in lines]
    ends = [line.rstrip(" \t\v\f\r") for line in lines]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lettered = np.fromiter((bool(_LETTER.search(w.decode())) for w in known), bool, len(known))
    spaces = len(data) - len(data.translate(None, _SPACES))
    return (
        len(words),
        len(text) - spaces,
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(again),
        _repeated(ids, len(known)),
        len(lines),
        sum(s.startswith(_BULLETS) for s in starts),
        sum(s.endswith(("...", "…")) for s in ends),
        int(lettered[ids].sum()),
        sum(map(len, lines)),
        sum(again),
    )


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words in a window of three that is found twice or more."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1].astype(np.int64)  # a number a pair keeps triples in 64 bits
    _, at, times = np.unique(pairs * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    inside = np.zeros(len(ids), bool)
    for i in range(3):
        inside[i : len(again) + i] |= again
    return int(inside.sum())


def bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One long, bit i set where rule i fails."""
    if len(rules) > 63:
        raise ValueError(f"a ledger has 63 rules at most, not {len(rules)}")
    found = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        found = found.bitwiseOR(F.when(rule.fails(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return found


def mask(policy: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits a policy looks at; an unknown rule is an error."""
    place = {rule.name: i for i, rule in enumerate(rules)}
    if unknown := [name for name in policy if name not in place]:
        raise ValueError(f"no rule named {', '.join(unknown)}")
    return sum(1 << place[name] for name in set(policy))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``failed``, as a written table."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(x) for x in texts(batch, "text")], np.int64).reshape(-1, len(MEASURES))
            columns = [batch.column(batch.schema.get_field_index("doc_id")), *[pa.array(found[:, i]) for i in range(len(MEASURES))]]
            yield pa.record_batch(columns, names=["doc_id", *MEASURES])

    measured = spread(pick(docs, doc_id="long", text="string")).mapInArrow(rows, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return materialize(measured.withColumn("failed", bits(rules)), "rule-ledger")


def apply(entries: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A ledger with ``kept_by``, the versions that keep a document, in their order, and ``sole_rule``: the one rule without
    which the last version would keep it."""
    asked = {version: mask(policy, rules) for version, policy in policies.items()}
    kept_by = F.array(*[F.when(F.col("failed").bitwiseAND(m) == 0, F.lit(version)) for version, m in asked.items()])
    against = F.col("failed").bitwiseAND(list(asked.values())[-1])
    sole = F.coalesce(*[F.when(against == 1 << i, F.lit(rule.name)) for i, rule in enumerate(rules)])
    return entries.withColumn("kept_by", F.array_compact(kept_by)).withColumn("sole_rule", sole)


def ablate(entries: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_sole, n_kept, n_kept_without): for each rule of each policy, documents that fail it, that fail it
    alone, that the policy keeps, and that it would keep without the rule.

    Documents are counted by bit set first: at most 2 ** rules sums, whatever the corpus.
    """
    place = {rule.name: i for i, rule in enumerate(rules)}
    wanted = [F.struct(F.lit(v).alias("policy"), F.lit(n).alias("rule"), F.lit(mask(p, rules)).alias("mask"), F.lit(1 << place[n]).alias("bit")) for v, p in policies.items() for n in dict.fromkeys(p)]
    sets = entries.groupBy("failed").agg(F.count("*").alias("docs")).select("failed", "docs", F.explode(F.array(*wanted)).alias("of")).select("failed", "docs", "of.*")
    against = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("docs")).otherwise(F.lit(0))).cast("long")
    return sets.groupBy("policy", "rule").agg(
        F.sum("docs").alias("n_docs"),
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(against == F.col("bit")).alias("n_sole"),
        total(against == 0).alias("n_kept"),
        total(against.bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def judge(docs: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each document's measurements, failed bits, versions that keep it, and the verdict of the last one; where one rule alone rejects it,
    that rule and how many documents it alone rejects."""
    entries = ledger(docs, rules)
    last = list(policies)[-1]
    freed = ablate(entries, {last: policies[last]}, rules).where("n_sole > 0").select(F.col("rule").alias("sole_rule"), "n_sole")
    judged = apply(entries, policies, rules).join(F.broadcast(freed), "sole_rule", "left")  # a row a rule
    return judged.select(
        "doc_id",
        *MEASURES[:5],
        (F.col("failed").bitwiseAND(mask(BASE, rules)) != 0).alias("base_failed"),
        F.array_contains("kept_by", last).alias("kept"),
        "failed",
        F.concat_ws(",", "kept_by").alias("kept_by"),
        "sole_rule",
        "n_sole",
    )


#: Written by hand from the contract, not from the rules above.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
three AS (SELECT r, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS c FROM three WHERE w3 IS NOT NULL),
inside AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS v(d) WHERE c > 1 GROUP BY r),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(inside.n, 0)::BIGINT AS n_repeat_words,
  len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•\-*·–‣▪]'))) AS bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS letters,
  coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS line_chars, coalesce(list_sum(list_transform(list_distinct(lines), lambda x: length(x))), 0) AS distinct_chars FROM w LEFT JOIN inside USING (r)),
f AS (SELECT *, n_words < 50 AS b0, n_repeat_words > 0.5 * n_words AS b1, n_words > 100000 AS b2, word_chars < 3 * n_words AS b3, word_chars > 10 * n_words AS b4, n_symbols > 0.1 * n_words AS b5,
  n_dup_lines > 0.3 * n_lines AS b6, bullets > 0.9 * n_lines AS b7, ellipses > 0.3 * n_lines AS b8, letters < 0.8 * n_words AS b9, line_chars - distinct_chars > 0.2 * line_chars AS b10 FROM m),
j AS (SELECT *, b0 OR b1 AS base_failed, NOT (b0 OR b1 OR b3 OR b4 OR b5 OR b10 OR b7 OR b8 OR b9) AS kept,
  CASE WHEN b0::INT + b1::INT + b3::INT + b4::INT + b5::INT + b10::INT + b7::INT + b8::INT + b9::INT = 1 THEN
    CASE WHEN b0 THEN 'few_words' WHEN b1 THEN 'repeated_words' WHEN b3 THEN 'short_words' WHEN b4 THEN 'long_words' WHEN b5 THEN 'symbols' WHEN b10 THEN 'repeated_line_chars' WHEN b7 THEN 'bullets' WHEN b8 THEN 'ellipses' ELSE 'few_letters' END END AS sole_rule FROM f),
s AS (SELECT sole_rule, count(*)::BIGINT AS n_sole FROM j WHERE sole_rule IS NOT NULL GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
  (b0::INT + 2 * b1::INT + 4 * b2::INT + 8 * b3::INT + 16 * b4::INT + 32 * b5::INT + 64 * b6::INT + 128 * b7::INT + 256 * b8::INT + 512 * b9::INT + 1024 * b10::INT)::BIGINT AS failed,
  concat_ws(',', CASE WHEN NOT base_failed THEN 'base' END, CASE WHEN NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5 OR b6 OR b7 OR b8 OR b9) THEN 'web' END, CASE WHEN kept THEN 'chars' END) AS kept_by, sole_rule, n_sole
FROM j LEFT JOIN s USING (sole_rule)
"""
