"""Dictionary match of skills in texts: the longest spelling at each place, ambiguous names only where they can be trusted."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.text import let, text_or_empty
from rankweave.operators.ontology import SkillOntology
from rankweave.schemas import section

#: Names that are ordinary words too, and sections whose words are skills.
AMBIGUOUS = ("c", "r", "go", "rust", "swift", "scala", "excel", "spark", "hive", "flask", "lambda", "monitoring", "statistics", "communication", "leadership", "teamwork", "mentoring", "routing", "switching", "containers", "algorithms")
TRUSTED_SECTIONS = ("skills", "certifications", "projects")
_WINDOW = 60
_DELIMITERS = r"[,|/•·;]"


def dictionary_pattern(surfaces: list[str]) -> str:
    """One alternation, longer spellings first, that matches whole words only."""
    ordered = sorted(set(surfaces), key=lambda s: (-len(s), s))
    return r"(?<![a-z0-9])(?:" + "|".join(re.escape(s).replace(r"\ ", r"\s+") for s in ordered) + r")(?![a-z0-9])"


def matches(text: Column, pattern: str) -> Column:
    """Array of struct(surface, start) of a pattern's matches, start counted from 0.

    Matches come without their places; those follow from the lengths of the pieces between them.
    """
    low = F.lower(text_or_empty(text))
    found, between = F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), F.split(low, pattern)
    none = F.array().cast("array<struct<surface:string,start:int>>")
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<surface:string,start:int>>").alias("out"))

    def add(acc: Column, m: Column) -> Column:
        start = acc.getField("at") + F.length(m.getField("gap"))
        hit = F.struct(m.getField("surface").alias("surface"), start.cast("int").alias("start"))
        return F.struct((start + F.length(m.getField("surface"))).cast("int").alias("at"), F.concat(acc.getField("out"), F.array(hit)).alias("out"))

    # One piece more than matches: the last, behind all of them, pairs with no match and falls out.
    pairs = F.filter(F.zip_with(found, between, lambda s, g: F.struct(s.alias("surface"), F.coalesce(g, F.lit("")).alias("gap"))), lambda m: m.getField("surface").isNotNull())
    return F.coalesce(F.aggregate(pairs, first, add, lambda a: a.getField("out")), none)


def in_list(text: Column, start: Column, length: Column, window: int = _WINDOW) -> Column:
    """Two list delimiters or more within ``window`` characters on either side."""
    low = text  # in lower case
    left = F.substring(low, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)))
    right = F.substring(low, start + length + 1, F.lit(window))
    return F.regexp_count(F.concat(left, right), F.lit(_DELIMITERS)) >= 2


def extract_skills(text: Column, ontology: SkillOntology, trusted: Column | None = None, found: Column | None = None) -> Column:
    """Sorted canonical skills of a text. ``trusted``: text whose words count wherever they stand; ``found``: the text's matches where
    an automaton has them already (``dictionary.add_matches``)."""
    hits = F.transform(found if found is not None else matches(text, dictionary_pattern(list(ontology.alias_index))), lambda m: F.struct(ontology.canonical_column(m.getField("surface")).alias("skill"), m.getField("surface").alias("surface"), m.getField("start").alias("start")))
    both = F.struct(F.lower(text_or_empty(text)).alias("low"), (F.lower(trusted) if trusted is not None else F.lit("")).alias("known"))

    def keep(t: Column) -> Column:
        sure = lambda h: ~h.getField("skill").isin(*AMBIGUOUS) | in_list(t.getField("low"), h.getField("start"), F.length(h.getField("surface"))) | F.contains(t.getField("known"), h.getField("surface"))
        return F.array_sort(F.array_distinct(F.transform(F.filter(hits, lambda h: h.getField("skill").isNotNull() & sure(h)), lambda h: h.getField("skill"))))

    return let(both, keep)


def trusted_text(sections: Column) -> Column:
    return F.concat_ws("\n", *[section(sections, s) for s in TRUSTED_SECTIONS])
