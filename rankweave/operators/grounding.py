"""Evidence for claimed skills in a candidate's own sentences.

First by name: the first sentence that has one of the skill's spellings, or of a skill that implies it. Only
what is left over is compared by vectors: the most similar sentence counts if it reaches the threshold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.config import DEFAULT_GROUNDING, GroundingConfig
from rankweave.functions.vectors import clamp
from rankweave.operators.blocks import segment_best
from rankweave.operators.ontology import SkillOntology

EXPLICIT, SEMANTIC, LISTED_ONLY, ABSENT = "explicit", "semantic", "listed_only", "absent"
MIN_SENTENCES = 3


def surface_forms(skill: str, ontology: SkillOntology) -> set[str]:
    """Spellings of a skill and of all that imply it."""
    forms: set[str] = set()
    for name in {skill, *ontology.descendants(skill)}:
        node = ontology.nodes.get(name)
        forms |= {name.replace("-", " ")} | ({node.name, *node.aliases} if node else set())
    return forms - {""}


def forms_table(ontology: SkillOntology, spark) -> DataFrame:
    """(skill, pattern): one guarded alternation a skill."""
    guard = lambda forms: r"(?<![a-z0-9])(?:" + "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f))) + r")(?![a-z0-9])"
    return spark.createDataFrame([(n, guard(surface_forms(n, ontology))) for n in ontology.nodes], "skill string, pattern string")


def mentions(sentence: Column, pattern: Column) -> Column:
    return F.regexp_like(F.lower(sentence), pattern)


def lexical(claims: DataFrame, sentences: DataFrame, forms: DataFrame) -> DataFrame:
    """Claims (candidate_id, skill) named in a sentence (candidate_id, pos, sentence): the first one. Joined by candidate, then filtered."""
    unknown = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace("skill", F.lit("-"), F.lit(" ")), F.lit(r"\E(?![a-z0-9])"))
    wanted = claims.join(forms, "skill", "left").withColumn("pattern", F.coalesce("pattern", unknown))
    hits = wanted.join(sentences, "candidate_id").filter(mentions(F.col("sentence"), F.col("pattern")))
    return hits.groupBy("candidate_id", "skill").agg(F.min_by("sentence", "pos").alias("evidence"))


def semantic_strength(similarity: Column, config: GroundingConfig = DEFAULT_GROUNDING) -> Column:
    span = max(1e-9, config.semantic_ceiling - config.semantic_threshold)
    return F.lit(config.semantic_max) * clamp((similarity - config.semantic_threshold) / span)


def best_sentence(claims: DataFrame, sentences: DataFrame, places: int = 12) -> DataFrame:
    """(candidate_id, skill, similarity, sentence) of claims with a vector and a candidate's sentences with one: the most similar sentence, the
    first of those equal to so many places. Multiplied in blocks inside a candidate; see ``segment_best``."""
    best = segment_best(claims, sentences, "candidate_id", "skill", "pos", places=places)
    return best.join(sentences.select("candidate_id", "pos", "sentence"), ["candidate_id", "pos"]).select("candidate_id", "skill", "similarity", "sentence")


def ground_skills(claims: DataFrame, sentences: DataFrame, forms: DataFrame, config: GroundingConfig = DEFAULT_GROUNDING) -> DataFrame:
    """(candidate_id, skill, grounding, kind, evidence, similarity) of every claim.

    The second pass runs only if both claims and sentences have a ``vector``, and only over claims that the first left.
    """
    named = lexical(claims.select("candidate_id", "skill"), sentences.select("candidate_id", "pos", "sentence"), forms)
    explicit = named.select("candidate_id", "skill", F.lit(1.0).alias("grounding"), F.lit(EXPLICIT).alias("kind"), "evidence", F.lit(1.0).alias("similarity"))
    rest = claims.join(named.select("candidate_id", "skill"), ["candidate_id", "skill"], "left_anti")
    if "vector" in claims.columns and "vector" in sentences.columns:
        rest = rest.drop("vector").join(best_sentence(rest, sentences), ["candidate_id", "skill"], "left")
    else:
        rest = rest.withColumns({"similarity": F.lit(None).cast("double"), "sentence": F.lit(None).cast("string")})
    near = F.coalesce(F.col("similarity") >= config.semantic_threshold, F.lit(False))
    other = rest.select(
        "candidate_id", "skill", F.when(near, semantic_strength(F.col("similarity"), config)).otherwise(0.0).alias("grounding"), F.when(near, SEMANTIC).otherwise(LISTED_ONLY).alias("kind"),
        F.when(near, F.col("sentence")).otherwise("").alias("evidence"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )
    return explicit.unionByName(other)


def is_grounded(kind: Column) -> Column:
    return kind.isin(EXPLICIT, SEMANTIC)


def summary(evidence: DataFrame, sentences: DataFrame) -> DataFrame:
    """(candidate_id, grounded_fraction, sentence_count, reliable): 1.0 for candidates without claims."""
    share = evidence.groupBy("candidate_id").agg(F.avg(is_grounded(F.col("kind")).cast("double")).alias("share"))
    n = sentences.groupBy("candidate_id").agg(F.count("*").alias("sentence_count"))
    both = n.join(share, "candidate_id", "full_outer")
    count = F.coalesce("sentence_count", F.lit(0)).cast("long")
    return both.select("candidate_id", F.coalesce("share", F.lit(1.0)).alias("grounded_fraction"), count.alias("sentence_count"), (count >= MIN_SENTENCES).alias("reliable"))


def strengths(evidence: DataFrame) -> DataFrame:
    """(candidate_id, strengths): a map a candidate for grounded coverage."""
    return evidence.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("skill", "grounding"))).alias("strengths"))


def describe(skill: Column, kind: Column, evidence: Column, similarity: Column) -> Column:
    quote = F.concat(F.lit("'"), F.left(evidence, F.lit(90)), F.lit("'"))
    return (
        F.when(kind == EXPLICIT, F.concat(skill, F.lit(": demonstrated - "), quote))
        .when(kind == SEMANTIC, F.concat(skill, F.format_string(": implied (sim %.2f) - ", similarity), quote))
        .when(kind == LISTED_ONLY, F.concat(skill, F.lit(": listed but not evidenced in the work history")))
        .otherwise(F.concat(skill, F.lit(": not present")))
    )


def evidence_for_requirements(evidence: DataFrame, required: DataFrame, held: DataFrame) -> DataFrame:
    """Evidence of required skills (candidate_id, skill) that are held, the strongest first; absent ones at 0."""
    wanted = required.join(held, ["candidate_id", "skill"], "left_semi").distinct().join(evidence, ["candidate_id", "skill"], "left")
    full = wanted.withColumns({"grounding": F.coalesce("grounding", F.lit(0.0)), "kind": F.coalesce("kind", F.lit(ABSENT)), "evidence": F.coalesce("evidence", F.lit("")), "similarity": F.coalesce("similarity", F.lit(0.0))})
    return full.orderBy("candidate_id", F.desc("grounding"), "skill")
