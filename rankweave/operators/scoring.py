"""Sub-scores and their combination, as Column expressions over rows of a candidate and a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.config import DEFAULT_GATE, DEFAULT_GROUNDING, DEFAULT_WEIGHTS, PREFERRED_WEIGHT, GroundingConfig, PrerequisiteGate, ScoringWeights
from rankweave.functions.vectors import clamp, cosine

COMPONENTS = ("semantic", "skill", "experience", "education")


def semantic_score(candidate: Column, job: Column) -> Column:
    return cosine(candidate, job)


def dice_score(held: Column, required: Column) -> Column:
    """Twice the common skills over all skills; 0 for two empty sets."""
    both = F.size(F.array_intersect(held, required))
    return F.coalesce(F.try_divide(F.lit(2.0) * both, F.size(F.array_distinct(held)) + F.size(F.array_distinct(required))), F.lit(0.0))


def coverage_score(held: Column, required: Column, preferred: Column, weight: float = PREFERRED_WEIGHT) -> Column:
    """Share of what is asked for, preferred skills at ``weight``; 1 where nothing is asked."""
    wished = F.array_except(preferred, required)
    met = F.size(F.array_intersect(required, held)) + F.lit(weight) * F.size(F.array_intersect(wished, held))
    asked = F.size(F.array_distinct(required)) + F.lit(weight) * F.size(wished)
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(met, asked), F.lit(1.0)))


def required_coverage(held: Column, required: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(required, held)).cast("double"), F.size(F.array_distinct(required))), F.lit(1.0))


def grounded_coverage(held: Column, required: Column, preferred: Column, strengths: Column | None, config: GroundingConfig = DEFAULT_GROUNDING, weight: float = PREFERRED_WEIGHT) -> Column:
    """Coverage where a met skill earns floor + (1 - floor) * strength; ``strengths``: map of skill to strength, None for plain coverage."""
    if strengths is None:
        return coverage_score(held, required, preferred, weight)
    wished = F.array_except(preferred, required)
    credit = lambda s: F.when(F.array_contains(held, s), F.lit(config.floor) + F.lit(1 - config.floor) * F.coalesce(F.try_element_at(strengths, s), F.lit(0.0))).otherwise(0.0)
    earned = lambda skills: F.aggregate(skills, F.lit(0.0), lambda a, s: a + credit(s))
    asked = F.size(F.array_distinct(required)) + F.lit(weight) * F.size(wished)
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(earned(F.array_distinct(required)) + F.lit(weight) * earned(wished), asked), F.lit(1.0)))


def skill_score(held: Column, required: Column, preferred: Column, method: str = "coverage", strengths: Column | None = None, config: GroundingConfig = DEFAULT_GROUNDING) -> Column:
    if method == "dice":
        return dice_score(held, required)
    if method == "grounded":
        return grounded_coverage(held, required, preferred, strengths, config)
    if method == "coverage":
        return coverage_score(held, required, preferred)
    raise ValueError(f"no skill method {method!r}: coverage, dice or grounded")


def experience_score(held: Column, required: Column) -> Column:
    return F.when(required <= 0, 1.0).when(held <= 0, 0.0).when(held >= required, 1.0).otherwise(held / required)


def education_score(held: Column, required: Column) -> Column:
    return F.when(required <= 0, 1.0).when(held <= 0, 0.0).when(held >= required, 1.0).otherwise(held.cast("double") / required)


def gate_multiplier(coverage: Column, gate: PrerequisiteGate = DEFAULT_GATE) -> Column:
    if not gate.enabled:
        return F.lit(1.0)
    return F.lit(gate.floor) + F.lit(1 - gate.floor) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), coverage) / F.lit(gate.threshold))


def combine(semantic: Column, skill: Column, experience: Column, education: Column, penalty: Column | float = 0.0, weights: ScoringWeights = DEFAULT_WEIGHTS, gate: Column | float = 1.0, coverage: Column | float = 1.0) -> Column:
    """The eight sub-scores as a struct; the penalty comes off after the gate."""
    column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    parts = dict(zip(COMPONENTS, (semantic, skill, experience, education), strict=True))
    weighed = sum((F.lit(getattr(weights, name)) * part for name, part in parts.items()), F.lit(0.0))
    total = clamp(weighed * column(gate) - column(penalty))
    return F.struct(*[p.alias(n) for n, p in parts.items()], column(penalty).alias("penalty"), total.alias("total"), column(gate).alias("gate"), column(coverage).alias("required_coverage"))


def score_pairs(
    pairs: DataFrame, weights: ScoringWeights = DEFAULT_WEIGHTS, gate: PrerequisiteGate = DEFAULT_GATE, skill_method: str = "coverage", grounding: GroundingConfig = DEFAULT_GROUNDING,
    semantic: Column | None = None, penalty: Column | None = None, strengths: Column | None = None,
) -> DataFrame:
    """Rows of skills_expanded, years_experience, degree, required, preferred, min_years, min_degree (and vector, job_vector) with a struct ``scores``."""
    c = F.col
    coverage = required_coverage(c("skills_expanded"), c("required"))
    scores = combine(
        semantic if semantic is not None else semantic_score(c("vector"), c("job_vector")),
        skill_score(c("skills_expanded"), c("required"), c("preferred"), skill_method, strengths, grounding),
        experience_score(c("years_experience"), c("min_years")), education_score(c("degree"), c("min_degree")),
        penalty if penalty is not None else 0.0, weights, gate_multiplier(coverage, gate), coverage,
    )
    return pairs.withColumn("scores", scores)


def contributions(scores: Column, weights: ScoringWeights = DEFAULT_WEIGHTS) -> Column:
    """Weight times sub-score of each component. Their sum is the total plus the penalty only where the gate is open and nothing is clamped."""
    return F.struct(*[(F.lit(getattr(weights, n)) * scores.getField(n)).alias(n) for n in COMPONENTS])


# The same measures from counts of common and of asked skills, as bit sets give them.


def dice_of(common: Column, held: Column, required: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0) * common, held + required), F.lit(0.0))


def coverage_of(met_required: Column, met_preferred: Column, required: Column, preferred: Column, weight: float = PREFERRED_WEIGHT) -> Column:
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(met_required + F.lit(weight) * met_preferred, required + F.lit(weight) * preferred), F.lit(1.0)))


def required_coverage_of(met: Column, required: Column) -> Column:
    return F.coalesce(F.try_divide(met.cast("double"), required), F.lit(1.0))
