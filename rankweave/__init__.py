"""Explainable document ranking on Spark DataFrames."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

#: Public names and where they live; loaded when first asked for, so that workers import little.
_NAMES = {
    "AntiGamingConfig": "config", "DEFAULT_ANTIGAMING": "config", "DEFAULT_GATE": "config", "DEFAULT_GROUNDING": "config", "DEFAULT_WEIGHTS": "config", "GroundingConfig": "config", "PrerequisiteGate": "config", "ScoringWeights": "config", "WeightError": "config",
    "DegreeLevel": "schemas", "GapStatus": "schemas", "Bm25Ranker": "operators.rankers", "DenseRanker": "operators.rankers", "FusionRanker": "operators.rankers", "TfidfRanker": "operators.rankers", "reciprocal_rank_fusion": "operators.rankers",
    "SkillOntology": "operators.ontology", "get_ontology": "operators.ontology", "HybridRanker": "plans.pipeline", "build_job": "plans.pipeline", "build_jobs": "plans.pipeline", "build_resumes": "plans.pipeline",
    "load_resume_uploads": "plans.pipeline", "load_resumes": "plans.pipeline", "screen": "plans.pipeline", "screen_files": "plans.pipeline",
}

__all__ = ["__version__", *sorted(_NAMES)]


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_NAMES[name]}"), name)
