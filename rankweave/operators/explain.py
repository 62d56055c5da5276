"""Explanations of ranked rows: a fixed template as one Column, and a plug-in point for hosted writers."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.config import DEFAULT_WEIGHTS, ScoringWeights
from rankweave.schemas import degree_label, display_name


def load_env(path: str | Path) -> None:
    """KEY=value lines into the environment; what is set already stays."""
    if not Path(path).is_file():
        return
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and key and not key.startswith("#"):
            os.environ.setdefault(key.strip(), value.strip().strip("\"'"))


def bar(value: Column, width: int = 20) -> Column:
    full = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


class Explainer(Protocol):
    def available(self) -> bool: ...

    def explain(self, ranked: DataFrame) -> DataFrame: ...


def _rows(weights: ScoringWeights) -> list[Column]:
    s, c = F.col("scores"), F.col
    years = F.format_string("%.1f yrs", c("years_experience"))
    notes = {
        "semantic": ("Semantic fit", F.lit("similarity to the job description")),
        "skill": ("Skill coverage", F.when(c("n_items") > 0, F.format_string("%d/%d requirements met", F.size("matched"), c("n_items"))).otherwise("no skills asked for")),
        "experience": ("Experience", F.when(c("min_years") > 0, F.concat(years, F.format_string(" of %.1f asked", c("min_years")))).otherwise(F.concat(years, F.lit(", no minimum stated")))),
        "education": ("Education", F.concat(degree_label(c("degree")), F.lit(", asked: "), degree_label(c("min_degree")))),
    }
    out = []
    for name, (label, note) in notes.items():
        w, v = getattr(weights, name), s.getField(name)
        out.append(F.concat(F.lit(f"  {label:<15} "), bar(v), F.format_string(f" %.3f x {w:.2f} = %.3f   ", v, F.lit(w) * v), note))
    return out


@dataclass(frozen=True)
class TemplateExplainer:
    """Rows with scores, candidate_id, name, rank, n_items, matched, transferable ("skill via held"), missing, flags, focus (string arrays),
    years_experience, min_years, degree, min_degree; adds ``explanation`` and, as JSON, ``facts``."""

    weights: ScoringWeights = DEFAULT_WEIGHTS

    def available(self) -> bool:
        return True

    def text(self) -> Column:
        s, c = F.col("scores"), F.col
        listed = lambda label, name, sep: F.when(F.size(name) > 0, F.concat(F.lit(f"  {label} ("), F.size(name).cast("string"), F.lit("): "), F.array_join(name, sep)))
        head = F.concat(F.lit("Rank #"), c("rank").cast("string"), F.lit(" - "), display_name(c("name"), c("candidate_id")), F.format_string(" - overall %.3f", s.getField("total")))
        gate = F.when(s.getField("gate") < 1, F.format_string("  Prerequisite    gate x%.2f, %.0f%% of required skills held", s.getField("gate"), s.getField("required_coverage") * 100))
        docked = F.when(s.getField("penalty") > 0, F.format_string("  Anti-gaming     penalty -%.3f", s.getField("penalty")))
        flags = F.when(F.size("flags") > 0, F.concat(F.lit("\n  INTEGRITY FLAGS:\n    - "), F.array_join("flags", "\n    - ")))
        focus = F.when(F.size("focus") > 0, F.concat(F.lit("\n  Interview focus: "), F.array_join("focus", ", ")))
        return F.concat_ws("\n", head, F.lit(""), *_rows(self.weights), gate, docked, F.lit(""), listed("Matched", "matched", ", "), listed("Transferable", "transferable", "; "), listed("Missing", "missing", ", "), flags, focus)

    def facts(self) -> Column:
        s, c = F.col("scores"), F.col
        r = lambda x: F.round(x, 4)
        names = ("semantic", "skill", "experience", "education")
        return F.to_json(
            F.struct(
                display_name(c("name"), c("candidate_id")).alias("candidate"), c("rank"), c("job_title"), r(s.getField("total")).alias("total_score"),
                F.struct(*[r(s.getField(n)).alias(n) for n in names]).alias("sub_scores"), F.struct(*[r(F.lit(getattr(self.weights, n)) * s.getField(n)).alias(n) for n in names]).alias("weighted_contributions"),
                r(s.getField("penalty")).alias("penalty"), r(s.getField("required_coverage")).alias("required_skill_coverage"), r(s.getField("gate")).alias("prerequisite_gate"),
                c("years_experience").alias("experience_years"), c("min_years").alias("experience_required"), degree_label(c("degree")).alias("degree"), degree_label(c("min_degree")).alias("degree_required"),
                c("matched").alias("matched_skills"), c("transferable").alias("transferable_skills"), c("missing").alias("missing_skills"), c("flags").alias("gaming_flags"),
            )
        )

    def explain(self, ranked: DataFrame) -> DataFrame:
        return ranked.withColumns({"facts": self.facts(), "explanation": self.text()})


@dataclass(frozen=True)
class HostedExplainer:
    """A chat endpoint of the usual JSON form that writes prose from the facts, never from texts; the template on any failure."""

    endpoint: str = ""
    model: str = ""
    key_variable: str = "EXPLAINER_API_KEY"
    system: str = "Explain this ranking to a recruiter in one paragraph. Use only the facts given."
    timeout: float = 60.0
    attempts: int = 3  # calls a row at most; a second, then two between them, and only after an answer that may pass (429 or 5xx) or none
    form: str = "chat"  # or "messages": the system text beside the messages, the answer as a list of parts
    template: TemplateExplainer = field(default_factory=TemplateExplainer)

    def available(self) -> bool:
        return bool(self.endpoint and os.environ.get(self.key_variable))

    def request(self, user: str, key: str) -> urllib.request.Request:
        asked = {"role": "user", "content": user}
        if self.form == "messages":
            body, headers = {"model": self.model, "system": self.system, "max_tokens": 600, "messages": [asked]}, {"x-api-key": key}
        else:
            body, headers = {"model": self.model, "messages": [{"role": "system", "content": self.system}, asked]}, {"Authorization": f"Bearer {key}"}
        return urllib.request.Request(self.endpoint, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)

    def text_of(self, answer: dict) -> str:
        return "".join(part.get("text", "") for part in answer["content"]) if self.form == "messages" else answer["choices"][0]["message"]["content"]

    def complete(self, user: str, key: str) -> str:
        for turn in range(self.attempts):
            try:
                with urllib.request.urlopen(self.request(user, key), timeout=self.timeout) as answer:
                    return self.text_of(json.load(answer))
            except urllib.error.HTTPError as e:
                if turn + 1 == self.attempts or e.code != 429 and e.code < 500:
                    raise
            except OSError:
                if turn + 1 == self.attempts:
                    raise
            time.sleep(1 << turn)
        return ""

    def explain(self, ranked: DataFrame) -> DataFrame:
        """For the few rows of a top k: one call a row on the executors."""
        rows, key, this = self.template.explain(ranked), os.environ.get(self.key_variable, ""), self
        if not self.available():
            return rows

        @F.pandas_udf("string")
        def write(facts: pd.Series, fallback: pd.Series) -> pd.Series:
            def one(f: str, t: str) -> str:
                try:
                    return this.complete(f, key) or t
                except (urllib.error.URLError, OSError, ValueError, KeyError, IndexError):
                    return t

            return pd.Series([one(f, t) for f, t in zip(facts, fallback, strict=True)])

        return rows.withColumn("explanation", write("facts", "explanation"))


def available_backends() -> dict[str, bool]:
    return {"template": True, "hosted": get_explainer("hosted").available()}


def get_explainer(name: str = "auto", **options) -> TemplateExplainer | HostedExplainer:
    if name == "template":
        return TemplateExplainer(**options)
    settings = {"endpoint": os.environ.get("EXPLAINER_ENDPOINT", ""), "model": os.environ.get("EXPLAINER_MODEL", "")} | options
    if name == "hosted":
        return HostedExplainer(**settings)
    if name == "auto":
        hosted = HostedExplainer(**{k: v for k, v in settings.items() if k != "weights"})
        return hosted if hosted.available() else TemplateExplainer(**{k: v for k, v in options.items() if k == "weights"})
    raise ValueError(f"no explainer {name!r}: auto, template or hosted")


def explain_top(ranked: DataFrame, k: int = 5, explainer: Explainer | None = None) -> Iterator[str]:
    """Explanations of the rows of rank k or better; the filter stands below the writing."""
    rows = (explainer or TemplateExplainer()).explain(ranked.filter(F.col("rank") <= k))
    return (r.explanation for r in rows.orderBy("job_id", "rank").select("explanation").toLocalIterator())
