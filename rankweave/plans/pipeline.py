"""Files or tables to ranked, explained rows: resumes and jobs built column by column, then one pass over all pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.config import DEFAULT_ANTIGAMING, DEFAULT_GATE, DEFAULT_GROUNDING, DEFAULT_WEIGHTS, AntiGamingConfig, GroundingConfig, PrerequisiteGate, ScoringWeights
from rankweave.functions import text as tx
from rankweave.functions.vectors import chunk_text, cosine, hashed_vector, mean_pool
from rankweave.operators import audit, gap, grounding, integrity, scoring
from rankweave.operators.dictionary import add_matches
from rankweave.operators.embedder import Embedder as StoredEmbedder
from rankweave.operators.explain import TemplateExplainer
from rankweave.operators.ontology import SkillOntology
from rankweave.operators.rankers import _small, rank
from rankweave.operators.skills import extract_skills, trusted_text
from rankweave.runtime import materialize
from rankweave.schemas import degree_label, display_name, section
from rankweave.sources.files import load_files, load_uploads, stem

#: Text column -> vector column. Models plug in as a pandas UDF of the same form, or as an ``embedder.Embedder``, whose store keeps their vectors.
Embedder = Callable[[Column], Column] | StoredEmbedder

#: Spellings past which texts are walked by an automaton: an alternation tries each spelling at each place.
AUTOMATON_FROM = 1_000


def _as_of(spark: SparkSession, as_of: int | None) -> Column:
    """The month index of "present": today's, unless given."""
    return F.lit(as_of) if as_of is not None else F.year(F.current_date()) * 12 + F.month(F.current_date())


def build_resumes(documents: DataFrame, ontology: SkillOntology, as_of: int | None = None, candidate_id: Column | None = None) -> DataFrame:
    """Documents (path, text, spans, page_backgrounds) with all that is read from their text."""
    now = _as_of(documents.sparkSession, as_of)
    first = lambda name: F.coalesce(F.nullif(section(F.col("sections"), name), F.lit("")), F.col("text"))
    rows = documents.withColumn("candidate_id", candidate_id if candidate_id is not None else stem(F.col("path"))).withColumn("sections", tx.segment_sections(F.col("text")))
    if len(ontology.alias_index) > AUTOMATON_FROM:
        rows = add_matches(rows, "text", list(ontology.alias_index), "_matches")
        rows = rows.withColumn("skills", extract_skills(F.col("text"), ontology, trusted_text(F.col("sections")), F.col("_matches"))).drop("_matches")
    else:
        rows = rows.withColumn("skills", extract_skills(F.col("text"), ontology, trusted_text(F.col("sections"))))
    return rows.withColumns(
        {
            "name": tx.person_name(F.col("text")), "email": tx.email(F.col("text")), "phone": tx.phone(F.col("text")), "skills_expanded": ontology.expand_column(F.col("skills")),
            "years_experience": tx.experience_years(first("experience"), now), "degree": tx.degree(first("education")), "experience_entries": tx.experience_entries(section(F.col("sections"), "experience"), now),
        }
    )


def build_jobs(texts: DataFrame, ontology: SkillOntology) -> DataFrame:
    """(job_id, text) and, where given, title, min_years, min_degree: what is given wins over what the text says."""
    given = lambda name, kind: F.col(name).cast(kind) if name in texts.columns else F.lit(None).cast(kind)
    parts = texts.withColumn("_parts", tx.split_required_preferred(F.col("text")))
    required = extract_skills(F.col("_parts.required"), ontology, F.col("text"))
    preferred = F.array_except(extract_skills(F.col("_parts.preferred"), ontology, F.col("text")), F.col("required"))
    first_line = F.left(F.coalesce(F.get(F.filter(F.transform(tx.lines(F.col("text")), tx.strip), lambda x: x != ""), F.lit(0)), F.lit("")), F.lit(80))
    rows = parts.withColumn("required", required).withColumn("preferred", preferred)
    years = F.coalesce(given("min_years", "double"), F.regexp_extract(tx.text_or_empty(F.col("text")), tx.MIN_YEARS, 1).try_cast("double"), F.lit(0.0))
    return rows.select(
        "job_id", F.coalesce(F.nullif(given("title", "string"), F.lit("")), first_line).alias("title"), "text", "required", "preferred", ontology.expand_column(F.col("required")).alias("required_expanded"),
        years.alias("min_years"), F.coalesce(given("min_degree", "int"), tx.degree(F.col("text"))).alias("min_degree"),
    )


def encode_documents(rows: DataFrame, key: str, text: Column, embedder: Embedder = hashed_vector, out: str = "vector") -> DataFrame:
    """(key, out): each text's chunks encoded and pooled; texts without words have none, or zeros from a stored embedder."""
    if isinstance(embedder, StoredEmbedder):
        return embedder.encode_documents(rows, key, text, out)
    chunks = rows.select(key, F.explode(chunk_text(text)).alias("chunk")).select(key, embedder(F.col("chunk")).alias("v"))
    return mean_pool(chunks, key, "v", out)


@dataclass(frozen=True)
class HybridRanker:
    """Dense similarity, skills, experience and education, gated, less the integrity penalty."""

    ontology: SkillOntology
    weights: ScoringWeights = DEFAULT_WEIGHTS
    antigaming: AntiGamingConfig = DEFAULT_ANTIGAMING
    skill_method: str = "coverage"
    use_antigaming: bool = True
    gate: PrerequisiteGate = DEFAULT_GATE
    anonymise: bool = False
    grounding: GroundingConfig = DEFAULT_GROUNDING
    embedder: Embedder = hashed_vector

    def evidence(self, resumes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(evidence of each candidate's skills, sentences)."""
        said = resumes.select("candidate_id", F.posexplode(tx.sentences(tx.narrative(F.col("sections"), F.col("text")))).alias("pos", "sentence")).withColumn("vector", self.embedder(F.col("sentence")))
        claims = resumes.select("candidate_id", F.explode("skills_expanded").alias("skill"))
        head, _, tail = self.grounding.query_template.partition("{skill}")
        asked = claims.select("skill").distinct().withColumn("vector", self.embedder(F.concat(F.lit(head), F.replace("skill", F.lit("-"), F.lit(" ")), F.lit(tail))))
        claims = claims.join(F.broadcast(materialize(asked, "asked")), "skill")  # an ontology's names: each is encoded once, not once a candidate
        return grounding.ground_skills(claims, said, grounding.forms_table(self.ontology, resumes.sparkSession), self.grounding), said

    def _signals(self, pairs: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
        """Adds ``integrity``: signals, penalty, flagged."""
        cfg, c = self.antigaming, F.col
        stats = integrity.corpus_stats(resumes, integrity.skill_density(c("skills"), c("text")))
        terms = integrity.top_terms(resumes, "candidate_id", "text", cfg).select("candidate_id", "n_content", "term", F.col("n").alias("term_n"))
        echo = integrity.echo_pairs(resumes.select("candidate_id", "text"), jobs.select("job_id", "text"), cfg).select("candidate_id", "job_id", "ratio")
        story = F.concat_ws(" ", *[section(c("sections"), s) for s in ("experience", "projects", "summary")])
        parts = resumes.select("candidate_id", section(c("sections"), "skills").alias("listed"), story.alias("story"))
        both = encode_documents(parts, "candidate_id", c("listed"), self.embedder, "listed_v").join(encode_documents(parts, "candidate_id", c("story"), self.embedder, "story_v"), "candidate_id")
        each = resumes.crossJoin(stats).join(terms, "candidate_id", "left").join(both, "candidate_id", "left").join(parts, "candidate_id")  # one row of statistics
        hidden = integrity.invisible_text(c("spans"), c("page_backgrounds"), cfg) if {"spans", "page_backgrounds"} <= set(resumes.columns) else integrity.quiet("invisible_text")
        signals = each.select(
            "candidate_id", hidden.alias("s1"), integrity.skill_density_signal(c("skills"), c("text"), c("density_mean"), c("density_std"), c("usable"), cfg).alias("s2"), integrity.repetition_signal(c("n_content"), c("term"), c("term_n"), cfg).alias("s3"),
            integrity.incoherence_signal(F.size(tx.tokens(c("listed"))), F.size(tx.tokens(c("story"))), c("listed_v"), c("story_v"), cfg).alias("s5"),
        )
        asked = F.size(tx.trigrams(tx.tokens(c("job_text")))) >= cfg.jd_echo_min_trigrams
        rows = pairs.join(signals, "candidate_id").join(echo, ["candidate_id", "job_id"], "left")
        s4 = integrity.jd_echo_signal(F.when(asked, F.coalesce("ratio", F.lit(0.0))), cfg)
        rows = materialize(rows, "signals")
        return rows.withColumn("integrity", integrity.report([c("s1"), c("s2"), c("s3"), s4, c("s5")], cfg)).drop("s1", "s2", "s3", "s5", "ratio")

    def rank_detailed(self, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
        """A row a pair: scores, integrity, gap arrays, rank. Resumes and jobs as ``build_resumes`` and ``build_jobs`` give them; a ``vector`` they carry is used."""
        c = F.col
        # Both are read many times below; what was extracted from texts is written once.
        resumes, jobs = materialize(resumes, "resumes"), materialize(jobs, "jobs")
        read = audit.anonymise(c("sections"), c("text"), c("name")) if self.anonymise else c("text")
        if "vector" not in resumes.columns:
            resumes = resumes.join(encode_documents(resumes, "candidate_id", read, self.embedder), "candidate_id", "left")
        if "vector" not in jobs.columns:
            jobs = jobs.join(encode_documents(jobs, "job_id", c("text"), self.embedder), "job_id", "left")
        wanted = jobs.select("job_id", c("title").alias("job_title"), c("text").alias("job_text"), "required", "preferred", "min_years", "min_degree", c("vector").alias("job_vector"))
        wanted = F.broadcast(wanted) if _small(jobs, 2_000) else wanted
        kept = ["candidate_id", "name", "skills", "skills_expanded", "years_experience", "degree", "vector"]
        pairs = resumes.select(*kept).crossJoin(wanted)  # jobs are a stated query set: every candidate is scored for each
        if self.use_antigaming:
            pairs = self._signals(pairs, resumes, jobs)
        else:
            pairs = pairs.withColumn("integrity", integrity.report([integrity.quiet(n) for n in integrity.SIGNALS], self.antigaming))
        strengths = None
        if self.skill_method == "grounded":
            found, _ = self.evidence(resumes)
            pairs, strengths = pairs.join(materialize(grounding.strengths(found), "strengths"), "candidate_id", "left"), c("strengths")
            strengths = F.coalesce(strengths, F.create_map().cast("map<string,double>"))
        semantic = F.coalesce(cosine(c("vector"), c("job_vector")), F.lit(0.0))
        scored = scoring.score_pairs(pairs, self.weights, self.gate, self.skill_method, self.grounding, semantic, c("integrity.penalty"), strengths)
        ranked = rank(scored.withColumn("total", c("scores.total")), "total")
        return ranked.drop("vector", "job_vector", "job_text", "strengths")

    def score_all(self, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
        return self.rank_detailed(resumes, jobs).select("job_id", "candidate_id", c_total().alias("score"))


def c_total() -> Column:
    return F.col("scores").getField("total")


def add_gaps(ranked: DataFrame, ontology: SkillOntology) -> DataFrame:
    """Ranked rows with matched, transferable, missing, focus, flags and n_items, as the explainers read them."""
    spark, key = ranked.sparkSession, ["job_id", "candidate_id"]
    wanted = gap.requirements(ranked.select("job_id", "required", "preferred").distinct())
    held = ranked.select("candidate_id", F.explode("skills").alias("skill")).distinct()
    wide = ranked.select("candidate_id", F.explode("skills_expanded").alias("skill")).distinct()
    items = gap.analyse(ranked.select(*key), wanted, held, wide, ontology.path_table(spark))
    listed = lambda status, value: F.array_sort(F.collect_list(F.when(F.col("status") == status, value)))
    missing = F.concat("skill", F.when(F.col("required"), " (required)").otherwise(""))
    per = items.groupBy(*key).agg(listed("matched", F.col("skill")).alias("matched"), listed("transferable", F.concat_ws(" via ", "skill", "via")).alias("transferable"), listed("missing", missing).alias("missing"), F.count("*").alias("n_items"))
    focus = gap.upskill_priorities(items, 3).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "skill"))), lambda x: x.getField("skill")).alias("focus"))
    none = F.array().cast("array<string>")
    out = ranked.join(per, key, "left").join(focus, key, "left")
    flags = F.transform(F.filter("integrity.signals", lambda s: s.getField("triggered")), lambda s: F.concat_ws(": ", s.getField("name"), s.getField("evidence")))
    return out.withColumns({n: F.coalesce(n, none) for n in ("matched", "transferable", "missing", "focus")}).withColumns({"n_items": F.coalesce("n_items", F.lit(0)), "flags": flags})


def load_resumes(spark: SparkSession, paths: str | Sequence[str], ontology: SkillOntology, skip_errors: bool = True, as_of: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(resumes, failures)."""
    documents, failures = load_files(spark, paths, skip_errors=skip_errors)
    return build_resumes(documents, ontology, as_of), failures


def load_resume_uploads(spark: SparkSession, uploads: Sequence[tuple[str, bytes]], ontology: SkillOntology, skip_errors: bool = True, as_of: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for files in memory; a candidate's id is the whole file name."""
    documents, failures = load_uploads(spark, uploads, skip_errors)
    return build_resumes(documents, ontology, as_of, F.col("path")), failures


def build_job(spark: SparkSession, text: str, ontology: SkillOntology, title: str = "", min_years: float | None = None, min_degree: int | None = None) -> DataFrame:
    row = [("job", title, text, min_years, min_degree)]
    return build_jobs(spark.createDataFrame(row, "job_id string, title string, text string, min_years double, min_degree int"), ontology)


def screen(resumes: DataFrame, jobs: DataFrame, ontology: SkillOntology, explainer=None, explain_top_k: int = 5, **settings) -> DataFrame:
    """Ranked rows; with an explainer, an ``explanation`` for the first ``explain_top_k`` of each job and null below."""
    ranked = HybridRanker(ontology, **settings).rank_detailed(resumes, jobs)
    if explainer is None or explain_top_k <= 0:
        return ranked
    ranked = materialize(ranked, "ranked")
    top = explainer.explain(add_gaps(ranked.filter(F.col("rank") <= explain_top_k), ontology)).select("job_id", "candidate_id", "explanation", "facts")
    return ranked.join(top, ["job_id", "candidate_id"], "left")


def dashboard(ranked: DataFrame) -> DataFrame:
    """The twelve columns that a ranking is shown with, and its job."""
    c = F.col
    part = {n: c(f"scores.{n}") for n in ("semantic", "skill", "experience", "education", "required_coverage", "penalty")}
    shown = {"position": c("rank"), "candidate": display_name(c("name"), c("candidate_id")), "score": c("total"), **part}
    shown |= {"flagged": F.when(c("integrity.flagged"), "YES").otherwise(""), "years": c("years_experience"), "degree": degree_label(c("degree"))}
    return ranked.select("job_id", *[column.alias(name) for name, column in shown.items()])


def screen_files(spark: SparkSession, paths: str | Sequence[str], job_text: str, ontology: SkillOntology, job_title: str = "", **settings) -> tuple[DataFrame, DataFrame]:
    """(ranked rows, failures) from files and a job's text."""
    resumes, failures = load_resumes(spark, paths, ontology)
    return screen(resumes, build_job(spark, job_text, ontology, job_title), ontology, **settings), failures


def rankers(ontology: SkillOntology) -> dict[str, HybridRanker]:
    """The hybrid systems that studies compare."""
    shut = PrerequisiteGate(enabled=False)
    return {
        "hybrid": HybridRanker(ontology), "hybrid_dice": HybridRanker(ontology, skill_method="dice"), "hybrid_grounded": HybridRanker(ontology, skill_method="grounded"),
        "hybrid_no_gate": HybridRanker(ontology, gate=shut), "hybrid_no_antigaming": HybridRanker(ontology, use_antigaming=False),
    }


__all__ = ["HybridRanker", "TemplateExplainer", "build_job", "build_jobs", "build_resumes", "load_resume_uploads", "load_resumes", "screen", "screen_files"]
