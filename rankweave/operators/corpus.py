"""A labelled synthetic corpus: resumes by role and tier, attacked copies with their controls, jobs and graded labels.

Rows come from a hash of (seed, role, tier, index), so any part can be made again on any executor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import let, lines, strip

DEGREES = ("None", "Associate", "Bachelor", "Master", "Doctorate")
TIERS = {3: 4, 2: 5, 1: 5}
ATTACKS = ("keyword_block", "hidden_text", "repetition")
MIN_LENGTH_RATIO = 0.55
REQUIRED_SECTIONS = ("SUMMARY", "EXPERIENCE", "SKILLS")


@dataclass(frozen=True)
class Role:
    key: str
    title: str
    required: tuple[str, ...]
    preferred: tuple[str, ...]
    min_years: int
    min_degree: str
    adjacent: tuple[str, ...] = ()


ROLES = (
    Role("backend", "Backend Engineer", ("python", "sql", "docker", "rest-api", "postgresql"), ("kubernetes", "redis", "aws"), 4, "Bachelor", ("devops", "data")),
    Role("devops", "DevOps Engineer", ("docker", "kubernetes", "linux", "terraform", "aws"), ("python", "ansible"), 4, "Bachelor", ("backend",)),
    Role("data", "Data Engineer", ("python", "sql", "airflow", "etl", "postgresql"), ("kafka", "aws"), 3, "Bachelor", ("backend", "ml")),
    Role("ml", "Machine Learning Engineer", ("python", "machine-learning", "pytorch", "numpy", "sql"), ("docker", "tensorflow"), 3, "Master", ("data",)),
    Role("frontend", "Frontend Engineer", ("javascript", "react", "html", "css", "typescript"), ("testing", "graphql"), 2, "Bachelor", ()),
)


def shift_degree(base: str, delta: int) -> str:
    return DEGREES[min(len(DEGREES) - 1, max(0, DEGREES.index(base) + delta))]


def job_text(role: Role) -> str:
    asked = [f"- {role.min_years}+ years of professional experience", *[f"- Hands-on {s}" for s in role.required], f"- {role.min_degree} degree or equivalent"]
    return "\n".join([role.title, "", f"We look for a {role.title}.", "", "Requirements:", *asked, "", "Preferred:", *[f"- Experience with {s}" for s in role.preferred], "", "You build and run systems with a small team."])


def jobs(spark: SparkSession, roles: tuple[Role, ...] = ROLES) -> DataFrame:
    rows = [(r.key, r.title, job_text(r), list(r.required), list(r.preferred), float(r.min_years), DEGREES.index(r.min_degree)) for r in roles]
    return spark.createDataFrame(rows, "job_id string, title string, text string, required array<string>, preferred array<string>, min_years double, min_degree int")


def resumes(spark: SparkSession, seed: int = 7, copies: int = 1, roles: tuple[Role, ...] = ROLES) -> DataFrame:
    """candidate_id, role, tier, name, years, degree, skills, text, hidden, stuffed, attack, control_id; ``copies`` times the usual number."""
    rows = [(r.key, r.title, tier, list(r.required), list(r.preferred), r.min_years, r.min_degree, n * copies) for r in roles for tier, n in TIERS.items()]
    base = spark.createDataFrame(rows, "role string, title string, tier int, required array<string>, preferred array<string>, min_years int, min_degree string, n int")
    base = base.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("index"))
    draw = lambda what, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "role", "tier", "index"), F.lit(n)).cast("int")
    share = F.element_at(F.create_map(*[F.lit(x) for x in (3, 1.0, 2, 0.6, 1, 0.3)]), F.col("tier"))
    years = F.greatest(F.lit(0), F.col("min_years") + F.when(F.col("tier") == 3, 1 + draw("years", 4)).when(F.col("tier") == 2, draw("years", 2) - 1).otherwise(-draw("years", 3) - 1))
    skills = F.slice(F.col("required"), F.lit(1), F.greatest(F.lit(1), F.ceil(F.size("required") * share).cast("int")))
    skills = F.when(F.col("tier") == 3, F.concat(skills, F.slice("preferred", F.lit(1), F.lit(1)))).otherwise(skills)
    first, last = ("Alex", "Sam", "Robin", "Kim", "Jo", "Chris", "Dana"), ("Berg", "Costa", "Dahl", "Evans", "Fontaine", "Greco", "Haas")
    pick = lambda names, what: F.element_at(F.array(*map(F.lit, names)), draw(what, len(names)) + 1)
    level = F.array_position(F.array(*map(F.lit, DEGREES)), F.col("min_degree")).cast("int") - F.when(F.col("tier") == 1, 1).otherwise(0)
    made = base.select(
        F.format_string("%s_t%d_%03d", "role", "tier", "index").alias("candidate_id"), "role", "title", "tier", F.concat_ws(" ", pick(first, "first"), pick(last, "last")).alias("name"),
        years.cast("double").alias("years"), F.element_at(F.array(*map(F.lit, DEGREES)), F.greatest(level, F.lit(1))).alias("degree"), skills.alias("skills"),
    )
    body = F.concat_ws(
        "\n", "name", F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("."))), F.lit("@example.com")), F.lit(""), F.lit("SUMMARY"), F.concat("title", F.format_string(" with %.0f years of practice.", "years")), F.lit(""),
        F.lit("EXPERIENCE"), F.concat("title", F.lit(" at Example Works, Jan "), (2024 - F.col("years").cast("int")).cast("string"), F.lit(" - Dec 2023")),
        F.array_join(F.transform("skills", lambda s: F.concat(F.lit("- Delivered services with "), F.replace(s, F.lit("-"), F.lit(" ")), F.lit(" for several teams."))), "\n"),
        F.lit(""), F.lit("EDUCATION"), F.concat("degree", F.lit(" degree, Example University")), F.lit(""), F.lit("SKILLS"), F.array_join("skills", ", "),
    )
    none = F.lit(None).cast("string")
    return made.select("*", body.alias("text"), F.lit("").alias("hidden"), F.lit(False).alias("stuffed"), F.lit("none").alias("attack"), none.alias("control_id"))


def attack_columns(attack: Column, text: Column, keywords: Column, term: Column, target_text: Column) -> tuple[Column, Column]:
    """(visible, hidden) text after an attack: keywords appended three times, a job pasted out of sight, or one term 25 times."""
    block = F.array_join(F.array_repeat(F.array_join(keywords, ", "), 3), ", ")
    visible = F.when(attack == "keyword_block", F.concat(text, F.lit("\n\nADDITIONAL SKILLS\n"), block)).when(attack == "repetition", F.concat(text, F.lit("\n\nCORE COMPETENCIES\n"), F.array_join(F.array_repeat(term, 25), " "))).otherwise(text)
    return visible, F.when(attack == "hidden_text", target_text).otherwise("")


def attacked(base: DataFrame, job_rows: DataFrame, per_attack: int = 3) -> DataFrame:
    """Copies of low-tier resumes, ``per_attack`` of each role and attack, each with the id of its control."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("role").orderBy("candidate_id"))
    chosen = base.filter("tier = 1 AND NOT stuffed").withColumn("turn", turn).filter(F.col("turn") <= per_attack).drop("turn", "attack")
    rows = chosen.withColumn("attack", F.explode(F.array(*map(F.lit, ATTACKS))))
    wanted = job_rows.select(F.col("job_id").alias("role"), F.concat("required", "preferred").alias("keywords"), F.get("required", F.lit(0)).alias("term"), F.col("text").alias("target_text"))
    rows = rows.join(wanted, "role")
    visible, hidden = attack_columns(F.col("attack"), F.col("text"), F.col("keywords"), F.col("term"), F.col("target_text"))
    rows = rows.withColumns({"control_id": F.col("candidate_id"), "candidate_id": F.concat_ws("_", "candidate_id", "attack"), "stuffed": F.lit(True), "hidden": hidden, "text": visible})
    return rows.select(*base.columns)


def spans(text: Column, hidden: Column) -> Column:
    """Text as black 11 pt spans by line, and hidden text as one white span of 1 pt."""
    span = lambda t, size, color: F.struct(t.alias("text"), F.lit(0).alias("page"), F.lit("").alias("font"), F.lit(size).alias("size"), F.lit(color).alias("color"), F.lit(0).alias("flags"), F.lit(None).cast("array<double>").alias("bbox"))
    shown = F.transform(F.filter(lines(text), lambda x: x.rlike(r"\S")), lambda x: span(x, 11.0, 0))
    return F.when(hidden != "", F.concat(shown, F.array(span(hidden, 1.0, 0xFFFFFF)))).otherwise(shown)


def labels(meta: DataFrame, job_rows: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(job_id, candidate_id, grade): the own role's tier; 1 for a tier-3 resume of an adjacent role (role, job_id); else 0.

    The result is candidates x jobs, so the cross join with the few jobs is its size.
    """
    rows = meta.select("candidate_id", "role", "tier").crossJoin(job_rows.select("job_id")).join(adjacency.withColumn("near", F.lit(True)), ["role", "job_id"], "left")
    grade = F.when(F.col("role") == F.col("job_id"), F.col("tier")).when((F.col("tier") == 3) & F.col("near"), 1).otherwise(0)
    return rows.select("job_id", "candidate_id", grade.alias("grade"))


def adjacency(spark: SparkSession, roles: tuple[Role, ...] = ROLES) -> DataFrame:
    return spark.createDataFrame([(r.key, a) for r in roles for a in r.adjacent], "role string, job_id string")


def generate(spark: SparkSession, seed: int = 7, pairs_per_attack: int = 3, copies: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resumes with attacked copies, jobs, labels)."""
    j = jobs(spark)
    honest = resumes(spark, seed, copies)
    every = honest.unionByName(attacked(honest, j, pairs_per_attack))
    return every, j, labels(every, j, adjacency(spark))


# Rewritten resumes: what a text generator returns is checked and mended before it becomes an attack.


class GenerationError(ValueError):
    """A generated resume that can't be used."""


def strip_fences(text: Column) -> Column:
    return strip(F.array_join(F.filter(lines(text), lambda x: ~F.ltrim(x).startswith("```")), "\n"))


def caps_sections(text: Column) -> Column:
    """Array of struct(name, body): lines under headings of up to three words in capitals; ``_header`` first. A heading that comes again replaces the first."""
    mark = "\x01"
    head = lambda x: strip(x).rlike(r"^[^a-z]*[A-Z][^a-z]*$") & (F.regexp_count(strip(x), F.lit(r"\S+")) <= 3)
    marked = F.array_join(F.transform(lines(text), lambda x: F.when(head(x), F.concat(F.lit(mark), strip(x))).otherwise(x)), "\n")
    parts = F.split(F.concat(F.lit(f"{mark}_header\n"), marked), mark)
    cut = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(F.substring_index(p, "\n", 1).alias("name"), F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"\n\z", "").alias("body")))
    return let(cut, lambda all_parts: F.filter(all_parts, lambda c, i: ~F.exists(F.slice(all_parts, i + 2, F.size(all_parts)), lambda later: later.getField("name") == c.getField("name"))))


def enforce_evidence(generated: Column, original: Column, kept: tuple[str, ...] = ("EXPERIENCE", "EDUCATION")) -> Column:
    """The generated text with the original's work history and education put back."""
    find = lambda parts, name: F.get(F.filter(parts, lambda p: p.getField("name") == name), F.lit(0)).getField("body")
    whole = lambda name, body: F.when(name == "_header", body).when(body == "", name).otherwise(F.concat(name, F.lit("\n"), body))

    def mend(parts: Column) -> Column:
        new, old = parts.getField("new"), parts.getField("old")
        mended = F.transform(new, lambda p: whole(p.getField("name"), F.when(p.getField("name").isin(*kept), F.coalesce(find(old, p.getField("name")), p.getField("body"))).otherwise(p.getField("body"))))
        missing = F.transform(F.filter(old, lambda p: p.getField("name").isin(*kept) & find(new, p.getField("name")).isNull()), lambda p: whole(p.getField("name"), p.getField("body")))
        return strip(F.array_join(F.concat(mended, missing), "\n"))

    return let(F.struct(caps_sections(generated).alias("new"), caps_sections(original).alias("old")), mend)


def is_valid(generated: Column, original: Column) -> Column:
    """Long enough, and with the three sections that a resume needs."""
    clean = strip_fences(generated)
    ok = F.length(clean) >= F.length(original) * MIN_LENGTH_RATIO
    for name in REQUIRED_SECTIONS:
        ok = ok & F.contains(F.upper(clean), F.lit(name))
    return ok
