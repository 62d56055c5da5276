"""Queries on sets, intervals and the ontology. Customers stand for candidates and part names for skills; suppliers or brands for jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.config import DEFAULT_GATE, DEFAULT_WEIGHTS
from rankweave.functions import text as tx
from rankweave.operators import audit, best_pairs, bitsets, gap, ontology, rankers, scoring
from rankweave.operators.blocks import sparse_products
from rankweave.operators.ontology import SkillNode, SkillOntology
from rankweave.operators.rankers import _small
from rankweave.plans.catalogue import Catalogue, r6
from rankweave.runtime import materialize, table

query = Catalogue()

#: A small ontology of its own for queries and tests: name, aliases, parents.
NODES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("bash", ("shell",), ("linux",)), ("css", (), ()), ("deep-learning", ("dl",), ("machine-learning",)), ("django", (), ("python",)), ("docker", ("containers",), ()), ("fastapi", (), ("python", "rest-api")),
    ("flask", (), ("python",)), ("helm", (), ("kubernetes",)), ("javascript", ("js", "ecmascript"), ()), ("keras", (), ("tensorflow",)), ("kubernetes", ("k8s",), ("docker",)), ("linux", (), ()),
    ("machine-learning", ("ml",), ("python",)), ("mysql", (), ("sql",)), ("nextjs", ("next.js",), ("react",)), ("postgresql", ("postgres",), ("sql",)), ("python", ("py", "python3"), ()), ("pytorch", ("torch",), ("deep-learning", "python")),
    ("react", ("react.js",), ("javascript",)), ("rest-api", ("rest",), ()), ("sql", (), ()), ("tensorflow", ("tf",), ("deep-learning",)), ("typescript", ("ts",), ("javascript",)),
)
ONTOLOGY = SkillOntology(SkillNode(n, "other", a, p) for n, a, p in NODES)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_EDGES = f"edge(child, parent) AS (VALUES {_values((n, p) for n, _, ps in NODES for p in ps)})"
_ALIASES = f"alias(surface, canonical) AS (VALUES {_values(sorted(ONTOLOGY.alias_index.items()))})"
_NODE = f"node(i, name) AS (VALUES {_values(enumerate(n for n, _, _ in NODES))})"
_CLOSURE = "closure AS (WITH RECURSIVE up(skill, ancestor, depth) AS (SELECT child, parent, 1 FROM edge UNION ALL SELECT u.skill, e.parent, u.depth + 1 FROM up u JOIN edge e ON u.ancestor = e.child) SELECT skill, ancestor, min(depth) AS depth FROM up GROUP BY ALL)"
_PATHS = """paths AS (
  WITH RECURSIVE sym AS (SELECT child AS a, parent AS b FROM edge UNION SELECT parent, child FROM edge),
  walk(a, b, hops, path) AS (SELECT a, b, 1, a || '>' || b FROM sym UNION ALL
    SELECT w.a, s.b, w.hops + 1, w.path || '>' || s.b FROM walk w JOIN sym s ON w.b = s.a WHERE w.hops < 3 AND NOT list_contains(string_split(w.path, '>'), s.b))
  SELECT a, b, min(hops) AS hops, arg_min(path, (hops, string_split(path, '>'))) AS path FROM walk GROUP BY ALL)"""

_HELD = "held AS (SELECT DISTINCT o_custkey AS candidate_id, p_name AS skill FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
_REQ = "req AS (SELECT DISTINCT l_suppkey AS job_id, p_name AS skill FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45)"
_PREF = "pref AS (SELECT DISTINCT l_suppkey AS job_id, p_name AS skill FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 40 AND l_quantity < 45 EXCEPT SELECT job_id, skill FROM req)"
_YEARS = """
span AS (SELECT o_custkey AS candidate_id, year(o_orderdate) * 12 + month(o_orderdate) AS s, year(o_orderdate) * 12 + month(o_orderdate) + 3 AS e FROM orders),
mark AS (SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM span),
island AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM mark),
merged AS (SELECT candidate_id, g, min(s) AS s, max(e) AS e FROM island GROUP BY ALL),
years AS (SELECT candidate_id, CAST(sum(e - s + 1) AS BIGINT) AS months, round(sum(e - s + 1) / 12.0, 2)::DOUBLE AS years FROM merged GROUP BY 1)"""
_PAIRS = """
n_req AS (SELECT job_id, count(*) AS n FROM req GROUP BY 1), n_pref AS (SELECT job_id, count(*) AS n FROM pref GROUP BY 1),
n_held AS (SELECT candidate_id, count(*) AS n FROM held GROUP BY 1),
hit_req AS (SELECT job_id, candidate_id, count(*) AS n FROM req JOIN held USING (skill) GROUP BY ALL), hit_pref AS (SELECT job_id, candidate_id, count(*) AS n FROM pref JOIN held USING (skill) GROUP BY ALL),
pair AS (
  SELECT j.job_id, c.candidate_id, j.n AS n_req, coalesce(p.n, 0) AS n_pref, c.n AS n_held, coalesce(hr.n, 0) AS hit_req, coalesce(hp.n, 0) AS hit_pref
  FROM n_req j CROSS JOIN n_held c LEFT JOIN n_pref p USING (job_id) LEFT JOIN hit_req hr USING (job_id, candidate_id) LEFT JOIN hit_pref hp USING (job_id, candidate_id))"""
_SETS = f"WITH {_HELD}, {_REQ}, {_PREF}, {_YEARS}, {_PAIRS}"


def _named_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return lines.join(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))


def _bought(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate_id"))
    return _named_lines(spark, d).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _tasks(spark: SparkSession) -> int:
    """Few bytes a candidate, but each meets every job: adaptive coalescing by bytes would leave one task all the work."""
    return max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Numbers of all jobs' sets that are broadcast at most (8 bytes each), and names where sets are arrays.
_MOST_NUMBERS, _MOST_NAMES = 4_000_000, 500_000


def _sides(spark: SparkSession, d: str, most: int = bitsets.MAX_SKILLS) -> tuple[DataFrame, list[str], DataFrame, list[str], dict[str, Column]]:
    """Customers (candidate_id, years, sets), suppliers that require something (job_id, sets), the columns of both sides' sets, and the counts of a
    pair: both (required names held), wished (preferred ones held), n_req, n_pref, n_held. Sets are bits up to ``most`` names, sorted arrays of names beyond."""
    lines = _named_lines(spark, d).select("l_orderkey", F.col("l_suppkey").alias("job_id"), "l_quantity", "p_name")
    asked, wished = F.col("l_quantity") >= 45, (F.col("l_quantity") >= 40) & (F.col("l_quantity") < 45)
    names = bitsets.vocabulary(table(spark, d, "part"), "p_name", most)
    if names is None:
        held = _bought(spark, d).groupBy("candidate_id").agg(F.array_sort(F.collect_set("p_name")).alias("held"))
        named = lambda where: F.array_sort(F.collect_set(F.when(where, F.col("p_name"))))
        jobs = lines.groupBy("job_id").agg(named(asked).alias("req"), named(wished).alias("pref")).filter(F.size("req") > 0).withColumn("pref", F.array_except("pref", "req"))
        size, both = F.size, (lambda x: F.size(F.array_intersect("held", x)))
        counts = {"both": both("req"), "wished": both("pref"), "n_req": size("req"), "n_pref": size("pref"), "n_held": size("held")}
        sets, asks = ["held"], ["req", "pref"]
    else:
        k = bitsets.words(names)
        held = bitsets.encode(_bought(spark, d), "candidate_id", "p_name", names, "held")
        req, pref = (bitsets.encode(lines, "job_id", "p_name", names, n, where) for n, where in (("req", asked), ("pref", wished)))
        jobs = bitsets.minus(req.join(pref, "job_id"), "pref", "req", k).filter(bitsets.size("req", k) > 0)
        counts = {"both": bitsets.common("held", "req", k), "wished": bitsets.common("held", "pref", k), "n_req": bitsets.size("req", k), "n_pref": bitsets.size("pref", k), "n_held": bitsets.size("held", k)}
        sets, asks = [f"held{j}" for j in range(k)], [f"{n}{j}" for n in ("req", "pref") for j in range(k)]
    return held.join(customer_years(spark, d), "candidate_id").select("candidate_id", "years", *sets), sets, jobs.select("job_id", *asks), asks, counts


def _crossed(spark: SparkSession, candidates: DataFrame, jobs: DataFrame, asks: list[str]) -> DataFrame:
    """Every candidate with every job; jobs are broadcast if their sets are few numbers, which is counted. Both sides are read once: give written tables."""
    arrays = [a for a in asks if dict(jobs.dtypes)[a].startswith("array")]
    if arrays:
        small = jobs.agg(F.coalesce(F.sum(sum((F.size(a) for a in arrays), F.lit(0))), F.lit(0))).first()[0] <= _MOST_NAMES
    else:
        small = jobs.count() * len(jobs.columns) <= _MOST_NUMBERS
    return candidates.repartition(_tasks(spark)).crossJoin(F.broadcast(jobs) if small else jobs)


def pairs(spark: SparkSession, d: str, most: int = bitsets.MAX_SKILLS) -> DataFrame:
    """Every customer with every supplier that requires something: job_id, candidate_id, years and the counts of ``_sides``. For few of either: see ``_kinds``."""
    candidates, _, jobs, asks, counts = _sides(spark, d, most)
    every = _crossed(spark, candidates, materialize(jobs, "job-sets"), asks)
    return every.select("job_id", "candidate_id", "years", *[c.alias(n) for n, c in counts.items()])


def _kinds(rows: DataFrame, key: str, by: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, written, with ``kind``; one row a kind: its smallest key, its columns ``by`` and ``n``, its rows). Rows equal in ``by`` are one
    kind: what depends on these columns alone is computed once a kind. Kinds are named by their smallest key, so no hash can bring two together."""
    rows = materialize(rows, name)
    kinds = materialize(rows.groupBy(*by).agg(F.min(key).alias("kind"), F.count("*").alias("n")), f"{name}-kinds")
    same = kinds.select("kind", *[F.col(c).alias(f"_{c}") for c in by])
    return rows.join(same, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).select(*rows.columns, "kind"), kinds


def customer_years(spark: SparkSession, d: str) -> DataFrame:
    """candidate_id, months, years covered by orders, each of which lasts three months after its own."""
    first = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    spans = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.collect_set(F.struct(first.alias("start"), (first + 3).alias("end"))).alias("spans"))
    months = tx.merged_months(F.col("spans"))
    return spans.select("candidate_id", months.cast("long").alias("months"), F.round(months / F.lit(12.0), 2).alias("years"))


def _education(spark: SparkSession, d: str, most: int = bitsets.MAX_SKILLS) -> tuple[DataFrame, list[str], DataFrame, list[str], dict[str, Column]]:
    """``_sides`` with what the ids say: a candidate's degree, a job's least years and degree."""
    candidates, sets, jobs, asks, counts = _sides(spark, d, most)
    who, job = F.col("candidate_id"), F.col("job_id")
    jobs = jobs.withColumns({"min_years": (job % 6).cast("double"), "min_degree": (job % 4).cast("int")})
    return candidates.withColumn("degree", (who % 5).cast("int")), [*sets, "years", "degree"], jobs, [*asks, "min_years", "min_degree"], counts


def _scores(counts: dict[str, Column]) -> Column:
    """The scores of a pair. The similarity that these tables lack is the Dice score's."""
    c, n = F.col, counts
    coverage = scoring.required_coverage_of(n["both"], n["n_req"])
    return scoring.combine(
        scoring.dice_of(n["both"], n["n_held"], n["n_req"]), scoring.coverage_of(n["both"], n["wished"], n["n_req"], n["n_pref"]),
        scoring.experience_score(c("years"), c("min_years")), scoring.education_score(c("degree"), c("min_degree")),
        gate=scoring.gate_multiplier(coverage), coverage=coverage,
    )


_SCORED = f"""{_SETS},
sub AS (
  SELECT job_id, candidate_id, 2.0::DOUBLE * hit_req / (n_held + n_req) AS semantic, least(1.0::DOUBLE, (hit_req + 0.5::DOUBLE * hit_pref) / (n_req + 0.5::DOUBLE * n_pref)) AS skill,
    CASE WHEN job_id % 6 <= 0 THEN 1.0::DOUBLE WHEN years <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, years / (job_id % 6)::DOUBLE) END AS experience,
    CASE WHEN job_id % 4 <= 0 THEN 1.0::DOUBLE WHEN candidate_id % 5 <= 0 THEN 0.0::DOUBLE WHEN candidate_id % 5 >= job_id % 4 THEN 1.0::DOUBLE ELSE (candidate_id % 5)::DOUBLE / (job_id % 4) END AS education,
    hit_req::DOUBLE / n_req AS coverage
  FROM pair JOIN years USING (candidate_id)),
score AS (SELECT *, 0.25::DOUBLE + 0.75::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, coverage) / 0.5::DOUBLE) AS gate FROM sub),
total AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.4::DOUBLE * semantic + 0.3::DOUBLE * skill + 0.2::DOUBLE * experience + 0.1::DOUBLE * education) * gate)), 6) AS total FROM score)"""


@query(f"""{_SCORED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY total DESC, candidate_id) AS rank FROM total)
SELECT job_id, candidate_id, total, round(skill, 6) AS skill, round(coverage, 6) AS coverage, round(gate, 6) AS gate, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10""")
def rank_by_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The ten best customers of each supplier. Kinds of customers meet kinds of suppliers: of each kind ten members at most, those of smallest id, can be among
    the ten, and they are only if fewer than ten kinds begin before theirs."""
    candidates, own, jobs, asks, counts = _education(spark, d)
    candidates, who = _kinds(candidates, "candidate_id", own, "candidates")
    jobs, wanted = _kinds(jobs, "job_id", asks, "jobs")
    who, wanted = who.withColumnRenamed("kind", "candidate_id").drop("n"), wanted.withColumnRenamed("kind", "job_id").drop("n")
    if "held" in own:  # arrays: each task keeps ten a job as they come, or the window would sort all pairs
        every, s = _crossed(spark, who, wanted, asks), F.col("scores")
        rows = every.select("job_id", "candidate_id", _scores(counts).alias("scores")).select("job_id", "candidate_id", r6(s.total).alias("total"), r6(s.skill).alias("skill"), r6(s.required_coverage).alias("coverage"), r6(s.gate).alias("gate"))
        rows = rankers.first_of_tasks(rows, 10, "total")
    else:
        rows = best_pairs.best(who, wanted, 10, len([n for n in own if n.startswith("held")]))
    first = materialize(rankers.top_k(rows, 10, "total").drop("rank").withColumnRenamed("candidate_id", "kind"), "best-kinds")
    members = candidates.join(first.select("kind").distinct(), "kind", "left_semi").select("kind", "candidate_id")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("candidate_id"))
    members = members.withColumn("place", place).filter("place <= 10").drop("place")
    best = rankers.top_k(first.join(members, "kind").drop("kind"), 10, "total").withColumnRenamed("job_id", "kind")
    return jobs.select("job_id", "kind").join(best, "kind").select("job_id", "candidate_id", "total", "skill", "coverage", "gate", "rank")


@query(f"{_SCORED} SELECT job_id, round(avg(semantic), 6) AS mean_dice, round(max(semantic), 6) AS max_dice, round(min(semantic), 6) AS min_dice FROM total GROUP BY 1")
def skill_dice(spark: SparkSession, d: str) -> DataFrame:
    """Over all customers; equal sets meet once, the mean counts each as often as it occurs."""
    candidates, own, jobs, asks, counts = _sides(spark, d)
    asks = [a for a in asks if a.startswith("req")]
    held = materialize(candidates.groupBy(*own).agg(F.count("*").alias("n")), "held-sets")
    jobs, wanted = _kinds(jobs.select("job_id", *asks), "job_id", asks, "jobs")
    dice = scoring.dice_of(counts["both"], counts["n_held"], counts["n_req"])
    each = _crossed(spark, held, wanted.drop("n"), asks).select("kind", "n", dice.alias("x")).groupBy("kind")
    means = each.agg(r6(F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean_dice"), r6(F.max("x")).alias("max_dice"), r6(F.min("x")).alias("min_dice"))
    return jobs.select("job_id", "kind").join(means, "kind").drop("kind")


@query(f"{_SCORED} SELECT job_id, round(avg(0.4 * semantic), 6) AS semantic, round(avg(0.3 * skill), 6) AS skill, round(avg(0.2 * experience), 6) AS experience, round(avg(0.1 * education), 6) AS education FROM total GROUP BY 1")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    """Means over all customers, without pairs: a job's sums are sums over its skills. A holder of a skill adds to coverage by the job's sizes alone, and to Dice by
    these and its own number of skills, so each skill counts its holders by that number. Experience and education depend on few values of either side."""
    c, w = F.col, DEFAULT_WEIGHTS
    held = _bought(spark, d).select("candidate_id", c("p_name").alias("skill")).distinct()
    held = materialize(held.join(customer_years(spark, d), "candidate_id"), "held")
    who = held.groupBy("candidate_id", "years").agg(F.count("skill").alias("size"))
    who = materialize(who.withColumn("degree", (c("candidate_id") % 5).cast("int")), "holders")
    holders = materialize(held.filter("skill IS NOT NULL").join(who.select("candidate_id", "size"), "candidate_id").groupBy("skill", "size").agg(F.count("*").alias("n")), "skill-holders")
    lines = _named_lines(spark, d).filter("l_quantity >= 40 AND p_name IS NOT NULL").groupBy(c("l_suppkey").alias("job_id"), c("p_name").alias("skill"))
    asked = materialize(lines.agg((F.max("l_quantity") >= 45).alias("required")), "asked")
    jobs = asked.groupBy("job_id").agg(F.count_if("required").alias("n_req"), F.count_if(~c("required")).alias("n_pref")).filter("n_req > 0")
    jobs = materialize(jobs.withColumns({"min_years": (c("job_id") % 6).cast("double"), "min_degree": (c("job_id") % 4).cast("int")}), "jobs")
    asked = asked.join(jobs.select("job_id", "n_req"), "job_id")
    # What a required skill's holders add to a job's Dice scores, for each number of required skills.
    dice = asked.filter("required").select("skill", "n_req").distinct().join(holders, "skill")
    dice = dice.groupBy("skill", "n_req").agg(F.sum(c("n") * scoring.dice_of(F.lit(1), c("size"), c("n_req"))).alias("dice"))
    met = asked.join(holders.groupBy("skill").agg(F.sum("n").alias("n")), "skill", "left").join(dice, ["skill", "n_req"], "left").groupBy("job_id")
    met = met.agg(F.sum(F.when(c("required"), c("dice"))).alias("dice"), *[F.sum(F.when(is_, c("n"))).alias(n) for n, is_ in (("both", c("required")), ("wished", ~c("required")))])
    few = _values_of(who, jobs, "years", "min_years", scoring.experience_score), _values_of(who, jobs, "degree", "min_degree", scoring.education_score)
    rows = jobs.join(met, "job_id").join(few[0], c("min_years").eqNullSafe(c("_min_years"))).join(few[1], c("min_degree").eqNullSafe(c("_min_degree")))
    everyone = F.lit(who.count())
    none = lambda n: F.coalesce(c(n), F.lit(0))
    # No pair's coverage passes 1, so the sum's share of the whole is the mean.
    sums = {"semantic": none("dice"), "skill": everyone * scoring.coverage_of(none("both") / everyone, none("wished") / everyone, c("n_req"), c("n_pref")), "experience": c("_years"), "education": c("_degree")}
    return rows.select("job_id", *[r6(F.lit(getattr(w, n)) * sums[n] / everyone).alias(n) for n in scoring.COMPONENTS])


def _values_of(who: DataFrame, jobs: DataFrame, own: str, least: str, score) -> DataFrame:
    """(_least, _own): the sum over all candidates of their score for each of the jobs' least values; either side has few different ones."""
    each = who.groupBy(own).agg(F.count("*").alias("n")).crossJoin(F.broadcast(jobs.select(least).distinct()))  # six of years, four of degrees at most, whatever the input
    return F.broadcast(each.groupBy(F.col(least).alias(f"_{least}")).agg(F.sum(F.col("n") * score(F.col(own), F.col(least))).alias(f"_{own}")))


_STRENGTH = "strength AS (SELECT o_custkey AS candidate_id, p_name AS skill, max(l_quantity) / 50.0::DOUBLE AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_CREDIT = """asked AS (SELECT job_id, skill, 1.0::DOUBLE AS w FROM req UNION ALL SELECT job_id, skill, 0.5::DOUBLE FROM pref),
credit AS (SELECT a.job_id, s.candidate_id, sum(a.w) AS met, sum(a.w * s.g) AS met_g FROM asked a JOIN strength s USING (skill) WHERE a.job_id IN (SELECT job_id FROM req) GROUP BY ALL),
whole AS (SELECT job_id, sum(w) AS w FROM asked GROUP BY 1)"""


def _grounded(spark: SparkSession, d: str, most: int = bitsets.MAX_SKILLS) -> DataFrame:
    """job_id, w (weights of all asked skills), n (candidates with one of them) and met, met_g: sums over these candidates of the weights of asked skills that they
    hold, and of the same times strength.

    Sums over pairs are sums over skills: each skill's holders and their strengths are added up once, and a job adds up its skills. Only the count
    needs the sets: candidates without any asked skill are found among those of few skills, equal sets once. Where a strength passes 1, a pair's
    coverage may be cut to 1: then rows are the pairs themselves, with n = 1.
    """
    strength = materialize(_bought(spark, d).groupBy("candidate_id", F.col("p_name").alias("skill")).agg((F.max("l_quantity") / 50.0).alias("g")), "strength")
    lines = _named_lines(spark, d).filter("l_quantity >= 40").groupBy(F.col("l_suppkey").alias("job_id"), F.col("p_name").alias("skill"))
    asked = lines.agg(F.when(F.max("l_quantity") >= 45, 1.0).otherwise(0.5).alias("w"))
    asked = materialize(asked.join(asked.filter("w = 1").select("job_id").distinct(), "job_id", "left_semi"), "asked")
    if strength.filter("g > 1").limit(1).count():
        return _grounded_pairs(strength, asked)
    of_skill = strength.groupBy("skill").agg(F.count("*").alias("holders"), F.sum("g").alias("g"))
    sums = asked.join(of_skill, "skill", "left").groupBy("job_id").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("holders")).alias("met"), F.sum(F.col("w") * F.col("g")).alias("met_g"))
    return sums.join(_meeting(spark, d, strength, asked, most), "job_id").filter("n > 0")


def _grounded_pairs(strength: DataFrame, asked: DataFrame) -> DataFrame:
    """The columns of ``_grounded`` for each pair with a common skill: candidates' skills times the jobs' in blocks."""
    each = strength.groupBy("candidate_id").agg(F.collect_list(F.struct("skill", "g")).alias("h")).select("candidate_id", F.col("h.skill").alias("skills"), F.col("h.g").alias("g"))
    met = sparse_products(each, ["candidate_id"], "skills", asked.withColumnRenamed("skill", "term"), ["w", "w"], "g", powers=(0, 1))
    met = met.withColumnsRenamed({"s0": "met", "s1": "met_g"}).withColumn("n", F.lit(1))
    return met.join(asked.groupBy("job_id").agg(F.sum("w").alias("w")), "job_id")


def _meeting(spark: SparkSession, d: str, strength: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(job_id, n): candidates that hold one of the job's skills at least."""
    names = bitsets.vocabulary(table(spark, d, "part"), "p_name", most)
    if names is None:
        sets = lambda rows, key, name: rows.groupBy(key).agg(F.array_sort(F.collect_set("skill")).alias(name))
        held, jobs, own, asks = sets(strength, "candidate_id", "held"), sets(asked, "job_id", "req"), ["held"], ["req"]
        apart = ~F.arrays_overlap("held", "req")
    else:
        k = bitsets.words(names)
        held, jobs = bitsets.encode(strength, "candidate_id", "skill", names, "held"), bitsets.encode(asked, "job_id", "skill", names, "req")
        own, asks = [f"held{j}" for j in range(k)], [f"req{j}" for j in range(k)]
        apart = bitsets.common("held", "req", k) == 0
    who = materialize(held.groupBy(*own).agg(F.count("*").alias("n")), "held-sets")
    jobs, wanted = _kinds(jobs, "job_id", asks, "asked-sets")
    everyone = who.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if names is not None:
        least = wanted.agg(F.coalesce(F.min(bitsets.size("req", k)), F.lit(0))).first()[0]
        who = who.filter(bitsets.size("held", k) <= len(names) - least)  # any other set meets every job's
    none = _crossed(spark, who, wanted.drop("n"), asks).filter(apart).groupBy("kind").agg(F.sum("n").alias("none"))
    return jobs.join(none, "kind", "left").select("job_id", (F.lit(everyone) - F.coalesce("none", F.lit(0))).alias("n"))


def _floors(parts: DataFrame) -> DataFrame:
    return parts.withColumn("floor", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)])))


def _credit(met: Column, met_g: Column, floor: Column | float) -> Column:
    """Summed coverage of a row's n candidates."""
    return F.least(F.col("n").cast("double"), (floor * met + (1 - floor) * met_g) / F.col("w"))


@query(f"WITH {_REQ}, {_PREF}, {_STRENGTH}, {_CREDIT} SELECT job_id, round(avg(least(1.0::DOUBLE, (0.4::DOUBLE * met + 0.6::DOUBLE * met_g) / w)), 6) AS mean_grounded, count(*) AS n FROM credit JOIN whole USING (job_id) GROUP BY 1")
def skill_grounded(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by strength of evidence: here the largest quantity bought, over 50. Candidates without any asked skill don't count."""
    c = F.col
    each = _grounded(spark, d).select("job_id", "n", _credit(c("met"), c("met_g"), F.lit(0.4)).alias("x")).groupBy("job_id")
    return each.agg(r6(F.sum("x") / F.sum("n")).alias("mean_grounded"), F.sum("n").cast("long").alias("n"))


@query(f"""WITH {_REQ}, {_PREF}, {_STRENGTH}, {_CREDIT}, floors(f) AS (VALUES (0.0::DOUBLE), (0.2), (0.4), (0.6), (0.8), (1.0))
SELECT f AS floor, round(avg(least(1.0::DOUBLE, (f * met + (1 - f) * met_g) / w)), 6) AS mean_coverage FROM credit JOIN whole USING (job_id) CROSS JOIN floors GROUP BY 1""")
def floor_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean grounded coverage at six floors: the two parts are summed once, the floor is a column."""
    c = F.col
    each = _floors(_grounded(spark, d)).select("floor", "n", _credit(c("met"), c("met_g"), c("floor")).alias("x")).groupBy("floor")
    return each.agg(r6(F.sum("x") / F.sum("n")).alias("mean_coverage"))


@query(f"""WITH {_REQ}, {_PREF}, {_STRENGTH}, {_CREDIT}, floors(f) AS (VALUES (0.0::DOUBLE), (0.2), (0.4), (0.6), (0.8), (1.0)),
x AS (SELECT f, least(1.0::DOUBLE, (f * met + (1 - f) * met_g) / w) AS original, least(1.0::DOUBLE, (f * w + (1 - f) * met_g) / w) AS stuffed, least(1.0::DOUBLE, (f * met + (1 - f) * 0.75::DOUBLE * met_g) / w) AS implicit
  FROM credit JOIN whole USING (job_id) CROSS JOIN floors)
SELECT f AS floor, round(avg(stuffed - original), 6) AS attack_gain, round((avg(implicit) - avg(original)) / avg(original), 6) AS fairness_cost FROM x GROUP BY 1""")
def tradeoff(spark: SparkSession, d: str) -> DataFrame:
    """At six floors: what claiming every asked skill without evidence gains, and what evidence that is only implied (three quarters of its strength) costs."""
    c = F.col
    credit = lambda claimed, shown: _credit(claimed, shown, c("floor"))
    x = _floors(_grounded(spark, d)).select("floor", "n", credit(c("met"), c("met_g")).alias("original"), credit(c("w") * c("n"), c("met_g")).alias("stuffed"), credit(c("met"), 0.75 * c("met_g")).alias("implicit"))
    cost = (F.sum("implicit") - F.sum("original")) / F.sum("original")
    return x.groupBy("floor").agg(r6((F.sum("stuffed") - F.sum("original")) / F.sum("n")).alias("attack_gain"), r6(cost).alias("fairness_cost"))


@query(f"WITH {_YEARS.strip()} SELECT candidate_id, months, years FROM years")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return customer_years(spark, d)


@query(f"""WITH {_YEARS.strip()} SELECT CAST(s_suppkey % 6 AS BIGINT) AS min_years, candidate_id,
  round(CASE WHEN s_suppkey % 6 <= 0 THEN 1.0 WHEN years <= 0 THEN 0.0 ELSE least(1.0::DOUBLE, years / (s_suppkey % 6)::DOUBLE) END::DOUBLE, 6) AS score
FROM years CROSS JOIN (SELECT DISTINCT s_suppkey % 6 AS s_suppkey FROM supplier)""")
def experience_score(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "supplier").select((F.col("s_suppkey") % 6).alias("min_years")).distinct()
    rows = customer_years(spark, d).crossJoin(F.broadcast(bars))  # six bars at most, whatever the input
    return rows.select("min_years", "candidate_id", r6(scoring.experience_score(F.col("years"), F.col("min_years").cast("double"))).alias("score"))


@query("SELECT CAST(c_custkey % 5 AS INT) AS held, CAST(c_nationkey % 5 AS INT) AS required, round(CASE WHEN c_nationkey % 5 <= 0 THEN 1.0 WHEN c_custkey % 5 <= 0 THEN 0.0 WHEN c_custkey % 5 >= c_nationkey % 5 THEN 1.0 ELSE (c_custkey % 5)::DOUBLE / (c_nationkey % 5) END::DOUBLE, 6) AS score, count(*) AS n FROM customer GROUP BY ALL")
def education_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 5).cast("int").alias("held"), (F.col("c_nationkey") % 5).cast("int").alias("required"))
    return rows.groupBy("held", "required").agg(F.count("*").alias("n")).withColumn("score", r6(scoring.education_score(F.col("held"), F.col("required"))))


@query("SELECT vec_id, round(0.25::DOUBLE + 0.75::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (label - 2) / 10.0::DOUBLE) / 0.5::DOUBLE), 6) AS gate FROM embeddings")
def gate_multiplier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", r6(scoring.gate_multiplier((F.col("label") - 2) / F.lit(10.0), DEFAULT_GATE)).alias("gate"))


# The ontology.


def _brand_skill(i) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n, _, _ in NODES]), (i % len(NODES) + 1).cast("int"))


_SURFACE = "surface AS (SELECT part.p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(name) || ' ' WHEN p_partkey % 3 = 1 THEN replace(name, '-', '  ') ELSE p_name END AS raw FROM part JOIN node ON p_partkey % 23 = i)"


def _surfaces(spark: SparkSession, d: str) -> DataFrame:
    name = _brand_skill(F.col("p_partkey"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper(name), F.lit(" "))).when(F.col("p_partkey") % 3 == 1, F.replace(name, F.lit("-"), F.lit("  "))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"))


@query(f"WITH {_NODE}, {_ALIASES}, {_SURFACE} SELECT p_partkey, raw, canonical FROM surface LEFT JOIN alias ON alias.surface = trim(regexp_replace(lower(raw), '\\s+', ' ', 'g'))")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _surfaces(spark, d).withColumn("canonical", ONTOLOGY.canonical_column(F.col("raw")))


@query("SELECT p_name AS surface, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def ontology_clash(spark: SparkSession, d: str) -> DataFrame:
    """Part names that several brands claim."""
    return ontology.clashes(table(spark, d, "part").select(F.col("p_name").alias("surface"), F.col("p_brand").alias("canonical")))


@query("SELECT n_name AS child, r.name AS parent FROM nation JOIN (VALUES (0, 'AFRICA'), (1, 'ATLANTIS'), (2, 'ASIA'), (3, 'EUROPE'), (4, 'LEMURIA')) r(k, name) ON n_regionkey = k WHERE r.name NOT IN (SELECT r_name FROM region)")
def unknown_parent(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("AFRICA", "ATLANTIS", "ASIA", "EUROPE", "LEMURIA")))
    edges = table(spark, d, "nation").select(F.col("n_name").alias("child"), F.element_at(names, F.col("n_regionkey") + 1).alias("parent"))
    return ontology.unknown_parents(edges, table(spark, d, "region").select(F.col("r_name").alias("name")))


_PART_SKILL = f"ps AS (SELECT p_partkey, name AS skill FROM part JOIN node ON p_partkey % {len(NODES)} = i)"


def _part_skills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", _brand_skill(F.col("p_partkey")).alias("skill"))


def _of_ontology(found: DataFrame) -> DataFrame:
    """What the ontology gives is bounded by its own size (23 names here, three hops at most), whatever the tables hold."""
    return F.broadcast(found)


@query(f"WITH {_NODE}, {_EDGES}, {_CLOSURE}, {_PART_SKILL} SELECT p_partkey, skill, ancestor, CAST(depth AS INT) AS depth FROM ps JOIN closure USING (skill)")
def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    """The skill of every part with all its ancestors."""
    return _part_skills(spark, d).join(_of_ontology(ontology.closure_of(ONTOLOGY.edge_table(spark))), "skill").select("p_partkey", "skill", "ancestor", "depth")


@query(f"""WITH {_NODE}, {_EDGES}, {_CLOSURE}, {_PART_SKILL}, down AS (SELECT ancestor AS skill, count(*) AS n_descendants, string_agg(skill, ',' ORDER BY skill) AS descendants FROM closure GROUP BY 1)
SELECT p_partkey, skill, n_descendants, descendants FROM ps JOIN down USING (skill)""")
def descendant_closure(spark: SparkSession, d: str) -> DataFrame:
    """The skill of every part that has descendants, with these."""
    up = ontology.closure_of(ONTOLOGY.edge_table(spark))
    down = up.groupBy(F.col("ancestor").alias("skill")).agg(F.count("*").alias("n_descendants"), F.array_join(F.array_sort(F.collect_list(F.col("skill"))), ",").alias("descendants"))
    return _part_skills(spark, d).join(_of_ontology(down), "skill").select("p_partkey", "skill", "n_descendants", "descendants")


_GAP_HELD = f"h0 AS (SELECT DISTINCT o_custkey AS candidate_id, name AS skill FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN node ON l_partkey % {len(NODES)} = i WHERE l_quantity >= 48)"
_GAP_WIDE = "wide AS (SELECT candidate_id, skill FROM h0 UNION SELECT candidate_id, ancestor FROM h0 JOIN closure USING (skill))"
_GAP_ASK = f"ask AS (SELECT p_brand AS job_id, name AS skill, max(CASE WHEN p_size > 46 THEN 1 ELSE 0 END) = 1 AS required FROM part JOIN node ON p_partkey % {len(NODES)} = i WHERE p_size > 44 GROUP BY ALL)"
_GAP = f"""WITH {_NODE}, {_EDGES}, {_CLOSURE}, {_PATHS}, {_GAP_HELD}, {_GAP_WIDE}, {_GAP_ASK},
near AS (SELECT h.candidate_id, p.b AS skill, min((p.hops, p.a)) AS best, arg_min(p.path, (p.hops, p.a)) AS path FROM h0 h JOIN paths p ON h.skill = p.a WHERE p.hops <= 2 GROUP BY ALL),
who AS (SELECT DISTINCT candidate_id FROM h0), job AS (SELECT DISTINCT job_id FROM ask),
gap AS (
  SELECT job_id, c.candidate_id, a.skill, a.required, CASE WHEN w.skill IS NOT NULL THEN 'matched' WHEN n.best IS NOT NULL THEN 'transferable' ELSE 'missing' END AS status,
    CASE WHEN w.skill IS NULL THEN string_split(n.path, '>')[1] END AS via, CASE WHEN w.skill IS NULL THEN n.path END AS path
  FROM who c CROSS JOIN ask a LEFT JOIN wide w ON w.candidate_id = c.candidate_id AND w.skill = a.skill LEFT JOIN near n ON n.candidate_id = c.candidate_id AND n.skill = a.skill)"""


def _gap_held(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate_id"))
    lines = table(spark, d, "lineitem").filter("l_quantity >= 48").select("l_orderkey", _brand_skill(F.col("l_partkey")).alias("skill"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("candidate_id", "skill").distinct()


def _gap_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, pairs, requirements, held, gaps). A gap depends on what is held alone, so candidates of equal skills are a kind: all but ``members`` (candidate_id, kind)
    have a kind in candidate_id. Sets of the ontology's names repeat, so kinds are far fewer than candidates. Nor does it depend on the job: ``gaps`` has a row for
    each kind and asked skill, which ``_of_jobs`` gives to the jobs that ask."""
    each = _gap_held(spark, d).groupBy("candidate_id").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    members, kinds = _kinds(each, "candidate_id", ["skills"], "gap-candidates")
    held = kinds.select(F.col("kind").alias("candidate_id"), F.explode("skills").alias("skill"))
    wide = ontology.expand_rows(held, ONTOLOGY.alias_table(spark), ONTOLOGY.closure_table(spark))
    parts = table(spark, d, "part").filter("p_size > 44").groupBy(F.col("p_brand").alias("job_id"))
    name = _brand_skill(F.col("p_partkey"))
    jobs = materialize(parts.agg(F.collect_set(F.when(F.col("p_size") > 46, name)).alias("required"), F.collect_set(F.when(F.col("p_size") <= 46, name)).alias("preferred")), "gap-jobs")
    pairs = kinds.select(F.col("kind").alias("candidate_id")).crossJoin(F.broadcast(jobs.select("job_id")) if _small(jobs) else jobs.select("job_id"))
    wanted = materialize(gap.requirements(jobs), "gap-wanted")
    asked = wanted.select(F.lit(0).alias("job_id"), "skill", F.lit(True).alias("required")).distinct()
    gaps = gap.analyse(kinds.select(F.col("kind").alias("candidate_id"), F.lit(0).alias("job_id")), asked, held, wide, ONTOLOGY.path_table(spark))
    return members.select("candidate_id", "kind"), pairs, wanted, held, gaps.drop("job_id", "required")


def _of_jobs(gaps: DataFrame, wanted: DataFrame) -> DataFrame:
    """The gaps of asked skills for each job that asks."""
    return gaps.join(rankers.few(wanted), "skill").select("job_id", "candidate_id", "skill", "required", "status", "via", "path")


def _of_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of each kind for each of its candidates. Written, these rows are small, as names repeat, but not in memory: merged, or Spark would take them to the driver to broadcast them."""
    written = materialize(rows.withColumnRenamed("candidate_id", "kind"), "gap-kinds")
    return members.join(written.hint("merge"), "kind").drop("kind")


@query(f"WITH {_NODE}, {_EDGES}, {_CLOSURE}, {_GAP_HELD}, {_GAP_WIDE} SELECT candidate_id, count(*) AS n_skills, string_agg(skill, ',' ORDER BY skill) AS skills FROM wide GROUP BY 1")
def expand_skills(spark: SparkSession, d: str) -> DataFrame:
    wide = ontology.expand_rows(_gap_held(spark, d), ONTOLOGY.alias_table(spark), ONTOLOGY.closure_table(spark))
    return wide.groupBy("candidate_id").agg(F.count("*").alias("n_skills"), F.array_join(F.array_sort(F.collect_list("skill")), ",").alias("skills"))


@query(f"""WITH {_NODE}, {_EDGES}, {_PART_SKILL}, sib AS (SELECT DISTINCT a.child AS skill, b.child AS sibling FROM edge a JOIN edge b ON a.parent = b.parent AND a.child <> b.child)
SELECT p_partkey, skill, sibling FROM ps JOIN sib USING (skill)""")
def siblings(spark: SparkSession, d: str) -> DataFrame:
    """The skill of every part with those that share a parent with it."""
    return _part_skills(spark, d).join(_of_ontology(ontology.siblings_of(ONTOLOGY.edge_table(spark))), "skill").select("p_partkey", "skill", "sibling")


_LINE_SKILLS = f"ls AS (SELECT l_orderkey, l_linenumber, x.name AS a, y.name AS b FROM lineitem JOIN node x ON l_partkey % {len(NODES)} = x.i JOIN node y ON l_suppkey % {len(NODES)} = y.i)"


def _line_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every line whose part's and supplier's skills are within three hops, and the way between them."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _brand_skill(F.col("l_partkey")).alias("a"), _brand_skill(F.col("l_suppkey")).alias("b"))
    return lines.join(_of_ontology(ontology.paths_of(ONTOLOGY.edge_table(spark))), ["a", "b"])


@query(f"WITH {_NODE}, {_EDGES}, {_PATHS}, {_LINE_SKILLS} SELECT l_orderkey, l_linenumber, a, b, CAST(hops AS INT) AS hops FROM ls JOIN paths USING (a, b)")
def hop_distance(spark: SparkSession, d: str) -> DataFrame:
    return _line_paths(spark, d).select("l_orderkey", "l_linenumber", "a", "b", "hops")


@query(f"WITH {_NODE}, {_EDGES}, {_PATHS}, {_LINE_SKILLS} SELECT l_orderkey, l_linenumber, a, b, path FROM ls JOIN paths USING (a, b)")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return _line_paths(spark, d).select("l_orderkey", "l_linenumber", "a", "b", F.array_join("path", ">").alias("path"))


@query(f"""WITH {_NODE}, {_EDGES}, {_PATHS}, {_GAP_HELD}
SELECT candidate_id, b AS target, CAST(min(hops) AS INT) AS hops, arg_min(a, (hops, a)) AS via, arg_min(path, (hops, a)) AS path FROM h0 JOIN paths ON skill = a WHERE hops <= 2 GROUP BY ALL""")
def nearest_held(spark: SparkSession, d: str) -> DataFrame:
    held = _gap_held(spark, d)
    targets = held.select("candidate_id").distinct().crossJoin(F.broadcast(ONTOLOGY.node_table(spark).select(F.col("name").alias("target"))))
    found = ontology.nearest_rows(targets, held, ONTOLOGY.path_table(spark))
    return found.select("candidate_id", "target", F.col("hops").cast("int").alias("hops"), "via", F.array_join("path", ">").alias("path"))


@query(f"{_GAP} SELECT job_id, candidate_id, skill, required, status, via, path FROM gap")
def skill_gap(spark: SparkSession, d: str) -> DataFrame:
    members, _, wanted, _, gaps = _gap_tables(spark, d)
    return _of_jobs(_of_members(gaps.withColumn("path", F.array_join("path", ">")), members), wanted)


@query(f"""{_GAP}, more AS (SELECT job.job_id, h.candidate_id, count(*) AS n FROM h0 h CROSS JOIN job WHERE NOT EXISTS (SELECT 1 FROM ask a WHERE a.job_id = job.job_id AND a.skill = h.skill) GROUP BY ALL)
SELECT job_id, candidate_id, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'transferable') AS transferable, count(*) FILTER (status = 'missing') AS missing,
  count(*) FILTER (status = 'missing' AND required) AS missing_required, count(*) AS total_requirements, coalesce(any_value(more.n), 0) AS surplus, round(count(*) FILTER (status = 'matched') / count(*)::DOUBLE, 6) AS coverage
FROM gap LEFT JOIN more USING (job_id, candidate_id) GROUP BY ALL""")
def gap_counts(spark: SparkSession, d: str) -> DataFrame:
    members, pairs, wanted, held, gaps = _gap_tables(spark, d)
    return _of_members(gap.counts(_of_jobs(gaps, wanted), gap.surplus(pairs, wanted, held)).withColumn("coverage", r6("coverage")), members)


@query(f"""{_GAP}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY required DESC, status = 'transferable' DESC, CASE WHEN path IS NULL THEN 0 ELSE len(string_split(path, '>')) END, skill) AS priority FROM gap WHERE status <> 'matched')
SELECT job_id, candidate_id, CAST(priority AS INT) AS priority, skill, required, status FROM o WHERE priority <= 5""")
def upskill_priorities(spark: SparkSession, d: str) -> DataFrame:
    members, _, wanted, _, gaps = _gap_tables(spark, d)
    return _of_members(gap.upskill_priorities(_of_jobs(gaps, wanted)).select("job_id", "candidate_id", "priority", "skill", "required", "status"), members)


@query(f"""{_GAP} SELECT status, required, count(*) AS n, min(CASE WHEN status = 'matched' THEN skill || ': held' WHEN status = 'transferable' THEN skill || ': transferable via ' || via || ' (' || replace(path, '>', ' -> ') || ')'
  ELSE skill || CASE WHEN required THEN ': missing (required)' ELSE ': missing (preferred)' END END) AS first_text FROM gap GROUP BY ALL""")
def gap_texts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    members, _, wanted, _, gaps = _gap_tables(spark, d)
    sizes = members.groupBy(F.col("kind").alias("candidate_id")).agg(F.count("*").alias("size"))
    rows = _of_jobs(gaps, wanted).join(sizes, "candidate_id").withColumn("line", gap.describe(c("skill"), c("status"), c("required"), c("via"), c("path")))
    return rows.groupBy("status", "required").agg(F.sum("size").alias("n"), F.min("line").alias("first_text"))


# Disparity between groups: market segments, scored by account balance and orders.

_AUDIT = """WITH c AS (SELECT c_mktsegment AS grp, c_custkey AS id, c_acctbal / 10000.0::DOUBLE AS total, (c_custkey % 7) / 7.0::DOUBLE AS semantic, (c_nationkey % 5) / 5.0::DOUBLE AS skill, (c_custkey % 11) / 11.0::DOUBLE AS experience, (c_custkey % 3) / 3.0::DOUBLE AS education FROM customer),
a AS (SELECT *, row_number() OVER (ORDER BY total DESC, id) AS rank FROM c), m AS (SELECT grp, avg(total) AS t, avg(semantic) AS s, avg(skill) AS k, avg(experience) AS x, avg(education) AS e FROM a GROUP BY 1)"""


def _audit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Segments with five scores. The rank is the row's place in the whole table: ranges are numbered one after another, no task sees all rows."""
    share = lambda c, n: (F.col(c) % n) / F.lit(float(n))
    return table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / F.lit(10000.0)).alias("total"), share("c_custkey", 7).alias("semantic"), share("c_nationkey", 5).alias("skill"), share("c_custkey", 11).alias("experience"), share("c_custkey", 3).alias("education")
    )


@query(f'{_AUDIT} SELECT grp AS "group", round(t, 6) AS mean_total, round(s, 6) AS mean_semantic, round(k, 6) AS mean_skill, round(x, 6) AS mean_experience, round(e, 6) AS mean_education FROM m')
def group_means(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.group_means(_audit_rows(spark, d))
    return rows.select("group", *[r6(c).alias(c) for c in rows.columns if c != "group"])


@query(f"{_AUDIT} SELECT round(max(t) - min(t), 6) AS max_gap, round(max(s) - min(s), 6) AS semantic_gap, round(max(k) - min(k), 6) AS skill_gap, round(max(x) - min(x), 6) AS experience_gap, round(max(e) - min(e), 6) AS education_gap FROM m")
def group_disparity(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.gaps(_audit_rows(spark, d))
    return rows.select(*[r6(c).alias(c) for c in rows.columns])


@query(f"""{_AUDIT}, g AS (SELECT unnest([(max(s) - min(s), 'semantic'), (max(k) - min(k), 'skill'), (max(x) - min(x), 'experience'), (max(e) - min(e), 'education')]) AS v FROM m)
SELECT v[2] AS component, round(v[1], 6) AS gap FROM g ORDER BY v[1] DESC LIMIT 1""")
def dominant_component(spark: SparkSession, d: str) -> DataFrame:
    return audit.dominant_component(audit.gaps(_audit_rows(spark, d))).withColumn("gap", r6("gap"))


_TOP = 100


def _top_ranked(spark: SparkSession, d: str) -> DataFrame:
    """All rows, the first hundred of the table with their rank: a bounded top-k, joined back by id."""
    rows = _audit_rows(spark, d)
    top = rows.orderBy(F.desc("total"), "id").limit(_TOP).select("id", F.lit(1).alias("rank"))
    return rows.join(top, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(_TOP + 1)))


@query(f'{_AUDIT} SELECT grp AS "group", count(*) AS n, count(*) FILTER (rank <= 100) AS selected, round(avg((rank <= 100)::INT), 6) AS rate FROM a GROUP BY 1')
def selection_rates(spark: SparkSession, d: str) -> DataFrame:
    return audit.selection(_top_ranked(spark, d), _TOP).withColumn("rate", r6("rate"))


@query(f"{_AUDIT}, r AS (SELECT grp, avg((rank <= 100)::INT) AS rate FROM a GROUP BY 1) SELECT round(min(rate) / max(rate), 6) AS disparate_impact, 100.0 / count(*) >= 5 AS reliable, min(rate) / max(rate) >= 0.8 AS four_fifths FROM r")
def disparate_impact(spark: SparkSession, d: str) -> DataFrame:
    return audit.disparate_impact(_top_ranked(spark, d), _TOP).withColumn("disparate_impact", r6("disparate_impact"))
