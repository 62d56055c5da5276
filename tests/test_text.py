"""Extraction from texts: sections, dates, degrees, contacts, sentences, chunks, skills."""

import pytest
from pyspark.sql import functions as F

from rankweave.functions import text as tx
from rankweave.functions import vectors as vx
from rankweave.operators import skills as sk
from rankweave.plans.skill_queries import ONTOLOGY

NOW = 2024 * 12 + 6


@pytest.fixture(scope="module")
def on(spark):
    """The value of a column expression for one text."""
    return lambda text, build: spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("x")).first().x


SAMPLE = "Alex Chen\nalex.chen@example.com\n+1 415 555 0123 99\n\nSUMMARY\nBuilds things.\n\nWork Experience:\nEngineer at Firm, Jan 2018 - Dec 2020\nAnalyst, Shop, 2019 - 2020\n\nEDUCATION\nB.Tech in Physics\n\nSkills\nPython, Docker, k8s\n"


def test_sections(on):
    s = on(SAMPLE, tx.segment_sections)
    assert set(s) == {"other", "summary", "experience", "education", "skills"}
    assert s["other"].startswith("Alex Chen") and s["skills"] == "Python, Docker, k8s" and s["summary"] == "Builds things."
    assert on("Skills\nsql\nEducation\nx\nSkills\nbash", tx.segment_sections) == {"other": "", "skills": "sql\n\n\nbash", "education": "x"}
    assert on("HR ADMIN      Summary     Dedicated     Experience     Firm", tx.segment_sections)["summary"] == "Dedicated"
    assert on("", tx.segment_sections) == {} and on(None, tx.segment_sections) == {}
    assert on("no headings\nhere", tx.segment_sections) == {"other": "no headings\nhere"}


@pytest.mark.parametrize(
    ("text", "years"),
    [
        ("Jan 2018 - Dec 2020", 3.0), ("2018 - 2020", 3.0), ("2018 - 2020 and 2019 - 2020", 3.0), ("2020 - 2018", 0.0), ("20+ years of experience, 2020 - 2020", 1.0), ("8 years of professional experience", 8.0),
        ("01/2020 to 06/2020", 0.5), ("2024 - present", 0.5), ("Sept 2023 – Current", 0.83), ("2010 - 2011, 2012 - 2012", 3.0), ("nothing", 0.0), (None, 0.0),
    ],
)
def test_years(on, text, years):
    assert on(text, lambda t: tx.experience_years(t, F.lit(NOW))) == pytest.approx(years)


def test_entries(on):
    rows = on(SAMPLE, lambda t: tx.experience_entries(t, F.lit(NOW)))
    assert [(r.title, r.organisation, r.start_year, r.start_month, r.end_year, r.end_month, r.is_current) for r in rows] == [("Engineer", "Firm", 2018, 1, 2020, 12, False), ("Analyst", "Shop", 2019, 1, 2020, 12, False)]
    assert on("Chef at Inn, Mar 2020 - present", lambda t: tx.experience_entries(t, F.lit(NOW)))[0].is_current


@pytest.mark.parametrize(("text", "tier"), [("PhD in X", 4), ("M.Sc. and B.Sc.", 3), ("MBA", 3), ("bachelor’s degree", 2), ("B.E in Y", 2), ("a diploma", 1), ("school", 0), (None, 0)])
def test_degree(on, text, tier):
    assert on(text, tx.degree) == tier


def test_contact(on):
    assert on(SAMPLE, tx.person_name) == "Alex Chen" and on(SAMPLE, tx.email) == "alex.chen@example.com" and on(SAMPLE, tx.phone).startswith("+1 415")
    assert on("no one\n12 years", tx.person_name) == "" and on("Jan 2018 - Dec 2020 123456789012", tx.phone) == ""
    assert on("mail a@b.co or http://x.y/z or 555-1234", tx.redact) == "mail [EMAIL] or [URL] or [PHONE]"


def test_split_job(on):
    r = on("Title\nMust: python\nNice to have\n- docker", tx.split_required_preferred)
    assert (r.required, r.preferred) == ("Title\nMust: python", "Nice to have\n- docker")
    r = on("a plus of a very long line that is certainly no heading at all", tx.split_required_preferred)
    assert r.preferred == ""


def test_tokens(on):
    assert on("C++ and c# in Node.js, a b.", tx.tokens) == ["c++", "and", "c#", "in", "node.js", "b."]
    assert on("a1 b-2 +x", tx.rank_tokens) == ["a1", "b-2", "x"]
    assert on("aa bb cc dd aa bb cc", lambda t: tx.trigrams(tx.tokens(t))) == ["aa bb cc", "bb cc dd", "cc dd aa", "dd aa bb"]
    assert on("aa bb", lambda t: tx.trigrams(tx.tokens(t))) == [] and on(None, lambda t: tx.trigrams(tx.tokens(t))) == []


def test_sentences(on):
    assert on("Short. This one is long enough. • - And this bullet too -\n\nno", tx.sentences) == ["This one is long enough.", "And this bullet too"]


def test_chunks(on):
    words = [str(i) for i in range(400)]
    chunks = on(" ".join(words), vx.chunk_text)
    assert [c.split()[0] for c in chunks] == ["0", "140", "280"] and chunks[-1].split()[-1] == "399" and len(chunks[0].split()) == 170
    packed = on("a b\n\nc d\n\n" + "x " * 200 + "\n\ne", lambda t: vx.chunk_text(t, 170, 30))
    assert packed[0] == "a b c d" and packed[-1] == "e" and len(packed) == 4
    assert on("  ", vx.chunk_text) == [] and on("one", vx.chunk_text) == ["one"]


def test_vectors(spark):
    row = spark.range(1).select(vx.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))).alias("opposite"), vx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), vx.norm(vx.hashed_vector(F.lit("a b c a"))).alias("unit"), vx.l2_normalise(F.array(F.lit(0.0))).alias("none")).first()
    assert (row.opposite, row.zero, row.none) == (0.0, 0.0, [0.0]) and row.unit == pytest.approx(1)


def test_skills(on):
    find = lambda t, trusted=None: on(t, lambda x: sk.extract_skills(x, ONTOLOGY, F.lit(trusted) if trusted else None))
    assert find("We ran K8s, Postgres and deep  learning; pythonic though.") == ["deep-learning", "kubernetes", "postgresql"]
    assert find("React.js and next.js") == ["nextjs", "react"]
    assert find("we drank from a flask") == [] and find("python, flask, docker") == ["docker", "flask", "python"] and find("a flask", "Flask") == ["flask"]
    starts = on("sql then bash sql", lambda t: sk.matches(t, sk.dictionary_pattern(["sql", "bash"])))
    assert [(m.surface, m.start) for m in starts] == [("sql", 0), ("bash", 9), ("sql", 14)]


def test_lines_that_open_a_section(spark):
    opens = {"SKILLS": "skills", "--- Work  Experience ---": "experience", ":: Education :": "education", "Skillset": None, "my skills": None, "skills - - - - -": None, "": None, "WORK:EXPERIENCE": "experience"}
    rows = spark.createDataFrame([(k,) for k in opens], "k string").select("k", tx.heading_of(F.col("k")).alias("h"))
    assert {r.k: r.h for r in rows.collect()} == opens


def test_scans_are_cut_by_rows(spark, tmp_path):
    from rankweave.runtime import spread

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    assert spread(spark.read.parquet(f"{tmp_path}/t"), 2).rdd.getNumPartitions() == 50


def test_scans_whose_rows_lie_in_few_row_groups_are_dealt_out(spark, tmp_path):
    from rankweave.runtime import spread

    texts = spark.range(40_000).selectExpr("id", "repeat(sha2(string(id), 512), 8) AS text").coalesce(1)
    texts.write.option("parquet.block.size", 1 << 30).option("compression", "none").parquet(f"{tmp_path}/one")
    scan = spark.read.parquet(f"{tmp_path}/one")
    per_task = lambda f: [r["count"] for r in f.groupBy(F.spark_partition_id()).count().collect()]
    assert scan.rdd.getNumPartitions() >= 4 and per_task(scan) == [40_000]  # many pieces of the file, all rows in one
    assert max(per_task(spread(scan))) < 10_000
    even = spark.range(1000).repartition(8)
    even.write.parquet(f"{tmp_path}/even")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a file a task
    try:
        assert "Exchange" not in spread(spark.read.parquet(f"{tmp_path}/even"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
