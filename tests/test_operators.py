"""Ontology, gaps, integrity, grounding, audit, rankers, explanations, sources, corpus and the whole pipeline."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import rankweave
from rankweave import schemas
from rankweave.operators import audit, corpus, explain, gap, grounding, integrity, ontology, rankers
from rankweave.operators.ontology import OntologyError, SkillOntology
from rankweave.plans import pipeline
from rankweave.plans.skill_queries import ONTOLOGY
from rankweave.sources import files, rows_api, sinks
from rankweave.streaming import incoming


@pytest.fixture(scope="module")
def value(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first().x


# Ontology.


def test_lookup():
    o = ONTOLOGY
    assert o.canonical("  K8S ") == "kubernetes" and o.canonical("deep learning") == "deep-learning" and o.canonical("cobol") is None
    assert "JS" not in o and "javascript" in o and len(o) == len(o.skill_names)
    assert {"tensorflow", "deep-learning", "machine-learning", "python"} == o.ancestors("keras")
    assert "django" in o.descendants("python") and o.children("docker") == {"kubernetes"}
    assert o.siblings("django") >= {"flask", "fastapi"} and "django" not in o.siblings("django")
    assert o.expand(["Keras", "cobol", " "]) == {"keras", "tensorflow", "deep-learning", "machine-learning", "python", "cobol"}
    assert o.shortest_path("django", "flask") == ("django", "python", "flask") and o.distance("django", "django") == 0
    assert o.distance("css", "python") is None and o.nearest_held("flask", ["django", "css"]) == ("django", ("django", "python", "flask"))
    assert o.nearest_held("flask", ["css"]) == (None, ()) and o.category("python") == "other"


@pytest.mark.parametrize("spec", [{"a": {"parents": ["b"]}, "b": {"parents": ["a"]}}, {"a": {"parents": ["zz"]}}, {"a": {"aliases": ["x"]}, "b": {"aliases": ["x"]}}, {}])
def test_bad_ontologies(spec):
    with pytest.raises(OntologyError):
        SkillOntology.from_mapping(spec)


def test_ontology_file(tmp_path):
    path = tmp_path / "o.yaml"
    path.write_text("skills:\n  A-B: {category: x, aliases: [ab]}\n  c: {parents: [a-b]}\n")
    o = SkillOntology.load(path)
    assert o.canonical("a b") == "a-b" and o.ancestors("c") == {"a-b"} and o.category("ab") == "x"
    with pytest.raises(OntologyError):
        SkillOntology.load(tmp_path / "none.yaml")


def test_default_ontology():
    o = SkillOntology.load()
    assert len(o) > 100 and o is not SkillOntology.load() and ontology.get_ontology() is ontology.get_ontology()
    assert o.canonical("PySpark") == "spark" and "statistics" in o.ancestors("pytorch") and o.category("k8s") == "cloud"
    with pytest.raises(OntologyError):
        SkillOntology.from_mapping({"a": {"parents": ["b"]}, "b": {"parents": ["a"]}})


def test_tables_agree_with_graph(spark):
    edges = ONTOLOGY.edge_table(spark)
    up = {(r.skill, r.ancestor) for r in ontology.closure_of(edges).collect()}
    assert up == {(n, a) for n in ONTOLOGY.nodes for a in ONTOLOGY.ancestors(n)}
    paths = {(r.a, r.b): tuple(r.path) for r in ontology.paths_of(edges).collect()}
    assert paths == {(a, b): ONTOLOGY.shortest_path(a, b) for a in ONTOLOGY.nodes for b in ONTOLOGY.nodes if a != b and ONTOLOGY.shortest_path(a, b)}
    row = spark.createDataFrame([(["Keras", "cobol"],)], "s array<string>").select(ONTOLOGY.expand_column(F.col("s")).alias("x")).first()
    assert row.x == sorted(ONTOLOGY.expand(["Keras", "cobol"]))


# Gaps.


def test_gaps(spark):
    pairs = spark.createDataFrame([("j", "c")], "job_id string, candidate_id string")
    jobs = spark.createDataFrame([("j", ["python", "flask", "css"], ["docker", "flask"])], "job_id string, required array<string>, preferred array<string>")
    held = spark.createDataFrame([("c", "django"), ("c", "linux")], "candidate_id string, skill string")
    wide = spark.createDataFrame([("c", s) for s in ONTOLOGY.expand(["django", "linux"])], "candidate_id string, skill string")
    wanted = gap.requirements(jobs)
    out = gap.analyse(pairs, wanted, held, wide, ONTOLOGY.path_table(spark))
    got = {r.skill: (r.status, r.required, r.via) for r in out.collect()}
    assert got == {"python": ("matched", True, None), "flask": ("transferable", True, "django"), "css": ("missing", True, None), "docker": ("missing", False, None)}
    c = gap.counts(out, gap.surplus(pairs, wanted, held)).first()
    assert (c.matched, c.transferable, c.missing, c.missing_required, c.surplus, c.total_requirements, c.coverage) == (1, 1, 2, 1, 2, 4, 0.25)
    assert [r.skill for r in gap.upskill_priorities(out).orderBy("priority").collect()] == ["flask", "css", "docker"]
    lines = {r.x for r in out.select(gap.describe(*map(F.col, ("skill", "status", "required", "via", "path"))).alias("x")).collect()}
    assert "flask: transferable via django (django -> python -> flask)" in lines and "docker: missing (preferred)" in lines


# Integrity.


def spans(*rows):
    return F.array(*[F.struct(F.lit(t).alias("text"), F.lit(p).alias("page"), F.lit(float(s)).alias("size"), F.lit(c).alias("color")) for t, p, s, c in rows])


def test_invisible_text(value):
    see = lambda *rows, back=(0xFFFFFF,): value(integrity.invisible_text(spans(*rows), F.array(*map(F.lit, back))))
    shown = ("plain text here", 0, 11, 0)
    assert see(shown, ("secret", 0, 11, 0xFFFFFF)).triggered and see(shown, ("secret", 0, 1, 0)).triggered
    assert not see(shown, ("grey", 0, 11, 0x444444)).triggered and not see(shown, ("unknown", 0, 11, -1)).triggered
    assert see(("black on black", 0, 11, 0), back=(0,)).severity == 1.0 and not see(("far page", 9, 11, 0), back=(0,)).triggered
    assert not value(integrity.invisible_text(F.array().cast("array<struct<text:string,page:int,size:double,color:int>>"), F.array(F.lit(1)))).triggered


def test_signals(spark, value):
    text = "word " * 130
    rows = spark.createDataFrame([("a", text), ("b", "short"), ("c", " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)))], "k string, text string")
    top = {r.k: r for r in integrity.top_terms(rows, "k", "text").collect()}
    assert (top["a"].term, top["a"].n) == ("word", 130)
    out = {r.k: r.s for r in integrity.top_terms(rows, "k", "text").select("k", integrity.repetition_signal(F.col("n_content"), F.col("term"), F.col("n")).alias("s")).collect()}
    assert out["a"].triggered and not out["b"].triggered and not out["c"].triggered
    density = lambda n, mean, std, ok: value(integrity.skill_density_signal(F.array_repeat(F.lit("s"), n), F.lit("tok " * 100), F.lit(mean), F.lit(std), F.lit(ok)))
    assert density(20, 0.05, 0.02, True).triggered and not density(20, 0.15, 0.1, True).triggered and density(40, 0.0, 0.0, False).triggered and not density(20, 0.0, 0.0, False).triggered
    job = " ".join(f"w{chr(97 + i)}" for i in range(26)) + " " + " ".join(f"x{chr(97 + i)}" for i in range(10))
    assert value(integrity.echo_ratio(F.lit(job), F.lit(job))) == 1.0 and value(integrity.echo_ratio(F.lit(job), F.lit("only a few words"))) is None
    assert value(integrity.jd_echo_signal(F.lit(0.25))).triggered is False and value(integrity.jd_echo_signal(F.lit(1.0))).severity == 1.0
    odd = value(integrity.incoherence_signal(F.lit(30), F.lit(30), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))))
    assert odd.triggered and odd.severity == 1.0


def test_penalty_is_capped(value):
    assert value(integrity.penalty([F.lit(1.0)] * 5)) == pytest.approx(0.35)
    assert value(integrity.penalty([F.lit(1.0)] + [F.lit(0.0)] * 4)) == pytest.approx(0.35 * 0.35)
    r = value(integrity.report([integrity.quiet(n) for n in integrity.SIGNALS]))
    assert not r.flagged and r.penalty == 0 and len(r.signals) == 5


# Grounding.


def test_grounding(spark):
    claims = spark.createDataFrame([("c", "python"), ("c", "css"), ("c", "sql"), ("c", "helm")], "candidate_id string, skill string")
    said = spark.createDataFrame([("c", 0, "Shipped Django services."), ("c", 1, "More Django later on."), ("c", 2, "Wrote mysqlish helmets.")], "candidate_id string, pos int, sentence string")
    forms = grounding.forms_table(ONTOLOGY, spark)
    out = grounding.ground_skills(claims, said, forms)
    got = {r.skill: (r.kind, r.grounding, r.evidence) for r in out.collect()}
    assert got["python"] == ("explicit", 1.0, "Shipped Django services.") and got["css"][0] == got["sql"][0] == got["helm"][0] == "listed_only"
    s = grounding.summary(out, said).first()
    assert (s.grounded_fraction, s.sentence_count, s.reliable) == (0.25, 3, True)
    vec = lambda frame, near: frame.withColumn("vector", F.when(near, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    out = grounding.ground_skills(vec(claims, F.col("skill") == "css"), vec(said, F.col("pos") == 2), forms)
    got = {r.skill: r for r in out.collect()}
    assert (got["css"].kind, got["css"].grounding, got["css"].evidence) == ("semantic", 0.75, "Wrote mysqlish helmets.")
    assert grounding.evidence_for_requirements(out, claims.filter("skill IN ('css', 'python')"), claims).first().skill == "python"
    # A parent's mention is no evidence for what implies it.
    up = grounding.ground_skills(spark.createDataFrame([("c", "django")], "candidate_id string, skill string"), spark.createDataFrame([("c", 0, "Plain python here.")], "candidate_id string, pos int, sentence string"), forms)
    assert up.first().kind == "listed_only"


# Audit.


def test_counterfactuals(value):
    sub = lambda t, a, b: value(audit.substitute_name(F.lit(t), F.lit(a), F.lit(b)))
    assert sub("Priya Raman, priya.raman@x.y. Priya and RAMANujan.", "Priya Raman", "Greg Baker") == "Greg Baker, greg.baker@x.y. Greg and RAMANujan."
    assert sub("a.b (c)", "", "X Y") == "a.b (c)" and sub("A.B C+", "A.B C+", "$1 Y") == "$1 Y"
    body = F.create_map(*map(F.lit, ("other", "Al Bo\na@b.co", "skills", "sql for Al Bo, 415 555 0123")))
    assert value(audit.anonymise(body, F.lit("x"), F.lit("Al Bo"))) == "sql for , "
    assert value(audit.terse_rewrite(F.lit("one two three four five six seven eight Nine c++\nshort"))) == "one two three four five Nine c++\nshort"
    sections = F.create_map(*map(F.lit, ("experience", "Ran Django and Python sites", "skills", "python")))
    assert value(audit.implicit_rewrite(sections, F.array(F.lit("python")), ONTOLOGY)) == "EXPERIENCE\nRan the system and the system sites\n\nSKILLS\npython"


def test_numbers_that_are_no_telephones_stay(value):
    kept = lambda t: value(audit.anonymise(F.create_map(F.lit("summary"), F.lit(t)), F.lit("x"), F.lit("")))
    assert kept("Buyer number 900000. Order 12345678") == "Buyer number 900000. Order 12345678"
    assert kept("call 555-0199, 4155550123, +49 1234567 or (030) 123456") == "call , , or "


def test_orders_of_one_month_count_once(spark, tmp_path):
    """Customer 3644 of sf0.1: 4 * 4 months apart, 6, 4, 6 and 4; the order of equal spans doesn't matter."""
    from rankweave.plans.skill_queries import customer_years

    dates = "1996-07 1997-03 1998-01 1998-07 1999-06 1999-08 1999-12 2000-11 2000-11 2000-12 2001-01 2001-01 2001-07".split()
    orders = spark.createDataFrame([(3644, f"{x}-01") for x in dates], "o_custkey long, o_orderdate string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in customer_years(spark, str(tmp_path)).collect()] == [(3644, 36, 3.0)]


def test_disparity(spark):
    rows = [(g, t, t, 0.5, 0.5, 0.5, i) for i, (g, t) in enumerate([("a", 0.9), ("b", 0.5), ("a", 0.7), ("b", 0.3)], start=1)]
    frame = spark.createDataFrame(rows, "group string, total double, semantic double, skill double, experience double, education double, rank int")
    g = audit.gaps(frame).first()
    assert g.max_gap == pytest.approx(0.4) and g.skill_gap == 0 and audit.dominant_component(audit.gaps(frame)).first().component == "semantic"
    assert audit.gaps(frame.filter("group = 'a'")).first().max_gap == 0
    d = audit.disparate_impact(frame, 2).first()
    assert d.disparate_impact == 1.0 and not d.reliable and "largest gap" in audit.summary(frame)
    assert audit.disparate_impact(frame, 1).first().disparate_impact == 0 and audit.disparate_impact(frame, 0).first().disparate_impact is None


def test_name_copies(spark):
    people = spark.createDataFrame([("c1", "Al Bo", "Al Bo here"), ("c2", "Cy Do", "Cy")], "candidate_id string, name string, text string")
    groups = audit.name_variants(spark, "nordic").unionByName(audit.name_variants(spark, "korean"))
    known = {g: {r.variant for r in groups.collect() if r.group == g} for g in ("nordic", "korean")}
    out = audit.name_copies(people, groups).collect()
    assert len(out) == 4 and all(r.name in known[r.group] for r in out)


def test_name_variants(spark):
    every = sorted((r.variant_no, r.variant) for r in audit.name_table(spark).filter("group = 'arab'").collect())
    assert [n for n, _ in every] == list(range(30)) and len({v for _, v in every}) == 30
    assert all(a.split()[0] != b.split()[0] and a.split()[1] != b.split()[1] for (_, a), (_, b) in zip(every[:6], every[1:6], strict=False))
    more = sorted((r.variant_no, r.variant) for r in audit.name_variants(spark, "arab", 33).collect())
    assert [v for _, v in more] == [v for _, v in every] + [v for _, v in every[:3]]


# Rankers.


def test_lexical_rankers(spark):
    texts = spark.createDataFrame([("a", "red apple pie"), ("b", "blue sky"), ("c", "red sky at night"), ("d", None), ("e", "green grass grows")], "candidate_id string, text string")
    jobs = spark.createDataFrame([(1, "red apple"), (2, "nothing shared")], "job_id int, text string")
    for ranker in (rankers.Bm25Ranker(), rankers.TfidfRanker(), rankers.FusionRanker((rankers.Bm25Ranker(), rankers.TfidfRanker()))):
        full = rankers.rank(rankers.fill_pairs(ranker.score_all(texts, jobs), texts, jobs))
        order = [r.candidate_id for r in full.filter("job_id = 1").orderBy("rank").collect()]
        assert order[:2] == ["a", "c"] and len(order) == 5
    assert rankers.Bm25Ranker().score_all(texts.limit(0), jobs).count() == 0
    timed = rankers.timed_rank(rankers.Bm25Ranker(), texts, jobs)
    assert timed.rows == 5 and timed.ms_per_resume > 0


def test_fusion_and_scaling(spark):
    lists = [spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "job_id int, candidate_id string, rank int"), spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "job_id int, candidate_id string, rank int")]
    assert len({r.score for r in rankers.reciprocal_rank_fusion(lists).collect()}) == 1
    scaled = rankers.scale_by_max(spark.createDataFrame([(1, "a", 4.0), (1, "b", 2.0), (2, "a", -1.0)], "job_id int, candidate_id string, score double"))
    assert sorted((r.job_id, r.candidate_id, r.score) for r in scaled.collect()) == [(1, "a", 1.0), (1, "b", 0.5), (2, "a", 0.0)]


# Accessors and explanations.


def test_accessors(value):
    assert tuple(value(schemas.rgb(F.lit(0x102030)))) == (16, 32, 48) and value(schemas.rgb(F.lit(-1))) is None
    assert value(schemas.background_for(F.array(F.lit(5)), F.lit(3))) == 0xFFFFFF and value(schemas.degree_label(F.lit(3))) == "Master's" == schemas.DegreeLevel.MASTER.label
    assert value(schemas.summarise_skills(F.array(*map(F.lit, "cab")), 2)) == "a, b (+1 more)" == schemas.summarise("cab", 2)
    assert value(schemas.display_name(F.lit(""), F.lit("id"))) == "id" and value(explain.bar(F.lit(0.525), 20)) == "#" * 10 + "." * 10
    assert rankweave.ScoringWeights().total and set(rankweave.__all__) and pytest.raises(AttributeError, getattr, rankweave, "nope")


def test_explainers(monkeypatch, tmp_path):
    monkeypatch.delenv("EXPLAINER_API_KEY", raising=False)
    assert explain.available_backends() == {"template": True, "hosted": False} and isinstance(explain.get_explainer(), explain.TemplateExplainer)
    with pytest.raises(ValueError):
        explain.get_explainer("oracle")
    (tmp_path / ".env").write_text("# c\nRW_A=1\nRW_B='two'\n")
    monkeypatch.setenv("RW_A", "0")
    explain.load_env(tmp_path / ".env")
    import os

    assert os.environ["RW_A"] == "0" and os.environ.pop("RW_B") == "two"


# Sources and sinks.


def docx(paragraphs, cells):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f'<w:p><w:r><w:rPr><w:color w:val="FF0000"/><w:sz w:val="22"/></w:rPr><w:t>{t}</w:t></w:r></w:p>'
    body = "".join(map(p, paragraphs)) + f"<w:tbl><w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in cells)}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.b.TXT").write_bytes(b"one  \n\n\n\n two \xff")
    (tmp_path / "d.docx").write_bytes(docx(["Head", "Body"], ["Cell"]))
    (tmp_path / "x.docx").write_bytes(b"no zip")
    (tmp_path / "y.odt").write_bytes(b"?")
    documents, failures = files.load_files(spark, str(tmp_path))
    got = {r.id: r for r in documents.withColumn("id", files.stem(F.col("path"))).collect()}
    assert got["a.b"].text == "one\n\n two �" and len(got["a.b"].spans) == 2
    assert got["d"].text == "Head\nBody\nCell" and (got["d"].spans[0].size, got["d"].spans[0].color) == (11.0, 0xFF0000)
    assert failures.count() == 2
    with pytest.raises(files.ParsingError):
        files.load_files(spark, str(tmp_path), skip_errors=False)
    assert files.load_uploads(spark, [("r.md", b"hi")])[0].first().source_format == "txt"
    assert files.page_background([(50, 1), (95, 2)], 100) == 2 and files.page_background([], 100) == 0xFFFFFF


def test_archives(spark, tmp_path):
    """Members keep their bytes, whatever the number of archives; the same rows again write the same archives over; none of none."""
    rows = [(f"{i}/a.txt", bytes([i % 256]) * (i % 7)) for i in range(1300)]
    frame = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    for _ in range(2):
        assert files.write_archives(frame, str(tmp_path / "z"), most=100) == 1300
    assert 13 <= len(list((tmp_path / "z").glob("*.zip"))) <= 16 and not list((tmp_path / "z").glob("_*"))
    assert sorted((r.path, bytes(r.content)) for r in files.archived(spark, str(tmp_path / "z")).collect()) == sorted(rows)
    assert files.write_archives(frame.limit(0), str(tmp_path / "none")) == 0 and files.archived(spark, str(tmp_path / "none")).count() == 0


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", 0.25), ("b", None)], "k string, v double")
    sinks.write_csv(frame, str(tmp_path / "c"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_markdown(frame, tmp_path / "r.md", "T")
    assert "| a | +0.250 |" in (tmp_path / "r.md").read_text() and sinks.signed(float("nan")) == "-"
    cache = frame.select(F.lit("kx").alias("key"), F.array(F.lit(1.0)).alias("vector"))
    sinks.flush_vectors(cache, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1 and sinks.uncached(spark.createDataFrame([("t",), ("t",)], "text string"), cache).count() == 1


def test_rows_api(spark, monkeypatch):
    calls = []

    def answer(url, timeout):
        calls.append(url)
        if len(calls) == 1:
            raise OSError("down")
        return io.BytesIO(json.dumps({"rows": [{"row": {"id": 1, "category": "IT", "text": "x"}}]}).encode())

    monkeypatch.setattr(rows_api.urllib.request, "urlopen", answer)
    reader = rows_api.RowsApi({"url": "http://h/r", "limit": "45", "pause": "0"}).reader(None)
    parts = reader.partitions()
    assert [(p.offset, p.length) for p in parts] == [(0, 20), (20, 20), (40, 5)] and list(reader.read(parts[0])) == [("1", "IT", "x")] and len(calls) == 2
    rows = spark.createDataFrame([("1", "IT", "a@b.co " + "x" * 400), ("2", "HR", "short")], "id string, category string, text string")
    assert rows_api.clean(rows).first().text.startswith("[EMAIL]") and rows_api.clean(rows).count() == 1


# Corpus and pipeline.


def test_corpus(spark):
    rows, jobs, labels = corpus.generate(spark)
    meta = rows.collect()
    assert len(meta) == 5 * 14 + 5 * 9 and labels.count() == len(meta) * 5 and jobs.count() == 5
    assert {r.attack for r in meta} == {"none", *corpus.ATTACKS} and all((r.control_id is None) == (not r.stuffed) for r in meta)
    assert sorted(meta) == sorted(corpus.generate(spark)[0].collect())


def test_mending(value):
    old = "Name\nSUMMARY\nfine\nEXPERIENCE\ntrue work\nEDUCATION\nschool\nSKILLS\nsql"
    new = "Name\nSUMMARY\nbetter\nEXPERIENCE\nfalse work\nSKILLS\nsql, all"
    assert value(corpus.enforce_evidence(F.lit(new), F.lit(old))) == "Name\nSUMMARY\nbetter\nEXPERIENCE\ntrue work\nSKILLS\nsql, all\nEDUCATION\nschool"
    assert value(corpus.strip_fences(F.lit("```x\na\n```"))) == "a" and value(corpus.is_valid(F.lit(new), F.lit(old))) and not value(corpus.is_valid(F.lit("no"), F.lit(old)))


def test_screening(spark):
    uploads = [
        ("good.txt", b"Ann Bell\nann@example.com\nSUMMARY\nBuilder of services.\nEXPERIENCE\nEngineer at Firm, 2015 - 2020\n- Wrote Django services and SQL reports for years.\nEDUCATION\nMaster of Science\nSKILLS\npython, sql, docker"),
        ("weak.txt", b"Cy Dell\nSUMMARY\nCook.\nEXPERIENCE\nChef at Inn, 2019 - 2020\n- Cooked meals for many people daily.\nSKILLS\nexcel, knives, salt"),
    ]
    resumes, failures = pipeline.load_resume_uploads(spark, uploads, ONTOLOGY, as_of=2024 * 12)
    assert failures.count() == 0
    got = {r.candidate_id: r for r in resumes.collect()}
    assert got["good.txt"].years_experience == 6.0 and got["good.txt"].degree == 3 and got["good.txt"].skills == ["django", "docker", "python", "sql"]
    job = pipeline.build_job(spark, "Engineer\nRequirements:\n- 4+ years\n- python, sql\nPreferred:\n- kubernetes", ONTOLOGY)
    spec = job.first()
    assert (spec.title, spec.required, spec.preferred, spec.min_years) == ("Engineer", ["python", "sql"], ["kubernetes"], 4.0)
    out = pipeline.screen(resumes, job, ONTOLOGY, explain.TemplateExplainer(), explain_top_k=1, skill_method="grounded").orderBy("rank").collect()
    board = pipeline.dashboard(pipeline.screen(resumes, job, ONTOLOGY, None, skill_method="grounded")).orderBy("position").collect()
    assert len(board[0]) == 13 and (board[0].candidate, board[0].degree, board[0].flagged, board[0].score) == ("Ann Bell", "Master's", "", out[0].total)
    assert [r.candidate_id for r in out] == ["good.txt", "weak.txt"] and out[0].scores.total > out[1].scores.total and out[1].scores.gate == 0.25
    assert "Rank #1 - Ann Bell" in out[0].explanation and "Transferable (1): kubernetes via docker" in out[0].explanation and out[1].explanation is None
    assert json.loads(out[0].facts)["matched_skills"] == ["python", "sql"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 10:00:00", i % 2 == 0) for i in range(30)], "ts string, flagged boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incoming.flagged_by_window(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, incoming.flagged_by_window(rows).collect()))


def test_clearing_the_shared_folder(spark):
    from rankweave import runtime

    kept = spark.sparkContext.__dict__.pop("_rankweave_paths", [])  # other tests' tables
    frame = runtime.materialize(spark.range(3), "cleared")
    assert frame.count() == 3 and runtime.clear(spark) == 1 and runtime.clear(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(frame.inputFiles()[0]).count()
    spark.sparkContext.__dict__["_rankweave_paths"] = kept


def test_hosted_calls(monkeypatch):
    import io
    import json
    import urllib.error
    import urllib.request

    asked, waits = [], []

    def answers(*codes):
        left = list(codes)

        def call(request, timeout):
            asked.append(json.loads(request.data))
            code = left.pop(0)
            if isinstance(code, int):
                raise urllib.error.HTTPError(request.full_url, code, "no", {}, None)
            return io.BytesIO(json.dumps(code).encode())

        monkeypatch.setattr(urllib.request, "urlopen", call)

    monkeypatch.setattr(explain.time, "sleep", waits.append)
    chat = explain.HostedExplainer(endpoint="http://x.test/v1", model="m")
    answers(503, 429, {"choices": [{"message": {"content": "well"}}]})
    assert chat.complete("facts", "k") == "well" and waits == [1, 2] and asked[-1]["messages"][1]["content"] == "facts"
    answers(401)
    with pytest.raises(urllib.error.HTTPError):
        chat.complete("facts", "k")
    answers(500, 500, 500)
    with pytest.raises(urllib.error.HTTPError):
        chat.complete("facts", "k")
    answers({"content": [{"type": "text", "text": "so "}, {"type": "text", "text": "it is"}]})
    assert explain.HostedExplainer(endpoint="http://x.test/v1", model="m", form="messages").complete("facts", "k") == "so it is" and "system" in asked[-1]


def test_copies_share_what_names_cannot_reach(spark):
    """Anonymised copies are those of each copy by itself, whether or not a name stands behind the header, is a heading, or opens one."""
    from rankweave.functions import text as tx

    bodies = ["SUMMARY\nA buyer, x@y.org, 555-123 4567.\nSkills\npython", "SUMMARY\nknown as ADA and ada.byron\nSkills\npython 123456", "no heading at all", "Skills   \nAma Mensah wrote sql", "Ada experience\nx\nEducation\nPhD", ""]
    names = ["Ada Byron", "", "Summary Byron", "Zoe (Zo) Q"]
    texts = [(f"{i}-{j}", n, f"{n}\nmail {n.lower().replace(' ', '.')}@z.com{glue}{b}") for i, n in enumerate(names) for j, (b, glue) in enumerate((b, g) for b in bodies for g in ("\n", "    "))]
    groups = spark.createDataFrame([(v, 0, v) for v in ("Ama Mensah", "Skills Jo", "Projects", "O'Neil B", "Al Sum")], "group string, variant_no long, variant string")
    rows = spark.createDataFrame(texts, "candidate_id string, name string, text string").withColumn("shared", audit.shared_body(F.col("text"), F.col("name")))
    c = F.col
    copies = audit.name_copies(rows, groups, ("shared",))
    plain = audit.anonymise(tx.segment_sections(c("text")), c("text"), c("name"))
    got = copies.select("candidate_id", plain.alias("plain"), audit.anonymised_copy(c("text"), c("name"), c("shared")).alias("shared_way"), audit.leaves_alone(c("name"), F.lower("shared")).alias("alone"), audit.same_for_all(c("shared")).alias("same")).collect()
    assert [r.shared_way for r in got] == [r.plain for r in got] and all(r.same == r.plain for r in got if r.alone)
    assert 0 < sum(bool(r.alone) for r in got) < len(got)


def test_gaps_of_kinds_are_not_broadcast(spark):
    """Gaps of kinds take little room written and much in memory: they are merged with the candidates, a row for each kind and asked skill, not for each job too."""
    from rankweave.plans import skill_queries

    d = "/root/testdata/sf0.001"
    plan = skill_queries.query.queries["skill_gap"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [kind" in plan
    *_, gaps = skill_queries._gap_tables(spark, d)
    assert gaps.count() == gaps.select("candidate_id", "skill").distinct().count()


def test_gaps_of_equal_skills_are_found_once(spark, tmp_path):
    from rankweave.plans import skill_queries

    spark.createDataFrame([(i, 1, 48.0) for i in range(5)] + [(5, 2, 48.0)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, 10 + i) for i in range(6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "x", 50), (3, "x", 45)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    members, _, _, _, gaps = skill_queries._gap_tables(spark, str(tmp_path))
    assert gaps.select("candidate_id").distinct().count() == 2 and members.count() == 6
    counts = skill_queries.query.queries["gap_counts"](spark, str(tmp_path)).collect()
    assert sorted((r.candidate_id, r.matched) for r in counts) == [*((10 + i, 1) for i in range(5)), (15, 0)]
