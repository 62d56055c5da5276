"""Vectors through a store, many spellings by an automaton, the best place of a segment by blocks."""

import os
import random
import re
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import blocks, dictionary, embedder, grounding
from rankweave.operators import skills as sk
from rankweave.operators.ontology import SkillOntology
from rankweave.plans import pipeline

# --- embedder


def counting_loader(folder):
    """Leaves a file for each load, named by the process, and one for each text it encodes."""

    def load(device):
        Path(folder, f"load-{os.getpid()}-{len(os.listdir(folder))}-{device}").touch()
        letters = embedder.load_letters(device)

        def model(texts):
            for t in texts:
                with open(f"{folder}/texts-{os.getpid()}", "a") as out:
                    out.write(f"{t!r}\n")
            return letters(texts)

        return model

    return load


def encoded(folder):
    return sorted(line for p in Path(folder).glob("texts-*") for line in p.read_text().splitlines())


def test_only_unseen_texts_are_encoded(spark, tmp_path):
    seen, store = tmp_path / "seen", tmp_path / "store"
    seen.mkdir()
    model = embedder.Embedder("counting", counting_loader(str(seen)), 26, f"file://{store}", batch=2)
    rows = [(1, "abc"), (2, "abc"), (3, None), (4, ""), (5, "zz top"), (6, "ÀÉ 12")]
    frame = spark.createDataFrame([(*r, "v") for r in rows], "id long, text string, vector2 string").repartition(3)
    found = {r.id: r.vector for r in model.encode(frame, F.col("text")).collect()}
    assert found[3] is None and found[1] == found[2] and found[4] == [0.0] * 26
    assert found[1][:4] == pytest.approx([3**-0.5] * 3 + [0.0])
    assert encoded(seen) == sorted(map(repr, {"abc", "", "zz top", "ÀÉ 12"}))
    loads = [p.name.split("-")[1] for p in seen.glob("load-*")]
    assert len(loads) == len(set(loads))  # once a worker
    assert model.fill(frame, F.col("text")) == 0 and model.fill(frame.limit(0), F.col("text")) == 0
    more = spark.createDataFrame([(7, "new"), (8, "abc")], "id long, text string")
    assert model.fill(more, F.col("text")) == 1 and model.fill(more, F.col("text")) == 0
    assert encoded(seen).count("'abc'") == 1 and model.vectors(spark).count() == 5


def test_appends_are_whole_or_not_there(spark, tmp_path):
    model = embedder.Embedder("letters", embedder.load_letters, 26, f"file://{tmp_path}")
    frame = spark.createDataFrame([(i, f"text {chr(97 + i)}") for i in range(6)], "id long, text string")
    assert model.fill(frame.where("id < 3"), F.col("text")) == 3
    (first,) = (tmp_path / "letters").glob("append-3-*")
    # A writer that died before its end: no success mark, so nobody reads it, and the same append replaces it.
    shutil.copytree(first, broken := tmp_path / "letters" / "append-9-dead")
    (broken / "_SUCCESS").unlink()
    assert model.vectors(spark).count() == 3
    (first / "_SUCCESS").unlink()
    assert model.fill(frame.where("id < 3"), F.col("text")) == 3 and len(list((tmp_path / "letters").glob("append-3-*"))) == 1
    # A file that can't be read is missing, not an error.
    for part in first.glob("part-*.parquet"):
        part.write_bytes(b"not parquet")
    for check in first.glob(".part-*.crc"):
        check.unlink()
    assert model.fill(frame, F.col("text")) == 6 and model.vectors(spark).count() == 6


def test_documents_are_chunked_pooled_and_zero_without_words(spark, tmp_path):
    model = embedder.Embedder("letters", embedder.load_letters, 26, f"file://{tmp_path}", kind="double")
    texts = ["a b", " \n ", None, " ".join(["ab"] * 400 + ["c"] * 3)]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.vector for r in pipeline.encode_documents(frame, "doc_id", F.col("text"), model).collect()}
    assert found[1] == found[2] == [0.0] * 26 and len(found) == 4
    assert found[0][:3] == pytest.approx([0.5**0.5, 0.5**0.5, 0]) and np.linalg.norm(found[3]) == pytest.approx(1) and found[3][2] > 0


def test_a_model_of_another_width_is_refused(spark, tmp_path):
    model = embedder.Embedder("letters", embedder.load_letters, 25, f"file://{tmp_path}")
    with pytest.raises(Exception, match="not 25 numbers each"):
        model.fill(spark.createDataFrame([("a",)], "text string"), F.col("text"))


def test_embedders_of_the_process():
    assert embedder.get_embedder() is embedder.get_embedder()
    assert embedder.get_embedder(store="s") is not embedder.get_embedder(store="s")


# --- dictionary


def slow_hits(text, surfaces):
    """The regular expression's way: at each place from the left, the longest spelling that stands alone."""
    low, out, at = (text or "").lower(), [], 0
    gap = r"[ \t\n\x0b\f\r]+"
    patterns = [re.compile(gap.join(map(re.escape, s.split(" ")))) for s in sorted({dictionary.folded(s) for s in surfaces} - {""}, key=lambda s: (-len(s), s))]
    while at < len(low):
        hit = None
        if at == 0 or not re.match("[a-z0-9]", low[at - 1]):
            for p in patterns:
                m = p.match(low, at)
                if m and not re.match("[a-z0-9]", low[m.end() : m.end() + 1] or " "):
                    hit = m
                    break
        if hit:
            out.append((hit.group(), at))
            at = hit.end()
        else:
            at += 1
    return out


SURFACES = ["python", "Python 3", "c++", "c", "machine learning", "learning", "learning rate", ".net", "deep  machine learning", "é", "", "  ", "go", "naïve bayes", "sql"]
TEXTS = ["Python 3 and c++, C; pythonic python3", "deep machine\n\tlearning rate learning   rate", "x.NET .net sql/sql sqlsql", None, "", "go go gogo go", "Naïve   Bayes é éé aé", "\n c \n\n machine  learning", "İ python c"]


@pytest.mark.parametrize("shard", [10**6, 20])
def test_hits_by_brute_force(spark, shard):
    frame = spark.createDataFrame([(i, t, "m") for i, t in enumerate(TEXTS)], "id long, text string, hits_spans2 string")
    found = dictionary.add_matches(frame, "text", SURFACES, "hits", shard_bytes=shard)
    assert found.columns == [*frame.columns, "hits"]
    got = {r.id: [(h.surface, h.start) for h in r.hits] for r in found.collect()}
    assert got == {i: slow_hits(t, SURFACES) for i, t in enumerate(TEXTS)}
    assert dictionary.add_matches(frame, "text", [], "hits").where("size(hits) > 0").count() == 0


def test_ten_thousand_spellings(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcd") for _ in range(draw.randrange(1, 8)))
    surfaces = list({" ".join(word() for _ in range(draw.choice((1, 1, 2, 3)))) for _ in range(12_000)})[:10_000]
    texts = [" ".join(draw.choice((word(), draw.choice(surfaces))) for _ in range(60)) for _ in range(20)]
    frame = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    known = set(surfaces)
    for r in dictionary.add_matches(frame, "text", surfaces, "hits").collect():
        words, at, want = texts[r.id].split(" "), 0, []
        while at < len(words):  # these spellings are whole words of at most three, or of more where one holds spaces
            run = next((k for k in (3, 2, 1) if at + k <= len(words) and " ".join(words[at : at + k]) in known), 0)
            if run:
                want.append(" ".join(words[at : at + run]))
            at += run or 1
        assert [h.surface for h in r.hits] == want
        assert all(texts[r.id][h.start : h.start + len(h.surface)] == h.surface for h in r.hits)


def test_spellings_inside_words_are_never_met():
    automaton = dictionary._automaton(["a", "ab", "b", "bc", "abc", "+c", "c+", "abc abc"])
    walked = []

    class Counted:
        def __len__(self):
            return len(automaton)

        def iter(self, text):
            for hit in automaton.iter(text):
                walked.append(hit)
                yield hit

    texts = ["xabc abcx", "abc  \t abc", "", "abab+c", " abc+", "abc+c"]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    a, b = dictionary.raw_matches(Counted(), "\n".join(texts), starts)
    hits = sorted((int(np.searchsorted(starts, x, "right")) - 1, "\n".join(texts)[x:y]) for x, y in zip(a, b, strict=True))
    assert hits == [(1, "abc"), (1, "abc"), (1, "abc  \t abc"), (4, "abc"), (5, "abc")]
    assert len(walked) == len(hits) + 2  # "+c" twice, whose plus touches a word


def test_texts_pass_python_once_and_stay_there(spark):
    texts = [None, "", "Go  go", "x" * 700_000 + " sql", "no\ngo " * 300_000, "é İ SQL"]
    frame = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "id long, text string, more string").coalesce(1)
    found = dictionary.add_matches(frame, "text", ["go", "sql", "go go"], "hits", keep=["more", "id"])
    assert found.columns == ["more", "id", "hits"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.id: [(h.surface, h.start) for h in r.hits] for r in found.collect()}
    assert got == {0: [], 1: [], 2: [("go  go", 0)], 3: [("sql", 700_001)], 4: [("go", 6 * i + 3) for i in range(300_000)], 5: [("sql", 5)]}


def test_skills_by_automaton_are_those_by_pattern(spark, monkeypatch):
    ontology = SkillOntology.load()
    texts = ["Skills\npython, docker, c, go\nExperience\nmachine learning with PyTorch, React.js and node.js; went to go home", "R, SQL | AWS", None]
    rows = spark.createDataFrame([(f"{i}.txt", t) for i, t in enumerate(texts)], "path string, text string")
    rows = rows.withColumns({"spans": F.array().cast("array<struct<text:string,page:int,font:string,size:double,color:int,flags:int,bbox:array<double>>>"), "page_backgrounds": F.array().cast("array<int>")})
    plain = {r.candidate_id: r.skills for r in pipeline.build_resumes(rows, ontology, 24_000).select("candidate_id", "skills").collect()}
    monkeypatch.setattr(pipeline, "AUTOMATON_FROM", 10)
    walked = {r.candidate_id: r.skills for r in pipeline.build_resumes(rows, ontology, 24_000).select("candidate_id", "skills").collect()}
    assert walked == plain and plain["0"]
    spans = rows.select(sk.matches(F.col("text"), sk.dictionary_pattern(list(ontology.alias_index))).alias("a"), F.col("path"))
    other = dictionary.add_matches(rows.select("path", "text"), "text", list(ontology.alias_index), "b")
    assert spans.join(other, "path").where("NOT (a <=> b)").count() == 0


# --- segments


def slow_best(left, right, apart):
    def unit(v):
        v = np.array(v if v is not None and len(v) == 3 else [0.0] * 3, float)
        return v / n if (n := np.linalg.norm(v)) > 0 else v

    out = {}
    for s, i, v in left:
        met = [(-round(float(np.clip(unit(v) @ unit(w), 0, 1)), 9), p) for t, p, w in right if t == s and not (apart and p == i)]
        if met and s is not None:
            out[s, i] = (-min(met)[0], min(met)[1])
    return out


@pytest.mark.parametrize("rows,apart", [(4096, False), (4096, True), (7, False), (7, True), (1, False)])
def test_best_of_a_segment(spark, rows, apart):
    draw = random.Random(rows)
    vector = lambda: [draw.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(3)]
    left = [(draw.choice(("hot", "hot", "hot", "a", "b")), i, vector()) for i in range(60)] + [(None, 900, [1.0] * 3), ("alone", 901, [1.0] * 3), ("a", 902, None)]
    right = [(draw.choice(("hot", "hot", "hot", "a", "b")), i, vector()) for i in range(70)] + [(None, 900, [1.0] * 3), ("empty", 903, [1.0] * 3), ("a", 904, [1.0, 2.0]), ("a", 905, None)]
    l = spark.createDataFrame([(*r, "x") for r in left], "s string, item long, vector array<double>, _v string")
    r = spark.createDataFrame(right, "s string, place long, vector array<double>")
    found = blocks.segment_best(l, r, "s", "item", "place", places=9, apart=apart, side_rows=rows)
    got = {(x.s, x.item): (x.similarity, x.place) for x in found.collect()}
    want = slow_best(left, right, apart)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert blocks.segment_best(l.limit(0), r, "s", "item", "place").count() == blocks.segment_best(l, r.limit(0), "s", "item", "place").count() == 0


def test_best_sentences_have_no_pair_table(spark):
    claims = spark.createDataFrame([(1, "x", [1.0, 0.0]), (1, "y", [0.0, 1.0]), (2, "x", [1.0, 1.0])], "candidate_id long, skill string, vector array<double>")
    told = spark.createDataFrame([(1, 5, "late", [2.0, 0.0]), (1, 3, "early", [1.0, 0.0]), (1, 9, "mixed", [1.0, 1.0])], "candidate_id long, pos long, sentence string, vector array<double>")
    found = grounding.best_sentence(claims, told)
    assert sorted((r.candidate_id, r.skill, r.sentence, round(r.similarity, 6)) for r in found.collect()) == [(1, "x", "early", 1.0), (1, "y", "mixed", round(0.5**0.5, 6))]
