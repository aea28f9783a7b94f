"""Operators read all of their input: no language, id or place is left out."""

import numpy as np

from sylvaspark.operators import answers, doctree, graphs, metrics, programs, vectors


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_lines_of_every_language(spark, tmp_path):
    langs = ["zh", "zh-CN", "ZH", "en", None]
    rows = [(i, x, "syllabus", "一、课程目标\n说明文字\n第1周 绪论") for i, x in enumerate(langs)] + [(9, "zh", "syllabus", None)]
    d = write(spark, tmp_path, "documents", rows, "doc_id long, lang string, doc_kind string, text string")
    every = set(range(len(langs)))
    for f in (doctree.o41_heading_path, doctree.o42_heading_level, doctree.o111_excerpt, doctree.o121_neighbours, doctree.o122_links, doctree.o194_doc_tree):
        assert {r.doc_id for r in f(spark, d).collect()} == every, f.__name__
    assert {r.kind: r.n for r in doctree.o44_section_type(spark, d).collect()} == {"objectives": 5}
    assert len(answers.o196_schedule_prefix(spark, d).collect()) > 0


def test_candidates_of_every_language(spark, tmp_path):
    docs = [
        (1, "zh", "web", "C1", "掌握概率密度和约束极值，第3章 绪论\n学时 考试 Bayes网络"),
        (2, None, "web", "C1", "概率密度；矩阵"),
        (3, "EN", "web", None, "Graph theory, graph (Theory)"),
        (4, "zh", "web", "C2", "概率密度"), (5, "zh", "web", "C3", None), (6, "zh", "web", "C4", "本章 学分"),
    ]
    d = write(spark, tmp_path, "documents", docs, "doc_id long, lang string, source string, course_code string, text string")
    got = {(r.course, r.phrase): r.tf for r in programs.o86_phrases(spark, d).collect()}
    c1 = {"概率密度": 2, "约束极值": 1, "Bayes网络": 1, "矩阵": 1}
    assert got == {("C1", k): n for k, n in c1.items()} | {("web", k): 1 for k in ("Graph", "theory", "graph", "Theory")} | {("C2", "概率密度"): 1}
    best = {(r.course, r.phrase): (r.score, r["rank"]) for r in programs.o87_ranked_phrases(spark, d).collect()}
    # five courses, those without candidates included; the phrase of two of them stays
    assert best["C1", "概率密度"] == (round(2 * (np.log(5 / 2) + 1), 6), 1) and best["C2", "概率密度"][0] == round(np.log(5 / 2) + 1, 6)


def test_phrases_of_a_single_course(spark, tmp_path):
    d = write(spark, tmp_path, "documents", [(1, "zh", "web", "C1", "矩阵")], "doc_id long, lang string, source string, course_code string, text string")
    assert [(r.phrase, r.score) for r in programs.o87_ranked_phrases(spark, d).collect()] == [("矩阵", 1.0)]


def test_hash_vectors_of_every_language(spark, tmp_path):
    rows = [(1, "zh", "概率　密度"), (2, None, "a A"), (3, "en", None)]
    d = write(spark, tmp_path, "documents", rows, "doc_id long, lang string, text string")
    assert {r.doc_id: r.used for r in vectors.o167_hash_embedding(spark, d).collect()} == {1: 2, 2: 1, 3: 0}


def test_conflicts_of_all_records(spark, tmp_path):
    rows = [
        (1, "A1", "P", "3", "48", "x、y"), (2, "a1 ", "P", "3", "", "y、x"), (3, "A1", "P", "4", "48", "x"), (4, "A1", "P", "", "32", "x、y"),
        (5, "B1", "P", "2", "16", "x、y"), (6, "B1", "P", "2", "16", "y、x"), (7, "B1", "P", None, "", "x、y"), (8, "C1", "P", "2", "16", "x"),
    ]
    schema = "offering_id long, course_code string, program_name string, credits string, hours string, instructor string, ingested_at string"
    d = write(spark, tmp_path, "course_offerings", [(*r, "t") for r in rows], schema)
    assert {r.code: r.conflicts for r in programs.o70_conflicts(spark, d).collect()} == {"A1": "credits,hours"}
    assert {r.code: r.same for r in metrics.o225_instructors(spark, d).collect()} == {"A1": False, "B1": True}
    assert [tuple(r) for r in metrics.o226_instructor_report(spark, d).collect()] == [(2, 0.5)]


def vector_table(spark, path, ids):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(size=4)], "ab"[i % 2]) for i in ids]
    return write(spark, path, "embeddings", rows, "vec_id long, embedding array<float>, label string")


def test_signals_of_all_pairs(spark, tmp_path):
    ids = [3, 41, 63, 101, 120]
    got = {(r.target, r.source): (r.bloom_allowed, r.rule, r.structure) for r in answers.o274_signals(spark, vector_table(spark, tmp_path, [*ids, 117])).collect()}
    assert set(got) == {(a, b) for a in ids for b in ids if a != b}
    assert got[101, 41] == (True, 1.0, 0.3) and got[120, 101] == (False, 0.0, 0.0)


def test_scores_of_every_match(spark, tmp_path):
    rows = [(50, "graph theory"), (7, "graph"), (90, "theory of sets"), (51, "algebra"), (100, "sets")]
    d = write(spark, tmp_path, "documents", [(i, "en", t) for i, t in rows], "doc_id long, lang string, text string")
    assert {(r.query_id, r.doc_id) for r in answers.o136_pair_score(spark, d).collect()} == {(50, 50), (50, 7), (50, 90), (100, 100), (100, 90)}


def test_chains_from_every_course(spark, monkeypatch):
    e = spark.createDataFrame([(20, 30), (30, 50), (60, 20), (70, 60), (50, 51)], "src long, dst long")
    monkeypatch.setattr(graphs, "part_edges", lambda *_: e)
    assert {(r.src, r.dst, r.distance) for r in graphs.o186_relation_chain(spark, "").collect()} == {(30, 50, 1), (20, 50, 2), (60, 50, 3)}


def test_limits_of_the_reference(spark, tmp_path, monkeypatch):
    d = vector_table(spark, tmp_path, range(1, 300))
    new = vectors.o170_concept_pairs(spark, d).where("(source + target) % 3 <> 0").count()
    assert answers.o271_verify_links(spark, d).where("not cached").count() == new > 40
    e = spark.createDataFrame([(i, 50) for i in range(100, 220)], "src long, dst long")
    monkeypatch.setattr(graphs, "part_edges", lambda *_: e)
    assert graphs.o117_paths(spark, d).count() == 100
    assert graphs.o191_mermaid(spark, d).collect()[0].diagram.count("-->") == 100
    text = " ".join(f"{a}{b}x" for a in "abcdefg" for b in "abcdefg")
    write(spark, tmp_path, "documents", [(1, "en", "web", "C1", text)], "doc_id long, lang string, source string, course_code string, text string")
    assert programs.o87_ranked_phrases(spark, d).count() == 40
