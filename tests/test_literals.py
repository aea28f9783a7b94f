"""Rules that the tables cannot reach, on literal input."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sylvaspark.common import join_lookup
from sylvaspark.functions import text as X
from sylvaspark.operators import answers, doctree, fields, graphs, lexical, linking, metrics, programs, vectors


def column(spark, values, made, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", made(F.col("v"))).orderBy("i").collect()]


def test_tokens(spark):
    assert [sorted(t) for t in column(spark, ["管理 abc 运筹学", "管", "", None, "a 1b2 x9 42"], X.tokens)] == [sorted(["abc", "管理", "理运", "运筹", "筹学"]), [], [], [], ["b2", "x9"]]


def test_semesters(spark):
    values = ["3", " 4 ", "1-6", "/", "13", "2.5", None, "7–8"]
    assert column(spark, values, X.semester_column) == [3, 4, None, None, None, None, None, None]
    assert column(spark, values, X.semester_label)[:4] == ["第 3 学期", "第 4 学期", "第 1–6 学期（弹性）", "未标注"]
    assert column(spark, ["3", "2", "1-6", "1-2", "x"], X.semester_display) == ["第 3 学期（大二上学期）", "第 2 学期（大一下学期）", "第 1–6 学期均可修读（大一至大三）", "第 1–2 学期均可修读（大一）", "x"]


def test_numerals(spark):
    assert column(spark, ["十", "十二", "二十三", "百", "两", "x", "15", "九", ""], X.chinese_number) == [10, 12, 23, 100, 2, None, 15, 9, None]


def test_placeholders(spark):
    values = [None, "", " ", "/", "无", "None", "none", "暂无", "－", "值"]
    assert column(spark, values, X.is_missing) == [True, True, True, True, True, False, True, True, True, False]
    assert column(spark, values, lambda c: X.is_missing(c, X.PROFILE_MISSING, True))[5] is True
    assert column(spark, ["张三、李四", "张三，/，张三；王五。", None], X.name_list)[:2] == [["张三", "李四"], ["张三", "王五"]]


def test_program_names(spark):
    types = ["辅修微专业", "微专业"]
    assert column(spark, ["某学院2024级档案学专业辅修微专业培养方案", "培养方案", "历史学专业"], lambda c: X.core_program(c, types)) == ["档案学", "培养方案", "历史学"]


def test_conditions(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    keep = lambda t: [r["n"] for r in df.where(fields.where(t)).collect()]
    assert keep(None) == [1, 2, 3] and keep({"s": "a"}) == [1] and keep({"s": {"$ne": "a"}}) == [2, 3] and keep({"s": {"$odd": 1}}) == []
    assert keep({"$or": [{"n": {"$gt": 2}}, {"s": {"$in": ["a"]}}]}) == [1, 3] and keep({"$not": {"$and": [{"n": {"$gte": 2}}, {"n": {"$lt": 3}}]}}) == [1, 3] and keep({"s": {"$gt": "a"}}) == [3]


INTENTS = [("《信息组织基础》有几学分？", "fact"), ("学这门课之前要修哪些课", "dependency"), ("第三章讲什么", "structure"), ("主要讲什么内容", "content"), ("有没有数据挖掘这门课", "existence"), ("信管专业有哪些专业必修课", "catalog"), ("你好", "hybrid"), ("先学什么", "dependency"), ("目录学是必修吗", "fact")]


def test_intents(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(INTENTS)], "i int, query string")
    got = [r["intent"] for r in linking.classify(df).orderBy("i").collect()]
    assert got == [w for _, w in INTENTS]


def test_longest_mention_claims_its_span(spark):
    names = spark.createDataFrame([("大数据", "A", 0), ("大数据分析", "B", 0), ("分析化学", "C", 0), ("化学", "D", 0)], "name string, code string, rank int")
    q = spark.createDataFrame([("q1", "大数据分析化学和大数据"), ("q2", "无"), ("q3", None)], "query_id string, query string")
    got = {(r["query_id"], r["code"], r["start"]) for r in linking.mentions(q, names).collect()}
    assert got == {("q1", "B", 1), ("q1", "D", 6), ("q1", "A", 9)}


def test_clarify_equals_all_pairs(spark):
    r = random.Random(2)
    names = ["".join(r.choice("甲乙丙丁戊己") for _ in range(r.randint(2, 7))) for _ in range(80)]
    typed = ["".join(r.choice("甲乙丙丁戊己") for _ in range(r.randint(5, 8))) for _ in range(25)]
    n = spark.createDataFrame([(v, f"C{i:02}") for i, v in enumerate(dict.fromkeys(names))], "key string, course_code string")
    got = {}
    for row in linking.clarify(spark.createDataFrame([(t,) for t in typed], "key string"), n).collect():
        got.setdefault(row["key"], []).append((row["rank"], row["course_code"]))
    for t in set(typed):
        paired = [(round(linking.ratio(t, v), 6), c) for v, c in ((x["key"], x["course_code"]) for x in n.collect()) if any(t[i : i + 2] in v for i in range(len(t) - 1)) or len(v) == 1]
        want = [c for s, c in sorted(((s, c) for s, c in paired if s >= 0.6), key=lambda x: (-x[0], x[1]))[:3]]
        assert [c for _, c in sorted(got.get(t, []))] == want


def test_heading_path(spark):
    r = random.Random(7)
    rows = [(d, i, r.choice([1, 2, 3, 4, None, None]), f"t{i}") for d in range(6) for i in range(60)]
    got = {(x["doc_id"], x["pos"]): x["path"] for x in doctree.heading_path(spark.createDataFrame(rows, "doc_id int, pos int, level int, line string")).collect()}
    for d in range(6):
        stack: list = []
        for _, i, level, t in (x for x in rows if x[0] == d):
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, t))
            assert got[d, i] == [t for _, t in stack]


def test_accepted_edges_have_no_cycle(spark):
    r = random.Random(3)
    edges = list({(r.randint(1, 9), r.randint(1, 9)) for _ in range(50)})
    rows = [(a, b, r.randint(0, 99) / 100) for a, b in edges]
    got = {(x["src"], x["dst"]) for x in graphs.accept(spark.createDataFrame(rows, "src long, dst long, confidence double")).collect()}
    want, after = set(), {}

    def reach(a, b):
        return a == b or any(reach(x, b) for x in after.get(a, ()))

    for a, b, _ in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a != b and not reach(b, a):
            want.add((a, b))
            after.setdefault(a, set()).add(b)
    assert got == want


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: np.array(r["embedding"]) for r in vectors.hash_embedding(df, "id", "t", 16).collect()}
    want = np.zeros(16)
    for w in ("alpha", "beta", "alpha"):
        h = hashlib.sha256(w.encode()).digest()
        want[int.from_bytes(h[:4], "little") % 16] += 1 if h[4] & 1 else -1
    assert np.allclose(got[1], want / np.linalg.norm(want)) and not got[2].any() and not got[3].any()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 60)], "a long, b long")
    n = spark.range(70)
    got = {r["id"]: r["root"] for r in vectors.components(e, n).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[51] == 50 and got[60] == 60 and got[69] == 69


def test_cosine_of_zero_and_unequal(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_hot_key_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else (None if i % 10 == 0 else f"k{i}")) for i in range(6000)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2)], "k string, v int")
    got = {r["i"]: r["v"] for r in join_lookup(left, right, "k").collect()}
    assert len(got) == 6000 and got[1] == 1 and got[2] == 2 and got[10] is None and got[4] is None
    assert join_lookup(left, right, "k", "inner").count() == 3001


def test_answers_and_json(spark):
    df = spark.createDataFrame([("x {\"a\": [1, 2]} y",), ("no",), (None,), ("{bad [1]",)], "t string")
    assert [r["json"] for r in answers.first_json(df, "t").collect()] == ['{"a": [1, 2]}', None, None, "[1]"]
    keys = answers.alias_key(spark.createDataFrame([("数组的定义",), ("方法论",), ("ＡＢ－Ｃ",)], "t string"), "t")
    assert [r["alias_key"] for r in keys.collect()] == ["数组", "方法论", "abc"]


def test_fill_and_metrics(spark):
    rows = [(1, 1, "A", "x"), (1, 2, None, None), (1, 3, "B", None), (1, 4, None, "y"), (2, 1, None, None)]
    got = [tuple(r) for r in programs.forward_fill(spark.createDataFrame(rows, "k int, r int, c string, s string"), ["k"], ["r"], "c", "s").orderBy("k", "r").select("c", "s").collect()]
    assert got == [("A", "x"), ("A", "x"), ("B", None), ("B", "y"), (None, None)]
    g = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "gold string, predicted string")
    m = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in metrics.per_class(g).collect()}
    assert m == {"a": (0.5, 0.5, 0.5, 2), "b": (0.5, 1.0, 0.6667, 1), "c": (0.0, 0.0, 0.0, 1)}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "alpha gamma gamma"), (2, None), (3, "delta")], "doc_id long, text string")
    m = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.search(docs, None).collect()}  # rounded to six decimals
    idf = lambda df: np.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda i, tf, n: i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    assert abs(m[0, 0] - part(idf(2), 1, 2) - part(idf(1), 1, 2)) < 1e-6 and abs(m[0, 1] - part(idf(2), 1, 3)) < 1e-6 and (0, 3) not in m


def test_search_shards_and_groups(spark, monkeypatch):
    """Small shards and blocks give the same best documents as one; groups keep their own best; nulls and repeated words are harmless."""
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(words[(i * k) % 5] for k in range(1 + i % 7)), "ab"[i % 2]) for i in range(120)] + [(None, "alpha", "a"), (200, None, "a"), (250, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    every = {}
    for r in lexical.search(docs, None).collect():
        every.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    assert set(every) == {0, 50, 100}
    monkeypatch.setattr(lexical, "SHARD", 7)
    monkeypatch.setattr(lexical, "BLOCK", 1)
    best = {}
    for r in lexical.top(lexical.search(docs, 5)).collect():
        best.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    assert {q: sorted(v) for q, v in best.items()} == {q: sorted(v)[:5] for q, v in every.items()}
    by = lexical.search(docs, 2, group=F.col("kind")).where("query_id = 0").collect()
    assert {r["kind"] for r in by} == {"a", "b"}
    assert lexical.search(docs.limit(0), 5).count() == 0


def test_mentions_both_ways(spark, monkeypatch):
    """An automaton and a join on substrings find the same names, however long."""
    long = "超长课程名称" * 30
    names = spark.createDataFrame([("高等数学", "M1", 0), ("数学", "M2", 0), ("线性代数", "M3", 0), (long, "L1", 0), (None, "N", 0), ("", "E", 0)], "name string, code string, rank int")
    q = spark.createDataFrame([(1, "高等数学和线性代数"), (2, f"请问{long}难吗，数学呢"), (3, None), (4, ""), (5, "数学数学")], "query_id int, query string")
    one = {tuple(r) for r in linking.mentions(q, names).collect()}
    monkeypatch.setattr(linking, "AUTOMATON", 0)
    assert one == {tuple(r) for r in linking.mentions(q, names).collect()} == {(1, "M1", "高等数学", 1), (1, "M3", "线性代数", 6), (2, "L1", long, 3), (2, "M2", "数学", 3 + len(long) + 3), (5, "M2", "数学", 1)}
    assert linking.mentions(q, names.limit(0)).count() == 0


def test_layers_and_closure_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (5, 6), (6, 5), (6, 7), (8, 8), (1, 2), (4, 7)], "src long, dst long")
    done, stuck = graphs.layers(e)
    assert {tuple(r) for r in done.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)} and {r[0] for r in stuck.collect()} == {5, 6, 7, 8}
    c = graphs.closure(e, spark.createDataFrame([(4,), (5,), (9,)], "target long"))
    assert {tuple(r) for r in c.collect()} == {(4, 4, 0), (4, 3, 1), (4, 2, 2), (4, 1, 2), (5, 5, 0), (5, 6, 1), (9, 9, 0)}
    done, stuck = graphs.layers(e.limit(0))
    assert done.count() == stuck.count() == 0


def test_split_content():
    assert answers.split_content(None) == answers.split_content(" \n") == [] and answers.split_content(" 短。 ") == ["短。"]
    text = "".join(f"{i:03d}" + "字" * 46 + "。" for i in range(40))
    parts = answers.split_content(text)
    assert all(len(p) <= 700 + 81 for p in parts) and len(parts) == 4
    for a, b in zip(parts, parts[1:]):
        assert b.startswith(a[-80:] + "\n")
    whole = "".join([parts[0], *(p[81:] for p in parts[1:])]).replace("\n", "")
    assert whole == text
    run = answers.split_content("长" * 2000)
    assert [len(p) for p in run] == [700, 700, 700, 140] or sum(map(len, run)) >= 2000
    assert "".join([run[0], *(p[80:] for p in run[1:])]).replace("\n", "") == "长" * 2000


def test_clarify(spark):
    unknown = spark.createDataFrame([("线性代数一",), ("高数",), ("完全不同",), ("",)], "key string")
    names = spark.createDataFrame([("线性代数", "M1"), ("线性代数二", "M2"), ("高等数学", "M3"), ("线性规划", "M4"), ("大学物理", "P1")], "key string, course_code string")
    got = [tuple(r) for r in linking.clarify(unknown, names).orderBy("key", "rank").select("key", "course_code", "score", "rank").collect()]
    assert got == [("线性代数一", "M1", round(8 / 9, 6), 1), ("线性代数一", "M2", 0.8, 2), ("高数", "M3", round(4 / 6, 6), 1)]
