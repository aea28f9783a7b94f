import random

from sylvaspark.llm import mapping as M
from sylvaspark.llm import splitting as S


def test_pieces_cover_the_text():
    r = random.Random(1)
    parts = ["句子。", "很长的一句话，里面有逗号，", "A line of words. ", "\n", "\n\n", "- 项目\n", "第一章 标题\n", "| a | b |\n", "x" * 90, "é" * 5]
    for text in ["".join(r.choice(parts) for _ in range(r.randint(1, 300))) for _ in range(120)] + ["x" * 5000, "e" + "́" * 2000]:
        found = S.split_text(text, 120, 20)
        assert "".join(text[b:e] for _, b, e in found) == text
        assert all(e - s <= 120 and 0 <= b - s <= 20 and e > b for s, b, e in found) or len(text) <= 120
        assert all(s == before[2] - (b - s) for before, (s, b, e) in zip(found, found[1:]))


def test_natural_boundaries():
    text = "# 一\n" + "甲句子。" * 30 + "\n# 二\n" + "乙句子。" * 30
    found = S.split_text(text, 130, 10)
    assert all(text[e - 1] in "。\n" for _, _, e in found) and any(text[b:e].startswith("# 二") for _, b, e in found)


def test_split_rows(spark):
    rows = [("a", "字" * 751, ["c1", "c2"], 0), ("a", "字" * 751, ["c1", "c2"], 0), ("b", "字" * 750, ["c"], 0), ("c", None, None, 0), ("d", "", [], 0), ("e", "句。" * 600, None, 0)]
    df = spark.createDataFrame(rows, "node_id string, text string, chunk_ids array<string>, piece_no int")
    got = S.split(df).collect()
    assert {r["node_id"] for r in got} == {"a", "e"}
    assert [r["piece_no"] for r in sorted((r for r in got if r["node_id"] == "a"), key=lambda r: r["piece_no"])] == [1, 2]
    assert all(len(r["piece"]) <= 750 for r in got) and all(r["chunk_ids"] == ["c1", "c2"] for r in got if r["node_id"] == "a")
    assert S.split(df.limit(0)).count() == 0


def test_mapping(spark):
    ref = spark.createDataFrame([("PB1", "线性代数导论", "Linear Algebra: Introduction", "q"), ("PB1027", "线性规划方法", "Linear Programming: Methods", "q"), ("PB3", "合同法", None, "q"), ("PB4", "双名课程", "", "q"), ("PB5", "双名课程", "", "q")], "code string, name string, english string, value string")
    typed = ["线性代数导论", " 《线性代数导伦》 ", "线 性 规 划 方 法", "LINEAR PROGRAMMING: METHODS", "pb 1027", "先修：合同法（必修）", "陶瓷修复", "双名课程", "", "线" * 5000, None, "线性代数导论"]
    got = {r["value"]: r["ref_code"] for r in M.map_values(spark, spark.createDataFrame([(v,) for v in typed], "value string"), ref, "code", ["name", "english"]).collect()}
    assert got["线性代数导论"] == got[" 《线性代数导伦》 "] == "PB1" and got["线 性 规 划 方 法"] == got["LINEAR PROGRAMMING: METHODS"] == got["pb 1027"] == "PB1027"
    assert got["先修：合同法（必修）"] == "PB3" and got["陶瓷修复"] == "" and got["双名课程"] == "" and None not in got and got["线" * 5000] == ""


def test_no_candidate_is_missed(spark):
    r = random.Random(4)
    names = ["".join(r.choice("甲乙丙丁戊己庚辛") for _ in range(6)) for _ in range(60)]
    ref = spark.createDataFrame([(f"C{i}", n) for i, n in enumerate(dict.fromkeys(names))], "code string, name string")
    typed = [n[:k] + r.choice("甲乙丙子") + n[k + 1 :] for n in names for k in (0, 3)]
    low = {x["value"]: x["score"] for x in M.map_values(spark, spark.createDataFrame([(v,) for v in typed], "value string"), ref, "code", ["name"], 0.5, 0.05).collect()}
    import math

    forms = {n: M.grams(n) for n in dict.fromkeys(names)}
    df = {}
    for g in forms.values():
        for k in g:
            df[k] = df.get(k, 0) + 1

    def vector(c):
        v = {k: (1 + math.log(n)) * math.log(1 + len(forms) / df[k] if k in df else 1 + 2 * len(forms)) for k, n in c.items()}
        z = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / z for k, x in v.items()}

    vectors = {n: vector(c) for n, c in forms.items()}
    for t in typed:
        v = vector(M.grams(t))
        best = max(sum(x * w.get(k, 0) for k, x in v.items()) for w in vectors.values())
        if best >= 0.5:
            assert abs(low[t] - best) < 1e-6


def test_mapping_empty_tables(spark):
    ref = spark.createDataFrame([], "code string, name string")
    got = M.map_values(spark, spark.createDataFrame([("x",)], "value string"), ref, "code", ["name"]).collect()
    assert [(r["value"], r["ref_code"]) for r in got] == [("x", "")]


def test_mapping_against_brute_force(spark, monkeypatch):
    """Every decision and every best score equals that of scoring each value against each entry, with busy grams dealt out."""
    import math
    import random

    r = random.Random(11)
    letters = "数据结构算法分析理论导概率统计线性代"
    names = sorted({"".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(60)})
    ref = [(f"C{i:03d}", x) for i, x in enumerate(names)]
    typed = sorted({x for n in names for x in (n, n[:-1], n[::-1], n + r.choice(letters), r.choice(letters) + n[1:])} | {"".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(200)})
    df = {}
    for n in names:
        for g in M.grams(n):
            df[g] = df.get(g, 0) + 1

    def vector(x):
        v = {g: (1 + math.log(k)) * (math.log(1 + len(names) / df[g]) if g in df else math.log(1 + 2 * len(names))) for g, k in M.grams(x).items()}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {g: w / size for g, w in v.items()}

    entries = {c: vector(n) for c, n in ref}
    monkeypatch.setattr(M, "HOT_ROWS", 5)
    for threshold, margin in ((0.45, 0.1), (0.7, 0.3)):
        got = {x["value"]: (x["ref_code"], x["score"]) for x in M.map_values(spark, spark.createDataFrame([(v,) for v in typed], "value string"), spark.createDataFrame(ref, "code string, name string"), "code", ["name"], threshold, margin, True).collect()}
        near = 0
        for x in typed:
            v = vector(M.normalise(x)[1])
            scores = sorted(((round(sum(w * e.get(g, 0) for g, w in v.items()), 9), c) for c, e in entries.items()), reverse=True)
            (a, code), (b, _) = scores[0], scores[1]
            if abs(a - b - margin) < 1e-6 or abs(a - threshold) < 1e-6:
                continue
            near += threshold - margin <= b < threshold <= a
            assert got[x][0] == (code if a >= threshold and a - b >= margin else ""), x
            assert abs(got[x][1] - a) < 1e-6, x
        assert near > 5
