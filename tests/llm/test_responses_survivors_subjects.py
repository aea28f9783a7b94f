import datetime as dt

from pyspark.sql import functions as F

from sylvaspark.llm import responses as R
from sylvaspark.llm import subjects as J
from sylvaspark.llm import survivors as V

CASES = [
    ("课程几个学分？", None, ["empty"]), ("课程几个学分？", "<p></p>", ["empty"]), ("课程几个学分？", "答：", ["empty"]), ("课程几个学分？", "N/A", ["empty"]), ("课程几个学分？", "3", []),
    ("谁负责这门课？", "课程组", []), ("谁负责这门课？", "问：谁负责这门课？", ["copy"]), ("How is it assessed in the course?", "HOW IS IT ASSESSED IN THE COURSE", ["copy"]),
    ("谁负责这门课？", "抱歉，我无法回答这个问题。", ["refusal"]), ("Who teaches the course?", "I'm sorry, but I can't help with that.", ["refusal"]), ("缺考了怎么办？", "缺考的学生无法参加当学期的补考，需要重新选课。", []),
    ("Is it suitable for the students?", "Yes, but the laboratory cannot be reached from outside.", []), ("谁负责这门课？", "The course is run by the group of the college.", ["other_language"]),
    ("谁负责这门课？请用英文回答", "The course is run by the group of the college.", []), ("When is the course taught?", "培养方案把它放在第二学期，与另一门课同步进行。", ["other_language"]),
    ("学什么？主要内容", "共三条：\n1. 甲部分的内容。\n2. 乙部分的内容。", ["truncated"]), ("学什么？主要内容", "如果已经修过《", ["truncated"]), ("学什么？主要内容", "要点如下：\n- 甲\n- 乙", []), ("学什么？主要内容", "课程重点为甲，", ["truncated"]),
]


def test_defects(spark):
    rows = [(f"q{i}", q, a, 1) for i, (q, a, _) in enumerate(CASES)]
    rows += rows[:3] + [(None, "x", "y", 1), ("z", None, "安排在第二学期。", 1)]
    got = {r["query_id"]: r["defects"] for r in R.flag(spark.createDataFrame(rows, "query_id string, query string, answer string, ending int")).collect()}
    for i, (q, a, want) in enumerate(CASES):
        assert got.get(f"q{i}", [])[:1] == want, (q, a, got.get(f"q{i}"))
    assert "z" not in got


def test_endings_from_the_corpus(spark):
    whole = "学生需要在考试之前阅读全部指定的材料。"
    rows = [(f"a{i}", "要读什么材料？", whole) for i in range(60)] + [("cut", "要读什么材料？", whole[:15]), ("nomark", "要读什么材料？", whole[:-1])]
    got = {r["query_id"]: list(r["defects"]) for r in R.flag(spark.createDataFrame(rows, "query_id string, query string, answer string")).collect()}
    assert got == {"cut": ["truncated"]}
    assert R.flag(spark.createDataFrame([], "query_id string, query string, answer string")).count() == 0


OFFER = "offering_id long, course_code string, program_name string, source_kind string, updated_at timestamp, credits string, hours string, instructor string, source string"


def test_survivors(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, " cs1 ", "p", "b", t, "3", "#REF!", "甲、乙", "x"), (2, "CS1", "p", "a", None, "/", "48", "TBD", "x"), (3, "CS1", "p", "a", t, "2", "32", None, "x"), (3, "CS1", "p", "a", t, "2", "32", None, "x"),
        (4, "CS1", "p", None, dt.datetime(2025, 1, 1), "9", "9", "丙", "x"), (5, "CS2", "p", "a", t, "1", "1", "甲", "x"), (6, "CS3", "p", "zz", t, "-", " ", "无", "x"), (7, "CS3", "p", "zz", t, None, "none", "#N/A", "x"), (8, None, "p", "a", t, "1", "1", "甲", "x"),
    ]
    df = spark.createDataFrame(rows, OFFER)
    src = spark.createDataFrame([("a", 1), ("b", 2)], "source_kind string, trust_rank int")
    got = {r["course_code"]: tuple(r)[2:] for r in V.best_records(df, src).collect()}
    assert got == {"CS1": (3, 3, 1), "CS3": (0, 0, 0)}
    values, quality = V.truths(spark, V.claims(df, src), ["course_code", "program_name"])
    kept = {(r["field"], r["value"]) for r in values.where("kept and course_code = 'CS1'").collect()}
    assert [sum(f == name for f, _ in kept) for name in ("credits", "hours")] == [1, 1] and any(f == "instructor" for f, _ in kept)
    assert quality.where("sensitivity <= 0 or sensitivity >= 1 or specificity <= 0 or specificity >= 1").count() == 0
    assert V.best_records(df.limit(0), src).count() == 0 and V.truths(spark, V.claims(df.limit(0), src), ["course_code", "program_name"])[0].count() == 0


def test_model_finds_the_bad_source(spark):
    rows = []
    for g in range(60):
        rows += [(f"g{g}", "f", s, ["right", f"also{g}"]) for s in ("s1", "s2", "s3")] + [(f"g{g}", "f", "bad", [f"wrong{g}"])]
    stated = spark.createDataFrame(rows, "k string, field string, source string, values array<string>")
    values, quality = V.truths(spark, stated, ["k"], multi=("f",))
    kept = {r["value"] for r in values.where("kept").collect()}
    assert "right" in kept and "also7" in kept and not any(v.startswith("wrong") for v in kept)
    q = {r["source"]: r["sensitivity"] for r in quality.collect()}
    assert q["bad"] < 0.3 < q["s1"]


def test_subjects(spark):
    areas = spark.createDataFrame([("law",), ("sport",)], "subject string")
    zh = {"law": ["法官审理合同案件。", "合同案件由法官判决。", "原告起诉被告。", "被告答辩原告起诉。"], "sport": ["运动员练习跑步。", "跑步之前运动员热身。", "篮球比赛计分。", "计分按照篮球比赛。"]}
    samples = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate((s, t) for s, v in zh.items() for t in v)], "sample_id long, subject string, text string")
    both = "法官审理合同案件。运动员练习跑步。原告起诉被告。篮球比赛计分。请带学生证。"
    rows = [(1, zh["law"][0] * 3), (2, "".join(zh["sport"])), (3, both), (4, None), (5, " \n"), (6, "".join(zh["law"]) * 2 + zh["sport"][0]), (7, "随便写写"), (1, zh["law"][0] * 3), (8, zh["law"][1] * 20_000)]
    docs = spark.createDataFrame([(i, t, None, "web", "notes", "clash") for i, t in rows], "doc_id long, text string, course_code string, source string, doc_kind string, subject string")
    out, accuracy = J.assign(docs, samples, areas)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert got[1] == {"law"} and got[2] == {"sport"} and got[3] == {"law", "sport"} and got[6] == {"law"} and got[8] == {"law"} and 4 not in got and 5 not in got and len(got[7]) == 1
    assert set(accuracy) == set(J.FUNCTIONS) and out.count() == out.select("doc_id", "subject").distinct().count()
    assert J.assign(docs.limit(0), samples, areas)[0].count() == 0
    assert out.where(F.col("share") > 1).count() == 0


def test_subject_model_recovers_planted_rates():
    """Votes drawn from known rates: the model finds them from agreement alone, and what it assigns differs from what its first values assign."""
    import numpy as np

    r, k, n = np.random.default_rng(5), 3, 60_000
    true = r.choice(k + 1, n, p=[0.3, 0.25, 0.15, 0.3])
    right, quiet = np.array([0.7, 0.85, 0.6]), np.array([0.1, 0.05, 0.3])
    u = r.random(n)
    other = (true + 1 + r.integers(0, k - 1, n)) % k
    known = np.minimum(true, k - 1)
    lex = np.where(true == k, np.where(u < 0.03, r.integers(0, k, n), -1), np.where(u < right[known], true, np.where(u < right[known] + quiet[known], -1, other)))
    agrees = lambda p: np.where(r.random(n) < 0.3, -1, np.where((true < k) & (r.random(n) < p), true, r.integers(0, k, n)))
    votes, count = np.unique(np.column_stack([lex, agrees(0.8), agrees(0.5), agrees(0.0)]), axis=0, return_counts=True)
    m = J.Model(votes, count.astype(float), k)
    before = m.posterior().argmax(1)
    m.learn(rounds=3000)
    assert 1 < m.rounds < 3000
    assert np.abs(m.right - right).max() < 0.1 and np.abs(m.quiet[:k] - quiet).max() < 0.12 and np.abs(m.prior - [0.3, 0.25, 0.15, 0.3]).max() < 0.05
    acc = m.accuracies()
    assert acc["lexicon"] > acc["address"] > acc["source"] and acc["section"] > acc["address"]
    assert (before != m.posterior().argmax(1)).any()
    assert np.allclose(m.posterior().sum(1), 1)


def test_copied_prefixes():
    """A copy may be repeated, cut short or followed by what states nothing; an answer that goes on after the prompt is none."""
    from sylvaspark.llm import responses as R

    q = "线性代数是多少学分？"
    for a in (q, "问题：线性代数是多少学分", q + q, q + "线性代数是多", "线性代数是多少学", "您好，" + q, q + " N/A", q + "\n答："):
        assert R.is_copy(q, a), a
    for a in (q + "3学分。", "线性代数", "线性代数为3学分。", "", "是多少学分？线性代数", q + "线性代数为3学分。"):
        assert not R.is_copy(q, a), a
    assert not R.is_copy(None, q) and not R.is_copy("x?", "x?") and R.is_copy("Who teaches algebra?", "You asked: who teaches algebra")
    long = "学分" * 50_000
    assert R.is_copy(long, long * 2) and not R.is_copy(long, long + "另外" + long)


def test_endings_that_are_wanted():
    """Counting only the places that are asked for gives the same counts for them."""
    from collections import Counter

    from sylvaspark.llm import responses as R

    texts = ["课程共3学分。期末考试闭卷", "The course ends here. It has 2 tests and a final examination.", "共12学时（含实验）。a", "", "考试。"]
    for t in texts:
        every = Counter(R.endings(t))
        for wanted in ({"学分", " here ", "闭卷"}, {" examination ", "考试"}, set()):
            some = Counter(R.endings(t, wanted))
            assert not some - every
            asked = {k for k, _ in every if (k.startswith(" ") and f" {k.split()[-1]} " in wanted) or (not k.startswith(" ") and k[-2:] in wanted)}
            assert {k: n for k, n in every.items() if k[0] in asked} == dict(some)


def test_planted_source_qualities(spark):
    """Sources of known quality: the model finds their order and rates, for a field of one value and for one of several."""
    import random

    r = random.Random(4)
    right = {"s1": 0.95, "s2": 0.85, "s3": 0.75, "s4": 0.6, "s5": 0.45}
    rows = []
    for g in range(3000):
        who = r.sample(sorted(right), r.randint(1, 5))
        team = [f"t{g}a", f"t{g}b"]
        for s in who:
            rows.append((g, "one", s, ["true" if r.random() < right[s] else f"false{r.randint(1, 3)}"]))
            said = [x for x in team if r.random() < right[s]] + ([f"other{g}{r.randint(1, 2)}"] if r.random() > right[s] else [])
            if said:
                rows.append((g, "many", s, said))
    values, quality = V.truths(spark, spark.createDataFrame(rows, "k long, field string, source string, values array<string>"), ["k"], multi=("many",))
    q = {(x["field"], x["source"]): x for x in quality.collect()}
    assert all(x["converged"] for x in q.values())
    for s, p in right.items():
        assert abs(q["one", s]["sensitivity"] - p) < 0.08 and abs(q["many", s]["sensitivity"] - p) < 0.15, (s, q["one", s], q["many", s])
    for f in ("one", "many"):
        order = sorted(right, key=lambda s: -q[f, s]["sensitivity"])
        assert order == sorted(right)
        assert q[f, "s1"]["specificity"] > q[f, "s4"]["specificity"]
    several = {x["k"] for x in spark.createDataFrame(rows, "k long, field string, source string, values array<string>").where("field = 'one'").groupBy("k").count().where("count >= 3").collect()}
    kept = {x["k"]: x["value"] for x in values.where("field = 'one' and kept").collect() if x["k"] in several}
    assert sum(v == "true" for v in kept.values()) >= 0.9 * len(kept)
