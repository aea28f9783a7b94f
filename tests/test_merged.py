"""Merged intents: the same pairs as from all labels, and a plan that looks for each pattern once."""

from pyspark.sql import functions as F

from sylvaspark.operators import linking


def texts():
    parts = ["先修课是什么", "培养方案", "几学分", "第三章", "主要讲什么内容", "学数学之前需要什么基础", "有没有数学这门课？", "数学存在吗", "《先修课》", "之前要学什么内容"]
    return [None, "", "　你好"] + parts + [f"{a}，{b}" for a in parts for b in parts] + [f"{a}{b}，{c}" for a in parts[:5] for b in parts[5:] for c in parts]


def test_pairs_as_from_labels(spark):
    q = spark.createDataFrame(list(enumerate(texts())), "id int, query string")
    pair = F.array_join(F.slice("labels", 1, 2), "+")
    want = {r.id: r.pair for r in linking.classify(q).select("id", pair.alias("pair")).collect() if r.pair in linking.MERGED}
    got = {r.id: r.pair for r in q.select("id", F.explode(F.array_compact(linking.merged_pair(F.col("query")))).alias("pair")).collect()}
    assert got == want and {"dependency+catalog", "dependency+fact", "dependency+structure", "dependency+content"} == set(got.values())


def test_each_pattern_once(spark, tmp_path):
    spark.createDataFrame([("q1", "先修课是什么？第三章", None, "t")], "query_id string, query string, course_code string, received_at string").write.parquet(f"{tmp_path}/query_log.parquet")
    spark.createDataFrame([("A1", "数学", "t")], "course_code string, course_name string, ingested_at string").write.parquet(f"{tmp_path}/course_catalog.parquet")
    df = linking.o54_mergeable(spark, str(tmp_path))
    assert {r.query_id: r.pair for r in df.collect()} == {"q1": "dependency+structure", "A1-5": "dependency+content", "A1-6": "dependency+structure"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    patterns = sum(len(p) for _, p in linking.INTENTS) + len(linking.NEEDED) + 1
    assert plan.count("RLIKE") <= 2 * patterns  # of the log and of the questions on courses
