"""One search for both lexical plans; a task keeps the best over several shards, of every group, with ties."""

import random

from pyspark.sql import functions as F

from sylvaspark.operators import answers, lexical


def corpus(spark, n=60):
    r = random.Random(5)
    words = ["graph", "theory", "sets", "algebra", "probability", "vector", "matrix", "limit"]
    rows = [(i * 10, " ".join(r.choice(words) for _ in range(r.randint(1, 9))), "ab"[i % 2]) for i in range(n)] + [(i * 10 + 3, "graph theory sets", "a") for i in range(9)]
    return spark.createDataFrame([*rows, (None, "graph limit", "a"), (7, None, "a"), (8, "", "b")], "doc_id long, text string, kind string").repartition(2)


def test_best_over_shards(spark, monkeypatch):
    docs = corpus(spark)
    every = {(r.query_id, r.doc_id): (r.score, r.share, r.kind) for r in lexical.search(docs, None, "both", group=F.col("kind")).collect()}
    assert len({q for q, _ in every}) == 12 and all(d not in (None, 7, 8) for _, d in every)
    monkeypatch.setattr(lexical, "SHARD", 4)
    small = {(r.query_id, r.doc_id): (r.score, r.share, r.kind) for r in lexical.search(docs, None, "both", group=F.col("kind")).collect()}
    assert small == every
    found = [(r.query_id, r.doc_id, r.score, r.share, r.kind) for r in lexical.search(docs, 3, "both", group=F.col("kind")).collect()]
    assert len(found) < len(every) and all(every[q, d] == rest for q, d, *rest in ((q, d, (s, h, k)) for q, d, s, h, k in found) for rest in rest)
    first = lambda rows, at: {(q, k): [d for _, d in sorted((-x[at], d) for (p, d), x in rows.items() if p == q and x[2] == k)[:3]] for q, _ in rows for k in "ab"}
    kept = {(q, d): (s, h, k) for q, d, s, h, k in found}
    assert first(kept, 0) == first(every, 0) and first(kept, 1) == first(every, 1)


def test_dispatch_searches_once(spark, tmp_path, monkeypatch):
    corpus(spark).select("doc_id", "text", F.col("kind").alias("doc_kind")).where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i * 10, [float(i % 7), 1.0], "x") for i in range(30)], "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    calls, search = [], lexical.search
    monkeypatch.setattr(lexical, "search", lambda *a, **k: calls.append(a) or search(*a, **k))
    got = {(r.mode, r.query_id) for r in answers.o109_dispatch(spark, str(tmp_path)).collect()}
    assert len(calls) == 1
    assert {m for m, _ in got} == {"bm25", "dense", "linear"} and len(got) == 12 + 6 + 12


def test_every_match_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 4)
    monkeypatch.setattr(lexical, "BLOCK", 2)
    monkeypatch.setattr(lexical, "SHARDS", 2)
    d = spark.createDataFrame([(i, f"common w{i % 7} v{i}") for i in range(1, 301)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = lexical.search(d, None).select("query_id", "doc_id", "score", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    best = {(r.query_id, r.doc_id, r.score) for r in lexical.search(d, 300).collect()}
    assert len(rows) == 6 * 300 and {(r.query_id, r.doc_id, r.score) for r in rows} == best
    for task in {r.task for r in rows}:
        assert len({r.doc_id for r in rows if r.task == task}) <= 4 * 2 and len({r.query_id for r in rows if r.task == task}) <= 2


def test_every_match_reads_few_shards_at_once(spark, monkeypatch):
    paths = []

    class Watched(lexical.Steps):
        def write(self, df, *a, **k):
            out = super().write(df, *a, **k)
            paths.extend([self.path] * ("vocab" in df.columns))
            return out

    monkeypatch.setattr(lexical, "SHARD", 4)
    monkeypatch.setattr(lexical, "SHARDS", 2)
    monkeypatch.setattr(lexical, "Steps", Watched)
    d = spark.createDataFrame([(i, f"common w{i % 7} v{i}") for i in range(1, 301)], "doc_id long, text string")
    for among in (None, d.where("doc_id % 2 = 0")):
        paths.clear()
        found = lexical.search(d, None, among=among)
        assert found.count() == 6 * (300 if among is None else 150) and len(paths) == (1 if among is None else 2)
        for path in paths:
            files = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).count().collect()
            assert max(r["count"] for r in files) <= 2
