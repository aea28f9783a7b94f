"""Queries of the subpackage on the smallest tables: SQL twins, round trips and invariants."""

import glob
import os

import pytest

from sylvaspark.llm import registry
from sylvaspark.llm.encoding import decode, encode

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    r = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert sorted(tuple(x[c] for c in columns) for x in df.collect()) == sorted(tuple(x[names.index(c)] for c in columns) for x in r.fetchall())


def test_encoding_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    back = {r["doc_id"]: r["text"] for r in decode(encode(docs)).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_found_rows_are_unique_and_typed(spark):
    kinds = {"p1_found": ["offering_id", "field_name"], "p4_found": ["query_id", "defect"], "p6_found": ["entry_id", "field_name", "pos", "ref_code"], "p9_found": ["doc_id", "subject"], "p3_found": ["course_code", "program_name", "credits_from", "hours_from", "instructor_from"]}
    for name, columns in kinds.items():
        df = registry.queries()[name](spark, DATA)
        assert df.columns == columns
        assert df.count() == df.distinct().count() > 0


def test_packed_tokens(spark):
    rows = registry.queries()["p8_containers"](spark, DATA).collect()
    used: dict = {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 4096 and len(used) == -(-sum(used.values()) // 4096)
    assert len({r["doc_id"] for r in rows}) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_held_out_subjects(spark):
    """Accuracy on labelled samples that the lexicon has not seen."""
    from pyspark.sql import functions as F

    from sylvaspark.llm.subjects import assign

    s = spark.read.parquet(f"{DATA}/subject_samples.parquet")
    test = s.where("sample_id % 4 = 0")
    docs = test.select(F.col("sample_id").alias("doc_id"), "text", F.lit(None).cast("string").alias("course_code"), F.lit("s").alias("source"), F.lit("notes").alias("doc_kind"))
    out, _ = assign(docs, s.where("sample_id % 4 <> 0"), spark.read.parquet(f"{DATA}/subject_areas.parquet"))
    truth = {r["sample_id"]: r["subject"] for r in test.collect()}
    first = {}
    for r in out.collect():
        if r["share"] > first.get(r["doc_id"], ("", 0))[1]:
            first[r["doc_id"]] = (r["subject"], r["share"])
    right = sum(first.get(k, ("",))[0] == v for k, v in truth.items())
    assert right >= 0.9 * len(truth), (right, len(truth))
