"""Freely typed values mapped to the closest entry of a reference list, or reported as unmatched.

Distinct values are normalised and cut into character n-grams. Candidates come from an inverted index over the reference forms, one row per gram and form: only as many of a value's grams are looked up, heaviest first, as any entry that matters must share at least one of. An entry matters if it can reach the threshold less the margin, as it then can be the next best; what is left out can't, so no decision misses an entry. Candidates are scored by the cosine of gram weights and accepted above the threshold and a margin to the next entry. Values that stay unmatched are scored against every form that shares a gram, so their best score is the true one."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvaspark.common import HOT_ROWS, HOT_SHARE, Steps, first_by, join_lookup, row_rank, table, trimmed

THRESHOLD, MARGIN = 0.45, 0.1
# No value at all.
PLACEHOLDERS = ["", "/", "-", "无", "暂无", "none"]
# What people write around a name.
AROUND = regex.compile(r"[（(\[【][^（()）\[\]【】]{0,12}[)）\]】]|^(?:先修课?程?|已?修[过读]?|须|需|建议|要求|学过|完成|prerequisites?|required|recommended)\s*(?:修读|学习)?\s*[:：]?\s*|^\d{1,2}\s*[.、)）]\s*|课程$")
CODE = regex.compile(r"(?<![a-z])([a-z]{2})\s*-?\s*(\d{4,8})(?!\d)")


def normalise(value: str) -> tuple[list[str], str]:
    """Codes in a value, and what remains of it as a name."""
    v = regex.sub(r"\p{Cf}", "", unicodedata.normalize("NFKC", value)).strip().lower()
    codes = [a + b for a, b in CODE.findall(v)]
    v = CODE.sub(" ", v)
    before = None
    while before != v:
        before = v
        v = regex.sub(r"^[\W_]+|[\W_]+$", "", AROUND.sub(" ", v).strip())
    return codes, " ".join([regex.sub(r"\P{Han}", "", v), " ".join(regex.findall(r"[^\W\d_\p{Han}]+", v))]).strip()


def grams(name: str) -> Counter:
    """Han characters and their pairs; groups of three letters of other scripts, with word ends."""
    han = regex.sub(r"\P{Han}", "", name)
    other = " ".join(regex.findall(r"[^\W\d_\p{Han}]+", name))
    out = [*han, *(han[i : i + 2] for i in range(len(han) - 1))]
    if other:
        padded = f" {other} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return Counter(out)


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts = [normalise(v) for v in b["value"]]
        b["codes"], b["name"] = [p[0] for p in parts], [p[1] for p in parts]
        yield b


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(n, g, 1.0 + math.log(k)) for n in b["name"] for g, k in grams(n).items()]
        yield pd.DataFrame(rows, columns=["name", "gram", "tf"])


def _vectors(steps: Steps, names: DataFrame, weights: DataFrame, rare: float) -> DataFrame:
    """(name, gram, w) with unit length; grams without a weight are rarer than any listed one."""
    g = steps.write(names.mapInPandas(_grams, "name string, gram string, tf double"))
    w = join_lookup(g, weights, "gram", "left").select("name", "gram", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("name")))
    return steps.write(w.withColumn("w", F.col("w") / size))


def join_grams(steps: Steps, left: DataFrame, right: DataFrame, total: int) -> DataFrame:
    """Inner join of two tables of grams on `gram`. A gram that many rows of the left hold is dealt out over several tasks, with its rows of the right in each."""
    busy = left.groupBy("gram").count().where(F.col("count") > max(total / HOT_SHARE, HOT_ROWS)) if total > HOT_ROWS else None
    if busy is None or not (busy := {r["gram"]: r["count"] for r in busy.collect()}):  # HOT_SHARE grams at most
        return left.join(right, "gram")
    shares = left.sparkSession.createDataFrame([(g, int(min(-(-n * HOT_SHARE // total), HOT_SHARE))) for g, n in busy.items()], "gram string, _n int")
    deal = lambda d: d.join(F.broadcast(shares), "gram", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    a = deal(left).withColumn("_s", F.pmod(F.xxhash64("name"), "_n").cast("int"))
    b = deal(right).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return a.drop("_n").join(b.drop("_n"), ["gram", "_s"]).drop("_s")


def map_values(spark: SparkSession, values: DataFrame, reference: DataFrame, code: str, forms: list[str], threshold: float = THRESHOLD, margin: float = MARGIN, full_scores: bool = False) -> DataFrame:
    """(value) -> (value, ref_code, score): the entry each distinct value means, '' and its best score if none.

    `reference`: `code` and columns of names `forms`; null and blank names are left out. A value that holds the code of an entry and no name that is accepted means that entry; a name is preferred. Two entries within `margin` of each other leave the value unmatched, so ties do too. An empty list leaves all unmatched. With `full_scores` the score of values without an accepted name is that of the best of all entries (0 if none shares a gram), else null where it is under `threshold` less `margin`."""
    steps = Steps(spark)
    named = steps.write(values.where(F.col("value").isNotNull()).select("value").distinct().mapInPandas(_named, "value string, codes array<string>, name string"))
    listed = reference.where(F.col(code).isNotNull()).select(F.col(code).alias("ref_code"), F.explode(F.array(*forms)).alias("value")).where("value is not null").distinct()
    listed = steps.write(listed.mapInPandas(lambda b: (x.assign(name=[normalise(v)[1] for v in x["value"]]) for x in b), "ref_code string, value string, name string").where("name <> ''").select("ref_code", "name").distinct())
    n = listed.select("name").distinct().count()
    form_grams = steps.write(listed.select("name").distinct().mapInPandas(_grams, "name string, gram string, tf double"))
    weights = steps.write(form_grams.groupBy("gram").agg(F.log(1 + n / F.count("*")).alias("idf")))
    rare = float(math.log(1 + 2 * max(n, 1)))
    entry = _vectors(steps, listed.select("name").distinct(), weights, rare).select(F.col("name").alias("entry"), "gram", F.col("w").alias("v"))
    typed = _vectors(steps, named.where("name <> ''").select("name").distinct(), weights, rare)
    total = typed.count()
    least = threshold - margin
    # Grams in order of weight; those after the point where the rest is shorter than the least score need no lookup.
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("name").orderBy("w", "gram").rowsBetween(Window.unboundedPreceding, 0))
    marked = steps.write(typed.withColumn("rest", rest).withColumn("ask", F.col("rest") >= least * least - 1e-9))
    asked = marked.where("ask").select("name", "gram", "w")
    other = marked.groupBy("name").agg(F.sqrt(F.coalesce(F.sum(F.when(~F.col("ask"), F.col("w") * F.col("w"))), F.lit(0.0))).alias("other"))
    # One partial score per candidate from the grams that were looked up; the rest adds no more than the product of the two remaining lengths.
    partial = join_grams(steps, asked, entry, total).groupBy("name", "entry").agg(F.sum(F.col("w") * F.col("v")).alias("part"), F.sum(F.col("v") * F.col("v")).alias("used"))
    partial = partial.join(other, "name").where(F.col("part") + F.col("other") * F.sqrt(F.greatest(1 - F.col("used"), F.lit(0.0))) >= least - 1e-9)
    partial = steps.write(partial.select("name", "entry", "part"))
    tail = marked.where("not ask").select("name", "gram", "w")
    more = partial.select("name", "entry").join(tail, "name").join(entry, ["entry", "gram"]).groupBy("name", "entry").agg(F.sum(F.col("w") * F.col("v")).alias("more"))
    scored = partial.join(more, ["name", "entry"], "left").select("name", "entry", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score")).where(F.col("score") >= least)
    by_code = scored.join(listed.withColumnRenamed("name", "entry"), "entry").groupBy("name", "ref_code").agg(F.max(F.round("score", 9)).alias("score"))
    two = by_code.withColumn("place", row_rank(["name"], F.col("score").desc(), F.col("ref_code").desc())).where("place <= 2")
    best = two.groupBy("name").agg(F.max(F.when(F.col("place") == 1, F.struct("score", "ref_code"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    clear = (F.col("first.score") >= threshold) & (F.col("first.score") - F.coalesce("second", F.lit(0.0)) >= margin)
    chosen = steps.write(best.select("name", F.when(clear, F.col("first.ref_code")).alias("by_name"), F.col("first.score").alias("score")))
    codes = reference.where(F.col(code).isNotNull()).select(F.lower(F.col(code)).alias("c"), F.col(code).alias("by_code")).dropDuplicates(["c"])
    coded = named.select("value", F.explode("codes").alias("c")).join(codes, "c").groupBy("value").agg(F.min("by_code").alias("by_code"))
    out = named.select("value", "name").join(chosen, "name", "left").join(coded, "value", "left")
    if full_scores:
        open_ = typed.join(chosen.where("by_name is not null").select("name"), "name", "left_anti")
        every = join_grams(steps, open_, entry, total).groupBy("name", "entry").agg(F.sum(F.col("w") * F.col("v")).alias("s")).groupBy("name").agg(F.round(F.max("s"), 9).alias("full"))
        out = out.join(every, "name", "left").withColumn("score", F.coalesce("score", "full", F.lit(0.0))).drop("full")
    return steps.write(out.select("value", F.coalesce("by_name", "by_code", F.lit("")).alias("ref_code"), "score"))


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, field_name, pos, value) of all typed names and prerequisites, repeated entries once, without placeholders."""
    rows = first_by(table(spark, sf_dir, "syllabus_courses").where("entry_id is not null").select("entry_id", "course_name", "prerequisites", "parsed_at"), ["entry_id"], F.col("parsed_at"), F.col("course_name"))
    name = F.array(F.struct(F.lit("course_name").alias("field_name"), F.lit(0).alias("pos"), F.col("course_name").alias("value")))
    links = F.transform(F.coalesce("prerequisites", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("prerequisites").alias("field_name"), i.alias("pos"), x.alias("value")))
    flat = rows.select("entry_id", F.explode(F.concat(name, links)).alias("x")).select("entry_id", "x.*")
    return flat.where(F.col("value").isNotNull() & ~F.lower(trimmed(F.col("value"))).isin(PLACEHOLDERS))


def _mapped(spark: SparkSession, sf_dir: str, full_scores: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = Steps(spark).write(typed_values(spark, sf_dir))
    return rows, map_values(spark, rows, table(spark, sf_dir, "course_reference"), "course_code", ["course_name", "english_name"], full_scores=full_scores)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The course of the reference list that each typed value means, '' for none."""
    rows, known = _mapped(spark, sf_dir)
    return join_lookup(rows, known, "value", "inner").select("entry_id", "field_name", "pos", "ref_code")


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry, with their number of rows and the score of the best of all entries."""
    rows, known = _mapped(spark, sf_dir, True)
    return rows.groupBy("value").agg(F.count("*").alias("n")).join(known.where("ref_code = ''"), "value").select("value", "n", F.round("score", 6).alias("score"))


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value once, and whether what it is mapped to is an entry of the list or nothing."""
    codes = table(spark, sf_dir, "course_reference").select(F.col("course_code").alias("ref_code")).distinct().withColumn("listed", F.lit(True))
    found = p6_found(spark, sf_dir).join(codes, "ref_code", "left")
    return found.groupBy("entry_id", "field_name", "pos").agg(F.bool_and((F.col("ref_code") == "") | F.coalesce("listed", F.lit(False))).alias("listed"), F.count("*").alias("n"))


_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
QUERIES = {"p6_found": p6_found, "p6_unmatched": p6_unmatched, "p6_rows": p6_rows}
SQL = {
    "p6_rows": "with s as (select entry_id, any_value(course_name) as course_name, any_value(prerequisites) as prerequisites from syllabus_courses where entry_id is not null group by 1), v as (select entry_id, 'course_name' as field_name, 0 as pos, course_name as value from s union all select entry_id, 'prerequisites', (generate_subscripts(prerequisites, 1) - 1)::int, unnest(prerequisites) from s) "
    f"select entry_id, field_name, pos, true as listed, 1::bigint as n from v where value is not null and lower(regexp_replace(value, '^{_SPACE}|{_SPACE}$', '', 'g')) not in ('', '/', '-', '无', '暂无', 'none')",
}
