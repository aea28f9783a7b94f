"""One surviving record per group of duplicates, field by field, and the values that a model of source quality holds true.

`best_records` takes each field from the record that a stated precedence puts first, as one aggregate that combines before the shuffle. `truths` is the latent model: every source has, per field, a sensitivity (how often it states a true value) and a specificity (how often it leaves out a false one), learned by expectation-maximisation together with the probability of each value; fields with several values keep every value held true. The model works on observation patterns, so its rounds read as many rows as there are different patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaspark.common import Steps, table, trimmed

FIELDS = ["credits", "hours", "instructor"]
# No usable value.
UNUSABLE = ["", "/", "／", "无", "-", "—", "暂无", "none", "null", "n/a", "待定", "tbd"]
#: Rank of a source that is null or not listed.
LAST = 2**31 - 1


def usable(c: Column) -> Column:
    t = trimmed(c)
    return c.isNotNull() & ~F.lower(t).isin(UNUSABLE) & ~t.startswith("#")


def ranked(offerings: DataFrame, sources: DataFrame, fields: list[str]) -> DataFrame:
    """Offerings with a clean code and the rank of their source. Rows without an id, a code or a program are no records of a course in a program."""
    ranks = sources.where("source_kind is not null").groupBy("source_kind").agg(F.min("trust_rank").alias("_rank"))
    o = offerings.select("offering_id", F.upper(trimmed(F.col("course_code"))).alias("course_code"), "program_name", "source_kind", "updated_at", *fields)
    o = o.where("offering_id is not null and course_code is not null and program_name is not null")
    return o.join(ranks, "source_kind", "left").withColumn("_rank", F.coalesce("_rank", F.lit(LAST)))


def best_records(offerings: DataFrame, sources: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(course_code, program_name, <field>_from...) for pairs with two or more offering ids.

    Precedence among usable values: lowest trust_rank (null or unlisted last), latest updated_at (null earliest), smallest offering_id; 0 if no value is usable. Rows delivered again change nothing."""
    when = F.coalesce(-F.unix_micros("updated_at"), F.lit(2**62))
    o = ranked(offerings, sources, fields)
    firsts = [F.coalesce(F.min(F.when(usable(F.col(f)), F.struct("_rank", when, "offering_id")))["offering_id"], F.lit(0)).cast("long").alias(f"{f}_from") for f in fields]
    groups = o.groupBy("course_code", "program_name").agg(F.min("offering_id").alias("_a"), F.max("offering_id").alias("_b"), *firsts)
    return groups.where("_a <> _b").drop("_a", "_b")


def amount(c: Column) -> Column:
    """A number as text: the sum of the numbers in a value, without units; the value itself if it has none."""
    t = F.translate(c, "０１２３４５６７８９．＋", "0123456789.+")
    found = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(found) > 0, total.cast("string")).otherwise(trimmed(c))


def claims(offerings: DataFrame, sources: DataFrame) -> DataFrame:
    """(course_code, program_name, field, source, values): what each source states of each group; instructors are several values."""
    o = ranked(offerings, sources, FIELDS).withColumn("source", F.coalesce("source_kind", F.lit("unknown")))
    names = F.filter(F.transform(F.split("instructor", "[、,，;；]"), trimmed), lambda x: x != "")
    stated = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("values")) for f, v in (("credits", F.when(usable(F.col("credits")), F.array(amount(F.col("credits"))))), ("hours", F.when(usable(F.col("hours")), F.array(amount(F.col("hours"))))), ("instructor", F.when(usable(F.col("instructor")), names)))])
    flat = o.select("course_code", "program_name", "source", F.explode(stated).alias("x")).select("course_code", "program_name", "source", "x.*").where("values is not null and size(values) > 0")
    return flat.groupBy("course_code", "program_name", "field", "source").agg(F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"))


#: Prior observations of the model, whatever the size of the data: (true values stated, true values left out) and (false values left out, false values stated).
SENSITIVITY, SPECIFICITY = (8.0, 2.0), (95.0, 5.0)


def truths(spark: SparkSession, stated: DataFrame, keys: list[str], rounds: int = 200, prior: float = 0.5, multi: tuple[str, ...] = ("instructor",), moved: float = 5e-4) -> tuple[DataFrame, DataFrame]:
    """Values with their probability, and sources with sensitivity and specificity by field, the rounds it took and whether the last one moved no rate by more than `moved`.

    `stated`: keys, field, source, values. A source observes every value that any source states of the same key and field: as true if it states it, else as false. Fields in `multi` keep every value of probability 0.5 or more, others the most probable one; of these at most one is true, so their probabilities share 1 with the chance that none is; ties keep the smallest value. Sources number few, like the table that lists them; their qualities go to the driver, nothing else does."""
    steps = Steps(spark)
    group = [*keys, "field"]
    seen = steps.write(stated.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("source", "values"))).alias("by_source")))  # one entry a source
    facts = seen.withColumn("value", F.explode(F.array_distinct(F.flatten(F.col("by_source.values")))))
    facts = steps.write(facts.select(*group, "value", F.transform("by_source", lambda s: F.struct(s["source"].alias("source"), F.array_contains(s["values"], F.col("value")).alias("said"))).alias("pattern")))
    # One source alone shows nothing of its quality, and two that disagree don't show which is right; of all other groups the sets of patterns are counted.
    sets = facts.where(F.size("pattern") > 2).groupBy(*group).agg(F.sort_array(F.collect_list("pattern")).alias("rivals"))
    sets = steps.write(sets.groupBy("field", "rivals").agg(F.count("*").alias("n")))
    quality = {(r[0], r[1]): (0.8, 0.9) for r in facts.select("field", F.explode("pattern.source").alias("s")).distinct().collect()}

    def odds(pattern: Column) -> Column:
        def table_of(what) -> Column:
            return F.create_map(*[x for (f, s), q in sorted(quality.items()) for x in (F.lit(f"{f}\x01{s}"), F.lit(what(*q)))])

        yes, no = table_of(lambda a, b: math.log(a / (1 - b))), table_of(lambda a, b: math.log((1 - a) / b))
        key = lambda s: F.concat("field", F.lit("\x01"), s["source"])
        return F.exp(F.aggregate(pattern, F.lit(math.log(prior / (1 - prior))), lambda a, s: a + F.when(s["said"], yes[key(s)]).otherwise(no[key(s)])))

    several = F.col("field").isin(*multi)
    done, converged = 0, not quality
    while quality and done < rounds and not converged:
        done += 1
        rated = sets.select("field", "n", "rivals", F.transform("rivals", odds).alias("o")).withColumn("all", F.aggregate("o", F.lit(1.0), lambda a, x: a + x))
        one = rated.select("field", "n", F.explode(F.zip_with("rivals", F.transform("o", lambda x: F.when(several, x / (1 + x)).otherwise(x / F.col("all"))), lambda r, p: F.struct(r.alias("pattern"), p.alias("p")))).alias("x"))
        weighed = one.select("field", "n", F.col("x.p").alias("p"), F.explode("x.pattern").alias("s"))
        said = F.col("s.said").cast("double")
        sums = weighed.groupBy("field", F.col("s.source").alias("source")).agg(F.sum(F.col("n") * F.col("p")).alias("t"), F.sum(F.col("n") * F.col("p") * said).alias("ts"), F.sum(F.col("n") * (1 - F.col("p"))).alias("f"), F.sum(F.col("n") * (1 - F.col("p")) * (1 - said)).alias("fs")).collect()
        new = dict(quality)
        for r in sums:
            rate = lambda k, n, p: min(max((k + p[0]) / (n + sum(p)), 0.001), 0.999)
            new[r["field"], r["source"]] = rate(r["ts"], r["t"], SENSITIVITY), rate(r["fs"], r["f"], SPECIFICITY)
        converged = max(abs(a - b) for k in new for a, b in zip(new[k], quality[k])) < moved
        quality = new
    found = facts.withColumn("_o", odds(F.col("pattern")) if quality else F.lit(0.0))
    sums = found.groupBy(*group).agg((F.lit(1.0) + F.sum("_o")).alias("_all"))
    found = found.join(sums, group).withColumn("probability", F.when(several, F.col("_o") / (1 + F.col("_o"))).otherwise(F.col("_o") / F.col("_all")))
    top = found.groupBy(*group).agg(F.min_by("value", F.struct(-F.col("probability"), F.col("value"))).alias("_top"))
    kept = F.when(F.col("field").isin(*multi), (F.col("probability") >= 0.5) | (F.col("value") == F.col("_top"))).otherwise(F.col("value") == F.col("_top"))
    values = found.join(top, group).select(*group, "value", "probability", kept.alias("kept"))
    qualities = spark.createDataFrame([(f, s, a, b, done, converged) for (f, s), (a, b) in sorted(quality.items())], "field string, source string, sensitivity double, specificity double, rounds int, converged boolean")
    return values, qualities


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "course_offerings"), table(spark, sf_dir, "plan_sources")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record each field survives from."""
    return best_records(*_sources(spark, sf_dir))


def p3_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated value with its probability under the model of source quality, and whether it is kept."""
    values, _ = truths(spark, claims(*_sources(spark, sf_dir)), ["course_code", "program_name"])
    return values.withColumn("probability", F.round("probability", 6))


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and specificity of each source by field, with the rounds of the model and whether it converged."""
    return truths(spark, claims(*_sources(spark, sf_dir)), ["course_code", "program_name"])[1]


_USABLE = "({0} is not null and lower(trim({0}, ' \t\n\r　')) not in ('', '/', '／', '无', '-', '—', '暂无', 'none', 'null', 'n/a', '待定', 'tbd') and trim({0}) not like '#%')"
QUERIES = {"p3_found": p3_found, "p3_truths": p3_truths, "p3_sources": p3_sources}
SQL = {
    "p3_found": "with o as (select o.*, upper(trim(o.course_code, ' \t\n\r　 ')) as code, coalesce(s.trust_rank, 2147483647) as r, coalesce(-epoch_us(o.updated_at), 4611686018427387904) as w from course_offerings o left join plan_sources s using (source_kind)) select code as course_code, program_name, "
    + ", ".join(f"coalesce(arg_min(offering_id, (r, w, offering_id)) filter ({_USABLE.format(f)}), 0)::bigint as {f}_from" for f in FIELDS)
    + " from o where code is not null and program_name is not null group by code, program_name having count(distinct offering_id) > 1"
}
