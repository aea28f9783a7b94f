"""Evaluation metrics: classes, retrieval, answers, refusals, verification, samples.

Graded rows come from the tables: predicted labels are those of the nearest other vector, retrieved lists are those of the dense search, answers are those of the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvaspark.common import Steps, row_rank, table
from sylvaspark.functions import text as X
from sylvaspark.operators.vectors import _VEC, _VOTE, _vectors, _votes, top_cosine
from sylvaspark.operators.fields import key_sql, strip_sql
from sylvaspark.plans.inputs import LOG, OFF, SYL, log

# Phrases of an answer that declines.
REFUSALS = ["未找到足够相关", "无法获取足够", "未找到符合条件", "未找到与该问题相关", "未找到明确的硬先修课程", "证据不足", "无法确认", "无法回答", "培养方案中没有名为", "你是不是想问", "均未记录", "无法说明两者存在关系", "没能确定你问的是哪门课", "未连接 Neo4j", "本地知识库暂无可用证据", "无法给出可靠答案"]
# A line that begins as a chapter heading.
CHAPTER_LINE = r"(?m)^[\s\-\*•#>\d\.、]*第\s*[一二三四五六七八九十百零\d]+\s*章"
YEARS = "一二三四五六七八九"
ENTAILED, WEAK = 0.6, 0.4


def is_refusal(c):
    out = F.lit(False)
    for m in REFUSALS:
        out = out | F.coalesce(c.contains(m), F.lit(False))
    return out


def rate(c):
    """Share of true values, to four places; null over no rows."""
    return F.round(F.avg(c.cast("double")), 4)


def _ranked(spark, sf_dir) -> DataFrame:
    """(query_id, id, rank, relevant): ten nearest other vectors; one with the same label is relevant."""
    v = _vectors(spark, sf_dir)
    t = top_cosine(v.where("vec_id % 5 = 0"), v, 11).where("query_id <> id")
    t = t.withColumn("rank", row_rank(["query_id"], F.col("cosine").desc(), F.col("id"))).where("rank <= 10")
    return t.join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), "query_id").join(v.select(F.col("vec_id").alias("id"), "label"), "id").select("query_id", "id", "rank", "gold", "label", (F.col("gold") == F.col("label")).alias("relevant"))


def _graded(spark, sf_dir) -> DataFrame:
    return _ranked(spark, sf_dir).where("rank = 1").select("query_id", "gold", F.col("label").alias("predicted"))


def o100_confusion(spark, sf_dir):
    """Gold by predicted label, with zeros."""
    g = Steps(spark).write(_graded(spark, sf_dir))
    c = g.groupBy("gold").pivot("predicted", list(range(10))).count().na.fill(0)
    return c.select("gold", *[F.col(str(i)).alias(f"p{i}") for i in range(10)])


def per_class(g: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where a denominator is."""
    s = g.select(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("predicted")).cast("int").alias("t")).unionByName(g.select(F.col("predicted").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))
    a = s.groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    pr, re = F.when(F.col("p") > 0, F.col("t") / F.col("p")).otherwise(0.0), F.when(F.col("g") > 0, F.col("t") / F.col("g")).otherwise(0.0)
    return a.select("label", F.round(pr, 4).alias("precision"), F.round(re, 4).alias("recall"), F.round(F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0), 4).alias("f1"), F.col("g").alias("support"))


def o211_per_class(spark, sf_dir):
    """Scores of each label."""
    return per_class(_graded(spark, sf_dir))


def o212_routing(spark, sf_dir):
    """Accuracy with neighbouring labels acceptable for even ones, and label recall over the first three."""
    r = _ranked(spark, sf_dir).where("rank <= 3")
    q = r.groupBy("query_id", "gold").agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("predicted"), F.max(F.col("relevant").cast("int")).alias("recalled"), F.count_if("relevant").alias("k"))
    ok = (F.col("predicted") == F.col("gold")) | ((F.col("gold") % 2 == 0) & (F.col("predicted") == F.col("gold") + 1))
    return q.agg(F.count("*").alias("items"), rate(ok).alias("accuracy"), rate(F.col("recalled")).alias("label_recall"), F.round(F.avg(F.col("k") / 3), 4).alias("confidence"))


def o213_positions(spark, sf_dir):
    """Ranks of the relevant hits of each query."""
    return _ranked(spark, sf_dir).groupBy("query_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("relevant"), F.col("rank")))), lambda x: x.cast("string"))).alias("positions"))


def retrieval(r: DataFrame) -> DataFrame:
    f = r.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    at = lambda k: rate(F.coalesce(F.col("first") <= k, F.lit(False)))
    return f.agg(F.count("*").alias("items"), at(1).alias("recall1"), at(5).alias("recall5"), at(10).alias("recall10"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def o214_retrieval(spark, sf_dir):
    """Recall at 1, 5 and 10 and mean reciprocal rank."""
    return retrieval(_ranked(spark, sf_dir))


def o164_comparison(spark, sf_dir):
    """Two versions of an index by recall and reciprocal rank: the second without vectors of odd id; whether any figure fell."""
    r = Steps(spark).write(_ranked(spark, sf_dir))
    second = r.where("id % 2 = 0").withColumn("rank", row_rank(["query_id"], F.col("rank")))
    both = retrieval(r).withColumn("v", F.lit("before")).unionByName(retrieval(second).withColumn("v", F.lit("after")))
    s = both.select("v", F.expr("stack(4, 'recall1', recall1, 'recall5', recall5, 'recall10', recall10, 'mrr', mrr) as (metric, value)"))
    w = s.groupBy("metric").agg(F.max(F.when(F.col("v") == "before", F.col("value"))).alias("before"), F.max(F.when(F.col("v") == "after", F.col("value"))).alias("after"))
    return w.select("metric", "before", "after", (F.col("after") < F.col("before")).alias("fell"))


def o216_citation_precision(spark, sf_dir):
    """Share of the first five hits that are accepted, by query; null where nothing is gold."""
    r = _ranked(spark, sf_dir).where("rank <= 5")
    return r.groupBy("query_id").agg(F.when(F.max("gold").isNotNull(), rate(F.col("relevant"))).alias("precision"))


def o217_chunk_precision(spark, sf_dir):
    """The same over hits of even id only."""
    return _ranked(spark, sf_dir).where("rank <= 5 and id % 2 = 0").groupBy("query_id").agg(rate(F.col("relevant")).alias("precision"))


def o221_refusals(spark, sf_dir):
    """Answers that hold a phrase of declining."""
    return log(spark, sf_dir).where(is_refusal(F.col("answer"))).select("query_id")


def refusal(g: DataFrame) -> list:
    un, an = ~F.col("answerable"), F.col("answerable")
    return [F.count("*").alias("items"), rate(F.when(un, F.col("refused"))).alias("correct_refusal"), rate(F.when(un, ~F.col("refused"))).alias("hallucination"), rate(F.when(an, F.col("refused"))).alias("false_refusal")]


def _answers(spark, sf_dir):
    return log(spark, sf_dir).withColumn("answerable", ~F.coalesce(F.col("status") == "refused", F.lit(False))).withColumn("refused", is_refusal(F.col("answer")))


def o219_refusal(spark, sf_dir):
    """Rates of correct refusals, made-up answers and false refusals; questions whose status is refused can't be answered."""
    return _answers(spark, sf_dir).agg(*refusal(None))


def o220_refusal_subsets(spark, sf_dir):
    """The same by persona."""
    return _answers(spark, sf_dir).groupBy("persona").agg(*refusal(None))


def covers(answer, keys: list[str]):
    """Every key has an alternative that the answer holds; no keys are not covered."""
    out = F.lit(bool(keys))
    for k in keys:
        part = F.lit(False)
        for a in filter(None, k.split("|")):
            part = part | answer.contains(a)
        out = out & part
    return F.coalesce(out, F.lit(False))


# What a question asks about, and the alternatives of which its answer must hold one.
ASKED_KEYS = [("学分|credit", "学分|credits"), ("学时|课时|hours", "学时|hours"), ("学期|什么时候|when", "学期|semester"), ("考核|考试|assess|exam", "考试|考核|examination|homework"), ("谁|老师|teach", "教师|老师|负责|taught")]


def covers_keys(answer, keys):
    """Every key of an array has an alternative, apart by |, that the answer holds; no keys are not covered."""
    one = lambda k: F.exists(F.split(k, "\\|"), lambda a: (a != "") & answer.contains(a))
    return F.coalesce((F.size(keys) > 0) & F.forall(keys, one), F.lit(False))


def o215_key_coverage(spark, sf_dir):
    """Whether an answer holds an alternative of every key of what its question asks."""
    q = F.lower(F.coalesce("query", F.lit("")))
    keys = F.array_compact(F.array(*[F.when(q.rlike(p), F.lit(k)) for p, k in ASKED_KEYS]))
    return log(spark, sf_dir).withColumn("keys", keys).select("query_id", F.size("keys").alias("keys"), covers_keys(F.col("answer"), F.col("keys")).alias("covered"))


def o218_generation(spark, sf_dir):
    """Coverage, share of answers without a bracketed source, and mean length by type of question."""
    a = log(spark, sf_dir).where("answer is not null").withColumn("covered", covers(F.col("answer"), ["学分|学时|credits|hours"]))
    return a.groupBy("query_type").agg(F.count("*").alias("items"), rate(F.col("covered")).alias("coverage"), rate(~F.col("answer").contains("《")).alias("uncited"), F.round(F.avg(F.length("answer")), 4).alias("length"))


def o223_order(spark, sf_dir):
    """Whether numbered points stand in order; null with fewer than two."""
    a = log(spark, sf_dir).where("answer is not null")
    p = F.filter(F.array(*[F.instr("answer", f"{i}. ") for i in range(1, 6)]), lambda x: x > 0)
    return a.select("query_id", F.when(F.size(p) >= 2, p == F.array_sort(p)).alias("in_order"))


def o224_structure(spark, sf_dir):
    """Mean coverage of points and share in order."""
    return o223_order(spark, sf_dir).agg(F.count("in_order").alias("items"), rate(F.col("in_order")).alias("in_order"))


def o225_instructors(spark, sf_dir):
    """Whether all records of a course in a plan name the same set of instructors."""
    from sylvaspark.plans.inputs import offerings

    o = offerings(spark, sf_dir).where("program_name is not null and course_code is not null and instructor is not null")
    o = o.select(F.upper(F.trim("course_code")).alias("code"), "program_name", F.array_join(F.array_sort(F.array_distinct(F.split("instructor", "、"))), "、").alias("n"))
    g = o.groupBy("code", "program_name").agg(F.count("*").alias("records"), F.count_distinct("n").alias("sets"))
    return g.where("records > 1").select("code", "program_name", (F.col("sets") == 1).alias("same"))


def o226_instructor_report(spark, sf_dir):
    """Share of courses in plans whose records all name the same instructors."""
    return o225_instructors(spark, sf_dir).agg(F.count("*").alias("items"), rate(F.col("same")).alias("accuracy"))


def o227_semester_answer(spark, sf_dir):
    """Answers that give a semester together with the year of study."""
    a = log(spark, sf_dir).where("answer is not null")
    n = F.regexp_extract("answer", r"第\s*(\d)\s*学期", 1).try_cast("int")
    year = F.substring(F.lit(YEARS), F.floor((n + 1) / 2).cast("int"), F.lit(1))
    half = F.when(n % 2 == 1, "上").otherwise("下")
    return a.where(n.between(1, 9)).select("query_id", F.col("answer").contains(F.concat(F.lit("大"), year, half)).alias("both"))


def o228_on_topic(spark, sf_dir):
    """Whether the first statement holds what the question is about (the course that it names in brackets, else a word for courses); a chapter heading anywhere means it does not."""
    a = log(spark, sf_dir).where("answer is not null")
    line = F.get(F.filter(F.transform(F.split("answer", r"\r\n|[\n\r]"), X.strip), lambda x: x != ""), F.lit(0))
    first = F.when(F.instr(line, "。") > 0, F.substring(line, F.lit(1), F.instr(line, "。"))).otherwise(F.coalesce(line, F.lit("")))
    return a.select("query_id", "query_type", F.when(F.col("answer").rlike(CHAPTER_LINE), False).otherwise(F.when(F.regexp_extract("query", "《([^》]+)》", 1) != "", first.contains(F.regexp_extract("query", "《([^》]+)》", 1))).otherwise(first.contains("课程") | first.contains("course"))).alias("on_topic"))


def o229_relevance(spark, sf_dir):
    """Rate on topic, in all and by type of question."""
    t = o228_on_topic(spark, sf_dir).where("query_type is not null")
    return t.rollup("query_type").agg(F.count("*").alias("items"), rate(F.col("on_topic")).alias("on_topic"))


def _labels(spark, sf_dir):
    v = _votes(spark, sf_dir)
    label = F.when(~F.col("requires"), "contradiction").when(F.col("confidence") >= 0.5, "entailment").when(F.col("confidence") >= 0.2, "neutral").otherwise("unknown")
    return v.select("target", "source", "vote", label.alias("label"))


def o230_attribution(spark, sf_dir):
    """Answers by their gravest label."""
    g = _labels(spark, sf_dir).groupBy("target").agg(F.count_if(F.col("label") == "contradiction").alias("c"), F.count_if(F.col("label") == "unknown").alias("u"), F.count_if(F.col("label") == "neutral").alias("n"))
    b = F.when(F.col("c") > 0, "contradiction").when(F.col("u") > 0, "unknown").when(F.col("n") > 0, "neutral").otherwise("entailment")
    return g.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def verdict(entailed, contradictions, total):
    return F.when(total == 0, "empty").when((entailed >= ENTAILED) & (contradictions == 0), "passed").when(entailed >= ENTAILED, "partial").when((entailed >= WEAK) & (contradictions == 0), "weak").otherwise("failed")


def o231_verdict(spark, sf_dir):
    """Verdict of each target from the share of entailed labels and the number of contradictions."""
    g = _labels(spark, sf_dir).groupBy("target").agg(F.avg((F.col("label") == "entailment").cast("double")).alias("e"), F.count_if(F.col("label") == "contradiction").alias("c"), F.count("*").alias("t"))
    return g.select("target", F.round("e", 6).alias("entailed"), F.col("c").alias("contradictions"), verdict(F.col("e"), F.col("c"), F.col("t")).alias("level"))


def o232_verify(spark, sf_dir):
    """Targets by verdict; a pass also needs every label entailed."""
    v = o231_verdict(spark, sf_dir)
    return v.groupBy(F.when((F.col("level") == "passed") & (F.col("entailed") < 1), "rewritten").otherwise(F.col("level")).alias("outcome")).agg(F.count("*").alias("n"))


def o233_state(spark, sf_dir):
    """What becomes of each answer: passed, rewritten, pruned or refused."""
    g = _labels(spark, sf_dir).groupBy("target").agg(F.avg((F.col("label") == "entailment").cast("double")).alias("e"), F.count_if(F.col("label") == "contradiction").alias("c"), F.count_if(F.col("label") == "unknown").alias("u"), F.count("*").alias("t"))
    return g.select("target", F.when(F.col("u") == F.col("t"), "unavailable").when(F.col("e") == 1, "passed").when((F.col("c") == 0) & (F.col("e") >= ENTAILED), "rewritten").when((F.col("c") == 0) & (F.col("e") > 0), "pruned").otherwise("refused").alias("state"))


def o234_retained(spark, sf_dir):
    """Entailed labels of targets without a contradiction."""
    l = _labels(spark, sf_dir).withColumn("bad", F.max((F.col("label") == "contradiction").cast("int")).over(Window.partitionBy("target")))
    return l.where("bad = 0 and label = 'entailment'").select("target", "source", "vote")


def score_arm(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Micro and macro precision, recall and F1 of predicted against gold concepts, both (keys, concept); a group without any counts 0."""
    j = gold.distinct().withColumn("g", F.lit(1)).join(predicted.distinct().withColumn("p", F.lit(1)), [*keys, "concept"], "full")
    a = j.groupBy(*keys).agg(F.count("g").alias("g"), F.count("p").alias("p"), F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("t"))
    pr = lambda t, n: F.when(n > 0, t / n).otherwise(0.0)
    t, g, p = F.sum("t"), F.sum("g"), F.sum("p")
    return a.agg(F.round(pr(t, p), 4).alias("micro_precision"), F.round(pr(t, g), 4).alias("micro_recall"), F.round(pr(2 * t, p + g), 4).alias("micro_f1"), F.round(F.avg(pr(F.col("t"), F.col("p"))), 4).alias("macro_precision"), F.round(F.avg(pr(F.col("t"), F.col("g"))), 4).alias("macro_recall"))


def o235_concept_scores(spark, sf_dir):
    """Typed prerequisites of the odd entries scored against those of the even ones, by term."""
    from sylvaspark.plans.inputs import syllabi

    s = syllabi(spark, sf_dir).where("source_year is not null").select("entry_id", "source_year", F.explode("prerequisites").alias("c")).select("entry_id", "source_year", X.course_key(F.col("c")).alias("concept")).where("concept <> ''")
    return score_arm(s.where("entry_id % 2 = 0").select("source_year", "concept"), s.where("entry_id % 2 = 1").select("source_year", "concept"), ["source_year"])


def o237_annotations(spark, sf_dir):
    """Strict and acceptable accuracy of predicted labels, per label and in all."""
    g = _graded(spark, sf_dir)
    strict, near = F.col("gold") == F.col("predicted"), F.abs(F.col("gold") - F.col("predicted")) <= 1
    return g.rollup("gold").agg(F.count("*").alias("items"), rate(strict).alias("strict"), rate(near).alias("acceptable"))


def o238_arms(spark, sf_dir):
    """Retrieval figures of each arm; an arm keeps vectors whose id leaves no rest."""
    r = Steps(spark).write(_ranked(spark, sf_dir))
    out = None
    for n in (1, 2, 3):
        arm = r.where(F.col("id") % n == 0).withColumn("rank", row_rank(["query_id"], F.col("rank")))
        one = retrieval(arm).withColumn("arm", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def o244_gold_set(spark, sf_dir):
    """A fixed gold set: ten questions of each type, in the order of the hash of their id."""
    q = log(spark, sf_dir).where("query_type is not null").withColumn("h", F.sha2("query_id", 256))
    return q.withColumn("r", row_rank(["query_type"], F.col("h"), F.col("query_id"))).where("r <= 10").select("query_id", "query_type", "r")


_RK = f"{_VEC}, nn as (select q.vec_id as query_id, d.vec_id as id, q.label as gold, d.label, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, d.e), 6) desc, d.vec_id)::int as rank from v q, v d where q.vec_id % 5 = 0 and q.vec_id <> d.vec_id qualify rank <= 10), r as (select *, gold = label as relevant from nn), g as (select query_id, gold, label as predicted from r where rank = 1)"
_REF = "(" + " or ".join(f"coalesce(contains(answer, '{m}'), false)" for m in REFUSALS) + ")"
_ANS = f"{LOG}, a as (select *, status is distinct from 'refused' as answerable, {_REF} as refused from lg)"
_RATES = "count(*) as items, round(avg(refused::int::double) filter (not answerable), 4) as correct_refusal, round(avg((not refused)::int::double) filter (not answerable), 4) as hallucination, round(avg(refused::int::double) filter (answerable), 4) as false_refusal"
_LB = f"{_VOTE}, lb as (select target, source, vote, case when not requires then 'contradiction' when confidence >= 0.5 then 'entailment' when confidence >= 0.2 then 'neutral' else 'unknown' end as label from vt), ve as (select target, avg((label = 'entailment')::int::double) as e, count(*) filter (label = 'contradiction') as c, count(*) filter (label = 'unknown') as u, count(*) filter (label = 'neutral') as n, count(*) as t from lb group by 1), vd as (select target, round(e, 6) as entailed, c as contradictions, case when t = 0 then 'empty' when e >= 0.6 and c = 0 then 'passed' when e >= 0.6 then 'partial' when e >= 0.4 and c = 0 then 'weak' else 'failed' end as level from ve)"


def _ret(source: str) -> str:
    return f"select count(*) as items, round(avg(coalesce(first <= 1, false)::int::double), 4) as recall1, round(avg(coalesce(first <= 5, false)::int::double), 4) as recall5, round(avg(coalesce(first <= 10, false)::int::double), 4) as recall10, round(avg(coalesce(1 / first, 0)), 4) as mrr from (select query_id, min(rank) filter (relevant) as first from {source} group by 1)"


def _arm(n: int) -> str:
    return f"(select query_id, id, relevant, row_number() over (partition by query_id order by rank) as rank from r where id % {n} = 0)"


_INS = f"{OFF}, o as (select upper(trim(course_code)) as code, program_name, array_to_string(list_sort(list_distinct(string_split(instructor, '、'))), '、') as n from off where program_name is not null and course_code is not null and instructor is not null), g as (select code, program_name, count(distinct n) = 1 as same from o group by all having count(*) > 1)"
_FIRST = f"coalesce([y for y in [{strip_sql('x')} for x in string_split_regex(answer, '\\r\\n|[\\n\\r]')] if y <> ''][1], '')"
_TOPIC = f"{LOG}, l as (select query_id, query_type, answer, regexp_extract(query, '《([^》]+)》', 1) as fo, {_FIRST} as line from lg where answer is not null), tp as (select query_id, query_type, case when regexp_matches(answer, '(?m)^[\\s\\-\\*•#>\\d\\.、]*第\\s*[一二三四五六七八九十百零\\d]+\\s*章') then false when fo <> '' then contains(case when instr(line, '。') > 0 then substring(line, 1, instr(line, '。')) else line end, fo) else regexp_matches(case when instr(line, '。') > 0 then substring(line, 1, instr(line, '。')) else line end, '课程|course') end as on_topic from l)"
_COV = "coalesce((contains(answer, '学分') or contains(answer, '学时') or contains(answer, 'credits') or contains(answer, 'hours')){}, false)"
SQL = {
    "o100_confusion": f"with {_RK} select gold, " + ", ".join(f"count(*) filter (predicted = {i}) as p{i}" for i in range(10)) + " from g group by gold",
    "o211_per_class": f"with {_RK}, s as (select gold as label, 1 as g, 0 as p, (gold = predicted)::int as t from g union all select predicted, 0, 1, 0 from g), a as (select label, sum(g)::bigint as g, sum(p) as p, sum(t) as t from s group by 1), b as (select label, g, case when p > 0 then t / p else 0.0 end as pr, case when g > 0 then t / g else 0.0 end as re from a) select label, round(pr, 4) as precision, round(re, 4) as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0.0 end, 4) as f1, g as support from b",
    "o212_routing": f"with {_RK}, q as (select query_id, gold, max(label) filter (rank = 1) as predicted, max(relevant::int) as rec, count(*) filter (relevant) as k from r where rank <= 3 group by all) select count(*) as items, round(avg((predicted = gold or (gold % 2 = 0 and predicted = gold + 1))::int::double), 4) as accuracy, round(avg(rec), 4) as label_recall, round(avg(k / 3), 4) as confidence from q",
    "o213_positions": f"with {_RK} select query_id, coalesce(string_agg(rank::varchar, ',' order by rank) filter (relevant), '') as positions from r group by 1",
    "o214_retrieval": f"with {_RK} {_ret('r')}",
    "o164_comparison": f"with {_RK}, b as ({_ret('r')}), a as ({_ret(_arm(2))}), m as (select unnest(['recall1', 'recall5', 'recall10', 'mrr']) as metric, unnest([b.recall1, b.recall5, b.recall10, b.mrr]) as before, unnest([a.recall1, a.recall5, a.recall10, a.mrr]) as after from a, b) select metric, before, after, after < before as fell from m",
    "o216_citation_precision": f"with {_RK} select query_id, case when max(gold) is not null then round(avg(relevant::int::double), 4) end as precision from r where rank <= 5 group by 1",
    "o217_chunk_precision": f"with {_RK} select query_id, round(avg(relevant::int::double), 4) as precision from r where rank <= 5 and id % 2 = 0 group by 1",
    "o221_refusals": f"with {_ANS} select query_id from a where refused",
    "o219_refusal": f"with {_ANS} select {_RATES} from a",
    "o220_refusal_subsets": f"with {_ANS} select persona, {_RATES} from a group by 1",
    "o215_key_coverage": f"with {LOG}, k as (select query_id, answer, [x for x in [" + ", ".join(f"case when regexp_matches(lower(coalesce(query, '')), '{p}') then '{k}' end" for p, k in ASKED_KEYS) + "] if x is not null] as keys from lg) select query_id, len(keys)::int as keys, coalesce(len(keys) > 0 and len([x for x in keys if len([y for y in string_split(x, '|') if y <> '' and contains(answer, y)]) = 0]) = 0 and answer is not null, false) as covered from k",
    "o218_generation": f"with {LOG} select query_type, count(*) as items, round(avg({_COV.format('')}::int::double), 4) as coverage, round(avg((not contains(answer, '《'))::int::double), 4) as uncited, round(avg(length(answer)), 4) as length from lg where answer is not null group by 1",
    "o223_order": f"with {LOG}, p as (select query_id, [x for x in [instr(answer, i || '. ') for i in range(1, 6)] if x > 0] as p from lg where answer is not null) select query_id, case when len(p) >= 2 then p = list_sort(p) end as in_order from p",
    "o224_structure": f"with {LOG}, p as (select query_id, [x for x in [instr(answer, i || '. ') for i in range(1, 6)] if x > 0] as p from lg where answer is not null) select count(*) as items, round(avg((p = list_sort(p))::int::double), 4) as in_order from p where len(p) >= 2",
    "o225_instructors": f"with {_INS} select code, program_name, same from g",
    "o226_instructor_report": f"with {_INS} select count(*) as items, round(avg(same::int::double), 4) as accuracy from g",
    "o228_on_topic": f"with {_TOPIC} select * from tp",
    "o229_relevance": f"with {_TOPIC} select query_type, count(*) as items, round(avg(on_topic::int::double), 4) as on_topic from tp where query_type is not null group by rollup (query_type)",
    "o227_semester_answer": f"with {LOG}, x as (select query_id, answer, try_cast(regexp_extract(answer, '第\\s*(\\d)\\s*学期', 1) as int) as n from lg where answer is not null) select query_id, contains(answer, '大' || substring('{YEARS}', (n + 1) // 2, 1) || case when n % 2 = 1 then '上' else '下' end) as \"both\" from x where n between 1 and 9",
    "o230_attribution": f"with {_LB} select case when c > 0 then 'contradiction' when u > 0 then 'unknown' when n > 0 then 'neutral' else 'entailment' end as bucket, count(*) as n from ve group by 1",
    "o231_verdict": f"with {_LB} select * from vd",
    "o232_verify": f"with {_LB} select case when level = 'passed' and entailed < 1 then 'rewritten' else level end as outcome, count(*) as n from vd group by 1",
    "o233_state": f"with {_LB} select target, case when u = t then 'unavailable' when e = 1 then 'passed' when c = 0 and e >= 0.6 then 'rewritten' when c = 0 and e > 0 then 'pruned' else 'refused' end as state from ve",
    "o234_retained": f"with {_LB} select target, source, vote from lb where label = 'entailment' and target not in (select target from lb where label = 'contradiction')",
    "o235_concept_scores": f"with {SYL}, s as (select entry_id, source_year, {key_sql('c')} as concept from (select entry_id, source_year, unnest(prerequisites) as c from syl where source_year is not null)), j as (select source_year, concept, bool_or(entry_id % 2 = 0) as g, bool_or(entry_id % 2 = 1) as p from s where concept <> '' group by all), a as (select source_year, count(*) filter (g) as g, count(*) filter (p) as p, count(*) filter (g and p) as t from j group by 1) select round(sum(t) / sum(p), 4) as micro_precision, round(sum(t) / sum(g), 4) as micro_recall, round(2 * sum(t) / (sum(p) + sum(g)), 4) as micro_f1, round(avg(case when p > 0 then t / p else 0 end), 4) as macro_precision, round(avg(case when g > 0 then t / g else 0 end), 4) as macro_recall from a",
    "o237_annotations": f"with {_RK} select gold, count(*) as items, round(avg((gold = predicted)::int::double), 4) as strict, round(avg((abs(gold - predicted) <= 1)::int::double), 4) as acceptable from g group by rollup (gold)",
    "o238_arms": f"with {_RK} " + " union all ".join(f"select *, {n} as arm from ({_ret(_arm(n))})" for n in (1, 2, 3)),
    "o244_gold_set": f"with {LOG} select query_id, query_type, row_number() over (partition by query_type order by sha256(query_id), query_id)::int as r from lg where query_type is not null qualify r <= 10",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit()}
