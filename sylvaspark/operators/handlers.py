"""Answer handlers: what a question of each kind is answered from, with retrieval within its course, a least score, evidence under a budget, citations and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvaspark.common import Steps, join_dealt, join_lookup, row_rank, table
from sylvaspark.functions import text as X
from sylvaspark.operators import lexical
from sylvaspark.operators.fields import clean_sql
from sylvaspark.operators.linking import classify
from sylvaspark.plans.inputs import CAT, LOG, OFF, catalog, log, offerings

# Hits of a question, least share of the reachable score, characters of evidence in all and of one hit.
HITS, LEAST, BUDGET, EXCERPT = 6, 0.03, 4200, 700
FACTS = ["credits", "hours", "semester", "instructor"]
# Which field a fact question asks for, in order.
ASKS = [("credits", "学分|credit"), ("hours", "学时|课时|hours"), ("semester", "学期|什么时候|哪年|when"), ("instructor", "谁|老师|教师|负责|teach|taught")]
# Where a text states prerequisites.
PREREQUISITE = r"(?:先修课程|先修|[Pp]rerequisites?)[：: ]*([^。；;\n]{2,60})"


def scoped_hits(questions: DataFrame, docs: DataFrame, k: int = HITS, least: float = LEAST) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each question's own course by BM25 as a share of what is reachable, `least` or more.

    `questions`: query_id, query, course_code. `docs`: doc_id, text, course_code. Statistics are those of all documents. A course of very many documents is dealt out over tasks."""
    steps = Steps(docs.sparkSession)
    size = lexical.corpus_size(docs).first()
    n, avg = size["n_docs"], size["avg_len"] or 1.0
    asked = lexical.postings(questions.where("course_code is not null").select(F.struct("query_id", "course_code").alias("q"), "query"), "q", "query")
    stats = steps.write(lexical.document_frequency(docs))
    asked = join_lookup(steps.write(asked.select("q.query_id", "q.course_code", "term")), stats, "term", "left").withColumn("idf", lexical.idf(F.coalesce("df", F.lit(0)), F.lit(n)))
    asked = steps.write(asked.withColumn("full", F.sum("idf").over(Window.partitionBy("query_id")) * (lexical.K1 + 1)).where("df is not null"))
    held = lexical.postings(docs.where("course_code is not null").select(F.struct("doc_id", "course_code").alias("d"), "text"), "d").select("d.doc_id", "d.course_code", "term", "tf", "len")
    part = F.col("idf") * F.col("tf") * (lexical.K1 + 1) / (F.col("tf") + lexical.K1 * (1 - lexical.B + lexical.B * F.col("len") / avg))
    pairs = join_dealt(steps.write(held), asked.select("query_id", "course_code", "term", "idf", "full"), ["course_code", "term"], "doc_id")
    scored = pairs.groupBy("query_id", "doc_id").agg(F.round(F.sum(part) / F.first("full"), 6).alias("score")).where(F.col("score") >= least)
    return lexical.top(scored, k)


def evidence(hits: DataFrame, docs: DataFrame, budget: int = BUDGET, most: int = EXCERPT) -> DataFrame:
    """`hits` with the source and the excerpt (an excerpt is the feature here) of each document, as far as the excerpts of a question stay within the budget."""
    d = docs.select("doc_id", "source", F.substring("text", 1, most).alias("excerpt"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.join(d, "doc_id").withColumn("used", F.sum(F.length("excerpt")).over(w)).where(F.col("used") <= budget)


def _questions(spark, sf_dir, kind: str | None) -> DataFrame:
    q = log(spark, sf_dir)
    return q.where(f"query_type = '{kind}'" if kind else "query_type is null")


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "course_code", "source")


def _cited(e: DataFrame) -> DataFrame:
    """(query_id, hits, chars, best, citations): citations are sources in the order of their first hit, each once."""
    s = e.groupBy("query_id", "source").agg(F.min("rank").alias("first"), F.count("*").alias("hits"), F.sum(F.length("excerpt")).alias("chars"), F.max("score").alias("best"))
    return s.groupBy("query_id").agg(F.sum("hits").alias("hits"), F.sum("chars").alias("chars"), F.max("best").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]), ",").alias("citations"))


def _supported(spark, sf_dir, q: DataFrame) -> DataFrame:
    d = _docs(spark, sf_dir)
    return q.join(_cited(evidence(scoped_hits(q, d), d)), "query_id", "left")


def _recorded(spark, sf_dir) -> DataFrame:
    """(course_code, field -> whether any plan records it)."""
    o = offerings(spark, sf_dir).where("course_code is not null")
    return o.groupBy(F.upper(F.trim("course_code")).alias("course_code")).agg(*[F.max((X.clean(F.col(c)) != "").cast("int")).alias(c) for c in FACTS])


def _asked_field(q: DataFrame) -> DataFrame:
    out = F.lit(None).cast("string")
    for f, p in reversed(ASKS):
        out = F.when(F.col("query").rlike(p), f).otherwise(out)
    return q.withColumn("field", out)


def o259_fact_search(spark, sf_dir):
    """Fact questions on a course from its documents: hits, best score and citations; refused where no document reaches the least score."""
    q = _supported(spark, sf_dir, _questions(spark, sf_dir, "fact").where("course_code is not null"))
    return q.select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), "best", "citations", F.when(F.col("hits").isNull(), "refused").otherwise("answered").alias("state"))


def o67_fact_gate(spark, sf_dir):
    """Fact questions: from the plans where they record the field that is asked, else from documents of the course above the least score with their citations, else refused."""
    q = _asked_field(_supported(spark, sf_dir, _questions(spark, sf_dir, "fact"))).join(_recorded(spark, sf_dir), "course_code", "left")
    there = F.coalesce(*[F.when(F.col("field") == f, F.col(f) == 1) for f in FACTS], F.lit(False))
    branch = F.when(there, "plans").when(F.col("hits").isNotNull(), "documents").otherwise("refused")
    return q.select("query_id", "field", branch.alias("branch"), F.when(branch == "documents", F.col("citations")).alias("citations"))


def o256_content(spark, sf_dir):
    """Content questions: evidence within the budget with its citations; without any the answer is refused and nothing is cited."""
    q = _supported(spark, sf_dir, _questions(spark, sf_dir, "content"))
    return q.select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("chars", F.lit(0)).alias("chars"), "citations", F.when(F.col("hits").isNull(), "refused").otherwise("answered").alias("state"))


def _listed(spark, sf_dir) -> DataFrame:
    p = F.filter(F.transform("prerequisites", lambda x: X.clean(x)), lambda x: x != "")
    return catalog(spark, sf_dir).select("course_code", F.greatest(F.coalesce(F.size(F.array_distinct(p)), F.lit(0)), F.lit(0)).alias("listed"))


def o255_dependency(spark, sf_dir):
    """Dependency questions: from the prerequisites that the catalogue lists, else from what the hits say of prerequisites (the first such statement), else none."""
    q = _questions(spark, sf_dir, "dependency").where("course_code is not null")
    d = _docs(spark, sf_dir)
    said = scoped_hits(q, d).join(d.select("doc_id", F.trim(F.regexp_extract("text", PREREQUISITE, 1)).alias("said")), "doc_id").where("said <> ''").groupBy("query_id").agg(F.min_by("said", "rank").alias("said"))
    j = q.join(_listed(spark, sf_dir), "course_code", "left").join(said, "query_id", "left")
    branch = F.when(F.col("listed") > 0, "catalog").when(F.col("said").isNotNull(), "documents").otherwise("none")
    return j.select("query_id", branch.alias("branch"), F.when(branch == "documents", F.col("said")).alias("said"))


def o257_hybrid(spark, sf_dir):
    """Other questions on a course: evidence and listed prerequisites together; documents, graph, both or neither."""
    q = _supported(spark, sf_dir, _questions(spark, sf_dir, None).where("course_code is not null")).join(_listed(spark, sf_dir), "course_code", "left")
    plan = F.when(F.col("hits").isNotNull() & (F.col("listed") > 0), "both").when(F.col("hits").isNotNull(), "documents").when(F.col("listed") > 0, "graph").otherwise("refused")
    return q.select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("listed", F.lit(0)).alias("listed"), plan.alias("plan"), "citations")


def o254_multi_intent(spark, sf_dir):
    """Questions of two intents: one section for each of the first two, in order, from what its handler has (plans, documents, catalogue), with the citations of both once; if no section has anything, the question falls back to one answer."""
    q = classify(log(spark, sf_dir)).where("size(labels) >= 2").withColumn("pair", F.slice("labels", 1, 2))
    q = Steps(spark).write(q.select("query_id", "query", "course_code", "pair"))
    q = _asked_field(_supported(spark, sf_dir, q)).join(_recorded(spark, sf_dir), "course_code", "left").join(_listed(spark, sf_dir), "course_code", "left")
    there = F.coalesce(*[F.when(F.col("field") == f, F.col(f) == 1) for f in FACTS], F.lit(False))
    text = F.when(F.col("hits").isNotNull(), "documents")
    has = lambda x: F.when((x == "fact") & there, "plans").when((x == "dependency") & (F.coalesce("listed", F.lit(0)) > 0), "catalog").when(x.isin("catalog", "existence"), F.when(F.coalesce(*FACTS, F.lit(0)) > 0, "plans")).otherwise(text)
    s = F.transform("pair", lambda x: F.struct(x.alias("section"), has(x).alias("source")))
    q = q.withColumn("sections", s)
    empty = F.forall("sections", lambda x: x["source"].isNull())
    return q.select("query_id", F.when(empty, "fallback").otherwise("sections").alias("state"), F.array_join(F.transform("sections", lambda x: F.concat(x["section"], F.lit("="), F.coalesce(x["source"], F.lit("-")))), ";").alias("sections"), F.when(~empty, F.col("citations")).alias("citations"))


_H = f"""{lexical.TOKENS}, {LOG}, {CAT}, {OFF},
qt as (select query_id, course_code, lower(coalesce(query, '')) as low from lg where course_code is not null), qh as (select *, regexp_extract_all(low, '[a-z][a-z0-9]+') as latin, regexp_replace(low, '[^一-鿿]', '', 'g') as han from qt),
qk as (select distinct query_id, course_code, unnest(list_concat(latin, [substring(han, i, 2) for i in range(1, length(han))])) as term from qh),
qw as (select query_id, course_code, term, df, greatest(0.0, ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) as idf, avg_len from qk left join dfs using (term), n),
qf as (select query_id, sum(idf) * 2.5 as full_ from qw group by 1),
sc as (select query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) / any_value(full_), 6) as score from qw join qf using (query_id) join documents d using (course_code) join post p using (doc_id, term) where df is not null group by all),
ht as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc where score >= {LEAST} qualify rank <= 6),
ev as (select *, sum(length(excerpt)) over (partition by query_id order by rank rows unbounded preceding) as used from (select ht.*, source, substring(text, 1, 700) as excerpt from ht join documents using (doc_id)) qualify used <= 4200),
es as (select query_id, source, min(rank) as f, count(*) as h, sum(length(excerpt)) as ch, max(score) as b from ev group by all),
ci as (select query_id, sum(h)::bigint as hits, sum(ch)::bigint as chars, max(b) as best, string_agg(source, ',' order by f) as citations from es group by 1),
rc as (select upper(trim(course_code)) as course_code, {', '.join(f"max(({clean_sql(c)} <> '')::int) as {c}" for c in FACTS)} from off where course_code is not null group by 1),
li as (select course_code, len(list_distinct([x for x in [{clean_sql('y')} for y in prerequisites] if x <> '']))::int as listed from cat)"""
_FIELD = "case " + " ".join(f"when regexp_matches(query, '{p}') then '{f}'" for f, p in ASKS) + " end"
_THERE = "coalesce(case field " + " ".join(f"when '{f}' then {f} = 1" for f in FACTS) + " end, false)"
SQL = {
    "o259_fact_search": f"with {_H} select query_id, coalesce(hits, 0) as hits, best, citations, case when hits is null then 'refused' else 'answered' end as state from lg left join ci using (query_id) where query_type = 'fact' and course_code is not null",
    "o67_fact_gate": f"with {_H}, x as (select lg.query_id, {_FIELD} as field, hits, citations, rc.* exclude (course_code) from lg left join ci using (query_id) left join rc using (course_code) where query_type = 'fact'), y as (select *, case when {_THERE} then 'plans' when hits is not null then 'documents' else 'refused' end as branch from x) select query_id, field, branch, case when branch = 'documents' then citations end as citations from y",
    "o256_content": f"with {_H} select query_id, coalesce(hits, 0) as hits, coalesce(chars, 0) as chars, citations, case when hits is null then 'refused' else 'answered' end as state from lg left join ci using (query_id) where query_type = 'content'",
    "o255_dependency": f"with {_H}, sd as (select query_id, trim(regexp_extract(text, '{PREREQUISITE}', 1)) as said, rank from ht join documents using (doc_id)), sf as (select query_id, arg_min(said, rank) as said from sd where said <> '' group by 1), y as (select query_id, case when listed > 0 then 'catalog' when said is not null then 'documents' else 'none' end as branch, said from lg left join li using (course_code) left join sf using (query_id) where query_type = 'dependency' and course_code is not null) select query_id, branch, case when branch = 'documents' then said end as said from y",
    "o257_hybrid": f"with {_H} select query_id, coalesce(hits, 0) as hits, coalesce(listed, 0) as listed, case when hits is not null and listed > 0 then 'both' when hits is not null then 'documents' when listed > 0 then 'graph' else 'refused' end as plan, citations from lg left join ci using (query_id) left join li using (course_code) where query_type is null and course_code is not null",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit()}
