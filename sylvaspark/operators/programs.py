"""Catalogue and plans: merges, counts, concept links between courses, graph records, programme networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvaspark.common import Steps, first_by, row_rank, table
from sylvaspark.functions import text as X
from sylvaspark.operators.fields import PLAN_TYPES, clean_sql, column_sql, core_sql
from sylvaspark.operators.hierarchy import parent_links
from sylvaspark.operators.linking import _CODE, _TITLE
from sylvaspark.operators.vectors import _VOTE, _vectors, _votes, concepts
from sylvaspark.plans.inputs import CAT, OFF, SYL, catalog, offerings, syllabi


def _off(spark, sf_dir) -> DataFrame:
    return offerings(spark, sf_dir).withColumn("code", F.upper(F.trim("course_code"))).where("code is not null")


def merge_catalog(rows: DataFrame) -> DataFrame:
    """One row per course: the first record's attributes, distinct offerings, programmes in order of first appearance."""
    g = rows.groupBy("code").agg(F.min_by(F.struct("source_file", "course_category"), "offering_id").alias("head"), F.count_distinct("program_name", "semester", F.coalesce("credits", F.lit("")), F.coalesce("instructor", F.lit(""))).alias("n_offerings"))
    p = rows.where("program_name is not null").groupBy("code", "program_name").agg(F.min("offering_id").alias("o")).groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "program_name"))), lambda x: x["program_name"]).alias("programs"))
    return g.join(p, "code", "left").select("code", "head.*", "n_offerings", "programs")


def o13_merge_catalog(spark, sf_dir):
    """Plans merged into one catalogue."""
    return merge_catalog(_off(spark, sf_dir).where("semester is not null")).select("code", "source_file", "course_category", F.size("programs").alias("n_programs"), "n_offerings")


def o14_plan_chunks(spark, sf_dir):
    """One key-value text per offering, without empty facts, with an id that depends on source and code only."""
    facts = [F.when(X.clean(F.col(c)) != "", F.concat(F.lit(f"{label}："), X.clean(F.col(c)))) for c, label in (("program_name", "培养方案"), ("credits", "学分"), ("hours", "学时"), ("semester", "学期"), ("instructor", "教师"))]
    return _off(spark, sf_dir).select("offering_id", F.sha2(F.concat_ws("|", "source_file", "code"), 256).alias("chunk_id"), F.array_join(F.array_compact(F.array(*facts)), "\n").alias("chunk"))


def duplicated(keyed: DataFrame) -> DataFrame:
    """(label, key, n) of the keys that occur more than once under their label; no rows if the constraint holds. Null keys break it too."""
    return keyed.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1 or key is null")


def o17_unique_keys(spark, sf_dir):
    """Keys that break the constraints of the graph: of courses, offerings and documents as they were delivered, where repeated deliveries do, and after these are taken out, where nothing should."""
    key = lambda d, label, c: d.select(F.lit(label).alias("label"), F.col(c).cast("string").alias("key"))
    raw = key(table(spark, sf_dir, "course_catalog"), "course as delivered", "course_code").union(key(table(spark, sf_dir, "course_offerings"), "offering as delivered", "offering_id"))
    clean = key(catalog(spark, sf_dir), "course", "course_code").union(key(offerings(spark, sf_dir), "offering", "offering_id")).union(key(table(spark, sf_dir, "documents"), "document", "doc_id"))
    return duplicated(raw.union(clean))


def o19_inventory(spark, sf_dir):
    """Files by kind and term."""
    f = offerings(spark, sf_dir).select("source_file").union(syllabi(spark, sf_dir).select("source_file")).where("source_file is not null").distinct()
    return f.groupBy(F.regexp_extract("source_file", r"\.([a-z]+)$", 1).alias("kind"), F.regexp_extract("source_file", r"^(\d{4}-\d)", 1).alias("term")).agg(F.count("*").alias("files"))


def o20_safe_names(spark, sf_dir):
    """File names without folders and unsafe characters, 150 characters at most."""
    f = offerings(spark, sf_dir).select("source_file").where("source_file is not null").distinct()
    base = F.regexp_replace(F.element_at(F.split("source_file", "[/\\\\\\\\]"), -1), '[<>:"|?*\\x00-\\x1f\\s]+', "_")
    return f.select("source_file", F.substring(F.regexp_replace(base, "^[.]+", ""), 1, 150).alias("safe"))


def o69_latest_profile(spark, sf_dir):
    """Of each course name the latest syllabus, joined to the catalogue without replacing what that has."""
    s = syllabi(spark, sf_dir).where("course_name is not null")
    latest = s.groupBy("course_name").agg(F.max_by(F.struct("entry_id", "source_year"), F.struct(F.coalesce("source_year", F.lit("")), "entry_id")).alias("p"))
    c = catalog(spark, sf_dir)
    return c.join(latest, "course_name", "left").select("course_code", F.col("p.entry_id").alias("entry_id"), F.coalesce(F.nullif("english_name", F.lit("")), F.col("p.source_year")).alias("detail"))


def o70_conflicts(spark, sf_dir):
    """Fields in which any two records of a course in a plan disagree."""
    g = _off(spark, sf_dir).where("program_name is not null").groupBy("code", "program_name").agg(*[F.count_distinct(F.nullif(X.clean(F.col(c)), F.lit(""))).alias(c) for c in ("credits", "hours")])
    found = F.array_compact(F.array(*[F.when(F.col(c) > 1, F.lit(c)) for c in ("credits", "hours")]))
    return g.select("code", "program_name", F.array_join(found, ",").alias("conflicts")).where("conflicts <> ''")


def o71_upsert(spark, sf_dir):
    """Catalogue and syllabi as one: courses of either, prerequisites of both in order."""
    c = catalog(spark, sf_dir).select(F.lower("course_name").alias("name"), F.col("prerequisites").alias("a"), "course_code").where("name is not null")
    c = first_by(c, ["name"], F.col("course_code"))
    s = syllabi(spark, sf_dir).select(F.lower("course_name").alias("name"), F.col("prerequisites").alias("b"), "entry_id").where("name is not null")
    s = first_by(s, ["name"], F.col("entry_id"))
    empty = F.array().cast("array<string>")
    return c.join(s, "name", "full").select("name", "course_code", "entry_id", F.size(F.array_union(F.coalesce("a", empty), F.coalesce("b", empty))).alias("prerequisites"))


def _verified(spark, sf_dir) -> DataFrame:
    v = _votes(spark, sf_dir).groupBy("target", "source").agg(F.bool_and("requires").alias("requires"), F.avg("confidence").alias("confidence"))
    return v.withColumn("origin", F.when(F.col("source") % 4 == 0, "rule").when(F.col("source") % 4 == 1, "human").otherwise("llm"))


def o72_course_links(spark, sf_dir):
    """Verified concept links lifted to courses: literally required, of human or model origin, confident; with the number of links and examples."""
    e = _verified(spark, sf_dir).where("requires and origin in ('llm', 'human') and confidence >= 0.3")
    c = e.select((F.col("source") % 50).alias("from_course"), (F.col("target") % 50).alias("to_course"), F.concat_ws(">", "source", "target").alias("x"))
    return c.where("from_course <> to_course").groupBy("from_course", "to_course").agg(F.countDistinct("x").alias("links"), F.array_join(F.slice(F.array_sort(F.collect_set("x")), 1, 3), ",").alias("examples"))


def o73_course_flows(spark, sf_dir):
    """Concept pairs per course pair under the looser gate: required is enough."""
    e = _verified(spark, sf_dir).where("requires").select((F.col("source") % 50).alias("from_course"), (F.col("target") % 50).alias("to_course"), "source", "target").where("from_course <> to_course")
    return e.groupBy("from_course", "to_course").agg(F.count_distinct("source", "target").alias("n"))


def top_flows(flows: DataFrame, allowed: DataFrame, k: int = 30) -> DataFrame:
    """The k largest flows (from_course, to_course, n) of which both ends are allowed (course); ties go to the smallest ends."""
    ends = allowed.select("course").where("course is not null").distinct()
    inside = flows.join(ends.withColumnRenamed("course", "from_course"), "from_course", "left_semi").join(ends.withColumnRenamed("course", "to_course"), "to_course", "left_semi")
    return inside.orderBy(F.col("n").desc(), "from_course", "to_course").limit(k)


def o116_top_flows(spark, sf_dir):
    """The thirty largest flows between courses that teach concepts in the first four semesters."""
    early = concepts(_vectors(spark, sf_dir)).where("semester <= 4").select("course")
    return top_flows(o73_course_flows(spark, sf_dir), early)


def o94_reason(spark, sf_dir):
    """The most frequent status of each course's questions; ties go to the longest, then the first by letters."""
    q = table(spark, sf_dir, "query_log").drop("received_at").distinct().where("course_code is not null and status is not null")
    return q.groupBy("course_code", "status").agg(F.count("*").alias("n")).groupBy("course_code").agg(F.min_by("status", F.struct(-F.col("n"), -F.length("status"), "status")).alias("status"))


def o89_majority(spark, sf_dir):
    """The most frequent category of each course, the first seen on ties."""
    o = _off(spark, sf_dir).where("course_category is not null").groupBy("code", "course_category").agg(F.count("*").alias("n"), F.min("offering_id").alias("first"))
    return o.groupBy("code").agg(F.min_by("course_category", F.struct(-F.col("n"), "first")).alias("category"))


def o90_unique_values(spark, sf_dir):
    """Distinct semesters of each course in the order of first appearance."""
    o = _off(spark, sf_dir).select("code", X.clean(F.col("semester")).alias("s"), "offering_id").where("s <> ''").groupBy("code", "s").agg(F.min("offering_id").alias("o"))
    return o.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]), "|").alias("semesters"))


def o91_occurrences(spark, sf_dir):
    """Occurrences of a concept (a block's title without its number) by course and chapter, each once, with the first text and the first chunk that any of them has."""
    from sylvaspark.operators.doctree import _blk

    b = _blk(spark, sf_dir).where("title is not null and course_code is not null").withColumn("concept", F.regexp_replace("title", r"^第[一二三四五六七八九十0-9]+[章讲节周]\s*", "")).where("concept <> ''")
    has_text, has_chunk = F.trim("text") != "", F.size("chunk_ids") > 0
    return b.groupBy("concept", "course_code", "chapter").agg(F.count("*").alias("n"), F.min_by("text", F.when(has_text, F.col("node_id"))).alias("evidence"), F.min_by(F.get("chunk_ids", F.lit(0)), F.when(has_chunk, F.col("node_id"))).alias("chunk_id"))


def o95_program_catalog(spark, sf_dir):
    """Distinct courses of each plan by college and core name, in display order."""
    o = _off(spark, sf_dir).where("program_name is not null")
    g = o.groupBy("program_name").agg(F.countDistinct("code").alias("courses"), F.min("program_type").alias("program_type"))
    core = X.core_program(F.regexp_replace("program_name", "（[^（）]*）$", ""), PLAN_TYPES)
    g = g.select(X.college(F.col("program_name")).alias("college"), core.alias("core"), "program_name", "program_type", "courses")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PLAN_ORDER)), F.col("program_type")), F.lit(0)), F.lit(99))
    return g.withColumn("place", row_rank(["college", "core"], place, F.col("program_type"), F.col("program_name")))


# Plan types in the order in which students meet them.
PLAN_ORDER = ["主修专业类", "主修专业", "辅修专业", "辅修微专业"]


def o96_overview(spark, sf_dir):
    """Courses, plans, majors and resolved prerequisites of the corpus."""
    o = _off(spark, sf_dir).agg(F.countDistinct("code").alias("offered"), F.countDistinct("program_name").alias("plans"), F.countDistinct("program_type").alias("types"))
    nodes, links = parent_links(table(spark, sf_dir, "course_catalog"))
    n = nodes.agg(F.count("*").alias("courses"))
    e = links.agg(F.count("*").alias("prerequisites"))
    return o.crossJoin(n).crossJoin(e)  # one row each


def o97_major_courses(spark, sf_dir):
    """Courses of each core major and type of plan, in order of their codes."""
    o = _off(spark, sf_dir).where("program_name is not null")
    core = X.core_program(F.regexp_replace("program_name", "（[^（）]*）$", ""), PLAN_TYPES)
    return o.groupBy(core.alias("core"), "program_type").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def o99_summary(spark, sf_dir):
    """Questions by type, status and persona, with totals of every level."""
    q = table(spark, sf_dir, "query_log").drop("received_at").distinct()
    return q.rollup("query_type", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def o103_existence_details(spark, sf_dir):
    """Values of each field of a course with the number of plans that say so."""
    o = _off(spark, sf_dir).where("program_name is not null")
    v = o.select("code", "program_name", F.explode(F.create_map(F.lit("semester"), X.clean(F.col("semester")), F.lit("category"), X.clean(F.col("course_category")))).alias("field", "value")).where("value <> ''")
    return v.groupBy("code", "field", "value").agg(F.countDistinct("program_name").alias("plans"))


def o119_home_offering(spark, sf_dir):
    """The offering of the earliest fixed semester, else the first."""
    o = _off(spark, sf_dir)
    return o.groupBy("code").agg(F.min_by("offering_id", F.struct(F.coalesce(X.semester_column(F.col("semester")), F.lit(99)), "offering_id")).alias("offering_id"))


def o118_nodes(spark, sf_dir):
    """Courses with their home offering's semester label and group."""
    o = _off(spark, sf_dir)
    home = o119_home_offering(spark, sf_dir).join(o.drop("code"), "offering_id")
    return home.select("code", X.semester_label(F.col("semester")).alias("label"), X.course_group(F.col("course_category"), F.col("course_subcategory")).alias("grp"))


def o278_semesters(spark, sf_dir):
    """Earliest fixed semester of each course."""
    return _off(spark, sf_dir).groupBy("code").agg(F.min(X.semester_column(F.col("semester"))).alias("semester"))


def o173_concept_semester(spark, sf_dir):
    """Earliest semester of a plan's courses, null if any of them has none."""
    s = o278_semesters(spark, sf_dir)
    o = _off(spark, sf_dir).where("program_name is not null").select("program_name", "code").distinct().join(s, "code")
    return o.groupBy("program_name").agg(F.when(F.count("*") == F.count("semester"), F.min("semester")).alias("semester"))


def o296_fixed_semester(spark, sf_dir):
    """Courses whose offerings all name one semester from 1 to 8, drawn in turn by semester."""
    o = _off(spark, sf_dir).select("code", X.semester_column(F.col("semester")).alias("s"))
    g = o.groupBy("code").agg(F.count("*").alias("n"), F.count("s").alias("k"), F.min("s").alias("s"), F.max("s").alias("t")).where("n = k and s = t and s <= 8")
    return g.select("code", "s", row_rank(["s"], F.col("code")).alias("draw"))


KNOWLEDGE = 150


def program_graph(offers: DataFrame, edges: DataFrame, links: DataFrame, most: int = KNOWLEDGE) -> DataFrame:
    """(program, kind, src, dst, external, weight): the links of every programme's network.

    `offers`: program, node, semester. Prerequisites (src, dst) of its courses, also from courses outside of it (external). Knowledge (src, dst, weight) between its own courses: not where there is a prerequisite already, not back in time, not where both directions remain; the `most` of most weight, ties by src and dst."""
    steps = Steps(offers.sparkSession)
    o = steps.write(offers.groupBy("program", "node").agg(F.min("semester").alias("s")))
    own = o.select("program", F.col("node").alias("src"), F.lit(False).alias("external"))
    pre = o.select("program", F.col("node").alias("dst")).join(edges.distinct(), "dst").join(own, ["program", "src"], "left")
    pre = steps.write(pre.select("program", F.lit("prerequisite").alias("kind"), "src", "dst", F.coalesce("external", F.lit(True)).alias("external"), F.lit(1).cast("long").alias("weight")))
    k = o.select("program", F.col("node").alias("src"), F.col("s").alias("_a")).join(links, "src").join(o.select("program", F.col("node").alias("dst"), F.col("s").alias("_b")), ["program", "dst"]).where("src <> dst and not coalesce(_a > _b, false)")
    k = steps.write(k.join(pre.select("program", "src", "dst"), ["program", "src", "dst"], "left_anti").select("program", "src", "dst", "weight"))
    k = k.join(k.select("program", F.col("dst").alias("src"), F.col("src").alias("dst")), ["program", "src", "dst"], "left_anti")
    k = k.withColumn("r", row_rank(["program"], F.col("weight").desc(), F.col("src"), F.col("dst"))).where(F.col("r") <= most)
    return pre.unionByName(k.select("program", F.lit("knowledge").alias("kind"), "src", "dst", F.lit(False).alias("external"), "weight"))


def _network(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from sylvaspark.operators.graphs import _offers, part_edges

    o = Steps(spark).write(_offers(spark, sf_dir))
    links = o72_course_links(spark, sf_dir).select(F.col("from_course").cast("long").alias("src"), F.col("to_course").cast("long").alias("dst"), F.col("links").alias("weight"))
    return o, program_graph(o, part_edges(spark, sf_dir), Steps(spark).write(links))


def o185_program_graph(spark, sf_dir):
    """The links of the networks of all programmes: prerequisites with those from outside, and knowledge."""
    return _network(spark, sf_dir)[1]


def o185_stats(spark, sf_dir):
    """Courses of each programme, those from outside, its links by kind and its courses with a prerequisite link."""
    o, g = _network(spark, sf_dir)
    g = Steps(spark).write(g)
    n = g.groupBy("program").agg(F.count_distinct(F.when(F.col("external"), F.col("src"))).alias("external"), F.count_if(F.col("kind") == "prerequisite").alias("prerequisites"), F.count_if(F.col("kind") == "knowledge").alias("knowledge"))
    ends = g.where("kind = 'prerequisite'").select("program", F.explode(F.array(F.col("dst"), F.when(~F.col("external"), F.col("src")))).alias("node")).where("node is not null").groupBy("program").agg(F.countDistinct("node").alias("linked"))
    c = o.groupBy("program").agg(F.countDistinct("node").alias("courses"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return c.join(n, "program", "left").join(ends, "program", "left").select("program", "courses", *map(zero, ("external", "prerequisites", "knowledge", "linked")))


def o83_graph_records(spark, sf_dir):
    """Nodes and edges of the catalogue graph with both ends present, counted by kind."""
    c, p = catalog(spark, sf_dir).select("course_code").distinct(), _off(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "course_code").where("course_code is not null")
    nodes = c.select(F.lit("Course").alias("kind")).union(p.select("program_name").where("program_name is not null").distinct().select(F.lit("Program"))).union(d.select(F.lit("Document")))
    teaches = p.select("program_name", F.col("code").alias("course_code")).distinct().where("program_name is not null").join(c, "course_code", "left_semi").select(F.lit("CONTAINS"))
    mentions = d.join(c, "course_code", "left_semi").select(F.lit("MENTIONS"))
    before = parent_links(table(spark, sf_dir, "course_catalog"))[1].select(F.lit("PREREQUISITE_OF"))
    return nodes.union(teaches).union(mentions).union(before).groupBy("kind").agg(F.count("*").alias("n"))


def o16_replace_managed(spark, sf_dir):
    """Rows that a build owns replaced by the new build's: what is not owned stays, equal keys merge."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "doc_kind")
    old = d.where("doc_id % 10 <> 0").withColumn("build", F.when(F.col("doc_id") % 3 == 0, "manual").otherwise("b1"))
    new = d.where("doc_id % 10 <> 1").withColumn("build", F.lit("b2"))
    kept = old.where("build = 'manual'")
    return new.unionByName(kept.join(new.select("doc_id"), "doc_id", "left_anti")).groupBy("build").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def o295_relation_items(spark, sf_dir):
    """Pairs of a course and what its parent is below: direct, indirect within three links, or none."""
    _, l = parent_links(table(spark, sf_dir, "course_catalog"))
    one = l.select(F.col("code").alias("a"), F.col("parent").alias("b"))
    two = one.select("a", F.col("b").alias("a2")).join(one.select(F.col("a").alias("a2"), "b"), "a2").select("a", "b")
    three = two.select("a", F.col("b").alias("a2")).join(one.select(F.col("a").alias("a2"), "b"), "a2").select("a", "b")
    every = one.withColumn("d", F.lit(1)).unionByName(two.withColumn("d", F.lit(2))).unionByName(three.withColumn("d", F.lit(3))).where("a <> b")
    return every.groupBy("a", "b").agg(F.min("d").alias("d")).groupBy(F.when(F.col("d") == 1, "direct").otherwise("indirect").alias("relation")).agg(F.count("*").alias("n"))


def forward_fill(rows: DataFrame, keys: list[str], order: list[str], category: str, subcategory: str) -> DataFrame:
    """Rows with the category of the row above where their own is null; the subcategory starts anew with each category."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_run", F.count(category).over(w)).withColumn(category, F.last(category, True).over(w))
    w2 = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn(subcategory, F.last(subcategory, True).over(w2)).drop("_run")


def o6_forward_fill(spark, sf_dir):
    """Order lines as sheet rows with sparse categories, filled from above."""
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", *line, F.when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag")).alias("category"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("subcategory"))
    return forward_fill(r, ["l_orderkey"], line, "category", "subcategory").select("l_orderkey", "l_linenumber", "l_partkey", "category", "subcategory")


def o123_part_number(spark, sf_dir):
    """Occurrence number of each category within an order."""
    r = table(spark, sf_dir, "lineitem")
    return r.select("l_orderkey", "l_linenumber", row_rank(["l_orderkey", "l_returnflag"], F.col("l_linenumber")).alias("part"))


def o125_spread(spark, sf_dir):
    """A quota of 40 offerings, one of each programme first, then in order."""
    o = offerings(spark, sf_dir).where("program_name is not null")
    r = o.withColumn("r", row_rank(["program_name"], F.col("offering_id")))
    return r.orderBy(F.col("r") > 1, "offering_id").limit(40).select("offering_id", "program_name")


def o236_quota(spark, sf_dir):
    """Seats of a sample of 100 events by type: one each, the rest by largest remainder."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    q = g.crossJoin(F.broadcast(t)).withColumn("exact", (F.lit(100) - F.col("groups")) * F.col("n") / F.col("total")).withColumn("base", F.floor("exact"))  # one row
    left = q.agg((F.first(F.lit(100) - F.col("groups")) - F.sum("base")).alias("left"))
    r = q.withColumn("place", F.row_number().over(Window.orderBy((F.col("exact") - F.col("base")).desc(), "event_type"))).crossJoin(F.broadcast(left))  # one row per type
    return r.select("event_type", (1 + F.col("base") + (F.col("place") <= F.col("left")).cast("long")).alias("seats"))


# Where a text is cut into candidates (white space, marks, particles, verbs of instruction), what a candidate is, and what is none.
CUT = r"(?U)[\s、,，;；。!！?？:：/|()（）\[\]【】]+|(?:以及|包括|涉及|掌握|了解|熟悉|理解|能够|要求|运用|应用于|等|与|和|及|的|并|或)"
CANDIDATE = "[一-鿿A-Za-z][一-鿿A-Za-z0-9]{1,15}"
STRUCTURAL = r"^(第[一二三四五六七八九十百千零\d]+[章节讲课周部单元次]|复习|答疑|绪论|导论|小结|总结|习题|案例分析|课堂讨论)"
NOISE = "教学进度表 成绩评定 参考书目 参考书 文档概览 课程基本信息 考核方式 教材 本课程 课程 学生 教学内容 教学目标 课程目标 课程简介 教学方法 教学要求 教学安排 学时 学分 章节 作业 考试 期末 期中 平时成绩 课堂 讲授 实验 掌握 了解 熟悉 理解 能够 要求 培养 重点 难点 内容 方法 主要 基本 相关 教师 专业 学院 大学 教研室 先修课程".split()
FRAGMENTS = "掌握|了解|熟悉|能够|要求|重点|难点|学时|学分|考核|成绩|作业|本章|本节"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents under their course; those without one under their source."""
    return docs.withColumn("course", F.coalesce(F.nullif("course_code", F.lit("")), "source", F.lit("unknown")))


def is_noise(x):
    """Too short, a word of instruction, a structure mark, or holding a fragment of either."""
    return (F.length(x) < 2) | x.isin(NOISE) | x.rlike(STRUCTURAL) | x.rlike(FRAGMENTS)


def candidates(text):
    """Candidates of a text in order, noise included."""
    return F.flatten(F.transform(F.split(text, CUT), lambda x: F.regexp_extract_all(x, F.lit(CANDIDATE), F.lit(0))))


def candidate_counts(docs: DataFrame) -> DataFrame:
    """(course, phrase, tf): candidates in the texts of each course, without structure marks and words of instruction."""
    p = docs.where("text is not null").select("course", F.explode(candidates(F.col("text"))).alias("phrase"))
    return p.where(~is_noise(F.col("phrase"))).groupBy("course", "phrase").agg(F.count("*").alias("tf"))


def o143_noise(spark, sf_dir):
    """Every candidate of all documents with its number of occurrences, and whether it is noise."""
    t = table(spark, sf_dir, "documents").where("text is not null").select(F.explode(candidates(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n")).select("term", "n", is_noise(F.col("term")).alias("noise"))


def o86_phrases(spark, sf_dir):
    """Candidate phrases of all documents by course."""
    return candidate_counts(_keyed(table(spark, sf_dir, "documents")))


def o87_ranked_phrases(spark, sf_dir):
    """The forty best phrases of each course by frequency times rarity over courses; phrases of most courses are left out."""
    d = _keyed(table(spark, sf_dir, "documents"))
    p = Steps(spark).write(candidate_counts(d))
    df = p.groupBy("phrase").agg(F.count("*").alias("df"))
    n = d.agg(F.countDistinct("course").alias("n"))
    s = p.join(df, "phrase").crossJoin(F.broadcast(n)).where("n = 1 or df / n <= 0.5")  # one row
    s = s.select("course", "phrase", (F.col("tf") * (F.log(F.col("n") / F.col("df")) + 1)).alias("score"))
    return s.withColumn("rank", row_rank(["course"], F.col("score").desc(), F.col("phrase"))).where("rank <= 40").withColumn("score", F.round("score", 6))


_O = f"{OFF}, o as (select *, {_CODE} as code from off where course_code is not null)"
_LINK = r"nodes as (select distinct upper(trim(course_code)) as code from course_catalog), raw as (select distinct upper(trim(course_code)) as code, upper(regexp_replace(u.p, '^\s+|\s+$', '', 'g')) as parent from course_catalog, unnest(prerequisites) as u(p)), link as (select code, min(parent) as parent from raw where parent in (select code from nodes) group by code)"
_GATE = f"{_VOTE}, ve as (select target, source, bool_and(requires) as requires, avg(confidence) as confidence, case when source % 4 = 0 then 'rule' when source % 4 = 1 then 'human' else 'llm' end as origin from vt group by target, source)"
_FLOW = f"{_GATE}, fl as (select source % 50 as from_course, target % 50 as to_course, count(distinct (source, target)) as n from ve where requires and source % 50 <> target % 50 group by all)"
_NET = f"""{_GATE}, cl as (select source % 50 as src, target % 50 as dst, count(distinct source || '>' || target) as weight from ve where requires and origin in ('llm', 'human') and confidence >= 0.3 and source % 50 <> target % 50 group by all),
kk as (select p_partkey::bigint as k from part where p_partkey > 1), e as (select distinct src, dst from (select unnest([k // 2, k // 3]) as src, k as dst from kk) where src > 0), ofr as (select l_suppkey::bigint as program, l_partkey::bigint as node, min(l_linenumber) as s from lineitem group by all),
pre as (select o.program, e.src, e.dst, (o.program, e.src) not in (select (program, node) from ofr) as external from ofr o join e on e.dst = o.node), kn as (select a.program, cl.src, cl.dst, weight from ofr a join cl on cl.src = a.node join ofr b on b.program = a.program and b.node = cl.dst where not coalesce(a.s > b.s, false) and (a.program, cl.src, cl.dst) not in (select (program, src, dst) from pre)),
kt as (select * from kn where (program, dst, src) not in (select (program, src, dst) from kn) qualify row_number() over (partition by program order by weight desc, src, dst) <= {KNOWLEDGE}),
net as (select program, 'prerequisite' as kind, src, dst, external, 1::bigint as weight from pre union all select program, 'knowledge', src, dst, false, weight from kt)"""
_LABEL = r"^(\d+)\s*[-–~～至]\s*(\d+)$"
_CUT = CUT.replace("(?U)", "").replace(r"[\s、", r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}、")
_PHR = f"dk as (select coalesce(nullif(course_code, ''), source, 'unknown') as course, text from documents), ph as (select course, unnest(flatten(list_transform(string_split_regex(text, '{_CUT}'), lambda x: regexp_extract_all(x, '{CANDIDATE}')))) as phrase from dk where text is not null), tf as (select course, phrase, count(*) as tf from ph where phrase not in {X.sql_list(NOISE)} and not regexp_matches(phrase, '{STRUCTURAL}') and not regexp_matches(phrase, '{FRAGMENTS}') group by all)"
SQL = {
    "o13_merge_catalog": f"with {_O} select code, arg_min(source_file, offering_id) as source_file, arg_min(course_category, offering_id) as course_category, count(distinct program_name)::int as n_programs, count(distinct (program_name, semester, coalesce(credits, ''), coalesce(instructor, ''))) filter (program_name is not null) as n_offerings from o where semester is not null group by code",
    "o14_plan_chunks": f"with {_O} select offering_id, sha256(concat_ws('|', source_file, code)) as chunk_id, concat_ws(chr(10), " + ", ".join(f"case when {clean_sql(c)} <> '' then '{n}：' || ({clean_sql(c)}) end" for c, n in (("program_name", "培养方案"), ("credits", "学分"), ("hours", "学时"), ("semester", "学期"), ("instructor", "教师"))) + ") as chunk from o",
    "o17_unique_keys": f"with {OFF}, {CAT} select label, key, count(*) as n from (select 'course as delivered' as label, course_code as key from course_catalog union all select 'offering as delivered', offering_id::varchar from course_offerings union all select 'course', course_code from cat union all select 'offering', offering_id::varchar from off union all select 'document', doc_id::varchar from documents) group by all having count(*) > 1 or key is null",
    "o20_safe_names": f"with {OFF}, f as (select distinct source_file from off where source_file is not null), b as (select source_file, regexp_replace(string_split_regex(source_file, '[/\\\\]')[-1], '[<>:\"|?*\\x00-\\x1f\\s]+', '_', 'g') as base from f) select source_file, substring(regexp_replace(base, '^[.]+', ''), 1, 150) as safe from b",
    "o19_inventory": f"with {OFF}, {SYL} select regexp_extract(f, '\\.([a-z]+)$', 1) as kind, regexp_extract(f, '^(\\d{{4}}-\\d)', 1) as term, count(*) as files from (select source_file as f from off union select source_file from syl) where f is not null group by all",
    "o69_latest_profile": f"with {SYL}, {CAT}, l as (select course_name, arg_max(entry_id, (coalesce(source_year, ''), entry_id)) as entry_id, arg_max(coalesce(source_year, '~'), (coalesce(source_year, ''), entry_id)) as y from syl where course_name is not null group by 1) select course_code, entry_id, coalesce(nullif(english_name, ''), nullif(y, '~')) as detail from cat left join l using (course_name)",
    "o70_conflicts": f"with {_O}, g as (select code, program_name, count(distinct nullif({clean_sql('credits')}, '')) as c, count(distinct nullif({clean_sql('hours')}, '')) as h from o where program_name is not null group by all) select code, program_name, concat_ws(',', case when c > 1 then 'credits' end, case when h > 1 then 'hours' end) as conflicts from g where c > 1 or h > 1",
    "o72_course_links": f"with {_GATE}, x as (select source % 50 as from_course, target % 50 as to_course, source || '>' || target as x from ve where requires and origin in ('llm', 'human') and confidence >= 0.3) select from_course, to_course, count(distinct x) as links, array_to_string(list_sort(list(distinct x))[1:3], ',') as examples from x where from_course <> to_course group by all",
    "o73_course_flows": f"with {_FLOW} select * from fl",
    "o116_top_flows": f"with {_FLOW}, al as (select distinct k from c where s <= 4) select * from fl where from_course in (select k from al) and to_course in (select k from al) order by n desc, from_course, to_course limit 30",
    "o94_reason": "with q as (select distinct * exclude (received_at) from query_log where course_code is not null and status is not null), g as (select course_code, status, count(*) as n from q group by all) select course_code, arg_min(status, (-n, -length(status), status)) as status from g group by 1",
    "o89_majority": f"with {_O}, g as (select code, course_category as c, count(*) as n, min(offering_id) as f from o where course_category is not null group by all) select code, arg_min(c, (-n, f)) as category from g group by 1",
    "o90_unique_values": f"with {_O}, g as (select code, {clean_sql('semester')} as s, min(offering_id) as f from o group by all) select code, string_agg(s, '|' order by f) as semesters from g where s <> '' group by 1",
    "o95_program_catalog": f"with {_O}, g as (select program_name, count(distinct code) as courses, min(program_type) as program_type from o where program_name is not null group by 1), x as (select coalesce(nullif(regexp_extract(trim(program_name), '^(.*?学院)', 1), ''), '未标注学院') as college, {core_sql(_TITLE)} as core, * from g) select *, row_number() over (partition by college, core order by coalesce(nullif(coalesce(list_position({PLAN_ORDER}, program_type), 0), 0), 99), program_type nulls first, program_name)::int as place from x",
    "o71_upsert": f"with {CAT}, {SYL}, c as (select lower(course_name) as name, min(course_code) as course_code, arg_min(coalesce(prerequisites, []), course_code) as a from cat where course_name is not null group by 1), s as (select lower(course_name) as name, min(entry_id) as entry_id, arg_min(coalesce(prerequisites, []), entry_id) as b from syl where course_name is not null group by 1) select name, course_code, entry_id, (len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) + (len(list_filter(list_concat(coalesce(a, []), coalesce(b, [])), lambda x: x is null)) > 0)::int)::int as prerequisites from c full join s using (name)",
    "o96_overview": f"with {_O}, {_LINK} select count(distinct o.code) as offered, count(distinct program_name) as plans, count(distinct program_type) as types, (select count(*) from nodes) as courses, (select count(*) from link) as prerequisites from o",
    "o97_major_courses": f"with {_O} select {core_sql(_TITLE)} as core, program_type, string_agg(distinct code, ',' order by code) as codes from o where program_name is not null group by all",
    "o99_summary": "with q as (select distinct * exclude (received_at) from query_log) select query_type, status, count(*) as n, grouping_id(query_type, status) as level from q group by rollup (query_type, status)",
    "o103_existence_details": f"with {_O}, v as (select code, program_name, unnest(['semester', 'category']) as field, unnest([{clean_sql('semester')}, {clean_sql('course_category')}]) as value from o where program_name is not null) select code, field, value, count(distinct program_name) as plans from v where value <> '' group by all",
    "o119_home_offering": f"with {_O} select code, arg_min(offering_id, (coalesce({column_sql('semester')}, 99), offering_id)) as offering_id from o group by 1",
    "o118_nodes": f"with {_O}, h as (select arg_min(offering_id, (coalesce({column_sql('semester')}, 99), offering_id)) as offering_id from o group by code), x as (select o.code, semester, {clean_sql('semester')} as t, {column_sql('semester')} as col, coalesce(course_category, '') || ' ' || coalesce(course_subcategory, '') as g from o join h using (offering_id)) select code, case when col is not null then '第 ' || col || ' 学期' when t = '' then '未标注' when regexp_matches(t, '{_LABEL}') then '第 ' || regexp_extract(t, '{_LABEL}', 1) || '–' || regexp_extract(t, '{_LABEL}', 2) || ' 学期（弹性）' else t end as label, case when contains(g, '公共') then 'public' when contains(g, '核心') then 'core' when contains(g, '实践') or contains(g, '实习') then 'practice' when contains(g, '基础') then 'foundation' when contains(g, '选修') then 'elective' when contains(g, '辅修') then 'minor' else 'other' end as grp from x",
    "o278_semesters": f"with {_O} select code, min({column_sql('semester')}) as semester from o group by 1",
    "o173_concept_semester": f"with {_O}, s as (select code, min({column_sql('semester')}) as semester from o group by 1), p as (select distinct program_name, code from o where program_name is not null) select program_name, case when count(*) = count(semester) then min(semester) end as semester from p join s using (code) group by 1",
    "o296_fixed_semester": f"with {_O}, s as (select code, {column_sql('semester')} as s from o), g as (select code, count(*) as n, count(s) as k, min(s) as s, max(s) as t from s group by 1) select code, s, row_number() over (partition by s order by code)::int as draw from g where n = k and s = t and s <= 8",
    "o185_program_graph": f"with {_NET} select * from net",
    "o185_stats": f"with {_NET}, n as (select program, count(distinct src) filter (external) as external, count(*) filter (kind = 'prerequisite') as prerequisites, count(*) filter (kind = 'knowledge') as knowledge from net group by 1), le as (select program, count(distinct node) as linked from (select program, dst as node from net where kind = 'prerequisite' union all select program, src from net where kind = 'prerequisite' and not external) group by 1), cs as (select program, count(*) as courses from ofr group by 1) select program, courses, coalesce(external, 0) as external, coalesce(prerequisites, 0) as prerequisites, coalesce(knowledge, 0) as knowledge, coalesce(linked, 0) as linked from cs left join n using (program) left join le using (program)",
    "o83_graph_records": f"with {_O}, {_LINK}, d as (select course_code from documents where course_code is not null), c as (select distinct course_code from course_catalog) select kind, count(*) as n from (select 'Course' as kind from c union all select 'Program' from (select distinct program_name from o where program_name is not null) union all select 'Document' from d union all select 'CONTAINS' from (select distinct program_name, code from o where program_name is not null and code in (select course_code from c)) union all select 'MENTIONS' from d where course_code in (select course_code from c) union all select 'PREREQUISITE_OF' from link) group by kind",
    "o16_replace_managed": "with n as (select doc_id, 'b2' as build from documents where doc_id % 10 <> 1), k as (select doc_id, 'manual' as build from documents where doc_id % 10 <> 0 and doc_id % 3 = 0 and doc_id not in (select doc_id from n)) select build, count(*) as n, sum(doc_id)::bigint as ids from (select * from n union all select * from k) group by 1",
    "o295_relation_items": f"with {_LINK}, e as (select code as a, parent as b from link), r as (select a, b, 1 as d from e union all select x.a, y.b, 2 from e x join e y on x.b = y.a union all select x.a, z.b, 3 from e x join e y on x.b = y.a join e z on y.b = z.a), m as (select a, b, min(d) as d from r where a <> b group by all) select case when d = 1 then 'direct' else 'indirect' end as relation, count(*) as n from m group by 1",
    "o6_forward_fill": "with r as (select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as o, case when l_linenumber % 3 = 1 then l_returnflag end as cat, case when l_linenumber % 2 = 0 then l_linestatus end as sub from lineitem), f as (select *, last_value(cat ignore nulls) over (partition by l_orderkey order by o rows unbounded preceding) as category, count(cat) over (partition by l_orderkey order by o rows unbounded preceding) as run from r) select l_orderkey, l_linenumber, l_partkey, category, last_value(sub ignore nulls) over (partition by l_orderkey, run order by o rows unbounded preceding) as subcategory from f",
    "o123_part_number": "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber)::int as part from lineitem",
    "o125_spread": f"with {OFF}, r as (select offering_id, program_name, row_number() over (partition by program_name order by offering_id) as r from off where program_name is not null) select offering_id, program_name from r order by r > 1, offering_id limit 40",
    "o236_quota": "with g as (select event_type, count(*) as n from events group by 1), q as (select *, (100 - count(*) over ()) * n / sum(n) over () as exact, count(*) over () as k from g), b as (select *, floor(exact) as base, row_number() over (order by exact - floor(exact) desc, event_type) as place from q) select event_type, (1 + base + (place <= (100 - k) - sum(base) over ())::int)::bigint as seats from b",
    "o143_noise": f"with {_PHR} select phrase as term, count(*) as n, length(phrase) < 2 or phrase in {X.sql_list(NOISE)} or regexp_matches(phrase, '{STRUCTURAL}') or regexp_matches(phrase, '{FRAGMENTS}') as noise from ph group by 1",
    "o86_phrases": f"with {_PHR} select * from tf",
    "o87_ranked_phrases": f"with {_PHR}, df as (select phrase, count(*) as df from tf group by 1), n as (select count(distinct course) as n from dk), s as (select course, phrase, tf * (ln(n / df) + 1) as score from tf join df using (phrase), n where n = 1 or df / n <= 0.5) select course, phrase, round(score, 6) as score, row_number() over (partition by course order by score desc, phrase)::int as rank from s qualify rank <= 40",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit()}
