"""Document trees from lines and blocks: heading levels and paths, neighbours, outlines, chapters, parts of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaspark.common import Steps, row_rank, table
from sylvaspark.functions import text as X
from sylvaspark.operators.fields import clean_sql, cn_sql, strip_sql
from sylvaspark.plans.inputs import BLK, SYL, blocks

# What makes a line a heading, with its level, in order.
LEVELS = [(1, "^第[一二三四五六七八九十0-9]+(章|部分)"), (2, "^[一二三四五六七八九十]+、"), (3, "^（[一二三四五六七八九十]+）|^[0-9]+[.][0-9]+"), (4, "^[0-9]+[.、]")]
# Kinds of sections by words of their titles, in order.
SECTIONS = [("objectives", "目标|Objectives"), ("content", "讲授内容|教学内容|Content"), ("schedule", "周次|进度|安排|Schedule"), ("requirements", "要求|Requirements"), ("assessment", "考核|Assessment"), ("prerequisites", "先修|Prerequisites"), ("references", "书目|参考|Reading"), ("basic_info", "概况|信息|information")]
BUDGET, EXCERPT = 4200, 400


def heading_level(line: Column) -> Column:
    """Level by the first rule that matches; lines of 40 characters or more and sentences are no headings."""
    out = F.lit(None).cast("int")
    for n, p in reversed(LEVELS):
        out = F.when(line.rlike(p), n).otherwise(out)
    return F.when((F.length(line) < 40) & ~line.rlike("[。！？；.!?;]$"), out)


def section_type(title: Column) -> Column:
    out = F.lit("other")
    for name, p in reversed(SECTIONS):
        out = F.when(title.rlike(p), name).otherwise(out)
    return out


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): non-blank lines of each document, pos from 0 over all of them."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")


def heading_path(rows: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level", title: str = "line", deepest: int = 4) -> DataFrame:
    """Adds `path`, the open headings of each line: of every level the last heading, if no heading of a lower level came after it."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for n in range(1, deepest + 1):
        out = out.withColumn(f"_p{n}", F.max(F.when(F.col(level) == n, F.col(pos))).over(w)).withColumn(f"_t{n}", F.last(F.when(F.col(level) == n, F.col(title)), True).over(w))
    parts = []
    for n in range(1, deepest + 1):
        above = F.greatest(*[F.coalesce(f"_p{i}", F.lit(-1)) for i in range(1, n)], F.lit(-1)) if n > 1 else F.lit(-1)
        parts.append(F.when(F.col(f"_p{n}") > above, F.col(f"_t{n}")))
    return out.withColumn("path", F.array_compact(F.array(*parts))).drop(*[f"_{x}{n}" for n in range(1, deepest + 1) for x in "pt"])


def _lines(spark, sf_dir) -> DataFrame:
    l = lines(table(spark, sf_dir, "documents"))
    return l.withColumn("level", heading_level(F.col("line")))


def o42_heading_level(spark, sf_dir):
    """Level of every heading line."""
    return _lines(spark, sf_dir).where("level is not null").select("doc_id", "pos", "level")


def o43_single_level(spark, sf_dir):
    """The flat rule: numbered Chinese headings only, all of one level."""
    return lines(table(spark, sf_dir, "documents")).where("line rlike '^[一二三四五六七八九十]+、' and length(line) < 40").select("doc_id", "pos")


def o44_section_type(spark, sf_dir):
    """Kind of section of every heading."""
    return _lines(spark, sf_dir).where("level is not null").groupBy(section_type(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


def o41_heading_path(spark, sf_dir):
    """Open headings of every line."""
    return heading_path(_lines(spark, sf_dir)).select("doc_id", "pos", F.array_join("path", " > ").alias("path"))


def o194_doc_tree(spark, sf_dir):
    """Nodes of each document by heading path, with the lines and characters below each."""
    p = heading_path(_lines(spark, sf_dir)).where("size(path) > 0")
    up = p.select("doc_id", F.length("line").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_join(F.slice("path", 1, i), " > "))).alias("node"))
    return up.groupBy("doc_id", "node").agg(F.count("*").alias("lines"), F.sum("n").alias("chars"))


def o122_links(spark, sf_dir):
    """Previous and next line of every line."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return _lines(spark, sf_dir).select("doc_id", "pos", F.lag("pos").over(w).alias("before"), F.lead("pos").over(w).alias("after"))


def o121_neighbours(spark, sf_dir):
    """Lines up to two places away, as positions."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-2, 2)
    return _lines(spark, sf_dir).select("doc_id", "pos", F.array_join(F.transform(F.collect_list("pos").over(w), lambda x: x.cast("string")), ",").alias("near"))


def _blk(spark, sf_dir):
    return blocks(spark, sf_dir).withColumn("chapter", F.coalesce(F.col("chapter_no").cast("int"), X.chapter_number(F.col("title"))))


def o120_latest(spark, sf_dir):
    """The newest document of each course by year and term."""
    b = _blk(spark, sf_dir).where("course_code is not null")
    key = F.struct(F.coalesce(F.regexp_extract("source_year", r"^(\d+)", 1).try_cast("int"), F.lit(0)), F.coalesce(F.regexp_extract("source_year", r"^\d+-(\d+)", 1).try_cast("int"), F.lit(0)), F.col("document_hash"))
    return b.groupBy("course_code").agg(F.max_by("document_hash", key).alias("document_hash"))


def _latest_chapters(spark, sf_dir):
    return _blk(spark, sf_dir).where("kind = 'chapter'").join(o120_latest(spark, sf_dir), ["course_code", "document_hash"])


def o197_outline(spark, sf_dir):
    """Chapters of each course's latest document in order."""
    c = _latest_chapters(spark, sf_dir)
    return c.select("course_code", "node_id", row_rank(["course_code"], F.coalesce("chapter", F.lit(999)), F.col("node_id")).alias("place"), "title")


def o198_chapter(spark, sf_dir):
    """The third chapter of each course's latest document."""
    return _latest_chapters(spark, sf_dir).where("chapter = 3").groupBy("course_code").agg(F.min("node_id").alias("node_id"))


def o201_chapter_numbers(spark, sf_dir):
    """Chapter numbers of each course in order."""
    c = _latest_chapters(spark, sf_dir).where("chapter is not null")
    return c.groupBy("course_code").agg(F.array_join(F.transform(F.sort_array(F.collect_list("chapter")), lambda x: x.cast("string")), ",").alias("numbers"))


def o265_outline_answer(spark, sf_dir):
    """Outline of each course as text, with the number of chapters and hours."""
    o = _latest_chapters(spark, sf_dir).withColumn("place", row_rank(["course_code"], F.coalesce("chapter", F.lit(999)), F.col("node_id")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), "；")
    return o.groupBy("course_code").agg(text.alias("outline"), F.count("*").alias("chapters"), F.coalesce(F.sum("hours"), F.lit(0)).alias("hours"))


def o199_parent_block(spark, sf_dir):
    """Of each document the deepest node of each kind."""
    return _blk(spark, sf_dir).groupBy("document_hash", "kind").agg(F.max_by("node_id", F.struct(F.coalesce("level", F.lit(0)), "node_id")).alias("node_id"))


def o200_order_key(spark, sf_dir):
    """Reading order of each block's chunks; blocks without a course come first."""
    b = _blk(spark, sf_dir).select("node_id", F.coalesce("course_code", F.lit("")).alias("course"), F.posexplode("chunk_ids").alias("i", "chunk_id"))
    return b.groupBy("chunk_id").agg(F.min(F.struct("course", "node_id", "i")).alias("k")).select("chunk_id", "k.course", "k.i")


def o202_header_chunks(spark, sf_dir):
    """First chunk of the sections of each document."""
    return _blk(spark, sf_dir).where("kind = 'section' and size(chunk_ids) > 0").select("document_hash", "node_id", F.col("chunk_ids")[0].alias("header"))


def o203_coverage(spark, sf_dir):
    """Chapters of each course whose title none of its documents names, and the share that is covered."""
    c = _latest_chapters(spark, sf_dir).select("course_code", "node_id", X.strip(F.regexp_replace("title", "^第[一二三四五六七八九十0-9]+[章讲节周]", "")).alias("topic")).where("topic <> ''")
    d = table(spark, sf_dir, "documents").where("course_code is not null and text is not null").select("course_code", "text")
    # A text meets the topics of its course once, as a set (those of one latest document), and only its hits go on.
    topics = c.groupBy("course_code").agg(F.collect_set("topic").alias("topics"))
    hits = d.join(topics, "course_code").select("course_code", F.explode(F.filter("topics", lambda x: F.col("text").contains(x))).alias("topic")).distinct().withColumn("hit", F.lit(1))
    j = c.join(hits, ["course_code", "topic"], "left")
    return j.groupBy("course_code").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("covered"), F.count("*").alias("total"))


def o205_week(spark, sf_dir):
    """For every week that a document's blocks mention, the first chapter that does."""
    b = _blk(spark, sf_dir).where("text is not null").select("document_hash", "node_id", "chapter", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"第\s*([一二两三四五六七八九十百\d]+)\s*周"), 1))).alias("w"))
    b = b.withColumn("week", X.chinese_number(F.col("w"))).where("week is not null")
    return b.groupBy("document_hash", "week").agg(F.min_by("node_id", F.struct(F.coalesce("chapter", F.lit(999)), "node_id")).alias("node_id"))


def o146_basic_info(spark, sf_dir):
    """Labelled lines of documents as canonical fields: the first value of each field that is no placeholder."""
    l = lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.regexp_extract("line", r"^([^：:]{1,12})[：:]([^\n]+)\z", 1).alias("k"), F.regexp_extract("line", r"^([^：:]{1,12})[：:]([^\n]+)\z", 2).alias("v"))
    field = F.when(F.lower("k").isin("课程名称", "course"), "name").when(F.col("k").contains("学分"), "credits").when(F.col("k").contains("学时"), "hours").when(F.lower("k").isin("问", "q"), "question").when(F.lower("k").isin("答", "a"), "answer")
    f = l.select("doc_id", "pos", field.alias("field"), X.clean(F.col("v")).alias("value")).where("field is not null and value <> ''")
    return f.groupBy("doc_id", "field").agg(F.min_by("value", "pos").alias("value"))


def o147_profile(spark, sf_dir):
    """One row per document: its canonical fields, and the line that the name comes from."""
    i = o146_basic_info(spark, sf_dir)
    return i.groupBy("doc_id").agg(F.max(F.when(F.col("field") == "name", F.col("value"))).alias("name"), F.count("*").alias("fields"))


def o111_excerpt(spark, sf_dir):
    """Lines of each document that fit 400 characters, the first always taken, later ones skipped when they don't fit."""
    l = _lines(spark, sf_dir).where("level is null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.length("line").alias("n")))).alias("l"))
    start = F.struct(F.lit(0).alias("used"), F.slice("l", 1, 0).alias("kept"))

    def take(a, x):
        fits = (F.size(a["kept"]) == 0) | (a["used"] + x["n"] <= EXCERPT)
        return F.when(fits, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)

    k = l.select("doc_id", F.aggregate("l", start, take).alias("a"))
    return k.select("doc_id", "a.used", F.size("a.kept").alias("taken"))


def o112_evidence(spark, sf_dir):
    """Blocks of each course within 4,200 characters: sections first, then chapters in order; what does not fit is skipped, what follows is still tried."""
    b = _blk(spark, sf_dir).where("course_code is not null and text is not null and text <> ''")
    order = F.struct(F.when(F.col("kind") == "section", 0).when(F.col("kind") == "chapter", 1).otherwise(2).alias("k"), F.coalesce("chapter", F.lit(999)).alias("c"), F.col("node_id"), F.length("text").alias("n"))
    g = b.groupBy("course_code").agg(F.array_sort(F.collect_list(order)).alias("l"))

    def take(a, x):
        return F.when(a["used"] + x["n"] <= BUDGET, F.struct((a["used"] + x["n"]).alias("used"), (a["taken"] + 1).alias("taken"))).otherwise(a)

    return g.select("course_code", F.aggregate("l", F.struct(F.lit(0).alias("used"), F.lit(0).alias("taken")), take).alias("a")).select("course_code", "a.used", "a.taken")


def o113_order(spark, sf_dir):
    """Place of each block in the order in which evidence is read."""
    b = _blk(spark, sf_dir)
    kind = F.when(F.col("kind") == "section", 0).when(F.col("kind") == "schedule", 1).otherwise(2)
    return b.select("document_hash", "node_id", row_rank(["document_hash"], kind, F.coalesce("chapter", F.lit(999)), F.col("node_id")).alias("place"))


def o114_select(spark, sf_dir):
    """The first ten blocks of each course; a schedule takes the last place if none is among them."""
    b = _blk(spark, sf_dir).where("course_code is not null").withColumn("r", row_rank(["course_code"], F.col("node_id")))
    sched = b.where("kind = 'schedule'").groupBy("course_code").agg(F.min(F.struct("r", "node_id")).alias("s"))
    t = b.where("r <= 10").join(sched, "course_code", "left")
    swap = (F.col("r") == 10) & (F.col("s.r") > 10)
    return t.select("course_code", "r", F.when(swap, F.col("s.node_id")).otherwise(F.col("node_id")).alias("node_id"))


def o263_citations(spark, sf_dir):
    """Distinct sources behind the blocks of each course, in order."""
    b = _blk(spark, sf_dir).where("course_code is not null")
    c = b.groupBy("course_code", "source_year", "kind").agg(F.min("node_id").alias("first"))
    return c.select("course_code", "source_year", "kind", row_rank(["course_code"], F.col("first")).alias("place"))


def o155_fallback_answer(spark, sf_dir):
    """Bullets of the sections of each course, at most 140 characters of each and three sections."""
    b = _blk(spark, sf_dir).where("course_code is not null and text is not null and text <> ''")
    one = b.groupBy("course_code", "kind").agg(F.min_by("text", "node_id").alias("t"), F.min("node_id").alias("n"))
    r = one.withColumn("r", row_rank(["course_code"], F.col("n"))).where("r <= 3")
    return r.groupBy("course_code").agg(F.sum(F.length(F.substring("t", 1, 140))).alias("chars"), F.count("*").alias("bullets"))


def o284_schedule_rows(spark, sf_dir):
    """Weekly rows of schedules: week and topic."""
    l = lines(table(spark, sf_dir, "documents").where("doc_kind = 'schedule'"))
    p = r"^第([0-9]{1,3})周[\t ]*([^\n]*)\z"
    return l.select("doc_id", "pos", F.regexp_extract("line", p, 1).try_cast("int").alias("week"), F.regexp_extract("line", p, 2).alias("topic")).where("week is not null")


def o285_explicit_prerequisites(spark, sf_dir):
    """Names on labelled prerequisite lines, of documents and of the entries of syllabi set as such lines (doc_id below 0)."""
    from sylvaspark.plans.inputs import syllabi

    l = lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", "line")
    e = syllabi(spark, sf_dir).where("size(prerequisites) > 0").select((-1 - F.col("entry_id")).alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.when(F.col("entry_id") % 2 == 0, "先修课程：").otherwise("Prerequisite:"), F.array_join("prerequisites", "、")).alias("line"))
    said = l.unionByName(e).select("doc_id", "pos", F.regexp_extract("line", r"^(?:先修课程|先修|Prerequisites?)[：:]([^\n]+)", 1).alias("names")).where("names <> ''")
    return said.select("doc_id", "pos", F.explode(F.filter(F.transform(F.split("names", "、"), X.strip), lambda x: x != "")).alias("name"))


def o84_concept_evidence(spark, sf_dir):
    """For each block's concept (its title without the number) the first statement that holds it: of its own text, else of another block of the document, else of a document of its course; with the tier it comes from."""
    b = blocks(spark, sf_dir).where("title is not null").select("node_id", "document_hash", "course_code", "text", F.regexp_replace("title", r"^第[一二三四五六七八九十0-9]+[章讲节周]\s*", "").alias("term")).where("term <> ''")
    b = Steps(spark).write(b)
    here = lambda d, tier, at: d.where(F.col("t").contains(F.col("term"))).select("node_id", "term", F.lit(tier).alias("tier"), at.cast("string").alias("at"), F.posexplode(F.regexp_extract_all("t", F.lit(r"([^。！？\n]+)"), 1)).alias("pos", "s")).where(F.col("s").contains(F.col("term"))).groupBy("node_id").agg(F.min_by(F.struct("tier", "s"), F.struct("tier", "at", "pos")).alias("e"))
    own = here(b.withColumn("t", F.col("text")), 1, F.col("node_id"))
    left = Steps(spark).write(b.join(own, "node_id", "left_anti").select("node_id", "document_hash", "course_code", "term"))
    near = here(left.join(b.select("document_hash", F.col("node_id").alias("other"), F.col("text").alias("t")), "document_hash").where("other <> node_id"), 2, F.col("other"))
    last = Steps(spark).write(left.join(near, "node_id", "left_anti").where("course_code is not null"))
    # The terms of one course are looked for together, so a text meets the different terms of its course, not every block.
    d = table(spark, sf_dir, "documents").where("course_code is not null and text is not null").select("course_code", "doc_id", F.col("text").alias("t"))
    terms = last.groupBy("course_code").agg(F.collect_set("term").alias("terms"))
    hit = d.join(terms, "course_code").withColumn("term", F.explode(F.filter("terms", lambda x: F.col("t").contains(x)))).select("course_code", "term", "doc_id", F.get(F.filter(F.regexp_extract_all("t", F.lit(r"([^。！？\n]+)"), 1), lambda x: x.contains(F.col("term"))), F.lit(0)).alias("s")).where("s is not null").groupBy("course_code", "term").agg(F.min_by("s", "doc_id").alias("s"))
    far = last.join(hit, ["course_code", "term"]).select("node_id", F.struct(F.lit(3).alias("tier"), "s").alias("e"))
    return own.unionByName(near).unionByName(far).select("node_id", "e.tier", F.col("e.s").alias("sentence"))


_LINES = "ln as (select doc_id, (generate_subscripts(a, 1) - 1)::int as pos, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null{0}))"
_LV = "case when length(line) < 40 and not regexp_matches(line, '[。！？；.!?;]$') then case " + " ".join(f"when regexp_matches(line, '{p}') then {n}" for n, p in LEVELS) + " end end"
_L = _LINES.format("") + f", l as (select *, {_LV} as level from ln where trim(line, ' ') <> '')"
_A = _LINES.format("") + ", l as (select * from ln where trim(line, ' ') <> '')"
_W = "over (partition by doc_id order by pos rows unbounded preceding)"
_PATH = f"{_L}, x as (select *, " + ", ".join(f"max(case when level = {n} then pos end) {_W} as p{n}, last_value(case when level = {n} then line end ignore nulls) {_W} as t{n}" for n in (1, 2, 3, 4)) + " from l), pa as (select doc_id, pos, line, [z for z in [case when p1 > -1 then t1 end, case when p2 > coalesce(p1, -1) then t2 end, case when p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) then t3 end, case when p4 > greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1)) then t4 end] if z is not null] as path from x)"
_NUM = cn_sql("regexp_extract(title, '第\\s*([一二两三四五六七八九十百\\d]+)\\s*[章讲节周]', 1)")
_B = f"{BLK}, b as (select *, coalesce(chapter_no::int, {_NUM}) as chapter from blk)"
_LAT = f"{_B}, la as (select course_code, arg_max(document_hash, (coalesce(try_cast(regexp_extract(source_year, '^(\\d+)', 1) as int), 0), coalesce(try_cast(regexp_extract(source_year, '^\\d+-(\\d+)', 1) as int), 0), document_hash)) as document_hash from b where course_code is not null group by 1), ch as (select b.* from b join la using (course_code, document_hash) where kind = 'chapter')"
_PAT = r"'^([^：:]{1,12})[：:]([^\n]+)\z'"
_INFO = f"{_A}, kv as (select doc_id, pos, regexp_extract(line, {_PAT}, 1) as k, regexp_extract(line, {_PAT}, 2) as v from l), fl as (select doc_id, pos, case when lower(k) in ('课程名称', 'course') then 'name' when contains(k, '学分') then 'credits' when contains(k, '学时') then 'hours' when lower(k) in ('问', 'q') then 'question' when lower(k) in ('答', 'a') then 'answer' end as field, {clean_sql('v')} as value from kv), bi as (select doc_id, field, arg_min(value, pos) as value from fl where field is not null and value <> '' group by all)"
SQL = {
    "o42_heading_level": f"with {_L} select doc_id, pos, level from l where level is not null",
    "o43_single_level": f"with {_A} select doc_id, pos from l where regexp_matches(line, '^[一二三四五六七八九十]+、') and length(line) < 40",
    "o44_section_type": f"with {_L} select case " + " ".join(f"when regexp_matches(line, '{p}') then '{n}'" for n, p in SECTIONS) + " else 'other' end as kind, count(*) as n from l where level is not null group by 1",
    "o41_heading_path": f"with {_PATH} select doc_id, pos, array_to_string(path, ' > ') as path from pa",
    "o194_doc_tree": f"with {_PATH}, u as (select doc_id, length(line) as n, array_to_string(path[1:i], ' > ') as node from pa, range(1, 5) r(i) where i <= len(path)) select doc_id, node, count(*) as lines, sum(n)::bigint as chars from u group by all",
    "o122_links": f"with {_L} select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before, lead(pos) over (partition by doc_id order by pos) as after from l",
    "o121_neighbours": f"with {_L} select doc_id, pos, array_to_string(list(pos) over (partition by doc_id order by pos rows between 2 preceding and 2 following), ',') as near from l",
    "o120_latest": f"with {_LAT} select * from la",
    "o197_outline": f"with {_LAT} select course_code, node_id, row_number() over (partition by course_code order by coalesce(chapter, 999), node_id)::int as place, title from ch",
    "o198_chapter": f"with {_LAT} select course_code, min(node_id) as node_id from ch where chapter = 3 group by 1",
    "o201_chapter_numbers": f"with {_LAT} select course_code, string_agg(chapter::varchar, ',' order by chapter) as numbers from ch where chapter is not null group by 1",
    "o265_outline_answer": f"with {_LAT} select course_code, string_agg(title, '；' order by coalesce(chapter, 999), node_id) as outline, count(*) as chapters, coalesce(sum(hours), 0)::bigint as hours from ch group by 1",
    "o199_parent_block": f"with {_B} select document_hash, kind, arg_max(node_id, (coalesce(level, 0), node_id)) as node_id from b group by all",
    "o200_order_key": f"with {_B}, x as (select node_id, coalesce(course_code, '') as course, (generate_subscripts(chunk_ids, 1) - 1)::int as i, unnest(chunk_ids) as chunk_id from b) select chunk_id, arg_min(course, (course, node_id, i)) as course, arg_min(i, (course, node_id, i)) as i from x group by 1",
    "o202_header_chunks": f"with {_B} select document_hash, node_id, chunk_ids[1] as header from b where kind = 'section' and len(chunk_ids) > 0",
    "o203_coverage": f"with {_LAT}, c as (select course_code, node_id, trim(regexp_replace(title, '^第[一二三四五六七八九十0-9]+[章讲节周]', '')) as topic from ch), j as (select c.course_code, node_id, max(coalesce(contains(text, topic), false)::int) as hit from c left join (select course_code, text from documents where course_code is not null and text is not null) d using (course_code) where topic <> '' group by all) select course_code, sum(hit)::bigint as covered, count(*) as total from j group by 1",
    "o205_week": f"with {_B}, wk as (select document_hash, node_id, chapter, unnest(list_distinct(regexp_extract_all(text, '第\\s*([一二两三四五六七八九十百\\d]+)\\s*周', 1))) as w from b where text is not null), nw as (select *, {cn_sql('w')} as week from wk) select document_hash, week, arg_min(node_id, (coalesce(chapter, 999), node_id)) as node_id from nw where week is not null group by all",
    "o146_basic_info": f"with {_INFO} select * from bi",
    "o147_profile": f"with {_INFO} select doc_id, max(value) filter (field = 'name') as name, count(*) as fields from bi group by 1",
    "o113_order": f"with {_B} select document_hash, node_id, row_number() over (partition by document_hash order by case kind when 'section' then 0 when 'schedule' then 1 else 2 end, coalesce(chapter, 999), node_id)::int as place from b",
    "o114_select": f"with {_B}, r as (select *, row_number() over (partition by course_code order by node_id)::int as r from b where course_code is not null), s as (select course_code, min(r) as sr, arg_min(node_id, r) as sn from r where kind = 'schedule' group by 1) select course_code, r, case when r = 10 and sr > 10 then sn else node_id end as node_id from r left join s using (course_code) where r <= 10",
    "o263_citations": f"with {_B}, c as (select course_code, source_year, kind, min(node_id) as f from b where course_code is not null group by all) select course_code, source_year, kind, row_number() over (partition by course_code order by f)::int as place from c",
    "o155_fallback_answer": f"with {_B}, o as (select course_code, kind, arg_min(text, node_id) as t, min(node_id) as n from b where course_code is not null and text is not null and text <> '' group by all), r as (select *, row_number() over (partition by course_code order by n) as r from o qualify r <= 3) select course_code, sum(length(substring(t, 1, 140)))::bigint as chars, count(*) as bullets from r group by 1",
    "o285_explicit_prerequisites": f"with {_A}, {SYL}, ll as (select doc_id, pos, line from l union all select -1 - entry_id, 0, (case when entry_id % 2 = 0 then '先修课程：' else 'Prerequisite:' end) || array_to_string(prerequisites, '、') from syl where len(prerequisites) > 0), sd as (select doc_id, pos, regexp_extract(line, '^(?:先修课程|先修|Prerequisites?)[：:]([^\\n]+)', 1) as names from ll), sp as (select doc_id, pos, unnest(string_split(names, '、')) as raw from sd where names <> '') select doc_id, pos, {strip_sql('raw')} as name from sp where {strip_sql('raw')} <> ''",
    "o84_concept_evidence": f"with {BLK}, b as (select node_id, document_hash, course_code, text, regexp_replace(title, '^第[一二三四五六七八九十0-9]+[章讲节周]\\s*', '') as term from blk where title is not null), c as (select b.node_id, term, 1 as tier, node_id as wh, text as t from b where term <> '' and contains(text, term) union all select b.node_id, b.term, 2, o.node_id, o.text from b join b o using (document_hash) where b.term <> '' and b.node_id <> o.node_id and contains(o.text, b.term) union all select b.node_id, term, 3, lpad(doc_id::varchar, 12, '0'), d.text from b join documents d using (course_code) where term <> '' and contains(d.text, term)), s as (select node_id, term, tier, wh, generate_subscripts(l, 1) as pos, unnest(l) as s from (select *, regexp_extract_all(t, '([^。！？\\n]+)', 1) as l from c)), f as (select node_id, arg_min((tier, s), (tier, wh, pos)) as e from s where contains(s, term) group by 1) select node_id, e[1] as tier, e[2] as sentence from f",
    "o91_occurrences": f"with {_B}, c as (select *, regexp_replace(title, '^第[一二三四五六七八九十0-9]+[章讲节周]\\s*', '') as concept from b where title is not null and course_code is not null) select concept, course_code, chapter, count(*) as n, arg_min(text, node_id) filter (trim(text, ' ') <> '') as evidence, arg_min(chunk_ids[1], node_id) filter (len(chunk_ids) > 0) as chunk_id from c where concept <> '' group by all",
    "o284_schedule_rows": "with " + _LINES.format(" and doc_kind = 'schedule'") + ", x as (select doc_id, pos, try_cast(regexp_extract(line, '^第([0-9]{1,3})周[\\t ]*([^\\n]*)\\z', 1) as int) as week, regexp_extract(line, '^第([0-9]{1,3})周[\\t ]*([^\\n]*)\\z', 2) as topic from ln where trim(line, ' ') <> '') select * from x where week is not null",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit()}
