"""Projections and predicates on records: placeholders, names, semesters, programmes, condition filters, comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvaspark.common import table
from sylvaspark.functions import text as X
from sylvaspark.plans.inputs import BLK, CAT, LOG, OFF, SYL, blocks, catalog, log, offerings, syllabi

OPERATORS = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: ~c.eqNullSafe(v), "$in": lambda c, v: c.isin(v), "$nin": lambda c, v: ~F.coalesce(c.isin(v), F.lit(False)), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def condition(column: str, test) -> Column:
    """One attribute against a scalar (equality) or an operator map; an unknown operator matches nothing, and null has no order."""
    if not isinstance(test, dict):
        return F.col(column).eqNullSafe(F.lit(test))
    out = F.lit(True)
    for op, value in test.items():
        made = OPERATORS[op](F.col(column), value) if op in OPERATORS else F.lit(False)
        out = out & F.coalesce(made, F.lit(False))
    return out


def where(tree: dict | None) -> Column:
    """A tree of $and, $or, $not and attribute conditions as one column, so that it reaches the scan. Empty is true."""
    out = F.lit(True)
    for key, value in (tree or {}).items():
        if key == "$and":
            part = F.lit(True)
            for t in value:
                part = part & where(t)
        elif key == "$or":
            part = F.lit(False)
            for t in value:
                part = part | where(t)
        elif key == "$not":
            part = ~where(value)
        else:
            part = condition(key, value)
        out = out & part
    return out


def loosely_equal(a: Column, b: Column) -> Column:
    """Equality of values as text; null equals only null."""
    return a.cast("string").eqNullSafe(b.cast("string"))


def values_differ(a: Column, b: Column) -> Column:
    """As numbers where both are, else as trimmed text."""
    x, y = X.number_or_null(a), X.number_or_null(b)
    return F.when(x.isNotNull() & y.isNotNull(), x != y).otherwise(X.strip(a) != X.strip(b))


def o31_flat_attributes(spark, sf_dir):
    """A null or empty attribute takes its fallback."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif("source_year", F.lit("")), F.date_format("ingested_at", "yyyy")).alias("year"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")).alias("lang"))


def o32_conditions(spark, sf_dir):
    """Every kind of attribute condition, counted."""
    d = table(spark, sf_dir, "documents")
    tests = {"eq": condition("lang", "zh"), "ne": condition("lang", {"$ne": "zh"}), "in": condition("source", {"$in": ["faq_export", "scan_ocr"]}), "nin": condition("lang", {"$nin": ["zh", "en"]}), "gt": condition("n_chars", {"$gt": 500}), "lte": condition("n_chars", {"$lte": 100}), "range": condition("n_chars", {"$gte": 100, "$lt": 200}), "unknown": condition("n_chars", {"$like": 1})}
    return d.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])


def o33_loose_equality(spark, sf_dir):
    """Declared hours and credits of an offering, equal as text."""
    o = offerings(spark, sf_dir)
    return o.select("offering_id", loosely_equal(F.col("credits"), F.col("theory_credits")).alias("same_credits"), loosely_equal(F.col("offering_id"), F.col("semester")).alias("id_is_semester"))


def o34_where_tree(spark, sf_dir):
    """A nested filter pushed to the scan."""
    tree = {"$and": [{"$or": [{"source": "faq_export"}, {"doc_kind": {"$in": ["list", "schedule"]}}]}, {"$not": {"lang": "en"}}], "n_chars": {"$gte": 50}}
    return table(spark, sf_dir, "documents").where(where(tree)).select("doc_id", "source", "doc_kind")


def o35_course_filter(spark, sf_dir):
    """Documents of one course within some sources."""
    return table(spark, sf_dir, "documents").where(where({"course_code": "PB1001", "source": {"$in": ["plan_archive", "course_wiki"]}})).select("doc_id")


def o36_is_missing(spark, sf_dir):
    """Placeholders of answers, letter case counts."""
    o = offerings(spark, sf_dir)
    return o.select("offering_id", X.is_missing(F.col("instructor")).alias("instructor"), X.is_missing(F.col("credits")).alias("credits"), X.is_missing(F.col("semester")).alias("semester"))


def o37_profile_missing(spark, sf_dir):
    """Placeholders of profiles, letter case does not count; an array is missing only when empty."""
    a = offerings(spark, sf_dir).select(F.lit("instructor").alias("field"), X.is_missing(F.col("instructor"), X.PROFILE_MISSING, True).alias("missing"))
    b = catalog(spark, sf_dir).select(F.lit("prerequisites").alias("field"), (F.coalesce(F.size("prerequisites"), F.lit(0)) <= 0).alias("missing"))
    return a.unionByName(b).groupBy("field", "missing").agg(F.count("*").alias("n"))


def o38_clean(spark, sf_dir):
    """Plan cells without placeholders."""
    return offerings(spark, sf_dir).select("offering_id", X.clean(F.col("hours")).alias("hours"), X.clean(F.col("credits")).alias("credits"))


def o39_names(spark, sf_dir):
    """Instructors as a list."""
    return offerings(spark, sf_dir).where("instructor is not null").select("offering_id", X.name_list(F.col("instructor")).alias("names"))


def o40_first_present(spark, sf_dir):
    """The first field that is no placeholder."""
    return offerings(spark, sf_dir).select("offering_id", X.first_present(F.col("credits"), F.col("theory_credits"), F.col("practice_credits")).alias("value"))


def o53_mask_titles(spark, sf_dir):
    """Questions with bracketed titles emptied."""
    return log(spark, sf_dir).select("query_id", F.regexp_replace("query", "《[^》]*》", "《》").alias("masked"))


def o59_clarify(spark, sf_dir):
    """Three answerable rewrites of a question; questions about teachers get their own."""
    name = F.coalesce(F.nullif(F.regexp_extract("query", "《([^《》]+)》", 1), F.lit("")), F.lit("课程名"))
    made = {k: F.concat(F.lit("《"), name, F.lit("》" + t)) for k, t in (("content", "的主要内容是什么？"), ("structure", "有哪些章节？"), ("assessment", "怎么考核？"), ("teacher", "的任课老师是谁？"))}
    about = F.col("query").rlike("老师|教师|任课|授课|负责人")
    return log(spark, sf_dir).where("query is not null").select("query_id", F.when(about, F.array(made["teacher"], made["content"], made["assessment"])).otherwise(F.array(made["content"], made["structure"], made["assessment"])).alias("rewrites"))


def o62_core_program(spark, sf_dir):
    """Core name and college of every plan."""
    o = offerings(spark, sf_dir)
    return o.select("program_name").where("program_name is not null").distinct().select("program_name", X.core_program(F.regexp_replace("program_name", "（[^（）]*）$", ""), PLAN_TYPES).alias("core"), X.college(F.col("program_name")).alias("college"))


# Plan types that end a plan's title.
PLAN_TYPES = ["主修专业类", "主修专业", "辅修专业", "辅修微专业", "微专业", "荣誉班", "大类"]


def o63_values_differ(spark, sf_dir):
    """Credits and theory credits that differ, as numbers or as text."""
    o = offerings(spark, sf_dir).where("credits is not null and theory_credits is not null")
    return o.select("offering_id", values_differ(F.col("credits"), F.col("theory_credits")).alias("differ"))


def o127_course_key(spark, sf_dir):
    """Typed course names as they are compared."""
    return syllabi(spark, sf_dir).select("course_name").distinct().select("course_name", X.course_key(F.col("course_name")).alias("key"))


def o148_chinese_number(spark, sf_dir):
    """Numerals of titles as integers."""
    n = F.regexp_extract("title", "([一二两三四五六七八九十百]+|[0-9]+)", 1)
    return blocks(spark, sf_dir).select("node_id", X.chinese_number(n).alias("n"))


def o149_chapter_number(spark, sf_dir):
    """Chapter numbers from titles."""
    return blocks(spark, sf_dir).select("node_id", X.chapter_number(F.col("title")).alias("chapter"))


def o150_semester(spark, sf_dir):
    """Semester column and label of every plan cell."""
    return offerings(spark, sf_dir).select("semester").distinct().select("semester", X.semester_column(F.col("semester")).alias("col"), X.semester_label(F.col("semester")).alias("label"))


def o151_semester_display(spark, sf_dir):
    """Semesters as years of study."""
    return offerings(spark, sf_dir).select("semester").where("semester is not null").distinct().select("semester", X.semester_display(F.col("semester")).alias("shown"))


def o152_course_group(spark, sf_dir):
    """Group of every category and subcategory."""
    return offerings(spark, sf_dir).groupBy("course_category", "course_subcategory").agg(F.count("*").alias("n")).select("course_category", "course_subcategory", X.course_group(F.col("course_category"), F.col("course_subcategory")).alias("grp"), "n")


def o157_text_hash(spark, sf_dir):
    """Hash of a text that white space and letter case don't change."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.text_hash(F.regexp_replace("text", "[^ -~一-鿿。，；：？！\\s]", "")).alias("hash"))


def o158_breadcrumb(spark, sf_dir):
    """Course and the last headings of a block."""
    b, c = blocks(spark, sf_dir), catalog(spark, sf_dir).select("course_code", "course_name")
    path = F.array("kind", "title")
    return b.join(c, "course_code", "left").select("node_id", F.concat(F.lit("【"), F.concat_ws(" | ", F.coalesce("course_name", "course_code"), F.array_join(F.slice(path, -2, 2), " > ")), F.lit("】")).alias("crumb"))


def o174_embedding_text(spark, sf_dir):
    """Block text with its breadcrumb in front, once."""
    b = blocks(spark, sf_dir).where("text is not null")
    crumb = F.concat(F.lit("【"), F.coalesce("title", F.lit("")), F.lit("】"))
    return b.select("node_id", F.when(F.col("text").startswith(crumb), F.col("text")).otherwise(F.concat(crumb, F.lit("\n"), F.col("text"))).alias("embed_text"))


def o175_concept_text(spark, sf_dir):
    """Course lines in front of a document's text."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.concat_ws("\n", F.concat(F.lit("course: "), F.col("course_code")), F.concat(F.lit("kind: "), F.col("doc_kind")), F.col("text")).alias("embed_text"))


def o280_description(spark, sf_dir):
    """Labelled text of a course, without fields that are missing."""
    c = catalog(spark, sf_dir)
    return c.select("course_code", F.concat_ws("; ", F.concat(F.lit("name: "), F.col("course_name")), F.when(X.clean(F.col("english_name")) != "", F.concat(F.lit("english: "), X.clean(F.col("english_name")))), F.concat(F.lit("source: "), F.col("source_file"))).alias("description"))


def o281_stable_id(spark, sf_dir):
    """Node ids that depend on label and key only."""
    return catalog(spark, sf_dir).select("course_code", X.stable_id(F.lit("Course"), F.col("course_code")).alias("node"))


def o195_node_id(spark, sf_dir):
    """Ids of document nodes from document and heading path."""
    return blocks(spark, sf_dir).select("node_id", F.concat(F.lit("n"), F.substring(F.sha1(F.concat_ws("|", "document_hash", "kind", "title")), 1, 15)).alias("made"))


def o282_properties(spark, sf_dir):
    """Nested values as JSON text, scalars as they are."""
    return catalog(spark, sf_dir).select("course_code", F.to_json(F.transform(F.coalesce("prerequisites", F.array().cast("array<string>")), lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", ""))).alias("prerequisites_json"))


def o145_prerequisite_list(spark, sf_dir):
    """Prerequisites without phrases that say there are none."""
    s = syllabi(spark, sf_dir).where("prerequisites is not null")
    parts = F.flatten(F.transform("prerequisites", lambda x: F.split(F.coalesce(x, F.lit("")), "[、,，;；/]")))
    kept = F.filter(F.transform(parts, X.strip), lambda x: ~F.lower(x).isin(["", "无", "暂无", "none", "-", "—", "无先修课程", "无先修要求"]))
    return s.select("entry_id", F.array_distinct(kept).alias("names"))


def o154_sources(spark, sf_dir):
    """Answers without a list of sources of their own, with the distinct source labels of their course, ten at most."""
    q = log(spark, sf_dir).where("answer is not null and course_code is not null")
    d = table(spark, sf_dir, "documents").where("course_code is not null").groupBy("course_code").agg(F.slice(F.array_sort(F.collect_set("source")), 1, 10).alias("labels"))
    return q.join(d, "course_code").select("query_id", F.concat(F.regexp_replace("answer", "(?s)\\n(来源|Sources)[:：].*$", ""), F.lit("\n来源："), F.array_join("labels", "、")).alias("shown"))


def o153_sentences(spark, sf_dir):
    """Claims of an answer, without headings and announcements."""
    q = log(spark, sf_dir).where("answer is not null")
    lines = q.select("query_id", F.posexplode(F.split("answer", "\n")).alias("line", "t"))
    parts = lines.select("query_id", "line", F.posexplode(F.regexp_extract_all("t", F.lit("([^。！？]+[。！？]?)"), 1)).alias("pos", "claim"))
    t = X.strip(F.col("claim"))
    return parts.select("query_id", "line", "pos", t.alias("claim")).where("claim <> '' and not claim rlike '^#' and not claim rlike '[:：]$'")


def o222_title_coverage(spark, sf_dir):
    """Share of a document's words that occur in its title line."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    head = F.split("text", "\n")[0]
    want, have = F.array_distinct(X.tokens(head)), F.array_distinct(X.tokens(F.col("text")))
    return d.select("doc_id", F.size(want).alias("in_title"), F.round(F.when(F.size(have) > 0, F.size(want) / F.size(have)).otherwise(0.0), 6).alias("share"))


_S = X.SPACE.replace("\\x0B", "\\v")


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def _missing(c: str, words: list[str], fold: bool = False) -> str:
    t = strip_sql(c)
    return f"({c} is null or {f'lower({t})' if fold else t} in {X.sql_list(words)})"


def clean_sql(c: str) -> str:
    return f"case when {_missing(c, X.PLAN_MISSING, True)} then '' else {strip_sql(c)} end"


def _num(c: str) -> str:
    t = strip_sql(c)
    return f"case when regexp_full_match({t}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') then ({t})::double end"


def key_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({strip_sql(f'coalesce({c}, {chr(39) * 2})')}), '转自\\s*doc', '', 'g'), '" + X.NAME_MARKS.replace("'", "''") + "', '', 'g')"


def column_sql(c: str) -> str:
    return f"(case when ({_num(c)}) = floor({_num(c)}) and ({_num(c)}) between 1 and 12 then ({_num(c)})::int end)"


_RANGE = r"^(\d+)\s*[-–~～至]\s*(\d+)$"
_DIGIT = "(case when {0} = '两' then 2 else instr('一二三四五六七八九', {0}) end)"


def cn_sql(c: str) -> str:
    l, r = f"regexp_extract({c}, '^([一二两三四五六七八九]?)十([一二三四五六七八九]?)$', 1)", f"regexp_extract({c}, '^([一二两三四五六七八九]?)十([一二三四五六七八九]?)$', 2)"
    return f"(case when regexp_full_match({c}, '\\d{{1,6}}') then {c}::int when regexp_full_match({c}, '[一二两三四五六七八九]') then {_DIGIT.format(c)} when {c} = '百' then 100 when regexp_full_match({c}, '[一二两三四五六七八九]?十[一二三四五六七八九]?') then (case when {l} = '' then 1 else {_DIGIT.format(l)} end) * 10 + (case when {r} = '' then 0 else {_DIGIT.format(r)} end) end)::int"


def year_sql(n: str) -> str:
    return f"substring('{X.NUMERALS}', ((({n}) + 1) // 2)::int + 1, 1)"


def core_sql(c: str) -> str:
    t = strip_sql(f"coalesce({c}, '')")
    for p in ("^.*学院", "^.*学校", r"^\d{4}\s*级"):
        t = f"regexp_replace({t}, '{p}', '')"
    words = "|".join([*sorted(PLAN_TYPES, key=lambda x: (-len(x), x)), "培养方案", "教学计划", "专业"])
    return f"trim(regexp_replace({t}, '^(.+?)((?:{words})+)$', '\\1'))"


_GROUP = "case when t like '%公共%' then 'public' when t like '%核心%' then 'core' when t like '%实践%' or t like '%实习%' then 'practice' when t like '%基础%' then 'foundation' when t like '%选修%' then 'elective' when t like '%辅修%' then 'minor' else 'other' end"
_R1, _R2 = f"try_cast(regexp_extract({strip_sql('semester')}, '{_RANGE}', 1) as int)", f"try_cast(regexp_extract({strip_sql('semester')}, '{_RANGE}', 2) as int)"

SQL = {
    "o31_flat_attributes": "select doc_id, coalesce(nullif(source_year, ''), strftime(ingested_at, '%Y')) as year, coalesce(nullif(lang, ''), 'und') as lang from documents",
    "o32_conditions": "select count(*) filter (lang = 'zh') as eq, count(*) filter (lang is distinct from 'zh') as ne, count(*) filter (source in ('faq_export', 'scan_ocr')) as \"in\", count(*) filter (lang is null or lang not in ('zh', 'en')) as nin, count(*) filter (n_chars > 500) as gt, count(*) filter (n_chars <= 100) as lte, count(*) filter (n_chars >= 100 and n_chars < 200) as range, 0::bigint as unknown from documents",
    "o33_loose_equality": f"with {OFF} select offering_id, credits is not distinct from theory_credits as same_credits, offering_id::varchar is not distinct from semester as id_is_semester from off",
    "o34_where_tree": "select doc_id, source, doc_kind from documents where (source is not distinct from 'faq_export' or coalesce(doc_kind in ('list', 'schedule'), false)) and lang is distinct from 'en' and coalesce(n_chars >= 50, false)",
    "o35_course_filter": "select doc_id from documents where course_code = 'PB1001' and source in ('plan_archive', 'course_wiki')",
    "o36_is_missing": f"with {OFF} select offering_id, {_missing('instructor', X.ANSWER_MISSING)} as instructor, {_missing('credits', X.ANSWER_MISSING)} as credits, {_missing('semester', X.ANSWER_MISSING)} as semester from off",
    "o37_profile_missing": f"with {OFF}, {CAT} select 'instructor' as field, {_missing('instructor', X.PROFILE_MISSING, True)} as missing, count(*) as n from off group by all union all select 'prerequisites', coalesce(len(prerequisites), 0) = 0, count(*) from cat group by all",
    "o38_clean": f"with {OFF} select offering_id, {clean_sql('hours')} as hours, {clean_sql('credits')} as credits from off",
    "o40_first_present": f"with {OFF} select offering_id, coalesce(" + ", ".join(f"case when not {_missing(c, X.ANSWER_MISSING)} then {c} end" for c in ("credits", "theory_credits", "practice_credits")) + ") as value from off",
    "o53_mask_titles": f"with {LOG} select query_id, regexp_replace(query, '《[^》]*》', '《》', 'g') as masked from lg",
    "o59_clarify": f"with {LOG}, n as (select query_id, query, coalesce(nullif(regexp_extract(query, '《([^《》]+)》', 1), ''), '课程名') as c from lg where query is not null) select query_id, case when regexp_matches(query, '老师|教师|任课|授课|负责人') then ['《' || c || '》的任课老师是谁？', '《' || c || '》的主要内容是什么？', '《' || c || '》怎么考核？'] else ['《' || c || '》的主要内容是什么？', '《' || c || '》有哪些章节？', '《' || c || '》怎么考核？'] end as rewrites from n",
    "o62_core_program": f"with {OFF} select distinct program_name, {core_sql("regexp_replace(program_name, '（[^（）]*）$', '')")} as core, coalesce(nullif(regexp_extract(trim(program_name), '^(.*?学院)', 1), ''), '未标注学院') as college from off where program_name is not null",
    "o63_values_differ": f"with {OFF} select offering_id, case when ({_num('credits')}) is not null and ({_num('theory_credits')}) is not null then ({_num('credits')}) <> ({_num('theory_credits')}) else {strip_sql('credits')} <> {strip_sql('theory_credits')} end as differ from off where credits is not null and theory_credits is not null",
    "o127_course_key": f"with {SYL} select distinct course_name, {key_sql('course_name')} as key from syl",
    "o148_chinese_number": f"with {BLK}, x as (select node_id, regexp_extract(title, '([一二两三四五六七八九十百]+|[0-9]+)', 1) as t from blk) select node_id, {cn_sql('t')} as n from x",
    "o149_chapter_number": f"with {BLK}, x as (select node_id, regexp_extract(title, '第\\s*([一二两三四五六七八九十百\\d]+)\\s*[章讲节周]', 1) as t from blk) select node_id, {cn_sql('t')} as chapter from x",
    "o150_semester": f"with {OFF}, s as (select distinct semester, {clean_sql('semester')} as t, {column_sql('semester')} as col from off) select semester, col, case when col is not null then '第 ' || col || ' 学期' when t = '' then '未标注' when regexp_matches(t, '{_RANGE}') then '第 ' || regexp_extract(t, '{_RANGE}', 1) || '–' || regexp_extract(t, '{_RANGE}', 2) || ' 学期（弹性）' else t end as label from s",
    "o151_semester_display": f"with {OFF}, s as (select distinct semester, {column_sql('semester')} as n, {_R1} as a, {_R2} as b from off where semester is not null) select semester, case when n is not null then '第 ' || n || ' 学期（大' || {year_sql('n')} || case when n % 2 = 1 then '上' else '下' end || '学期）' when a >= 1 and a <= b and b <= 12 then '第 ' || a || '–' || b || ' 学期均可修读（' || case when {year_sql('a')} = {year_sql('b')} then '大' || {year_sql('a')} else '大' || {year_sql('a')} || '至大' || {year_sql('b')} end || '）' else semester end as shown from s",
    "o152_course_group": f"with {OFF}, g as (select course_category, course_subcategory, coalesce(course_category, '') || ' ' || coalesce(course_subcategory, '') as t, count(*) as n from off group by all) select course_category, course_subcategory, {_GROUP} as grp, n from g",
    "o157_text_hash": "select doc_id, sha256(lower(regexp_replace(regexp_replace(text, '[^ -~一-鿿。，；：？！\\s]', '', 'g'), '\\s+', '', 'g'))) as hash from documents where text is not null",
    "o158_breadcrumb": f"with {BLK}, {CAT} select node_id, '【' || concat_ws(' | ', coalesce(course_name, b.course_code), concat_ws(' > ', kind, title)) || '】' as crumb from blk b left join cat c on b.course_code = c.course_code",
    "o174_embedding_text": f"with {BLK} select node_id, case when starts_with(text, '【' || coalesce(title, '') || '】') then text else '【' || coalesce(title, '') || '】' || chr(10) || text end as embed_text from blk where text is not null",
    "o175_concept_text": "select doc_id, concat_ws(chr(10), 'course: ' || course_code, 'kind: ' || doc_kind, text) as embed_text from documents where text is not null",
    "o280_description": f"with {CAT} select course_code, concat_ws('; ', 'name: ' || course_name, case when {clean_sql('english_name')} <> '' then 'english: ' || ({clean_sql('english_name')}) end, 'source: ' || source_file) as description from cat",
    "o281_stable_id": f"with {CAT} select course_code, substring(sha256('Course|' || course_code), 1, 24) as node from cat",
    "o195_node_id": f"with {BLK} select node_id, 'n' || substring(sha1(concat_ws('|', document_hash, kind, title)), 1, 15) as made from blk",
    "o282_properties": f"with {CAT} select course_code, to_json([regexp_replace(coalesce(x, ''), '[^A-Za-z0-9]', '', 'g') for x in coalesce(prerequisites, []::varchar[])])::varchar as prerequisites_json from cat",
    "o145_prerequisite_list": f"with {SYL}, e as (select entry_id, i, x from (select entry_id, generate_subscripts(prerequisites, 1) as i, unnest(prerequisites) as x from syl where prerequisites is not null)), p as (select entry_id, i, generate_subscripts(a, 1) as j, unnest(a) as v from (select entry_id, i, string_split_regex(coalesce(x, ''), '[、,，;；/]') as a from e)), k as (select entry_id, t, min((i, j)) as o from (select entry_id, i, j, {strip_sql('v')} as t from p) where lower(t) not in ('', '无', '暂无', 'none', '-', '—', '无先修课程', '无先修要求') group by all) select s.entry_id, coalesce(n, []) as names from (select entry_id from syl where prerequisites is not null) s left join (select entry_id, list(t order by o) as n from k group by 1) using (entry_id)",
    "o154_sources": f"with {LOG}, d as (select course_code, list_sort(list(distinct source))[1:10] as labels from documents where course_code is not null and source is not null group by 1) select query_id, regexp_replace(answer, '(?s)\\n(来源|Sources)[:：].*$', '') || chr(10) || '来源：' || array_to_string(labels, '、') as shown from lg join d using (course_code) where answer is not null",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit()}
