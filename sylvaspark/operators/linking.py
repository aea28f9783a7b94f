"""Questions to courses, intents and routes: mention linking, aliases, gates, intent labels, offering choice, catalogue answers.

A batch of questions is a table; every step adds columns or joins by query id. Mentions are found in one pass over the question, so no question meets every course."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaspark.common import Steps, join_lookup, row_rank, table
from sylvaspark.functions import text as X
from sylvaspark.operators.fields import PLAN_TYPES, clean_sql, column_sql, core_sql, key_sql
from sylvaspark.plans.inputs import CAT, LOG, OFF, SYL, catalog, log, offerings, syllabi

# What asks for each intent, in the order in which intents win.
DEPENDENCY = [r"(为什么|为何).{0,4}(学|需要|先修|前置|依赖|前提|先上)", r"(依赖|先修|前置|前提|基础).{0,4}(什么|哪些|哪个)", r"(需要|需|要求|具备).{0,4}(什么|哪些|哪个).{0,2}(基础|前提|先修|前置|知识)", r"(课程|概念|知识).{0,4}(顺序|路径|依赖|关联)", r"(先学|后学|前置课程|先修课|预修课|前导课)", r"(之前|以前).{0,4}(学|修)(什么|哪些)", r"(有什么|有哪些).{0,4}(依赖|联系|关系|关联)", r"(有关系|有联系|有关联)吗|有没有(关系|联系|关联)", r"(怎么|如何).{0,4}(选修|选课|规划|安排)"]
ASSESSMENT = r"怎么考核|如何考核|怎么考试|考核形式|考核办法|考核方式|怎么考|怎么评"
UNRECORDED = [("上课地点/教室", r"上课地点|上课教室|教室|在哪(?:里|儿)?上课|哪里上课"), ("考试具体日期/时间", r"(?:期末|期中|课程|结课)?考试.{0,8}(?:具体)?(?:日期|时间|哪天|哪一天|什么时候|何时|几号)|(?:具体)?(?:日期|时间).{0,4}(?:期末|期中|课程)?考试|(?:什么时候|何时|哪天|哪一天|几号)(?:期末|期中)?考试"), ("历年成绩/平均分/及格率", r"(?:历年|往年|去年|往届|上一届|上一学年).{0,8}(?:成绩|平均分|及格率)|平均分|及格率"), ("选课人数", r"选课人数|多少人选(?:这|该|这门)?课|选这门课的有多少人")]
FACT = [r"(学分|学时|开课学期|考核方式|任课教师|课程负责人|谁负责|负责人|教材|上课地点|教室)", r"(课程代码|课程编号|课号)", r"(几学分|多少学时|哪个老师|谁教)", r"(老师是谁|哪位老师|主讲教师|授课教师|任课老师|授课老师|主讲老师)", r"(必修|选修|任选|公选|通识)", r"(期末考试|期中|平时成绩|考核|评分).{0,4}(方式|办法|比例|占比)", ASSESSMENT, r"(第几学期|什么学期|哪个学期|哪一学期|几年级|大几|哪一年|哪年|什么时候(?:开|上|学|修)|何时开|开设时间|开课时间).{0,3}(开|上|学|修|开课)?", *[p for _, p in UNRECORDED]]
CATALOG = [r"(培养方案|课程设置|课程体系)", r"(专业|主修|辅修).{0,8}(核心课|核心课程|基础课|必修课|选修课|课程)"]
STRUCTURE = [r"第\s*[一二三四五六七八九十百0-9]+\s*(章|节|讲|周|部分|单元|模块)", r"(有|共|分)(几|多少)(章|讲|部分|个单元|个模块)", r"(章节|目录(?!学)|大纲结构|教学进度|教学安排|课程安排|进度安排)", r"(每周|哪一?周|第几周).{0,6}(学|讲|上)"]
CONTENT = [r"(主要讲|主要学习|(?<!先)学什么|讲什么|内容|介绍|包括)"]
_NAME = r"(?![哪什几多这那该本此怎如谁])(?!(?:专业)?(?:选修|必修|核心|基础|先修|前置|通识|公选|任选|实践|相关|其他|别的)(?:课|$))([^，。？?！!,；;\s]{1,20}?)"
_TAIL, _END = r"(?:这(?:一)?门|这个)?课(?:程)?", r"(?=[，。？?！!,；;\s]|$)"
_ASKED = rf"(?:存在吗|存不存在|存在不|有吗|开吗|开不开|开没开|是否开设){_END}"
EXISTENCE = [rf"(?<![所拥具含享还])(?:有(?:没有|无)|是否有|是否开设){_NAME}{_TAIL}(?:吗|么|嘛)?{_END}", rf"(?<![所拥具含享还])有{_NAME}{_TAIL}(?:吗|么|嘛|没有|不){_END}", rf"(?:开不开|开没开|有没有开){_NAME}(?:这(?:一)?门)?(?:课程|课)?{_END}", rf"开(?:设)?了{_NAME}{_TAIL}(?:吗|么|嘛){_END}", rf"{_NAME}(?:这(?:一)?门课(?:程)?|课程|课)?{_ASKED}"]
#: What a text must hold to match a pattern that tries a name at every place; far cheaper to look for.
NEEDED = {EXISTENCE[4]: _ASKED}
INTENTS = [("dependency", DEPENDENCY), ("existence", EXISTENCE), ("catalog", CATALOG), ("fact", FACT), ("structure", STRUCTURE), ("content", CONTENT)]
PREREQUISITE_CUE = r"(先|之前|以前).{0,4}(学|修)"
# Pairs of intents that are answered together; confidence under which one intent among several is not trusted.
MERGED = ["fact+dependency", "dependency+fact", "content+dependency", "dependency+content", "catalog+dependency", "dependency+catalog", "structure+dependency", "dependency+structure"]
LOW_CONFIDENCE = 0.34
SIMILAR, CLARIFY = 0.6, 3


def hits(q: Column, patterns: list[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + q.rlike(p).cast("int")
    return out


def classify(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds intent, labels and confidence: an intent's hits are its matching patterns, the first matching intent wins, its share of all hits is the confidence; without a match the intent is hybrid. Bracketed titles don't count. What asks for prerequisites is no question of content."""
    q = F.regexp_replace(F.lower(X.strip(F.coalesce(F.col(query), F.lit("")))), "《[^》]*》", "《》")
    t = df.withColumn("_q", q)
    counts = {name: hits(F.col("_q"), p) for name, p in INTENTS}
    free = hits(F.regexp_replace("_q", PREREQUISITE_CUE, " "), CONTENT) > 0
    t = t.withColumns({f"_{n}": c for n, c in counts.items()})
    t = t.withColumn("_content", F.when((F.col("_dependency") > 0) & ~free, 0).otherwise(F.col("_content")))
    labels = F.array_compact(F.array(*[F.when(F.col(f"_{n}") > 0, F.lit(n)) for n, _ in INTENTS]))
    t = t.withColumn("labels", labels)
    total = sum((F.col(f"_{n}") for n, _ in INTENTS), F.lit(0))
    best = F.coalesce(*[F.when(F.col(f"_{n}") > 0, F.col(f"_{n}")) for n, _ in INTENTS], F.lit(0))
    out = t.withColumn("intent", F.when(F.size("labels") > 0, F.col("labels")[0]).otherwise("hybrid")).withColumn("confidence", F.when(total > 0, best / total).otherwise(0.0))
    return out.withColumn("labels", F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit("hybrid")))).drop("_q", *[f"_{n}" for n, _ in INTENTS])


#: Names that are sent to every task as one automaton; longer lists are met by a join on the substrings of the questions.
AUTOMATON = 500_000


def _found_by_automaton(q: DataFrame, names: list) -> DataFrame:
    import ahocorasick

    shared = q.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ahocorasick.Automaton()
        for name, code, rank in shared.value:
            found.add_word(name, (name, code, rank))
        if len(found):
            found.make_automaton()
        for b in batches:
            rows = [(i, code, name, end - len(name) + 2, rank) for i, t in zip(b["query_id"], b["q"]) for end, (name, code, rank) in (found.iter(t) if len(found) else ())]
            yield pd.DataFrame(rows, columns=["query_id", "code", "name", "start", "rank"])

    kinds = dict(q.dtypes)
    return q.mapInPandas(run, f"query_id {kinds['query_id']}, code string, name string, start int, rank int")


def _found_by_join(q: DataFrame, names: DataFrame) -> DataFrame:
    sizes = [r[0] for r in names.select(F.length("name").alias("n")).distinct().collect()]  # one row per length in use
    spans = F.flatten(F.transform(F.array(*map(F.lit, sorted(sizes))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("q") - n + 1, F.lit(1))), lambda i: F.struct(i.alias("start"), F.substring(F.col("q"), i, n).alias("name"))))) if sizes else F.array().cast("array<struct<start:int,name:string>>")
    left = Steps(q.sparkSession).write(q.select("query_id", F.explode(spans).alias("s")).select("query_id", "s.*").distinct())
    return join_lookup(left, names, "name", "inner").select("query_id", "code", "name", "start", "rank")


def mentions(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, code, name, start): names that a question mentions, longest first, on spans that no longer name claims.

    `names`: (name, code, rank) with unique names of any length, none empty. The claims of one question are settled in order over its own few candidates."""
    q = queries.where("query is not null").select("query_id", F.lower("query").alias("q"))
    names = names.where("name is not null and name <> ''").select("name", F.col("code").cast("string").alias("code"), F.col("rank").cast("int").alias("rank"))
    few = names.limit(AUTOMATON + 1).collect()
    cand = _found_by_automaton(q, [tuple(r) for r in few]) if len(few) <= AUTOMATON else _found_by_join(q, names)
    ordered = cand.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("k"), "rank", "code", "start", "name"))).alias("c"))
    free = lambda a, x: ~F.exists(a, lambda y: (y["start"] < x["start"] + F.length(x["name"])) & (x["start"] < y["start"] + F.length(y["name"])) | (y["code"] == x["code"]))
    picked = F.aggregate("c", F.slice("c", 1, 0), lambda a, x: F.when(free(a, x), F.concat(a, F.array(x))).otherwise(a))
    return ordered.select("query_id", F.explode(picked).alias("m")).select("query_id", "m.code", "m.name", "m.start")


def course_names(courses: DataFrame) -> DataFrame:
    """(name, code, rank): lower-case names and codes; of courses with one name the first by code."""
    n = courses.select(F.explode(F.array("course_name", "course_code")).alias("name"), F.col("course_code").alias("code")).select(F.lower("name").alias("name"), "code").where("name is not null and length(name) > 1")
    return n.groupBy("name").agg(F.min("code").alias("code")).withColumn("rank", F.lit(0))


def alias_index(courses: DataFrame) -> DataFrame:
    """(key, course_code) of names, English names and codes as they are compared."""
    v = courses.select("course_code", F.explode(F.array("course_code", "course_name", "english_name")).alias("v"))
    return v.select(X.course_key(F.col("v")).alias("key"), "course_code").where("key <> ''").distinct()


def o48_alias_index(spark, sf_dir):
    """Courses of every alias."""
    return alias_index(catalog(spark, sf_dir)).groupBy("key").agg(F.array_sort(F.collect_set("course_code")).alias("codes"))


def o46_links(spark, sf_dir):
    """Courses that a question mentions, in order of position (also the source of the best link)."""
    return mentions(log(spark, sf_dir), course_names(catalog(spark, sf_dir))).select("query_id", "code", "start")


def o47_best_link(spark, sf_dir):
    """The course of the longest mention; ties go to the smallest code."""
    m = mentions(log(spark, sf_dir), course_names(catalog(spark, sf_dir)))
    return m.groupBy("query_id").agg(F.min_by("code", F.struct(-F.length("name"), "code")).alias("code"))


# Questions that the log doesn't hold, asked of every course of the catalogue; {} stands for its name.
TEMPLATES = ["有没有{}这门课？", "《{}进阶》是几学分？", "《{}》在哪个教室上课？", "{}的期末考试具体日期是哪天？", "{}去年的平均分是多少？", "学{}之前需要什么基础？主要讲什么内容？", "第三章讲什么，先修课是什么？{}", "你们开设了的{}存在吗？"]


def questions(spark, sf_dir):
    """(query_id, query, course_code): the log, and the questions of TEMPLATES on every course."""
    c = catalog(spark, sf_dir).where("course_name is not null").select("course_code", "course_name").repartition(3 * spark.sparkContext.defaultParallelism)  # names are few bytes, their questions much work
    c = c.select("course_code", "course_name", F.posexplode(F.array(*map(F.lit, TEMPLATES))).alias("i", "t"))
    asked = c.select(F.concat_ws("-", "course_code", "i").alias("query_id"), F.replace("t", F.lit("{}"), F.col("course_name")).alias("query"), "course_code")
    return log(spark, sf_dir).select("query_id", "query", "course_code").unionByName(asked)


def _bracketed(spark, sf_dir):
    b = questions(spark, sf_dir).select("query_id", F.explode(F.regexp_extract_all("query", F.lit("《([^《》]+)》"), 1)).alias("name"))
    return b.select("query_id", "name", X.course_key(F.col("name")).alias("key"))


def o49_name_gate(spark, sf_dir):
    """Bracketed names that no course has."""
    known = alias_index(catalog(spark, sf_dir)).select("key").distinct()
    return _bracketed(spark, sf_dir).join(known, "key", "left_anti").select("query_id", "name")


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def clarify(unknown: DataFrame, names: DataFrame, least: float = SIMILAR, k: int = CLARIFY) -> DataFrame:
    """(key, course_code, score): the k most similar names to each unknown one, by matching-block ratio.

    Candidates share a character pair: two names without one reach a ratio of `least` only if they are a few characters long, so names of up to four characters meet all names that share a character instead."""
    def grams(c: Column) -> Column:
        pairs = F.regexp_extract_all(c, F.lit("(?=(..))"), 1)
        return F.array_distinct(F.concat(pairs, F.when(F.length(c) <= 4, F.filter(F.split(c, ""), lambda x: x != "")).otherwise(F.array().cast("array<string>"))))

    def entry(c: Column) -> Column:
        return F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit("(?=(..))"), 1), F.filter(F.split(c, ""), lambda x: x != "")))

    u = unknown.select("key").distinct()
    n = names.select(F.col("key").alias("other"), "course_code").distinct()
    pairs = u.select("key", F.explode(grams(F.col("key"))).alias("g")).join(n.select("other", "course_code", F.explode(entry(F.col("other"))).alias("g")), "g").select("key", "other", "course_code").distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["score"] = [ratio(x, y) for x, y in zip(b["key"], b["other"])]
            yield b[b["score"] >= least]

    scored = pairs.mapInPandas(score, "key string, other string, course_code string, score double")
    best = scored.groupBy("key", "course_code").agg(F.round(F.max("score"), 6).alias("score"))
    return best.withColumn("rank", row_rank(["key"], F.col("score").desc(), F.col("course_code"))).where(F.col("rank") <= k)


def o50_clarify(spark, sf_dir):
    """The three courses most similar to each typed course name that no course has."""
    c = alias_index(catalog(spark, sf_dir))
    s = syllabi(spark, sf_dir).where("entry_id % 50 = 0").select(X.course_key(F.col("course_name")).alias("key")).where("key <> ''").join(c, "key", "left_anti")
    names = catalog(spark, sf_dir).select(X.course_key(F.col("course_name")).alias("key"), "course_code")
    return clarify(s, names)


def o51_unrecorded_gate(spark, sf_dir):
    """Questions about a linked course's fields that are never recorded: the first such field."""
    q = questions(spark, sf_dir)
    label = F.lit(None).cast("string")
    for name, p in reversed(UNRECORDED):
        label = F.when(F.col("query").rlike(p), name).otherwise(label)
    return q.where("course_code is not null").select("query_id", "course_code", label.alias("field")).where("field is not null")


def o52_intent(spark, sf_dir):
    """Intent, labels and confidence of every question."""
    return classify(log(spark, sf_dir)).select("query_id", "intent", F.array_join("labels", "+").alias("labels"), F.round("confidence", 6).alias("confidence"))


def o52_pattern_hits(spark, sf_dir):
    """Matching patterns of the intents whose patterns need no context."""
    q = F.regexp_replace(F.lower("query"), "《[^》]*》", "《》")
    return log(spark, sf_dir).where("query is not null").select("query_id", hits(q, DEPENDENCY).alias("dependency"), hits(q, CATALOG).alias("catalog"), hits(q, FACT).alias("fact"))


def merged_pair(query: Column) -> Column:
    """An array of one: the first two intents of a question with + between them, if these are answered together, else null; the same as from the labels of `classify`.

    Intents are looked at in their order, and only as long as a pair can follow that is answered together. The text is a lambda's variable, so that it is made once and not again for every pattern."""
    names = [n for n, _ in INTENTS]

    def pair(q: Column) -> Column:
        def has(name: str, first: str) -> Column:
            found = reduce(Column.__or__, [q.rlike(NEEDED[p]) & q.rlike(p) if p in NEEDED else q.rlike(p) for p in dict(INTENTS)[name]])
            if (name, first) == ("content", "dependency"):
                found = found & (hits(F.regexp_replace(q, PREREQUISITE_CUE, " "), CONTENT) > 0)
            return found

        none = F.lit(None).cast("string")
        out = None
        for i in reversed(range(len(names))):
            rest = None
            for other in reversed(names[i + 1 :]):
                both = f"{names[i]}+{other}"
                if both in MERGED or rest is not None:
                    rest = F.when(has(other, names[i]), F.lit(both) if both in MERGED else none).otherwise(none if rest is None else rest)
            if rest is not None or out is not None:
                out = F.when(has(names[i], names[i]), none if rest is None else rest).otherwise(none if out is None else out)
        return none if out is None else out

    return F.transform(F.array(F.regexp_replace(F.lower(X.strip(F.coalesce(query, F.lit("")))), "《[^》]*》", "《》")), pair)


def o54_mergeable(spark, sf_dir):
    """Questions whose first two intents are answered together."""
    q = questions(spark, sf_dir)
    return q.select("query_id", F.explode(F.array_compact(merged_pair(F.col("query")))).alias("pair"))


def o57_existence_fragment(spark, sf_dir):
    """The name that a question of existence asks for, by the first pattern that matches, without words of address and measure."""
    q = questions(spark, sf_dir)
    found = F.coalesce(*[F.nullif(F.regexp_extract("query", p, 1), F.lit("")) for p in EXISTENCE])
    bare = F.regexp_replace(F.regexp_replace(found, "^(?:本科生?|研究生|专业|学院|学校|你们|咱们|的|开设了?|开了?)+", ""), "(?:这(?:一)?门|这个|的)+$", "")
    return q.select("query_id", found.alias("fragment"), X.strip(bare).alias("name")).where("fragment is not null")


def _programs(spark, sf_dir):
    o = offerings(spark, sf_dir).where("program_name is not null")
    return o.withColumn("core", X.core_program(F.regexp_replace("program_name", "（[^（）]*）$", ""), PLAN_TYPES))


def match_keyword(texts: DataFrame, aliases: DataFrame, cores: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, keyword): the programme that each text names: by an alias, else a core name, else a whole title, the longest first; an alias gives what it stands for.

    `texts`: query_id, query. `aliases`: name, keyword. `cores`, `titles`: name."""
    named = lambda d, step: d.where("name <> ''").select(F.lower("name").alias("name"), F.concat(F.lit(f"{step}|"), "keyword").alias("code"), F.lit(step).alias("rank"))
    steps_ = (aliases, cores.select("name", F.col("name").alias("keyword")), titles.select("name", F.col("name").alias("keyword")))
    found = reduce(DataFrame.unionByName, [mentions(texts, named(d, i).groupBy("name").agg(F.min("code").alias("code"), F.min("rank").alias("rank"))) for i, d in enumerate(steps_)])
    best = found.groupBy("query_id").agg(F.min_by("code", F.struct(F.substring("code", 1, 1), -F.length("name"), "name")).alias("code"))
    return best.select("query_id", F.substr(F.col("code"), F.lit(3)).alias("keyword"))


def o60_program_keyword(spark, sf_dir):
    """The programme that texts name: titles of plans, their cores' short forms (first and third character, where that stands for one core) and whole titles of plans without a core."""
    p = _programs(spark, sf_dir).select("program_name", "core").distinct()
    cores = p.select(F.col("core").alias("name")).where("core <> ''").distinct()
    short = cores.where("length(name) >= 4").select(F.concat(F.substring("name", 1, 1), F.substring("name", 3, 1)).alias("s"), "name").groupBy("s").agg(F.min("name").alias("keyword"), F.count("*").alias("n")).where("n = 1").select(F.concat(F.lit("简称"), "s").alias("name"), "keyword")
    asked = p.select(F.col("program_name").alias("query")).union(short.select(F.concat("name", F.lit("的课程有哪些")))).distinct().select(F.col("query").alias("query_id"), "query")
    return match_keyword(asked, short, cores, p.select(F.col("program_name").alias("name")).distinct()).withColumnRenamed("query_id", "text")


def o61_program_type(spark, sf_dir):
    """Type of plan of a programme: the one its title names, else the most frequent one, first seen first."""
    p = _programs(spark, sf_dir).where("program_type is not null")
    n = p.groupBy("program_name", "program_type").agg(F.count("*").alias("n"), F.min("offering_id").alias("first"))
    named = F.col("program_name").contains(F.col("program_type"))
    return n.groupBy("program_name").agg(F.min_by("program_type", F.struct(F.when(named, -F.length("program_type")).otherwise(0), -F.col("n"), "first")).alias("program_type"))


def select_offering(offers: DataFrame, keyword: str = "keyword", kind: str = "wanted_type") -> DataFrame:
    """(code, keyword, wanted_type, offering_id): of a course's offerings those of plans whose title holds the keyword if there are any, of these the ones of the wanted type if there are any, of these the first. `offers`: code, program_name, program_type, offering_id, keyword, wanted_type; a null or blank wish leaves all."""
    said = F.coalesce((F.col(keyword) != "") & F.col("program_name").contains(F.col(keyword)), F.lit(False))
    typed = F.coalesce(F.col("program_type") == F.col(kind), F.lit(False))
    return offers.groupBy("code", keyword, kind).agg(F.min_by("offering_id", F.struct(~said, ~typed, "offering_id")).alias("offering_id"))


def o55_select_offering(spark, sf_dir):
    """One offering per course for readers of each type of plan, with and without the core programme of the course's first plan as their keyword."""
    o = _programs(spark, sf_dir).withColumn("code", F.upper(F.trim("course_code"))).where("code is not null").select("code", "program_name", "program_type", "offering_id", "core")
    first = o.groupBy("code").agg(F.max_by("core", "offering_id").alias("core"))
    wishes = first.select("code", F.explode(F.array(F.col("core"), F.lit(""))).alias("keyword")).distinct().crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in PLAN_TYPES], "wanted_type string")))  # a handful of types
    return select_offering(o.drop("core").join(wishes, "code"))


def o56_same_name(spark, sf_dir):
    """Entries of one compared name."""
    s = syllabi(spark, sf_dir).select(X.course_key(F.col("course_name")).alias("key"), "entry_id").where("key <> ''")
    return s.groupBy("key").agg(F.array_sort(F.collect_set("entry_id")).alias("entries")).where(F.size("entries") > 1)


def o68_resolve(spark, sf_dir):
    """Typed prerequisites against the alias index, the entry's own course left out: one match is an edge, more are ambiguous, none is not found."""
    s = syllabi(spark, sf_dir).select("entry_id", F.upper(F.trim("course_code")).alias("own"), F.explode("prerequisites").alias("raw")).where("raw is not null").distinct()
    s = s.withColumn("key", X.course_key(F.col("raw"))).where("key <> ''")
    hit = s.join(alias_index(catalog(spark, sf_dir)), "key", "left").withColumn("hit", F.when(~F.col("course_code").eqNullSafe(F.col("own")), F.col("course_code")))
    g = hit.groupBy("entry_id", "raw").agg(F.count("hit").alias("n"), F.min("hit").alias("code"))
    return g.select("entry_id", "raw", F.when(F.col("n") == 1, "edge").when(F.col("n") > 1, "ambiguous").otherwise("not_found").alias("status"), F.when(F.col("n") == 1, F.col("code")).alias("code"))


CODE_PATTERN = r"(?<![A-Za-z0-9])([A-Za-z]{2}\d{6,10})(?![A-Za-z0-9])"


def match_metadata(files: DataFrame, courses: DataFrame) -> DataFrame:
    """(file_id, course_code, matched_by) of every file: by a known code in its name; by a code in its name that no course has (a stub of its own); by its title as a course's exact name; by the first known code in its text; by the longest course name that its text holds; else none.

    `files`: file_id, name, title, text. `courses`: course_code, course_name. Names in texts are found in one pass over each text; of courses with one name the smallest code counts."""
    steps = Steps(files.sparkSession)
    known = courses.select(F.upper("course_code").alias("code")).where("code is not null").distinct()
    first = steps.write(files.select("file_id", F.upper(F.regexp_extract("name", CODE_PATTERN, 1)).alias("in_name"), X.course_key(F.col("title")).alias("key"), F.transform(F.regexp_extract_all("text", F.lit(CODE_PATTERN), 1), F.upper).alias("in_text")))
    by_name = courses.select(X.course_key(F.col("course_name")).alias("key"), "course_code").where("key <> ''").groupBy("key").agg(F.min("course_code").alias("exact"))
    codes = first.select("file_id", F.posexplode("in_text").alias("pos", "code"))
    by_text = join_lookup(codes, known.withColumn("there", F.lit(True)), "code", "inner").groupBy("file_id").agg(F.min_by("code", "pos").alias("said"))
    names = courses.where("length(course_name) > 1").groupBy(F.lower("course_name").alias("name")).agg(F.min("course_code").alias("code")).withColumn("rank", F.lit(0))
    held = mentions(files.select(F.col("file_id").alias("query_id"), F.col("text").alias("query")), names).groupBy(F.col("query_id").alias("file_id")).agg(F.min_by("code", F.struct(-F.length("name"), "code")).alias("held"))
    j = first.join(known.select(F.col("code").alias("in_name"), F.lit(True).alias("listed")), "in_name", "left").join(by_name, "key", "left").join(by_text, "file_id", "left").join(held, "file_id", "left")
    steps_ = [(F.col("listed"), F.col("in_name"), "file_code"), (F.col("in_name") != "", F.col("in_name"), "stub"), (F.col("exact").isNotNull(), F.col("exact"), "name"), (F.col("said").isNotNull(), F.col("said"), "text_code"), (F.col("held").isNotNull(), F.col("held"), "text_name")]
    code, how = F.lit(None).cast("string"), F.lit("none")
    for when, value, label in reversed(steps_):
        code, how = F.when(when, value).otherwise(code), F.when(when, label).otherwise(how)
    return j.select("file_id", code.alias("course_code"), how.alias("matched_by"))


def o45_match_metadata(spark, sf_dir):
    """Courses of documents as syllabus files: every third is named after its course's code, every twelfth of these after a code that no course has; the title is the labelled name of the course."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    code = F.when(F.col("doc_id") % 12 == 0, F.concat(F.lit("ZZ"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))).otherwise(F.col("course_code"))
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, F.coalesce(code, F.lit("syllabus"))).otherwise("syllabus"), F.lit("_"), "source")
    title = F.regexp_extract("text", r"(?m)^课程名称[：:](.+)$", 1)
    return match_metadata(d.select(F.col("doc_id").alias("file_id"), name.alias("name"), title.alias("title"), "text"), catalog(spark, sf_dir))


def o64_fact_answer(spark, sf_dir):
    """Recorded values of the fields of each course over all plans, conflicts side by side."""
    o = offerings(spark, sf_dir).withColumn("code", F.upper(F.trim("course_code"))).where("code is not null")
    v = o.select("code", F.explode(F.create_map(*[x for f in ("credits", "hours", "semester") for x in (F.lit(f), X.clean(F.col(f)))])).alias("field", "value")).where("value <> ''")
    return v.groupBy("code", "field").agg(F.array_join(F.array_sort(F.collect_set("value")), " | ").alias("recorded"), (F.count_distinct("value") > 1).alias("conflict"))


def o65_instructor_answer(spark, sf_dir):
    """Who teaches a course, and the fixed refusal where no plan says."""
    o = offerings(spark, sf_dir).withColumn("code", F.upper(F.trim("course_code"))).where("code is not null")
    names = o.select("code", F.explode_outer(F.split(X.clean(F.col("instructor")), "、")).alias("name")).where("name is not null")
    g = names.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("name"), F.lit("")))), "、").alias("names"))
    return g.select("code", F.when(F.col("names") == "", "培养方案与教学大纲均未记录该课程的任课教师").otherwise(F.col("names")).alias("answer"))


def o66_existence(spark, sf_dir):
    """Whether each course is offered by plans of one core programme, and by how many."""
    p = _programs(spark, sf_dir).withColumn("code", F.upper(F.trim("course_code")))
    c = catalog(spark, sf_dir).select("course_code").distinct()
    of = p.where(F.col("core").contains("法学")).groupBy(F.col("code").alias("course_code")).agg(F.countDistinct("program_name").alias("plans"))
    return c.join(of, "course_code", "left").select("course_code", F.coalesce("plans", F.lit(0)).alias("plans"), F.col("plans").isNotNull().alias("opened"))


def o115_catalog_answer(spark, sf_dir):
    """Courses of each plan that a question for core courses lists: labelled core courses, else required ones, else all; by semester, then code."""
    o = offerings(spark, sf_dir).where("program_name is not null and course_code is not null").withColumn("code", F.upper(F.trim("course_code")))
    cat = F.concat_ws(" ", "course_category", "course_subcategory")
    o = o.withColumn("tier", F.when(cat.contains("核心"), 0).when(cat.contains("专业必修"), 1).otherwise(2))
    best = o.groupBy("program_name").agg(F.min("tier").alias("tier"))
    one = o.join(best, ["program_name", "tier"]).groupBy("program_name", "code").agg(F.min_by(F.struct("offering_id", "semester"), "offering_id").alias("o"))
    n = X.semester_column(F.col("o.semester"))
    return one.select("program_name", "code", F.col("o.offering_id").alias("offering_id"), row_rank(["program_name"], F.coalesce(n, F.lit(99)), F.col("code")).alias("place"))


def o75_catalog_matches(spark, sf_dir):
    """The first matching offering of each course for a programme word, type and category."""
    o = offerings(spark, sf_dir).withColumn("code", F.upper(F.trim("course_code")))
    f = o.where(F.col("program_name").contains("数据科学") & (F.col("program_type") == "主修专业类") & F.concat_ws(" ", "course_category", "course_subcategory").contains("通识"))
    return f.groupBy("code").agg(F.min("offering_id").alias("offering_id"))


def o102_semester_variants(spark, sf_dir):
    """Courses that plans place in different semesters."""
    o = offerings(spark, sf_dir).withColumn("code", F.upper(F.trim("course_code"))).where("code is not null and program_name is not null")
    v = o.select("code", "program_name", X.clean(F.col("semester")).alias("s")).where("s <> ''").distinct()
    return v.groupBy("code").agg(F.countDistinct("s").alias("semesters"), F.countDistinct("program_name").alias("programs")).where("semesters > 1")


def o253_route(spark, sf_dir):
    """Route of every question: gates first, then two linked courses, then merged, single or broad."""
    q = classify(log(spark, sf_dir)).select("query_id", "query", "intent", "labels", "confidence")
    unknown = o49_name_gate(spark, sf_dir).select("query_id").distinct().withColumn("unknown", F.lit(True))
    linked = o46_links(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("linked"))
    relation = F.col("query").rlike("有什么关系|什么关系|有关系吗|有没有关系|什么联系|有联系吗|有关联吗|(?:有什么|有哪些|之间的?)关联|区别和联系|哪个先学|先学哪个")
    field = F.lit(False)
    for _, p in UNRECORDED:
        field = field | F.col("query").rlike(p)
    j = q.join(unknown, "query_id", "left").join(linked, "query_id", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    route = F.when(F.col("unknown"), "name_gate").when((F.col("linked") > 0) & field, "field_gate").when((F.col("linked") >= 2) & relation, "relation").when(F.array_join(F.slice("labels", 1, 2), "+").isin(MERGED), "merged").when((F.size("labels") > 1) & (F.col("confidence") < LOW_CONFIDENCE), "hybrid").otherwise(F.col("intent"))
    return j.select("query_id", route.alias("route"), "linked")


def o258_vague(spark, sf_dir):
    """Vague questions without a course get a block of questions, with one a suggestion."""
    q = log(spark, sf_dir)
    vague = F.col("query").rlike("这门课|这课|难不难|难吗|难度|怎么样|好不好|值不值|值得|好学|好过|水课|给分|要学.{0,8}吗|需要学.{0,8}吗")
    return q.select("query_id", F.when(vague & F.col("course_code").isNull(), "clarify").when(vague, "suggest").otherwise("answer").alias("reaction"))


_TITLE = "regexp_replace(program_name, '（[^（）]*）$', '')"
_CODE = "upper(trim(course_code))"
_IDX = f"idx as (select distinct {key_sql('v')} as key, course_code from (select course_code, unnest([course_code, course_name, english_name]) as v from cat) where {key_sql('v')} <> '')"


def _hits(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({c}, '{p}')::int" for p in patterns) + ")"


_ASKED = f"{LOG}, {CAT}, aq as (select query_id, query, course_code from lg union all select course_code || '-' || (i - 1), replace(t[i], '{{}}', course_name), course_code from (select cat.*, {TEMPLATES} as t from cat where course_name is not null), range(1, {len(TEMPLATES) + 1}) r(i))"
SQL = {
    "o48_alias_index": f"with {CAT}, {_IDX} select key, list_sort(list(distinct course_code)) as codes from idx group by key",
    "o49_name_gate": f"with {_ASKED}, {_IDX}, b as (select query_id, unnest(regexp_extract_all(query, '《([^《》]+)》', 1)) as name from aq) select query_id, name from b where {key_sql('name')} not in (select key from idx)",
    "o51_unrecorded_gate": f"with {_ASKED} select * from (select query_id, course_code, case " + " ".join(f"when regexp_matches(query, '{p}') then '{n}'" for n, p in UNRECORDED) + " end as field from aq where course_code is not null) where field is not null",
    "o52_pattern_hits": f"with {LOG}, x as (select query_id, regexp_replace(lower(query), '《[^》]*》', '《》', 'g') as q from lg where query is not null) select query_id, {_hits('q', DEPENDENCY)} as dependency, {_hits('q', CATALOG)} as catalog, {_hits('q', FACT)} as fact from x",
    "o61_program_type": f"with {OFF}, n as (select program_name, program_type, count(*) as n, min(offering_id) as f from off where program_name is not null and program_type is not null group by all) select program_name, arg_min(program_type, (case when contains(program_name, program_type) then -length(program_type) else 0 end, -n, f)) as program_type from n group by 1",
    "o55_select_offering": f"with {OFF}, o as (select {_CODE} as code, program_name, program_type, offering_id, {core_sql(_TITLE)} as core from off where course_code is not null and program_name is not null), f as (select code, arg_max(core, offering_id) as core from o group by 1), w as (select distinct code, unnest([core, '']) as keyword from f), ty as (select unnest({PLAN_TYPES}::varchar[]) as wanted_type) select o.code, keyword, wanted_type, arg_min(offering_id, (not coalesce(keyword <> '' and contains(program_name, keyword), false), not coalesce(program_type = wanted_type, false), offering_id)) as offering_id from o join w using (code), ty group by all",
    "o56_same_name": f"with {SYL} select * from (select {key_sql('course_name')} as key, list_sort(list(distinct entry_id)) as entries from syl group by 1) where key <> '' and len(entries) > 1",
    "o68_resolve": f"with {SYL}, {CAT}, {_IDX}, s as (select distinct entry_id, {_CODE} as own, unnest(prerequisites) as raw from syl), k as (select *, {key_sql('raw')} as key from s where raw is not null), g as (select entry_id, raw, count(case when i.course_code is distinct from own then i.course_code end) as n, min(case when i.course_code is distinct from own then i.course_code end) as c from k left join idx i using (key) where key <> '' group by all) select entry_id, raw, case when n = 1 then 'edge' when n > 1 then 'ambiguous' else 'not_found' end as status, case when n = 1 then c end as code from g",
    "o45_match_metadata": f"""with {CAT}, fl as (select doc_id as file_id, text, (case when doc_id % 3 = 0 then coalesce(case when doc_id % 12 = 0 then 'ZZ' || lpad(doc_id::varchar, 8, '0') else course_code end, 'syllabus') else 'syllabus' end) || '_' || source as name, regexp_extract(text, '(?m)^课程名称[：:](.+)$', 1) as title from documents where text is not null),
f1 as (select file_id, text, upper(regexp_extract(' ' || name, '[^A-Za-z0-9]([A-Za-z]{{2}}\\d{{6,10}})([^A-Za-z0-9]|$)', 1)) as in_name, {key_sql('title')} as key, regexp_extract_all(replace(' ' || text, ' ', '  '), '[^A-Za-z0-9]([A-Za-z]{{2}}\\d{{6,10}})(?:[^A-Za-z0-9]|$)', 1) as codes from fl),
nm as (select {key_sql('course_name')} as key, min(course_code) as exact from cat group by 1), tc as (select file_id, u.code, u.pos from (select file_id, unnest(codes) as code, generate_subscripts(codes, 1) as pos from f1) u), ts as (select file_id, arg_min(upper(code), pos) as said from tc where upper(code) in (select upper(course_code) from cat) group by 1),
ln as (select lower(course_name) as name, min(course_code) as code from cat where length(course_name) > 1 group by 1), hd as (select file_id, arg_min(ln.code, (-length(ln.name), ln.code)) as held from fl join ln on contains(lower(text), ln.name) group by 1)
select file_id, case when in_name in (select upper(course_code) from cat) then in_name when in_name <> '' then in_name when exact is not null then exact when said is not null then said else held end as course_code, case when in_name in (select upper(course_code) from cat) then 'file_code' when in_name <> '' then 'stub' when exact is not null then 'name' when said is not null then 'text_code' when held is not null then 'text_name' else 'none' end as matched_by from f1 left join (select * from nm where key <> '') nm using (key) left join ts using (file_id) left join hd using (file_id)""",
    "o47_best_link": f"with {LOG}, {CAT}, nm as (select lower(v) as name, min(course_code) as code from (select course_code, unnest([course_name, course_code]) as v from cat) where length(v) > 1 group by 1) select query_id, arg_min(code, (-length(name), code)) as code from lg join nm on contains(lower(query), name) group by 1",
    "o64_fact_answer": f"with {OFF}, v as (select {_CODE} as code, unnest(['credits', 'hours', 'semester']) as field, unnest([{clean_sql('credits')}, {clean_sql('hours')}, {clean_sql('semester')}]) as value from off where course_code is not null) select code, field, array_to_string(list_sort(list(distinct value)), ' | ') as recorded, count(distinct value) > 1 as conflict from v where value <> '' group by all",
    "o65_instructor_answer": f"with {OFF}, v as (select {_CODE} as code, unnest(string_split({clean_sql('instructor')}, '、')) as name from off where course_code is not null), g as (select code, array_to_string(list_sort(list(distinct nullif(trim(name, ' '), '')) filter (trim(name, ' ') <> '')), '、') as names from v group by 1) select code, case when coalesce(names, '') = '' then '培养方案与教学大纲均未记录该课程的任课教师' else names end as answer from g",
    "o115_catalog_answer": f"with {OFF}, x as (select *, {_CODE} as code, concat_ws(' ', course_category, course_subcategory) as c from off where program_name is not null and course_code is not null), t as (select *, case when contains(c, '核心') then 0 when contains(c, '专业必修') then 1 else 2 end as tier from x), b as (select program_name, min(tier) as tier from t group by 1), o as (select program_name, code, min(offering_id) as offering_id, arg_min(case when semester is null then '' else semester end, offering_id) as semester from t join b using (program_name, tier) group by all) select program_name, code, offering_id, row_number() over (partition by program_name order by coalesce({column_sql('semester')}, 99), code)::int as place from o",
    "o75_catalog_matches": f"with {OFF} select {_CODE} as code, min(offering_id) as offering_id from off where contains(program_name, '数据科学') and program_type = '主修专业类' and contains(concat_ws(' ', course_category, course_subcategory), '通识') group by 1",
    "o102_semester_variants": f"with {OFF}, v as (select distinct {_CODE} as code, program_name, {clean_sql('semester')} as s from off where course_code is not null and program_name is not null) select * from (select code, count(distinct s) as semesters, count(distinct program_name) as programs from v where s <> '' group by 1) where semesters > 1",
    "o258_vague": f"with {LOG}, x as (select query_id, course_code, coalesce(regexp_matches(query, '这门课|这课|难不难|难吗|难度|怎么样|好不好|值不值|值得|好学|好过|水课|给分|要学.{{0,8}}吗|需要学.{{0,8}}吗'), false) as v from lg) select query_id, case when v and course_code is null then 'clarify' when v then 'suggest' else 'answer' end as reaction from x",
}
SQL["o66_existence"] = f"with {OFF}, {CAT}, p as (select {_CODE} as course_code, count(distinct program_name) as plans from off where program_name is not null and contains({core_sql(_TITLE)}, '法学') group by 1) select distinct c.course_code, coalesce(plans, 0) as plans, plans is not null as opened from (select distinct course_code from cat) c left join p using (course_code)"
SQL["o60_program_keyword"] = f"with {OFF}, p as (select distinct program_name, {core_sql(_TITLE)} as core from off where program_name is not null), co as (select distinct core from p where core <> ''), sh as (select '简称' || substring(core, 1, 1) || substring(core, 3, 1) as name, min(core) as keyword from co where length(core) >= 4 group by 1 having count(*) = 1), tx as (select program_name as text from p union select name || '的课程有哪些' from sh), al as (select text, 0 as step, name, keyword from tx join sh on contains(lower(text), lower(name)) union all select text, 1, core, core from tx join co on contains(lower(text), lower(core)) union all select text, 2, program_name, program_name from tx join (select distinct program_name from p) on contains(lower(text), lower(program_name))) select text, arg_min(keyword, (step, -length(name), lower(name))) as keyword from al group by 1"
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit()}
