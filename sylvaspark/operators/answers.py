"""Composite plans and the remaining projections: recall with filters, evidence, answers by route, concepts and links, pipeline counts."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaspark.common import Steps, join_lookup, row_rank, table
from sylvaspark.functions import text as X
from sylvaspark.operators import lexical
from sylvaspark.operators.fields import clean_sql, cn_sql, column_sql, key_sql
from sylvaspark.operators.graphs import _E, part_edges
from sylvaspark.operators.metrics import _REF
from sylvaspark.operators.programs import _GATE, _LINK
from sylvaspark.operators.doctree import _LAT, _PATH
from sylvaspark.operators.vectors import _CON, _LISTS, _PAIR, _VOTE, _vectors, _votes, concepts, cosine_deciles, o106_linear_fusion, o170_concept_pairs, top_cosine
from sylvaspark.plans.inputs import BLK, CAT, LOG, OFF, SYL, blocks, catalog, log, offerings, syllabi

# Trailing words that don't tell concepts apart, and how concept types are recognised by their ends.
MODIFIERS = ["的定义", "的概念", "的性质", "的应用", "的基本概念", "概述", "简介"]
SUFFIX_TYPES = [("method", "法|方法|算法|技术"), ("theory", "理论|原理|定理|定律"), ("system", "系统|体系|模型"), ("activity", "训练|实验|设计|管理|分析")]
BLOOM = {"remember": 1, "understand": 2, "apply": 3}


def alias_key(df: DataFrame, text: str) -> DataFrame:
    """Adds `alias_key`: compatibility form in lower case, without punctuation, trailing modifiers and 的."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["alias_key"] = [unicodedata.normalize("NFKC", t).casefold() if t is not None else None for t in b[text]]
            yield b

    out = df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("alias_key", T.StringType())]))
    words = "|".join(sorted(MODIFIERS, key=lambda w: (-len(w), w)))
    bare = F.regexp_replace("alias_key", r"[\p{P}\p{S}\s]+", "")
    return out.withColumn("alias_key", F.regexp_replace(F.regexp_replace(bare, f"(?<=.)(?:{words})+$", ""), "的", ""))


def first_json(df: DataFrame, text: str) -> DataFrame:
    """Adds `json`: the first balanced JSON object or array in a text, null if there is none."""

    def find(t: str | None) -> str | None:
        if t is None:
            return None
        decoder = json.JSONDecoder()
        at = 0
        while True:
            spots = [i for i in (t.find("{", at), t.find("[", at)) if i >= 0]
            if not spots:
                return None
            try:
                value, _ = decoder.raw_decode(t, min(spots))
                return json.dumps(value, ensure_ascii=False, sort_keys=True)
            except ValueError:
                at = min(spots) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["json"] = [find(t) for t in b[text]]
            yield b

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("json", T.StringType())]))


def o138_alias_key(spark, sf_dir):
    """Course names of syllabi as concept keys."""
    return alias_key(syllabi(spark, sf_dir).select("course_name").where("course_name is not null").distinct(), "course_name")


def o156_json(spark, sf_dir):
    """JSON values in event properties."""
    return first_json(table(spark, sf_dir, "events").select("user_id", "ts", "props"), "props")


def o136_pair_score(spark, sf_dir):
    """BM25 of each query document against every document that shares a term with it."""
    return lexical.ranked(spark, sf_dir, None).drop("kind")


def o132_score_terms(spark, sf_dir):
    """Parts of the BM25 score of each query document against itself, term by term, the ten largest."""
    d = table(spark, sf_dir, "documents")
    own = lexical.postings(d.where("doc_id % 50 = 0"))
    own = join_lookup(Steps(spark).write(own), lexical.document_frequency(d), "term", "inner").crossJoin(F.broadcast(lexical.corpus_size(d)))  # one row of sizes
    part = lexical.idf(F.col("df"), F.col("n_docs")) * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    s = own.select("doc_id", "term", F.round(part, 6).alias("part"))
    return s.withColumn("rank", row_rank(["doc_id"], F.col("part").desc(), F.col("term"))).where("rank <= 10")


def o268_recall(spark, sf_dir):
    """The twenty lexical candidates of each query among documents of its own language."""
    d = table(spark, sf_dir, "documents")
    r = lexical.ranked(spark, sf_dir, 20, group=F.col("lang")).join(d.where("lang is not null").select(F.col("doc_id").alias("query_id"), "lang"), "query_id").where("kind = lang")
    return lexical.top(r.select("query_id", "doc_id", "score"), 20)


def o108_bm25_arm(spark, sf_dir):
    """BM25 alone with a boost for one source."""
    r = lexical.ranked(spark, sf_dir, 5, group=F.col("source"))
    r = r.select("query_id", "doc_id", F.round(F.col("score") + F.when(F.col("kind") == "course_wiki", 0.08).otherwise(0.0), 6).alias("score"))
    return lexical.top(r, 5)


def o110_two_branch(spark, sf_dir):
    """Two filtered searches, syllabi and notes, put together: each document once, from the first branch that has it."""
    r = Steps(spark).write(lexical.ranked(spark, sf_dir, 5, group=F.col("doc_kind")).withColumnRenamed("kind", "doc_kind"))
    a = lexical.top(r.where("doc_kind = 'syllabus'").select("query_id", "doc_id", "score"), 5).withColumn("branch", F.lit(1))
    b = lexical.top(r.where("doc_kind in ('notes', 'syllabus')").select("query_id", "doc_id", "score"), 5).withColumn("branch", F.lit(2))
    u = a.unionByName(b).withColumn("k", row_rank(["query_id", "doc_id"], F.col("branch"), F.col("rank"))).where("k = 1")
    return u.select("query_id", "doc_id", "score", "branch", row_rank(["query_id"], F.col("score").desc(), F.col("doc_id")).alias("place"))


def o109_dispatch(spark, sf_dir):
    """One row per query and fusion mode: the best document of the lexical, dense and linear plans. One lexical search serves both plans that need one."""
    found = Steps(spark).write(lexical.ranked(spark, sf_dir, 20, "both").drop("kind"))
    lex = lexical.top(found.select("query_id", "doc_id", "score"), 1).select("query_id", "doc_id", F.lit("bm25").alias("mode"))
    v = _vectors(spark, sf_dir)
    den = top_cosine(v.where("vec_id % 50 = 0"), v, 1).select("query_id", F.col("id").alias("doc_id"), F.lit("dense").alias("mode"))
    lin = o106_linear_fusion(spark, sf_dir, found.select("query_id", "doc_id", F.col("share").alias("score"))).where("rank = 1").select("query_id", "doc_id", F.lit("linear").alias("mode"))
    return lex.unionByName(den).unionByName(lin)


def o74_pair_candidates(spark, sf_dir):
    """Concept pairs by decade of cosine, over all sources of the targets."""
    c = concepts(_vectors(spark, sf_dir))
    return cosine_deciles(c.where("vec_id % 10 = 0"), c)


def _paired(spark, sf_dir) -> DataFrame:
    """The best pairs with the attributes of both ends."""
    c = concepts(_vectors(spark, sf_dir)).drop("embedding")
    t = c.select(F.col("vec_id").alias("target"), F.col("discipline").alias("td"), F.col("semester").alias("ts"))
    return o170_concept_pairs(spark, sf_dir).join(t, "target").join(c.withColumnRenamed("vec_id", "source"), "source")


def o172_candidate_rows(spark, sf_dir):
    """The four evidence records of each candidate link: vector, rule, structure and what they come to."""
    same = F.col("discipline") == F.col("td")
    later = F.coalesce(F.col("semester") < F.col("ts"), F.lit(False))
    record = lambda kind, score: F.struct(F.lit(kind).alias("kind"), score.alias("score"))
    e = F.array(record("vector", F.col("cosine")), record("rule", F.when(same, 1.0).otherwise(0.5)), record("structure", F.when(later, 0.3).otherwise(0.0)), record("confidence", F.col("confidence")))
    return _paired(spark, sf_dir).select("target", "source", F.inline(e))


def o270_candidate_links(spark, sf_dir):
    """Candidate links in order, concepts of courses that all take left out: links per target and best confidence."""
    return o170_concept_pairs(spark, sf_dir).groupBy("target").agg(F.count("*").alias("links"), F.max("confidence").alias("best"))


def o271_verify_links(spark, sf_dir):
    """Links to verify: those not in the cache, by confidence, within a budget of 3,000; cached ones are free."""
    p = o170_concept_pairs(spark, sf_dir).withColumn("cached", (F.col("source") + F.col("target")) % 3 == 0)
    new = p.where("not cached").orderBy(F.col("confidence").desc(), "target", "source").limit(3000)
    return p.where("cached").unionByName(new).select("target", "source", "cached")


def o273_normal_votes(spark, sf_dir):
    """Votes with literal booleans and clamped, rounded confidence."""
    v = _votes(spark, sf_dir)
    return v.select("target", "source", "vote", F.coalesce(F.col("requires"), F.lit(False)).alias("requires"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * 1.25)), 6).alias("confidence"))


def o251_votes(spark, sf_dir):
    """Three votes for every candidate link, counted."""
    return _votes(spark, sf_dir).groupBy("vote").agg(F.count("*").alias("n"), F.count_if("requires").alias("yes"))


def o274_signals(spark, sf_dir):
    """Rule, order and Bloom signals of every pair of concepts, those that Bloom levels forbid included."""
    c = concepts(_vectors(spark, sf_dir))
    t = c.select(F.col("vec_id").alias("target"), F.col("discipline").alias("td"), F.col("bloom").alias("tb"), F.col("semester").alias("ts"))
    p = t.join(c, F.col("target") != F.col("vec_id"))
    allowed = F.col("bloom") <= F.col("tb")
    return p.select("target", F.col("vec_id").alias("source"), allowed.alias("bloom_allowed"), F.when(~allowed, 0.0).when(F.col("discipline") == F.col("td"), 1.0).otherwise(0.5).alias("rule"), F.when(F.coalesce(F.col("semester") < F.col("ts"), F.lit(False)), 0.3).otherwise(0.0).alias("structure"))


# How codes of courses that all students take begin.
PUBLIC = ("TY", "PE", "MA")


def o277_public(spark, sf_dir):
    """Whether a concept belongs to a course that all students take: any code of its courses has one of the prefixes. Block titles without their number stand for concepts."""
    b = blocks(spark, sf_dir).where("title is not null").select(F.regexp_replace("title", "^第[一二三四五六七八九十0-9]+[章讲节周]\\s*", "").alias("concept"), F.upper(F.trim("course_code")).alias("code"))
    g = b.groupBy("concept").agg(F.collect_set("code").alias("codes"))
    starts = lambda c: F.coalesce(F.exists(c, lambda x: x.rlike(f"^(?:{'|'.join(PUBLIC)})")), F.lit(False))
    return g.select("concept", starts(F.col("codes")).alias("public"))


def o272_concept_types(spark, sf_dir):
    """Type of each course name by its end; names of no known type are concepts."""
    out = F.lit("concept")
    for name, p in reversed(SUFFIX_TYPES):
        out = F.when(F.col("course_name").rlike(f"(?:{p})$"), name).otherwise(out)
    return catalog(spark, sf_dir).where("course_name is not null").groupBy(out.alias("type")).agg(F.count("*").alias("n"))


def fallback_concepts(docs: DataFrame) -> DataFrame:
    """(doc_id, type, term): Han runs of two to eight characters that end as concepts of a type do, of each compared key once per document; the first type that matches counts."""
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit("([一-鿿]{2,8})"), 1))
    kind = F.lit(None).cast("string")
    for name, p in reversed(SUFFIX_TYPES):
        kind = F.when(F.col("term").rlike(f"(?:{p})$"), name).otherwise(kind)
    t = docs.where("text is not null").select("doc_id", F.explode(runs).alias("term")).withColumn("type", kind).where("type is not null")
    bare = F.regexp_replace("term", f"(?<=.)(?:{'|'.join(MODIFIERS)})+$|的", "")
    return t.groupBy("doc_id", bare.alias("key")).agg(F.min(F.struct("term", "type")).alias("x")).select("doc_id", "x.type", "x.term")


def o142_fallback_concepts(spark, sf_dir):
    """Concepts of documents by type, with the documents that hold them."""
    return fallback_concepts(table(spark, sf_dir, "documents")).groupBy("type", "term").agg(F.count("*").alias("docs"))


def o140_evidence_sentence(spark, sf_dir):
    """The first sentence of each block that holds its title's topic."""
    b = blocks(spark, sf_dir).where("text is not null and title is not null").withColumn("topic", F.regexp_replace("title", "^第[一二三四五六七八九十0-9]+[章讲节周]\\s*", ""))
    s = F.filter(F.split("text", "[。！？\\n]"), lambda x: F.length(x) > 0)
    hit = F.transform(F.filter(F.transform(s, lambda x: F.struct(x.alias("s"), F.col("topic").alias("t"))), lambda x: x["s"].contains(x["t"])), lambda x: x["s"])
    return b.where("topic <> ''").select("node_id", F.get(hit, F.lit(0)).alias("sentence")).where("sentence is not null")


def o141_field_only(spark, sf_dir):
    """Documents in which a word occurs in a labelled line only."""
    d = table(spark, sf_dir, "documents").where("text like '%考核%'")
    rest = F.regexp_replace("text", "(?m)^(?:重点|难点|考核内容|考核方式)[^\\n。]*", "")
    return d.select("doc_id", (~rest.contains("考核")).alias("field_only"))


def o139_canonical_name(spark, sf_dir):
    """Of the names of one English name the most frequent, then one in Han, then the shortest, then the first."""
    c = catalog(spark, sf_dir).where("english_name is not null and english_name <> '' and course_name is not null")
    g = c.groupBy("english_name", "course_name").agg(F.count("*").alias("n"))
    return g.groupBy("english_name").agg(F.min_by("course_name", F.struct(-F.col("n"), ~F.col("course_name").rlike("[一-鿿]"), F.length("course_name"), "course_name")).alias("name"))


def o279_resolve_alias(spark, sf_dir):
    """Typed prerequisites to canonical names by compared key, the first match."""
    names = catalog(spark, sf_dir).select(X.course_key(F.col("course_name")).alias("key"), "course_name").where("key <> ''").groupBy("key").agg(F.min("course_name").alias("canonical"))
    s = syllabi(spark, sf_dir).select("entry_id", F.posexplode("prerequisites").alias("pos", "raw")).where("raw is not null").withColumn("key", X.course_key(F.col("raw")))
    return s.join(names, "key", "left").select("entry_id", "pos", "canonical")


def o176_enrich(spark, sf_dir):
    """Blocks with the distinct courses of their documents' concepts."""
    b = blocks(spark, sf_dir).where("course_code is not null").select("document_hash", "course_code").distinct()
    return b.groupBy("document_hash").agg(F.array_join(F.array_sort(F.collect_set("course_code")), ",").alias("courses"))


def o208_merge_unique(spark, sf_dir):
    """Chunk lists of a document's blocks as one list, each chunk once (also merged string lists)."""
    b = blocks(spark, sf_dir).where("chunk_ids is not null").groupBy("document_hash").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "chunk_ids"))), lambda x: x["chunk_ids"]))).alias("ids"))
    return b.select("document_hash", F.size("ids").alias("n"), F.try_element_at("ids", F.lit(1)).alias("first"))


def o209_share(spark, sf_dir):
    """Pairs of offerings of a course in one plan that share an instructor."""
    o = offerings(spark, sf_dir).where("course_code is not null and program_name is not null and instructor is not null").select(F.upper(F.trim("course_code")).alias("code"), "program_name", "offering_id", F.split("instructor", "、").alias("n"))
    w = Window.partitionBy("code", "program_name").orderBy("offering_id")
    return o.select("offering_id", F.lag("offering_id").over(w).alias("before"), F.arrays_overlap("n", F.lag("n").over(w)).alias("shared")).where("before is not null")


PART, OVERLAP = 700, 80


def split_content(text: str | None, most: int = PART, overlap: int = OVERLAP) -> list[str]:
    """Sentences and lines packed in order into parts of at most `most` characters, each part but the first starting with the end of the one before, which comes on top where a whole sentence follows; longer sentences are cut. A text within the limit is one part; a null or blank one gives none."""
    text = (text or "").strip()
    if len(text) <= most:
        return [text] if text else []
    parts = [""]  # the last one is open
    for unit in filter(None, map(str.strip, re.split(r"(?<=[。！？；])|\n+", text))):
        while len(unit) > most:
            if parts[-1]:
                parts.append(parts[-1][-overlap:])
            room = most - len(parts[-1])
            parts[-1] += unit[:room]
            unit = unit[room:]
        longer = "\n".join(filter(None, (parts[-1], unit)))
        if len(longer) <= most:
            parts[-1] = longer
        else:
            parts.append(f"{parts[-1][-overlap:]}\n{unit}".strip())
    return parts


def o144_split(spark, sf_dir):
    """The parts of each block's text, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, i, p) for n, t in zip(b["node_id"], b["text"]) for i, p in enumerate(split_content(t))]
            yield pd.DataFrame(rows, columns=["node_id", "part", "text"])

    b = blocks(spark, sf_dir).where("text is not null").select("node_id", "text")
    return b.mapInPandas(run, "node_id string, part int, text string")


def o159_markdown(spark, sf_dir):
    """Schedule documents as markdown tables: rows and the first one."""
    d = table(spark, sf_dir, "documents").where("doc_kind = 'schedule' and text is not null")
    rows = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("| "), F.regexp_replace(x, "\t", " | "), F.lit(" |")))
    return d.select("doc_id", F.size(rows).alias("rows"), F.get(rows, F.lit(0)).alias("first"))


def o283_chunk_records(spark, sf_dir):
    """Chunk records of blocks: id, neighbours and position in the document."""
    c = blocks(spark, sf_dir).select("document_hash", "node_id", F.posexplode("chunk_ids").alias("i", "chunk_id"))
    w = Window.partitionBy("document_hash").orderBy("node_id", "i")
    return c.select("document_hash", "chunk_id", "node_id", "i", F.lag("chunk_id").over(w).alias("before"), F.lead("chunk_id").over(w).alias("after"), (F.row_number().over(w) - 1).alias("chunk_index"))


def o178_official_semester(spark, sf_dir):
    """Semester of a course in each plan that offers it (of its first record there), and, under no plan, its earliest one in any."""
    o = offerings(spark, sf_dir).where("course_code is not null").withColumn("code", F.upper(F.trim("course_code"))).withColumn("s", X.semester_column(F.col("semester")))
    own = o.where("program_name is not null").groupBy("code", "program_name").agg(F.min_by(F.struct("s"), "offering_id")["s"].alias("semester"))
    return own.unionByName(o.groupBy("code").agg(F.min("s").alias("semester")).withColumn("program_name", F.lit("")))


def o260_evidence_items(spark, sf_dir):
    """Hits as evidence: source, kind and size of the best five documents of each query."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "doc_kind", "n_chars")
    return lexical.o128_bm25_topk(spark, sf_dir).join(d, "doc_id").select("query_id", "rank", "doc_id", "source", "doc_kind", "n_chars")


def o264_hit_citations(spark, sf_dir):
    """Distinct sources of the hits of each query in order of first appearance."""
    e = o260_evidence_items(spark, sf_dir).groupBy("query_id", "source").agg(F.min("rank").alias("first"))
    return e.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]), ",").alias("sources"))


def o241_graded(spark, sf_dir):
    """First rank of a hit of the query's own course, for all queries at once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "course_code")
    t = lexical.top(lexical.ranked(spark, sf_dir, 11).drop("kind").where("query_id <> doc_id"), 10)  # one more than ten, as the query finds itself
    j = t.join(d, "doc_id").join(d.select(F.col("doc_id").alias("query_id"), F.col("course_code").alias("gold")), "query_id")
    return j.groupBy("query_id").agg(F.min(F.when(F.col("course_code") == F.col("gold"), F.col("rank"))).alias("first"))


def o242_routing_items(spark, sf_dir):
    """Predicted intent against the logged type, counted."""
    from sylvaspark.operators.linking import classify

    return classify(log(spark, sf_dir)).groupBy("query_type", "intent").agg(F.count("*").alias("n"))


def o286_concept_stage(spark, sf_dir):
    """Chunks of the three kinds of blocks, with what was extracted merged back by id: one row per chunk, its concept (null where its block has no text or names none) and course."""
    c = blocks(spark, sf_dir).where("kind in ('chapter', 'section', 'schedule')").select("node_id", "kind", "course_code", F.explode_outer("chunk_ids").alias("chunk_id"))
    found = _concept_names(spark, sf_dir).where("text is not null and text <> ''").select("node_id", "concept")
    return c.join(found, "node_id", "left").select("node_id", "kind", "chunk_id", "concept", "course_code")


def o287_manifest(spark, sf_dir):
    """Counts by which a graph build is recorded and checked."""
    e = part_edges(spark, sf_dir)
    return e.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.bool_and(F.col("src") < F.col("dst")).alias("ordered"))


def o294_catalog_items(spark, sf_dir):
    """Gold items of each plan: its required courses, else all it offers."""
    o = offerings(spark, sf_dir).where("program_name is not null and course_code is not null")
    req = F.concat_ws(" ", "course_category", "course_subcategory").contains("必修")
    code = F.upper(F.trim("course_code"))
    g = o.groupBy("program_name").agg(F.count_distinct(F.when(req, code)).alias("required"), F.count_distinct(code).alias("offered"))
    return g.select("program_name", F.when(F.col("required") > 0, F.col("required")).otherwise(F.col("offered")).alias("items"))


def o297_template(spark, sf_dir):
    """Population and sample of candidate links by pair of disciplines: three of each, in the order of a hash."""
    p = _paired(spark, sf_dir).withColumn("stratum", F.concat_ws("-", "discipline", "td"))
    s = p.withColumn("r", row_rank(["stratum"], F.sha2(F.concat_ws(":", "target", "source"), 256)))
    return s.groupBy("stratum").agg(F.count("*").alias("population"), F.count_if(F.col("r") <= 3).alias("selected"))


def _concept_names(spark, sf_dir) -> DataFrame:
    """Blocks with the concept that their title names."""
    b = blocks(spark, sf_dir).where("title is not null").withColumn("concept", F.regexp_replace("title", r"^第[一二三四五六七八九十0-9]+[章讲节周]\s*", ""))
    return b.where("concept <> ''")


def o298_predictions(spark, sf_dir):
    """Concept names by the code of each course that teaches them, each once."""
    return _concept_names(spark, sf_dir).where("course_code is not null").select(F.upper(F.trim("course_code")).alias("course_code"), "concept").distinct()


def o77_edge_pairs(spark, sf_dir):
    """Course pair of each selected edge, by its label if it has one (also the selection itself)."""
    v = _votes(spark, sf_dir).where("requires and vote = 0")
    return v.select("target", "source", F.concat_ws("->", (F.col("source") % 50).cast("string"), (F.col("target") % 50).cast("string")).alias("pair"))


# Questions on structure that the log doesn't hold, asked of every course; {} stands for its name.
STRUCTURE_TEMPLATES = ["{}的大纲有哪些章节？", "{}第5周讲什么？", "{}第九十章讲什么？"]
WEEK_ASKED = r"第\s*([一二两三四五六七八九十百\d]+)\s*周|\b[Ww]eek (\d+)"
CHAPTER_ASKED = r"第\s*([一二两三四五六七八九十百\d]+)\s*[章讲节]|\b[Cc]hapter (\d+)"


def o204_structure_answer(spark, sf_dir):
    """Structure questions of the log and of the templates, answered from the latest document of the course: the chapter or the week that they name (the first chapter whose text mentions it), refused where there is none; else the outline, with its number of chapters."""
    from sylvaspark.operators.doctree import _latest_chapters

    c = catalog(spark, sf_dir).where("course_name is not null").select("course_code", "course_name", F.posexplode(F.array(*map(F.lit, STRUCTURE_TEMPLATES))).alias("i", "t"))
    q = c.select(F.concat_ws("-s", "course_code", "i").alias("query_id"), F.replace("t", F.lit("{}"), F.col("course_name")).alias("query"), "course_code")
    q = log(spark, sf_dir).where("course_code is not null").select("query_id", "query", "course_code").unionByName(q)
    said = lambda p: X.chinese_number(F.coalesce(F.nullif(F.regexp_extract("query", p, 1), F.lit("")), F.nullif(F.regexp_extract("query", p, 2), F.lit(""))))
    q = q.withColumn("chapter", said(CHAPTER_ASKED)).withColumn("week", said(WEEK_ASKED)).withColumn("outline", F.col("query").rlike("章节|大纲|目录|[Oo]utline"))
    q = Steps(spark).write(q.where("chapter is not null or week is not null or outline"))
    ch = Steps(spark).write(_latest_chapters(spark, sf_dir).select("course_code", "node_id", "chapter", "text"))
    place = F.struct(F.coalesce("chapter", F.lit(999)), "node_id")
    by_chapter = ch.where("chapter is not null").groupBy("course_code", "chapter").agg(F.min("node_id").alias("of_chapter"))
    weeks = ch.select("course_code", "node_id", "chapter", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"第\s*([一二两三四五六七八九十百\d]+)\s*周"), 1))).alias("w")).withColumn("week", X.chinese_number(F.col("w"))).where("week is not null")
    by_week = weeks.groupBy("course_code", "week").agg(F.min_by("node_id", place).alias("of_week"))
    size = ch.groupBy("course_code").agg(F.count("*").alias("chapters"))
    j = q.join(by_chapter, ["course_code", "chapter"], "left").join(by_week, ["course_code", "week"], "left").join(size, "course_code", "left")
    n = F.coalesce("chapters", F.lit(0))
    reaction = F.when(F.col("chapter").isNotNull(), F.when(F.col("of_chapter").isNotNull(), "chapter").otherwise("unknown_chapter")).when(F.col("week").isNotNull(), F.when(F.col("of_week").isNotNull(), "week").otherwise("unknown_week")).when(n > 0, "outline").otherwise("no_outline")
    return j.select("query_id", reaction.alias("reaction"), F.when(F.col("chapter").isNotNull(), F.col("of_chapter")).when(F.col("week").isNotNull(), F.col("of_week")).alias("node_id"), n.alias("chapters"))


def o3_header_rows(spark, sf_dir):
    """Header detection, joined header rows and column places on the plan sheets of the offerings, flattened to rows of cells."""
    from sylvaspark.sources import office

    o = offerings(spark, sf_dir).where("source_file is not null")
    body = o.select(F.col("source_file").alias("path"), F.col("sheet_name").alias("sheet"), (F.row_number().over(Window.partitionBy("source_file", "sheet_name").orderBy("offering_id")) + 3).alias("row"), F.array("course_code", "course_category", "credits", "theory_credits").alias("cells"))
    sheets = body.select("path", "sheet").distinct()
    head = sheets.select("path", "sheet", F.lit(2).alias("row"), F.array(*map(F.lit, ("课程代码", "课程 名称", "学分", ""))).alias("cells"))
    second = sheets.where(F.length("path") % 2 == 0).select("path", "sheet", F.lit(3).alias("row"), F.array(*map(F.lit, ("", "", "总计", "理论"))).alias("cells"))
    h = office.header_rows(body.unionByName(head).unionByName(second))
    return h.select("path", "sheet", "row", "first", F.array_join("names", ",").alias("names"), office.column_index(F.col("names"), ["学分"]).alias("credits_at"))


EXAMPLES = 3
# What an answer on two courses says.
BEFORE, NO_RELATION = "先修", "未找到关系"


def o187_relation(spark, sf_dir):
    """What each question that names two courses is answered with: the chain of at most three prerequisites in either direction, else up to three verified links between their concepts in either direction, else a refusal."""
    from sylvaspark.operators.hierarchy import parent_links
    from sylvaspark.operators.linking import course_names, mentions
    from sylvaspark.operators.programs import o72_course_links

    m = mentions(log(spark, sf_dir), course_names(catalog(spark, sf_dir)))
    two = m.groupBy("query_id").agg(F.min_by("code", "start").alias("a"), F.max_by("code", "start").alias("b"), F.count("*").alias("n")).where("n = 2")
    two = Steps(spark).write(two.drop("n"))
    up = Steps(spark).write(parent_links(table(spark, sf_dir, "course_catalog"))[1].select(F.col("code"), F.col("parent")))
    one = up.select(F.col("code").alias("below"), F.col("parent").alias("top"), F.array("parent", "code").alias("chain"))
    more = lambda d: d.select("below", F.col("top").alias("code"), "chain").join(up, "code").where(~F.array_contains("chain", F.col("parent"))).select("below", F.col("parent").alias("top"), F.concat(F.array("parent"), "chain").alias("chain"))
    second = more(one)
    chains = one.unionByName(second).unionByName(more(second)).groupBy("below", "top").agg(F.min_by("chain", F.size("chain")).alias("chain"))
    chains = Steps(spark).write(chains)
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long") % 50
    links = Steps(spark).write(o72_course_links(spark, sf_dir).select("from_course", "to_course", "examples"))
    j = two
    for x, y, c, e in (("b", "a", "c1", "e1"), ("a", "b", "c2", "e2")):
        j = j.join(chains.select(F.col("below").alias(x), F.col("top").alias(y), F.array_join("chain", ">").alias(c)), [x, y], "left")
        j = j.withColumn("_f", number(F.col(y))).withColumn("_t", number(F.col(x))).join(links.select(F.col("from_course").alias("_f"), F.col("to_course").alias("_t"), F.split("examples", ",").alias(e)), ["_f", "_t"], "left").drop("_f", "_t")
    chain = F.concat_ws(";", "c1", "c2")
    none = F.array().cast("array<string>")
    known = F.slice(F.concat(F.coalesce("e1", none), F.coalesce("e2", none)), 1, EXAMPLES)
    relation = F.when(chain != "", "prerequisite").when(F.size(known) > 0, "knowledge").otherwise("refused")
    return j.select("query_id", relation.alias("relation"), F.when(relation == "prerequisite", F.concat(F.lit(f"{BEFORE}："), chain)).when(relation == "knowledge", F.array_join(known, "、")).otherwise(NO_RELATION).alias("answer"))


def o189_locate(spark, sf_dir):
    """Courses whose name holds a topic of the reference list."""
    t = table(spark, sf_dir, "course_reference").select(F.substring("course_name", 3, 4).alias("topic")).where("length(topic) = 4").distinct()
    c = catalog(spark, sf_dir).where("course_name is not null").select("course_code", "course_name")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(6)), lambda n: F.when(F.length("course_name") >= n, F.transform(F.sequence(F.lit(1), F.length("course_name") - n + 1), lambda i: F.substring(F.col("course_name"), i, n))).otherwise(F.array().cast("array<string>")))))
    return c.select("course_code", F.explode(grams).alias("topic")).join(t, "topic").groupBy("topic").agg(F.count("*").alias("courses"), F.min("course_code").alias("first"))


def o196_schedule_prefix(spark, sf_dir):
    """The deepest heading of each line's path that announces a schedule, else the heading above."""
    from sylvaspark.operators.doctree import _lines, heading_path

    p = heading_path(_lines(spark, sf_dir)).where("size(path) > 0")
    hit = F.filter("path", lambda x: x.rlike("周次|进度|安排"))
    return p.select("doc_id", "pos", F.coalesce(F.get(F.reverse(hit), F.lit(0)), F.element_at("path", -1)).alias("prefix"))


def o243_graded_answers(spark, sf_dir):
    """All measures of each answer side by side."""
    from sylvaspark.operators.metrics import covers, is_refusal

    a = log(spark, sf_dir)
    return a.select("query_id", is_refusal(F.col("answer")).alias("refused"), covers(F.col("answer"), ["学分|credits"]).alias("covered"), F.coalesce(F.col("answer").contains("《"), F.lit(False)).alias("cited"), F.coalesce(F.length("answer"), F.lit(0)).alias("length"))


def o261_parent_excerpt(spark, sf_dir):
    """Block texts cut at 1,200 characters with their title in front (an excerpt is the feature here)."""
    b = blocks(spark, sf_dir).where("text is not null and title is not null")
    return b.select("node_id", F.concat("title", F.lit("\n"), F.substring("text", 1, 1200)).alias("excerpt"))


def o269_coverage_gate(spark, sf_dir):
    """Share of documents from which a concept was extracted, by source, and whether it passes the gate of one half."""
    d = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    has = F.size(F.regexp_extract_all("text", F.lit("([一-鿿]{2,6}(?:理论|原理|方法|模型|系统))"), 1)) > 0
    g = d.groupBy("source").agg(F.count("*").alias("docs"), F.round(F.avg(has.cast("double")), 6).alias("coverage"))
    return g.withColumn("passed", F.col("coverage") >= 0.5)


def o126_pairs(spark, sf_dir):
    """Gold pairs of courses that share no end: of each course's links the first, each end used once, in order."""
    l = o170_concept_pairs(spark, sf_dir).where("rank = 1 and target <> source")
    once = l.withColumn("r", row_rank(["source"], F.col("confidence").desc(), F.col("target"))).where("r = 1")
    ends = once.select(F.col("target").alias("source")).distinct()
    return once.join(ends, "source", "left_anti").select("target", "source")


_T = lexical.TOKENS
_C = "upper(trim(course_code))"
_CN = "(case when regexp_full_match(t, '\\d{1,6}') then t::int when regexp_full_match(t, '[一二两三四五六七八九]') then case when t = '两' then 2 else instr('一二三四五六七八九', t) end when t = '十' then 10 end)"
SQL = {
    "o136_pair_score": f"with {_T} select * from raw",
    "o132_score_terms": f"with {_T}, s as (select doc_id, term, round(greatest(0.0, ln(1 + (n_docs - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)), 6) as part from post join dfs using (term), n where doc_id % 50 = 0) select *, row_number() over (partition by doc_id order by part desc, term)::int as rank from s qualify rank <= 10",
    "o268_recall": f"with {_T}, x as (select r.* from raw r join documents a on a.doc_id = r.doc_id join documents b on b.doc_id = r.query_id where a.lang = b.lang) select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from x qualify rank <= 20",
    "o108_bm25_arm": f"with {_T}, x as (select query_id, doc_id, round(score + case when source = 'course_wiki' then 0.08::double else 0 end, 6) as score from raw join documents using (doc_id)) select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from x qualify rank <= 5",
    "o110_two_branch": f"with {_T}, a as (select query_id, doc_id, score, 1 as branch from raw join documents using (doc_id) where doc_kind = 'syllabus' qualify row_number() over (partition by query_id order by score desc, doc_id) <= 5), b as (select query_id, doc_id, score, 2 as branch from raw join documents using (doc_id) where doc_kind in ('notes', 'syllabus') qualify row_number() over (partition by query_id order by score desc, doc_id) <= 5), u as (select * from a union all select * from b where (query_id, doc_id) not in (select (query_id, doc_id) from a)) select *, row_number() over (partition by query_id order by score desc, doc_id)::int as place from u",
    "o251_votes": f"with {_VOTE} select vote::int as vote, count(*) as n, count(*) filter (requires) as yes from vt group by 1",
    "o273_normal_votes": f"with {_VOTE} select target, source, vote::int as vote, coalesce(requires, false) as requires, round(greatest(0.0, least(1.0, confidence * 1.25::double)), 6) as confidence from vt",
    "o172_candidate_rows": f"with {_PAIR}, x as (select pr.*, s.d = t.d as same, coalesce(s.s < t.s, false) as later from pr join c t on t.vec_id = target join c s on s.vec_id = source) select target, source, unnest(['vector', 'rule', 'structure', 'confidence']) as kind, unnest([cosine, case when same then 1.0::double else 0.5 end, case when later then 0.3::double else 0 end, confidence]) as score from x",
    "o270_candidate_links": f"with {_PAIR} select target, count(*) as links, max(confidence) as best from pr group by 1",
    "o271_verify_links": f"with {_PAIR}, p as (select target, source, confidence, (source + target) % 3 = 0 as cached from pr), n as (select * from p where not cached order by confidence desc, target, source limit 3000) select target, source, cached from p where cached union all select target, source, cached from n",
    "o274_signals": f"with {_CON} select t.vec_id as target, s.vec_id as source, s.b <= t.b as bloom_allowed, (case when s.b > t.b then 0 when s.d = t.d then 1 else 0.5 end)::double as rule, (case when coalesce(s.s < t.s, false) then 0.3 else 0 end)::double as structure from c t, c s where t.vec_id <> s.vec_id",
    "o277_public": f"with {BLK} select regexp_replace(title, '^第[一二三四五六七八九十0-9]+[章讲节周]\\s*', '') as concept, coalesce(bool_or(regexp_matches(upper(trim(course_code)), '^(?:{'|'.join(PUBLIC)})')), false) as public from blk where title is not null group by 1",
    "o272_concept_types": f"with {CAT} select case " + " ".join(f"when regexp_matches(course_name, '(?:{p})$') then '{n}'" for n, p in SUFFIX_TYPES) + " else 'concept' end as type, count(*) as n from cat where course_name is not null group by 1",
    "o142_fallback_concepts": f"with r as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '([一-鿿]{{2,8}})', 1))) as term from documents where text is not null), t as (select *, case " + " ".join(f"when regexp_matches(term, '(?:{p})$') then '{n}'" for n, p in SUFFIX_TYPES) + " end as type from r), k as (select *, replace(case when length(regexp_replace(term, '(?:" + "|".join(MODIFIERS) + ")+$', '')) > 0 then regexp_replace(term, '(?:" + "|".join(MODIFIERS) + ")+$', '') else term end, '的', '') as key from t where type is not null), m as (select doc_id, key, min((term, type)) as x from k group by all) select x[2] as type, x[1] as term, count(*) as docs from m group by all",
    "o141_field_only": "select doc_id, not contains(regexp_replace(text, '(?m)^(?:重点|难点|考核内容|考核方式)[^\\n。]*', '', 'g'), '考核') as field_only from documents where text like '%考核%'",
    "o140_evidence_sentence": f"with {BLK}, b as (select node_id, text, regexp_replace(title, '^第[一二三四五六七八九十0-9]+[章讲节周]\\s*', '') as topic from blk where text is not null and title is not null), s as (select node_id, [x for x in string_split_regex(text, '[。！？\\n]') if length(x) > 0 and contains(x, topic)] as l from b where topic <> '') select node_id, l[1] as sentence from s where len(l) > 0",
    "o159_markdown": "with r as (select doc_id, [x for x in string_split(text, chr(10)) if trim(x, ' ') <> ''] as l from documents where doc_kind = 'schedule' and text is not null) select doc_id, len(l)::int as rows, '| ' || replace(l[1], chr(9), ' | ') || ' |' as first from r",
    "o178_official_semester": f"with {OFF}, o as (select {_C} as code, offering_id, program_name, {column_sql('semester')} as s from off where course_code is not null) select code, program_name, nullif(arg_min(coalesce(s, -1), offering_id), -1) as semester from o where program_name is not null group by all union all select code, '', min(s) from o group by 1",
    "o208_merge_unique": f"with {BLK}, c as (select document_hash, chunk_id, min((node_id, i)) as o from (select document_hash, node_id, generate_subscripts(chunk_ids, 1) as i, unnest(chunk_ids) as chunk_id from blk) group by all), g as (select document_hash, count(*)::int as n, arg_min(chunk_id, o) as first from c group by 1) select document_hash, coalesce(n, 0)::int as n, first from (select distinct document_hash from blk where chunk_ids is not null) left join g using (document_hash)",
    "o209_share": f"with {OFF}, o as (select {_C} as code, program_name, offering_id, string_split(instructor, '、') as n from off where course_code is not null and program_name is not null and instructor is not null), l as (select offering_id, n, lag(offering_id) over w as before, lag(n) over w as bn from o window w as (partition by code, program_name order by offering_id)) select offering_id, before, list_has_any(n, bn) as shared from l where before is not null",
    "o187_relation": f"""with {LOG}, {CAT}, {_LINK}, {_GATE}, nm as (select lower(v) as name, min(course_code) as code from (select course_code, unnest([course_name, course_code]) as v from cat) where length(v) > 1 group by 1), mt as (select query_id, name, code, instr(lower(query), name) as st from lg join nm on contains(lower(query), name)), mm as (select query_id, code, min(st) as st from mt where not exists (select 1 from mt o where o.query_id = mt.query_id and length(o.name) > length(mt.name) and contains(o.name, mt.name)) group by all), tw as (select query_id, arg_min(code, st) as a, arg_max(code, st) as b from mm group by 1 having count(*) = 2),
h1 as (select code as below, parent as top, parent || '>' || code as chain, 1 as k from link), h2 as (select h1.below, l.parent as top, l.parent || '>' || chain as chain, 2 as k from h1 join link l on l.code = h1.top where not contains(chain, l.parent)), h3 as (select h2.below, l.parent as top, l.parent || '>' || chain as chain, 3 as k from h2 join link l on l.code = h2.top where not contains(chain, l.parent)), hc as (select below, top, arg_min(chain, k) as chain from (select * from h1 union all select * from h2 union all select * from h3) group by all),
xl as (select source % 50 as f, target % 50 as g, source || '>' || target as x from ve where requires and origin in ('llm', 'human') and confidence >= 0.3), el as (select f, g, list_sort(list(distinct x))[1:3] as ex from xl where f <> g group by all), nb as (select tw.*, try_cast(regexp_extract(a, '(\\d+)$', 1) as bigint) % 50 as na, try_cast(regexp_extract(b, '(\\d+)$', 1) as bigint) % 50 as nb from tw),
j as (select nb.query_id, concat_ws(';', p.chain, q.chain) as ch, list_concat(coalesce(e.ex, []), coalesce(d.ex, []))[1:3] as ex from nb left join hc p on p.below = b and p.top = a left join hc q on q.below = a and q.top = b left join el e on e.f = na and e.g = nb.nb left join el d on d.f = nb.nb and d.g = na)
select query_id, case when ch <> '' then 'prerequisite' when len(ex) > 0 then 'knowledge' else 'refused' end as relation, case when ch <> '' then '{BEFORE}：' || ch when len(ex) > 0 then array_to_string(ex, '、') else '{NO_RELATION}' end as answer from j""",
    "o189_locate": f"with {CAT}, t as (select distinct substring(course_name, 3, 4) as topic from course_reference) select topic, count(*) as courses, min(course_code) as first from t join cat on contains(course_name, topic) where length(topic) = 4 group by 1",
    "o261_parent_excerpt": f"with {BLK} select node_id, title || chr(10) || substring(text, 1, 1200) as excerpt from blk where text is not null and title is not null",
    "o269_coverage_gate": "with g as (select source, count(*) as docs, round(avg((len(regexp_extract_all(text, '([一-鿿]{2,6}(?:理论|原理|方法|模型|系统))', 1)) > 0)::int::double), 6) as coverage from documents where text is not null and source is not null group by 1) select *, coverage >= 0.5 as passed from g",
    "o126_pairs": f"with {_PAIR}, l as (select * from pr where rank = 1 and target <> source qualify row_number() over (partition by source order by confidence desc, target) = 1) select target, source from l where source not in (select target from l)",
    "o243_graded_answers": f"with {LOG} select query_id, {_REF} as refused, coalesce(contains(answer, '学分') or contains(answer, 'credits'), false) as covered, coalesce(contains(answer, '《'), false) as cited, coalesce(length(answer), 0)::int as length from lg",
    "o139_canonical_name": f"with {CAT}, g as (select english_name, course_name, count(*) as n from cat where english_name <> '' and course_name is not null group by all) select english_name, arg_min(course_name, (-n, not regexp_matches(course_name, '[一-鿿]'), length(course_name), course_name)) as name from g group by 1",
    "o279_resolve_alias": f"with {SYL}, {CAT}, n as (select {key_sql('course_name')} as key, min(course_name) as canonical from cat group by 1), s as (select entry_id, (generate_subscripts(prerequisites, 1) - 1)::int as pos, unnest(prerequisites) as raw from syl) select entry_id, pos, canonical from s left join (select * from n where key <> '') m on m.key = {key_sql('raw')} where raw is not null",
    "o176_enrich": f"with {BLK} select document_hash, array_to_string(list_sort(list(distinct course_code)), ',') as courses from blk where course_code is not null group by 1",
    "o283_chunk_records": f"with {BLK}, c as (select document_hash, node_id, (generate_subscripts(chunk_ids, 1) - 1)::int as i, unnest(chunk_ids) as chunk_id from blk) select *, lag(chunk_id) over w as before, lead(chunk_id) over w as after, (row_number() over w - 1)::int as chunk_index from c window w as (partition by document_hash order by node_id, i)",
    "o260_evidence_items": f"with {_T}, hits as ({lexical._top('raw')}) select query_id, rank, doc_id, source, doc_kind, n_chars from hits join documents using (doc_id)",
    "o264_hit_citations": f"with {_T}, hits as ({lexical._top('raw')}), e as (select query_id, source, min(rank) as f from hits join documents using (doc_id) group by all) select query_id, string_agg(source, ',' order by f) as sources from e group by 1",
    "o241_graded": f"with {_T}, hits as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from raw where query_id <> doc_id qualify rank <= 10) select query_id, min(rank) filter (a.course_code = b.course_code) as first from hits h join documents a on a.doc_id = h.doc_id join documents b on b.doc_id = h.query_id group by 1",
    "o286_concept_stage": f"with {BLK}, x as (select node_id, kind, course_code, unnest(case when len(chunk_ids) > 0 then chunk_ids else [null] end) as chunk_id, case when text <> '' then nullif(regexp_replace(title, '^第[一二三四五六七八九十0-9]+[章讲节周]\\s*', ''), '') end as concept from blk where kind in ('chapter', 'section', 'schedule')) select node_id, kind, chunk_id, concept, course_code from x",
    "o287_manifest": f"with {_E} select count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets, bool_and(src < dst) as ordered from e",
    "o294_catalog_items": f"with {OFF}, g as (select program_name, count(distinct {_C}) filter (contains(concat_ws(' ', course_category, course_subcategory), '必修')) as r, count(distinct {_C}) as o from off where program_name is not null and course_code is not null group by 1) select program_name, case when r > 0 then r else o end as items from g",
    "o297_template": f"with {_PAIR}, p as (select pr.*, s.d || '-' || t.d as stratum from pr join c t on t.vec_id = target join c s on s.vec_id = source), s as (select stratum, row_number() over (partition by stratum order by sha256(target || ':' || source)) as r from p) select stratum, count(*) as population, count(*) filter (r <= 3) as selected from s group by 1",
    "o298_predictions": f"with {BLK} select distinct upper(trim(course_code)) as course_code, regexp_replace(title, '^第[一二三四五六七八九十0-9]+[章讲节周]\\s*', '') as concept from blk where title is not null and course_code is not null and regexp_replace(title, '^第[一二三四五六七八九十0-9]+[章讲节周]\\s*', '') <> ''",
    "o77_edge_pairs": f"with {_VOTE} select target, source, (source % 50) || '->' || (target % 50) as pair from vt where requires and vote = 0",
    "o204_structure_answer": f"""with {LOG}, {CAT}, {_LAT}, aq as (select query_id, query, course_code from lg where course_code is not null union all select course_code || '-s' || (i - 1), replace(t[i], '{{}}', course_name), course_code from (select cat.*, {STRUCTURE_TEMPLATES} as t from cat where course_name is not null), range(1, 4) r(i)),
x1 as (select *, coalesce(nullif(regexp_extract(query, '{CHAPTER_ASKED}', 1), ''), nullif(regexp_extract(query, '{CHAPTER_ASKED}', 2), '')) as cs, coalesce(nullif(regexp_extract(query, '{WEEK_ASKED}', 1), ''), nullif(regexp_extract(query, '{WEEK_ASKED}', 2), '')) as ws from aq), x2 as (select query_id, course_code, {cn_sql('cs')} as chapter, {cn_sql('ws')} as week, regexp_matches(query, '章节|大纲|目录|[Oo]utline') as ol from x1), x3 as (select * from x2 where chapter is not null or week is not null or ol),
bc as (select course_code, chapter, min(node_id) as oc from ch where chapter is not null group by all), wk as (select course_code, node_id, chapter, unnest(list_distinct(regexp_extract_all(text, '第\\s*([一二两三四五六七八九十百\\d]+)\\s*周', 1))) as w from ch), bw as (select course_code, {cn_sql('w')} as week, arg_min(node_id, (coalesce(chapter, 999), node_id)) as ow from wk group by all having {cn_sql('w')} is not null), sz as (select course_code, count(*) as chapters from ch group by 1)
select query_id, case when x3.chapter is not null then case when oc is not null then 'chapter' else 'unknown_chapter' end when x3.week is not null then case when ow is not null then 'week' else 'unknown_week' end when coalesce(chapters, 0) > 0 then 'outline' else 'no_outline' end as reaction, case when x3.chapter is not null then oc when x3.week is not null then ow end as node_id, coalesce(chapters, 0) as chapters from x3 left join bc on bc.course_code = x3.course_code and bc.chapter = x3.chapter left join bw on bw.course_code = x3.course_code and bw.week = x3.week left join sz on sz.course_code = x3.course_code""",
    "o109_dispatch": f"with {_LISTS}, x as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as r from raw), y as (select query_id, doc_id, row_number() over (partition by query_id order by round(0.75::double * coalesce(vec, 0) + 0.15::double * lex + 0.08::double * section, 8) desc, doc_id) as r from bf) select query_id, doc_id, 'bm25' as mode from x where r = 1 union all select query_id, doc_id, 'dense' from dense where dense_rank = 1 union all select query_id, doc_id, 'linear' from y where r = 1",
    "o196_schedule_prefix": f"with {_PATH} select doc_id, pos, coalesce([z for z in list_reverse(path) if regexp_matches(z, '周次|进度|安排')][1], path[-1]) as prefix from pa where len(path) > 0",
    "o74_pair_candidates": f"with {_CON} select floor(round(list_cosine_similarity(t.e, s.e), 6) * 10)::bigint as decile, count(*) as pairs from c t, c s where t.vec_id % 10 = 0 and t.vec_id <> s.vec_id group by 1",
}
_OWN = {"o106_linear_fusion", "o170_concept_pairs"}
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit() and k not in _OWN}
