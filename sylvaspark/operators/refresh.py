"""Incremental refresh and the feedback loop: manifests, caches, upserts, chunk ids, versions, review samples, rate limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvaspark.common import Steps, row_rank, table
from sylvaspark.functions import text as X
from sylvaspark.operators.vectors import _PAIR, _VOTE
from sylvaspark.operators.doctree import lines
from sylvaspark.operators.lexical import TOKENS
from sylvaspark.operators.fields import strip_sql
from sylvaspark.plans.inputs import LOG, OFF, SYL, log, syllabi

WINDOW_S, LIMIT = 60, 3


def manifest(files: DataFrame, path: str, content) -> DataFrame:
    """(path, hash) of the files."""
    return files.select(F.col(path).alias("path"), F.sha2(content, 256).alias("hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed, removed; files with the same hash are left out."""
    j = old.withColumnRenamed("hash", "_o").join(new.withColumnRenamed("hash", "_n"), "path", "full")
    c = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return j.select("path", c.alias("change")).where("change is not null")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def _manifests(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    t = F.col("text")
    return manifest(d.where("doc_id % 10 <> 0"), "doc_id", t), manifest(d.where("doc_id % 10 <> 1"), "doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(t, F.lit("!"))).otherwise(t))


def o22_manifest_diff(spark, sf_dir):
    """Added, changed and removed files between two manifests."""
    return diff(*_manifests(spark, sf_dir))


def o23_manifest_update(spark, sf_dir):
    """The manifest after an update; removed files stay until they are dropped by name."""
    old, new = _manifests(spark, sf_dir)
    return upsert(old, new, "path")


def o24_incremental(spark, sf_dir):
    """Rows after an incremental run: those of unchanged files, and new ones of files that were added or changed."""
    old, new = _manifests(spark, sf_dir)
    d = Steps(spark).write(diff(old, new))
    kept = old.join(d.where("change <> 'added'"), "path", "left_anti").select("path", F.lit("kept").alias("state"))
    made = new.join(d.where("change <> 'removed'"), "path", "left_semi").select("path", F.lit("parsed").alias("state"))
    return kept.unionByName(made)


def path_matches(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, path): for each asked path the known one that equals it, else the first that ends with it after a slash, else the first that it ends with after a slash; no row where none does. Paths meet by their tails, not all with all."""
    tails = lambda d, c: d.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))).alias("tail"))
    k, a = known.select("path").where("path is not null").distinct(), asked.select("asked").where("asked is not null").distinct()
    whole_asked = tails(k, "path").join(a.withColumn("tail", F.col("asked")), "tail").select("asked", "path")
    whole_known = tails(a, "asked").join(k.withColumn("tail", F.col("path")), "tail").select("asked", "path")
    both = whole_asked.unionByName(whole_known).withColumn("how", F.when(F.col("path") == F.col("asked"), 0).when(F.length("path") > F.length("asked"), 1).otherwise(2))
    return both.groupBy("asked").agg(F.min_by("path", F.struct("how", "path")).alias("path"))


def o25_path_match(spark, sf_dir):
    """Files of syllabi asked for by their path, by its last part, below another folder and by a name that none has."""
    p = syllabi(spark, sf_dir).select(F.col("source_file").alias("path")).where("source_file is not null").distinct()
    asked = p.select(F.explode(F.array(F.col("path"), F.element_at(F.split("path", "/"), -1), F.concat(F.lit("archive/"), "path"), F.concat(F.lit("x"), "path"))).alias("asked"))
    return path_matches(p, asked)


def o26_groups(spark, sf_dir):
    """Entries by course and year; rows without either are left out."""
    s = syllabi(spark, sf_dir).where("course_code is not null and source_year is not null and source_year <> ''")
    return s.groupBy(F.upper(F.trim("course_code")).alias("code"), "source_year").agg(F.count("*").alias("entries"), F.max("source_file").alias("last_file"))


def o27_profiles(spark, sf_dir):
    """Profiles recomputed for affected courses only: of each, the last file's."""
    s = syllabi(spark, sf_dir).where("course_name is not null")
    touched = s.where("entry_id % 3 = 0").select("course_name").distinct()
    return s.join(touched, "course_name", "left_semi").groupBy("course_name").agg(F.max_by("entry_id", F.struct("source_file", "entry_id")).alias("entry_id"))


def o28_cache_misses(spark, sf_dir):
    """Documents whose content is not in the cache of an earlier run."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.join(d.where("doc_id % 4 = 0").select("hash").distinct(), "hash", "left_anti").select("doc_id")


def o29_extraction_key(spark, sf_dir):
    """Cache keys of extraction: version, model, kind and text."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.sha2(F.concat_ws("\x1f", F.lit("v1"), F.lit("rules"), "course_code", "doc_kind", "text"), 256).alias("key"))


def o30_validation_key(spark, sf_dir):
    """Cache keys of validation: configuration of the votes and the records of both concepts."""
    from sylvaspark.operators.vectors import _vectors, concepts, o170_concept_pairs

    c = concepts(_vectors(spark, sf_dir))
    record = F.concat_ws("|", F.col("vec_id").cast("string"), F.col("discipline").cast("string"), F.col("bloom").cast("string"), F.coalesce(F.col("semester").cast("string"), F.lit("-")), F.col("course").cast("string"))
    r = c.select("vec_id", record.alias("r"))
    j = o170_concept_pairs(spark, sf_dir).select("target", "source").join(r.select(F.col("vec_id").alias("source"), F.col("r").alias("sr")), "source").join(r.select(F.col("vec_id").alias("target"), F.col("r").alias("tr")), "target")
    return j.select("target", "source", F.sha2(F.concat_ws("\x1f", F.lit("votes=3"), "sr", "tr"), 256).alias("key"))


def o9_log_records(spark, sf_dir):
    """Log rows as the JSON lines that are appended."""
    q = log(spark, sf_dir).where("course_code is not null")
    return q.select("query_id", F.to_json(F.struct("course_code", "persona", "latency_ms")).alias("record"))


def _chunks(spark, sf_dir):
    l = lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", X.text_hash(F.regexp_replace("line", "[^ -~一-鿿。，；：？！\\s]", "")).alias("hash"), F.length("line").alias("n"))
    return l


def o79_remap(spark, sf_dir):
    """New ids of old chunks: the same id, else the same document and text, else a text that is unique and long enough, else none."""
    c = Steps(spark).write(_chunks(spark, sf_dir))
    new = c.withColumn("new_id", F.concat_ws("#", "doc_id", F.col("pos") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)))
    old = c.withColumn("old_id", F.concat_ws("#", "doc_id", "pos")).where("doc_id % 2 = 0")
    by_id = new.select(F.col("new_id").alias("old_id"), F.lit(1).alias("same"))
    by_doc = new.groupBy("doc_id", "hash").agg(F.min("new_id").alias("in_doc"))
    unique = new.groupBy("hash").agg(F.count("*").alias("k"), F.min("new_id").alias("anywhere")).where("k = 1").drop("k")
    j = old.join(by_id, "old_id", "left").join(by_doc, ["doc_id", "hash"], "left").join(unique, "hash", "left")
    to = F.when(F.col("same").isNotNull(), F.col("old_id")).otherwise(F.coalesce("in_doc", F.when(F.col("n") >= 8, F.col("anywhere"))))
    return j.select("old_id", to.alias("new_id"))


def o80_remap_counts(spark, sf_dir):
    """Chunks that are unchanged, mapped and stale, over records and the citations nested in them: each record cites itself and the lines before it of its document."""
    m = Steps(spark).write(o79_remap(spark, sf_dir))
    at = F.split("old_id", "#")
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(-2, -1)
    records = m.select("old_id", at[0].alias("doc"), at[1].cast("int").alias("pos")).withColumn("citations", F.collect_list("old_id").over(w))
    ids = records.select(F.lit("record").alias("place"), "old_id").unionByName(records.select(F.lit("citation").alias("place"), F.explode("citations").alias("old_id")))
    status = F.when(F.col("new_id").isNull(), "stale").when(F.col("new_id") == F.col("old_id"), "unchanged").otherwise("mapped")
    return ids.join(m, "old_id").groupBy("place", status.alias("status")).agg(F.count("*").alias("n"))


def o81_corrections(spark, sf_dir):
    """Texts after corrections by id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    fix = d.where("doc_id % 9 = 0").select("doc_id", F.lit("xx").alias("new_lang"))
    return d.join(fix, "doc_id", "left").select("doc_id", F.coalesce("new_lang", "lang").alias("lang"))


def o82_edge_fixes(spark, sf_dir):
    """Edges after some are deleted and others added, each once; only types in capitals are added."""
    from sylvaspark.operators.graphs import part_edges

    e = part_edges(spark, sf_dir).withColumn("type", F.lit("PREREQUISITE_OF"))
    gone = e.where("dst % 5 = 0").select("src", "dst")
    add = e.where("dst % 10 = 0").select("src", "dst", F.when(F.col("dst") % 20 == 0, "RELATED_TO").otherwise("bad type").alias("type")).where("type rlike '^[A-Z][A-Z_]*$'")
    return e.join(gone, ["src", "dst"], "left_anti").unionByName(add).distinct()


def o78_review_samples(spark, sf_dir):
    """Questions for review: with negative feedback or an uncertain check, with the reasons."""
    q = log(spark, sf_dir)
    bad = q.where("latency_ms > 3000").select("query_id").distinct().withColumn("slow", F.lit("negative_feedback"))
    uncertain = F.when(F.coalesce(F.col("status").isin("degraded", "fallback"), F.lit(False)), "uncertain_verification")
    r = q.join(bad, "query_id", "left").select("query_id", F.array_join(F.array_compact(F.array("slow", uncertain)), ",").alias("reasons"))
    return r.where("reasons <> ''")


def o248_uncertain(spark, sf_dir):
    """Records of which any verification label is neutral or a contradiction: the votes of a link, labelled by what they say."""
    from sylvaspark.operators.vectors import _votes

    label = F.when(~F.col("requires"), "contradiction").when(F.col("confidence") < 0.3, "neutral (weak)").otherwise("entailment")
    g = _votes(spark, sf_dir).groupBy("target", "source").agg(F.collect_list(label).alias("labels"))
    return g.select("target", "source", F.exists("labels", lambda x: F.lower(x).rlike("neutral|contradiction")).alias("uncertain"))


def o166_apply(spark, sf_dir):
    """Corrected samples by kind of issue, and whether the index has to be rebuilt."""
    q = log(spark, sf_dir)
    kind = F.when(F.col("query_type").isin("content", "structure"), "chunking").when(F.col("query_type") == "dependency", "graph").otherwise("embedding")
    return q.groupBy(kind.alias("issue")).agg(F.count("*").alias("n")).withColumn("rebuild", F.col("issue") != "graph")


def versions(names: DataFrame) -> DataFrame:
    """(name, base, version) of collection names that end in _v and a number."""
    return names.select("name", F.regexp_extract("name", "^(.*)_v[0-9]+$", 1).alias("base"), F.regexp_extract("name", "_v([0-9]+)$", 1).try_cast("int").alias("version"))


def _names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("_v"), (F.col("doc_id") % 12).cast("string"))).otherwise("")).alias("name")).distinct()


def o162_parse_version(spark, sf_dir):
    """Version numbers of collection names, null without one."""
    return versions(_names(spark, sf_dir)).select("name", "version")


def o161_next_version(spark, sf_dir):
    """The next version of each collection."""
    v = versions(_names(spark, sf_dir)).where("version is not null")
    return v.groupBy("base").agg((F.max("version") + 1).alias("next")).select("base", F.concat("base", F.lit("_v"), "next").alias("next_name"))


def o160_active(spark, sf_dir):
    """The version each alias points to; the alias itself if that version is gone."""
    v = versions(_names(spark, sf_dir)).where("version is not null")
    alias = v.select("base").distinct().select(F.col("base").alias("alias"), F.concat("base", F.lit("_v"), F.when(F.length("base") % 2 == 0, "11").otherwise("99")).alias("name"))
    return alias.join(v.select("name", F.lit(True).alias("there")), "name", "left").select("alias", F.when(F.col("there"), F.col("name")).otherwise(F.col("alias")).alias("active"))


def o163_history(spark, sf_dir):
    """Alias history: the last fifty pointers of each source, the newest last."""
    d = table(spark, sf_dir, "documents").where("source is not null")
    newest = d.select("source", "doc_id", row_rank(["source"], F.col("doc_id").desc()).alias("r")).where("r <= 50")
    return newest.groupBy("source").agg(F.count("*").alias("kept"), F.max("doc_id").alias("active"))


def o165_index_version(spark, sf_dir):
    """What a new index version holds: vectors and lexical statistics in one row."""
    from sylvaspark.operators.lexical import corpus_size

    v = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"))
    n = corpus_size(table(spark, sf_dir, "documents")).select("n_docs", F.round("avg_len", 6).alias("avg_len"))
    return v.crossJoin(n)  # one row each


def rate_limited(events: DataFrame, client: str, at: str, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """(client, at, allowed): a call is refused while `limit` allowed calls of the client are younger than the window; refused calls don't count, and a call leaves the window when it is older.

    One pass in time order over rows that are partitioned by client: the state is the open window, not the client's history."""
    rows = events.select(F.col(client).alias("client"), F.col(at).alias("at")).repartition("client").sortWithinPartitions("client", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, open_ = object(), deque()
        for b in batches:
            out = []
            for c, t in zip(b["client"], b["at"]):
                if c != who:
                    who, open_ = c, deque()
                while open_ and (t - open_[0]).total_seconds() > window_s:
                    open_.popleft()
                ok = len(open_) < limit
                if ok:
                    open_.append(t)
                out.append(ok)
            b["allowed"] = out
            yield b

    return rows.mapInPandas(run, f"client {dict(rows.dtypes)['client']}, at timestamp, allowed boolean")


def o245_rate_limit(spark, sf_dir):
    """Events per user and minute that a limit of three would allow."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return rate_limited(e, "user_id", "t").groupBy("client").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("calls"))


def o247_log_schema(spark, sf_dir):
    """Log rows by day with the share of each status, and mean latency."""
    q = log(spark, sf_dir)
    return q.groupBy(F.to_date("asked_at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.round(F.avg("latency_ms"), 4).alias("latency"))


def o252_weights(spark, sf_dir):
    """The rerank weights as a row."""
    from sylvaspark.operators.vectors import BOOST, LEXICAL, VECTOR

    return spark.createDataFrame([(VECTOR, LEXICAL, BOOST)], "vector double, lexical double, section double")


def o246_feedback(spark, sf_dir):
    """Feedback events by type and day, negative ones flagged."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n")).withColumn("negative", F.col("event_type") == "error")


def o293_fact_items(spark, sf_dir):
    """Two facts of each course, one per field first."""
    from sylvaspark.plans.inputs import offerings

    o = offerings(spark, sf_dir).where("course_code is not null").withColumn("code", F.upper(F.trim("course_code")))
    v = o.groupBy("code").agg(F.min_by(F.struct("credits", "hours", "semester"), "offering_id").alias("v"))
    f = v.select("code", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit("credits").alias("field"), F.col("v.credits").alias("value")), F.struct(F.lit(2).alias("k"), F.lit("hours").alias("field"), F.col("v.hours").alias("value")), F.struct(F.lit(3).alias("k"), F.lit("semester").alias("field"), F.col("v.semester").alias("value")))).alias("f")).select("code", "f.*")
    f = f.where(~X.is_missing(F.col("value")))
    return f.withColumn("r", row_rank(["code"], F.col("k"))).where("r <= 2").select("code", "field", "value")


_MAN = "d as (select * from documents where text is not null), om as (select doc_id as path, sha256(text) as hash from d where doc_id % 10 <> 0), nm as (select doc_id as path, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as hash from d where doc_id % 10 <> 1), df as (select * from (select path, case when om.hash is null then 'added' when nm.hash is null then 'removed' when om.hash <> nm.hash then 'changed' end as change from om full join nm using (path)) where change is not null)"
_CH = "ln as (select doc_id, (generate_subscripts(a, 1) - 1)::int as pos, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null)), c as (select doc_id, pos, sha256(lower(regexp_replace(regexp_replace(line, '[^ -~一-鿿。，；：？！\\s]', '', 'g'), '\\s+', '', 'g'))) as hash, length(line) as n from ln where trim(line, ' ') <> ''), nw as (select *, doc_id || '#' || (pos + case when doc_id % 3 = 0 then 1 else 0 end) as new_id from c), ol as (select *, doc_id || '#' || pos as old_id from c where doc_id % 2 = 0), bd as (select doc_id, hash, min(new_id) as in_doc from nw group by all), un as (select hash, min(new_id) as anywhere from nw group by 1 having count(*) = 1), mp as (select old_id, case when old_id in (select new_id from nw) then old_id else coalesce(in_doc, case when n >= 8 then anywhere end) end as new_id from ol left join bd using (doc_id, hash) left join un using (hash))"
_VN = "nv as (select distinct source || case when doc_id % 5 > 0 then '_v' || (doc_id % 12) else '' end as name from documents), vv as (select name, regexp_extract(name, '^(.*)_v[0-9]+$', 1) as base, try_cast(regexp_extract(name, '_v([0-9]+)$', 1) as int) as version from nv)"
_C = "upper(trim(course_code))"
SQL = {
    "o22_manifest_diff": f"with {_MAN} select * from df",
    "o23_manifest_update": f"with {_MAN} select * from nm union all select * from om where path not in (select path from nm)",
    "o24_incremental": f"with {_MAN} select path, 'kept' as state from om where path not in (select path from df where change <> 'added') union all select path, 'parsed' from nm where path in (select path from df where change <> 'removed')",
    "o25_path_match": f"with {SYL}, p as (select distinct source_file as path from syl where source_file is not null), a as (select distinct unnest([path, string_split(path, '/')[-1], 'archive/' || path, 'x' || path]) as asked from p), j as (select asked, path, case when path = asked then 0 when length(path) > length(asked) then 1 else 2 end as how from a join p on path = asked or ends_with(path, '/' || asked) or ends_with(asked, '/' || path)) select asked, arg_min(path, (how, path)) as path from j group by 1",
    "o26_groups": f"with {SYL} select {_C} as code, source_year, count(*) as entries, max(source_file) as last_file from syl where course_code is not null and source_year <> '' group by all",
    "o27_profiles": f"with {SYL} select course_name, arg_max(entry_id, (source_file, entry_id)) as entry_id from syl where course_name in (select course_name from syl where entry_id % 3 = 0) group by 1",
    "o28_cache_misses": "select doc_id from documents where text is not null and sha256(text) not in (select sha256(text) from documents where text is not null and doc_id % 4 = 0)",
    "o29_extraction_key": "select doc_id, sha256(concat_ws(chr(31), 'v1', 'rules', course_code, doc_kind, text)) as key from documents where text is not null",
    "o30_validation_key": f"with {_PAIR}, r as (select vec_id, vec_id || '|' || d || '|' || b || '|' || coalesce(s::varchar, '-') || '|' || k as r from c) select target, source, sha256('votes=3' || chr(31) || a.r || chr(31) || b.r) as key from pr join r a on a.vec_id = source join r b on b.vec_id = target",
    "o79_remap": f"with {_CH} select * from mp",
    "o80_remap_counts": f"with {_CH}, r as (select old_id, case when new_id is null then 'stale' when new_id = old_id then 'unchanged' else 'mapped' end as status, split_part(old_id, '#', 1) as doc, split_part(old_id, '#', 2)::int as pos from mp), ct as (select status, lead(old_id, 1) over w as a, lead(old_id, 2) over w as b from r window w as (partition by doc order by pos)) select place, status, sum(n)::bigint as n from (select 'record' as place, status, count(*) as n from r group by status union all select 'citation', status, (count(a) + count(b)) as n from ct group by status) group by all having sum(n) > 0",
    "o81_corrections": "select doc_id, case when doc_id % 9 = 0 then 'xx' else lang end as lang from documents",
    "o82_edge_fixes": "with k as (select p_partkey::bigint as k from part where p_partkey > 1), e as (select distinct src, dst from (select unnest([k // 2, k // 3]) as src, k as dst from k) where src > 0) select src, dst, 'PREREQUISITE_OF' as type from e where dst % 5 <> 0 union select src, dst, 'RELATED_TO' from e where dst % 20 = 0",
    "o78_review_samples": f"with {LOG}, r as (select query_id, concat_ws(',', case when latency_ms > 3000 then 'negative_feedback' end, case when status in ('degraded', 'fallback') then 'uncertain_verification' end) as reasons from lg) select * from r where reasons <> ''",
    "o248_uncertain": f"with {_VOTE} select target, source, bool_or(not requires or confidence < 0.3) as uncertain from vt group by all",
    "o166_apply": f"with {LOG} select issue, count(*) as n, issue <> 'graph' as rebuild from (select case when query_type in ('content', 'structure') then 'chunking' when query_type = 'dependency' then 'graph' else 'embedding' end as issue from lg) group by 1",
    "o162_parse_version": f"with {_VN} select name, version from vv",
    "o161_next_version": f"with {_VN} select base, base || '_v' || (max(version) + 1) as next_name from vv where version is not null group by base",
    "o160_active": f"with {_VN}, a as (select distinct base as alias, base || '_v' || case when length(base) % 2 = 0 then '11' else '99' end as name from vv where version is not null) select alias, case when name in (select name from vv) then name else alias end as active from a",
    "o163_history": "select source, least(50, count(distinct doc_id)) as kept, max(doc_id) as active from documents where source is not null group by 1",
    "o247_log_schema": f"with {LOG} select asked_at::date::varchar as day, count(*) as n, count(*) filter (status = 'ok') as ok, round(avg(latency_ms), 4) as latency from lg group by 1",
    "o293_fact_items": f"with {OFF}, v as (select {_C} as code, arg_min(coalesce(credits, chr(1)), offering_id) as c, arg_min(coalesce(hours, chr(1)), offering_id) as h, arg_min(coalesce(semester, chr(1)), offering_id) as s from off where course_code is not null group by 1), f as (select code, unnest([1, 2, 3]) as k, unnest(['credits', 'hours', 'semester']) as field, unnest([c, h, s]) as value from v), g as (select *, row_number() over (partition by code order by k) as r from f where value <> chr(1) and {strip_sql('value')} not in {X.sql_list(X.ANSWER_MISSING)}) select code, field, value from g where r <= 2",
    "o252_weights": "select 0.75::double as vector, 0.15::double as lexical, 0.08::double as section",
    "o246_feedback": "select event_type, ts::date::varchar as day, count(*) as n, event_type = 'error' as negative from events group by all",
}
SQL["o165_index_version"] = f"with {TOKENS} select (select count(*) from embeddings) as vectors, n_docs, round(avg_len, 6) as avg_len from n"
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit()}
