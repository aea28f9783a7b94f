"""Lexical statistics, BM25 and overlap search.

Queries are the documents whose id is divisible by 50, each with its whole text; all documents are searched. Tokens are counted within the row that holds the text, so only document frequencies are shuffled. A search cuts documents into shards and queries into blocks: each pair of a shard and a block is scored as one small product, and a task keeps the best over all of its shards, so pairs of documents that can't be among the best never leave a task. idf always comes from the whole corpus, before any filter."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaspark.common import Steps, join_lookup, row_rank, spread, table
from sylvaspark.functions import text as X

K1, B, TOP = 1.5, 0.75, 5
#: Documents in a shard and queries in a block; a term is multiplied rather than added if it stands in one of so many pairs of a query and a document.
SHARD, BLOCK, MATRIX = 2048, 2048, 500
#: Shards that a task scores for one block, and that a file holds, where every match is given; more rows in a batch take more memory.
SHARDS = 4
_LATIN, _NOT_HAN = re.compile("[a-z][a-z0-9]+"), re.compile("[^一-鿿]+")


def count_tokens(text: str | None) -> Counter:
    """Counts of the tokens of one text; the same tokens as `functions.text.tokens`."""
    low = (text or "").lower()
    han = _NOT_HAN.sub("", low)
    found = Counter(_LATIN.findall(low))
    found.update(map("".join, zip(han, han[1:])))
    return found


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, len): term counts per document, with the document's length in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SHARD):
                b = whole.slice(at, SHARD)
                counts = [count_tokens(t) for t in b.column(1).to_pylist()]
                n = [len(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([t for c in counts for t in c], pa.string()), pa.array([k for c in counts for k in c.values()], pa.int64()), pa.array(np.repeat([c.total() for c in counts], n).astype(np.int64))],
                    names=[key, "term", "tf", "len"])

    out = T.StructType([docs.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("len", T.LongType())])
    return spread(docs.select(key, text)).mapInArrow(run, out)


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many documents each term stands; counted per task before the shuffle."""
    terms = spread(docs.select(text)).select(F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def lexical_stats(df: DataFrame, least: int = 2) -> DataFrame:
    """(term, df) of terms in `least` documents or more."""
    return df.where(F.col("df") >= least)


def corpus_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents with at least one token, and their mean length."""
    n = docs.select(F.size(X.tokens(F.col(text))).alias("len")).where("len > 0")
    return n.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def idf(df, n):
    return F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as Spark rounds: halves go away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits, x)


def _row(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False)


def _one(types: dict, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(t)) for v, t in zip(values, types.values())], names=list(types))


def _packed(docs: DataFrame, key: str, text: str, group: Column | None, size: int) -> DataFrame:
    """(ids, kinds, lens, vocab, df, n, of, tfs): token counts of up to `size` documents in one row: the terms and in how many of the documents they stand; per document its number of terms, and of these the place in `vocab` and the count. No shuffle: each batch packs its own rows. Documents without an id count in the statistics only; their rows have no ids."""
    types = {"ids": pa.int64(), "kinds": pa.string(), "lens": pa.int64(), "vocab": pa.string(), "df": pa.int64(), "n": pa.int32(), "of": pa.int32(), "tfs": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in batches:
            known = pc.is_valid(both.column(0))
            for whole, named in ((both.filter(known), True), (both.filter(pc.invert(known)), False)):
                for at in range(0, whole.num_rows, size):
                    b = whole.slice(at, size)
                    counts = [count_tokens(t) for t in b.column(1).to_pylist()]
                    terms = pa.array([t for c in counts for t in c], pa.string()).dictionary_encode()
                    of, vocab = terms.indices.to_numpy(), terms.dictionary
                    yield _one(types, [b.column(0) if named else [], b.column(2) if named else [], [c.total() for c in counts], vocab, np.bincount(of, minlength=len(vocab)), [len(c) for c in counts], of, [k for c in counts for k in c.values()]])

    kind = F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias(key), text, kind.alias("_kind"))
    return spread(rows).mapInArrow(run, "ids array<long>, kinds array<string>, lens array<long>, vocab array<string>, df array<long>, n array<int>, of array<int>, tfs array<int>")


def _query_blocks(weighted: DataFrame) -> DataFrame:
    """(qids, full, qvocab, w, qn, qrow): up to BLOCK queries in one row, from (query_id, full, terms): the terms with their weights and numbers of queries, and these queries' places, term by term."""
    types = {"qids": pa.int64(), "full": pa.float64(), "qvocab": pa.string(), "w": pa.float64(), "qn": pa.int32(), "qrow": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                pairs = b.column(2).flatten()
                terms = pairs.field(0).dictionary_encode()
                of, vocab = terms.indices.to_numpy(), terms.dictionary
                w = np.zeros(len(vocab))
                w[of] = pairs.field(1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
                yield _one(types, [b.column(0), b.column(1), vocab, w, np.bincount(of, minlength=len(vocab)), row[np.argsort(of, kind="stable")]])

    return weighted.select("query_id", "full", "terms").mapInArrow(run, "qids array<long>, full array<double>, qvocab array<string>, w array<double>, qn array<int>, qrow array<int>")


class _Shard:
    """The documents of one row of `_packed`: what each posting adds to a score before the weight of its term (`part`), the order by term (`by`) and the documents in that order (`row`)."""

    def __init__(self, b: pa.RecordBatch, avg: float, bm25: bool):
        self.ids, self.kinds, self.vocab = _row(b, "ids"), _row(b, "kinds"), b.column("vocab").flatten()
        doc, tf = np.repeat(np.arange(len(self.ids)), _row(b, "n")), _row(b, "tfs").astype(float)
        self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * _row(b, "lens")[doc] / avg)) if bm25 else np.ones(len(tf))
        self.by = np.argsort(_row(b, "of"), kind="stable")
        self.row, self.df = doc[self.by], _row(b, "df")
        self.at = np.cumsum(self.df) - self.df


class _Pair:
    """Scores of one shard for one block of queries. Terms that many queries and documents have are multiplied as matrices, others added one by one."""

    def __init__(self, s: _Shard, b: pa.RecordBatch):
        self.s, self.queries = s, len(b.column("qids").flatten())
        place = pc.fill_null(pc.index_in(s.vocab, value_set=b.column("qvocab").flatten()), -1).to_numpy(zero_copy_only=False)
        self.terms = np.flatnonzero(place >= 0)  # of the shard's
        place, qn = place[self.terms], _row(b, "qn")
        self.w, self.qn, self.qrow, self.qat = _row(b, "w")[place], qn[place], _row(b, "qrow"), (np.cumsum(qn) - qn)[place]

    def _askers(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries that ask for each of the (local) terms, and the places of these in the list."""
        n = self.qn[terms]
        return self.qrow[np.repeat(self.qat[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(terms)), n)

    def scores(self) -> np.ndarray:
        """Queries by documents."""
        s = self.s
        there = s.df[self.terms]
        dense = self.qn * there * MATRIX >= self.queries * len(s.ids)
        few, left, right = np.flatnonzero(dense), np.zeros((self.queries, dense.sum())), np.zeros((dense.sum(), len(s.ids)))
        left[self._askers(few)] = 1
        n, start = there[few], s.at[self.terms[few]]
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        right[np.repeat(np.arange(len(few)), n), s.row[at]] = s.part[s.by[at]] * np.repeat(self.w[few], n)
        out = left @ right
        flat, rest = out.ravel(), np.flatnonzero(~dense & (there > 0))
        n = there[rest]
        post, t = np.repeat(s.at[self.terms[rest]] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(rest, n)
        doc, part, asked = s.row[post], s.part[s.by[post]] * self.w[t], self.qn[t].astype(int)
        ends = np.cumsum(asked)
        at = 0
        while at < len(post):  # so many single additions at once
            to = max(at + 1, np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right"))
            x, m = slice(at, to), asked[at:to]
            q = self.qrow[np.repeat(self.qat[t[x]] - np.cumsum(m) + m, m) + np.arange(m.sum())].astype(int)
            np.add.at(flat, q * len(s.ids) + np.repeat(doc[x], m), np.repeat(part[x], m))
            at = to
        return out


class _Best:
    """Of one block of queries the k best documents so far, with all that tie with the last of them at six decimals."""

    def __init__(self, qids: np.ndarray, full: np.ndarray, k: int):
        self.qids, self.full, self.k = qids, full, k
        self.slack = 1e-6 * np.maximum(1.0, full)  # six decimals of the score or of its share
        self.bar, self.r, self.ids, self.scores = None, np.zeros(0, int), np.zeros(0, int), np.zeros(0)

    def add(self, found: np.ndarray, scores: np.ndarray) -> None:
        bar = self.bar
        if bar is None:
            bar = np.partition(scores, -self.k, axis=1)[:, -self.k] if scores.shape[1] > self.k else np.zeros(len(self.qids))
        low = np.maximum(bar - self.slack, 1e-300)
        r, c = np.divmod(np.flatnonzero((scores >= low[:, None]).ravel()), scores.shape[1])
        if not len(r):
            return
        r, ids, new = np.append(self.r, r), np.append(self.ids, found[c]), np.append(self.scores, scores[r, c])
        order = np.lexsort((-new, r))
        r, ids, new = r[order], ids[order], new[order]
        n = np.bincount(r, minlength=len(self.qids))
        first, self.bar = np.cumsum(n) - n, np.zeros(len(self.qids))
        enough = n >= self.k
        self.bar[enough] = new[first[enough] + self.k - 1]
        keep = new >= (self.bar - self.slack)[r]
        self.r, self.ids, self.scores = r[keep], ids[keep], new[keep]


def search(docs: DataFrame, k: int | None, scheme: str = "bm25", among: DataFrame | None = None, group: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, kind): of every part of the documents the k best per query and `group` (all that share a term if k is None), scores rounded.

    `scheme`: bm25; normalized, BM25 as a share of what a document of all query terms could reach; overlap, the share of the query's distinct terms; both, bm25 with the share beside it (`share`). `among`: the documents that may be found (default: all); statistics are those of all. A boost that is the same for all documents of a group can be added afterwards without losing any of the best. Documents with a null id or without tokens are neither queries nor found."""
    steps = Steps(docs.sparkSession)
    asked = steps.write(postings(docs.where(F.col(key) % 50 == 0), key, text).select(F.col(key).cast("long").alias("query_id"), "term"))
    few = SHARDS if k is None else 0
    packed = steps.write(_packed(docs, key, text, group, SHARD), most=few)
    size = packed.select(F.explode("lens").alias("len")).where("len > 0").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).first()
    n_docs, avg = size["n_docs"], size["avg_len"] or 1.0
    if scheme == "overlap":
        weighted = asked.withColumn("w", F.lit(1.0))
    else:
        stats = packed.select(F.explode(F.arrays_zip("vocab", "df")).alias("x")).groupBy(F.col("x.vocab").alias("term")).agg(F.sum("x.df").alias("df"))
        weighted = join_lookup(asked, steps.write(stats), "term", "inner").withColumn("w", idf(F.col("df"), F.lit(n_docs)))
    full = F.sum("w") * (1.0 if scheme == "overlap" else K1 + 1)
    queries = weighted.groupBy("query_id").agg(full.alias("full"), F.collect_list(F.struct("term", "w")).alias("terms"))  # the terms of one text
    blocks = -(-asked.select("query_id").distinct().count() // BLOCK) or 1
    queries = steps.write(_query_blocks(queries.repartition(blocks)))
    shards = packed if among is None else steps.write(_packed(among, key, text, group, SHARD), most=few)
    shards = shards.where(F.size("ids") > 0).withColumn("sid", F.monotonically_increasing_id())
    if k is None:  # as many matches as pairs leave a task, so a task has few of these
        shards = shards.repartitionByRange(-(-shards.count() // SHARDS) or 1, "sid")
        queries = queries.withColumn("bid", F.monotonically_increasing_id()).repartitionByRange(blocks, "bid")

    def found(qids, ids, scores, full_, kind) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(qids), 1 << 18):
            x = scores[i : i + (1 << 18)]
            share = np.divide(x, full_[i : i + (1 << 18)], out=np.zeros_like(x), where=full_[i : i + (1 << 18)] > 0) if scheme != "bm25" else None
            given = [half_up(v) for v in {"bm25": [x], "both": [x, share]}.get(scheme, [share])]
            yield pa.RecordBatch.from_arrays([pa.array(qids[i : i + (1 << 18)]), pa.array(ids[i : i + (1 << 18)]), *map(pa.array, given), pa.repeat(pa.scalar(kind, pa.string()), len(x))], names=["query_id", "doc_id", "score", *["share"] * (scheme == "both"), "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, best = None, {}
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                if sid != (sid := b.column("sid")[0].as_py()):
                    s = _Shard(b, avg, scheme != "overlap")
                    kinds = [(x, np.flatnonzero(s.kinds == x)) for x in sorted(set(s.kinds))]
                pair, qids, full_ = _Pair(s, b), _row(b, "qids"), _row(b, "full")
                scores = pair.scores()
                for kind, at in kinds:
                    at = at if len(kinds) > 1 else None
                    if k is None:
                        for q in range(0, len(qids), 128):  # so many rows at once
                            some = scores[q : q + 128] if at is None else scores[q : q + 128, at]
                            r, c = np.divmod(np.flatnonzero(some.ravel() > 0), some.shape[1])
                            yield from found(qids[q + r], s.ids[c if at is None else at[c]], some[r, c], full_[q + r], kind)
                    else:
                        if (qids[0], kind) not in best:
                            best[qids[0], kind] = _Best(qids, full_, k)
                        best[qids[0], kind].add(*((s.ids, scores) if at is None else (s.ids[at], scores[:, at])))
        for (_, kind), x in best.items():
            yield from found(x.qids[x.r], x.ids, x.scores, x.full[x.r], kind)

    pairs = shards.join(queries, F.lit(True))  # blocks of queries against shards
    return pairs.mapInArrow(run, "query_id long, doc_id long, score double, " + "share double, " * (scheme == "both") + "kind string")


def top(scored: DataFrame, k: int = TOP, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    return scored.withColumn("rank", row_rank([query], F.col("score").desc(), F.col(key))).where(F.col("rank") <= k)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def o129_tokens(spark, sf_dir):
    """Latin words and Han bigrams with their counts."""
    return postings(_docs(spark, sf_dir)).select("doc_id", "term", "tf")


def o130_term_set(spark, sf_dir):
    """Distinct tokens of each document."""
    return _docs(spark, sf_dir).select("doc_id", F.size(F.array_distinct(X.tokens(F.col("text")))).alias("n_terms"))


def o85_lexical_stats(spark, sf_dir):
    """Document frequency of terms in two documents or more."""
    return lexical_stats(document_frequency(_docs(spark, sf_dir)))


def o85_corpus_size(spark, sf_dir):
    """Documents, mean length and vocabulary."""
    d = _docs(spark, sf_dir)
    vocabulary = document_frequency(d).agg(F.count("*").alias("vocabulary"))
    return corpus_size(d).crossJoin(vocabulary).select("n_docs", F.round("avg_len", 6).alias("avg_len"), "vocabulary")  # one row each


def o131_idf(spark, sf_dir):
    """Inverse document frequency of every term."""
    d = _docs(spark, sf_dir)
    return document_frequency(d).crossJoin(F.broadcast(corpus_size(d))).select("term", F.round(idf(F.col("df"), F.col("n_docs")), 6).alias("idf"))  # one row of sizes


def ranked(spark, sf_dir, k=TOP, scheme="bm25", among=None, group=None):
    return search(_docs(spark, sf_dir), k, scheme, among, group)


def o128_bm25_topk(spark, sf_dir):
    """The five best documents of each query by BM25 (also the per-document score and the scorer choice)."""
    return top(ranked(spark, sf_dir).drop("kind"))


def o133_bm25_normalized(spark, sf_dir):
    """BM25 as a share of the score that a document of all query terms could reach."""
    return top(ranked(spark, sf_dir, scheme="normalized").drop("kind"))


def o135_overlap_topk(spark, sf_dir):
    """Share of the distinct query terms that a document holds."""
    return top(ranked(spark, sf_dir, scheme="overlap").drop("kind"))


def o34_filtered_search(spark, sf_dir):
    """BM25 with a filter on document attributes that is applied before the top five but leaves idf global."""
    d = _docs(spark, sf_dir).where((F.col("source") == "syllabus_portal") & F.col("doc_kind").isin("notes", "faq"))
    return top(ranked(spark, sf_dir, among=d).drop("kind"))


def o134_scorer_schemes(spark, sf_dir):
    """Lexical score of the best five under each scheme: none is 0, overlap, or normalised BM25."""
    bm, ov = o133_bm25_normalized(spark, sf_dir), o135_overlap_topk(spark, sf_dir)
    none = bm.withColumn("score", F.lit(0.0))
    return none.withColumn("scheme", F.lit("none")).unionByName(bm.withColumn("scheme", F.lit("bm25"))).unionByName(ov.withColumn("scheme", F.lit("overlap")))


def o124_topk_ids(spark, sf_dir):
    """The ids of the best five, in order, per query and source boost: each boost prefers one source."""
    boosts = spark.createDataFrame([("student", "faq_export", 0.1), ("teacher", "syllabus_portal", 0.1), ("visitor", "course_wiki", 0.1)], "persona string, boosted string, boost double")
    m = ranked(spark, sf_dir, scheme="normalized", group=F.col("source")).crossJoin(F.broadcast(boosts))  # three rows
    s = m.withColumn("score", F.round(F.col("score") + F.when(F.col("kind") == F.col("boosted"), F.col("boost")).otherwise(0.0), 6))
    r = s.withColumn("rank", row_rank(["persona", "query_id"], F.col("score").desc(), F.col("doc_id"))).where(F.col("rank") <= TOP)
    return r.groupBy("persona", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))


def o206_persona_overlap(spark, sf_dir):
    """Overlap, Jaccard and change of the first hit between the personas' lists, query by query."""
    ids = o124_topk_ids(spark, sf_dir)
    a, b = ids.select(F.col("persona").alias("p1"), "query_id", F.col("ids").alias("x")), ids.select(F.col("persona").alias("p2"), "query_id", F.col("ids").alias("y"))
    both = a.join(b, "query_id").where("p1 < p2")
    inter, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    small = F.least(F.size("x"), F.size("y"))
    return both.select("query_id", "p1", "p2", F.round(F.when(union == 0, 1.0).otherwise(inter / F.greatest(small, F.lit(1))), 6).alias("overlap"), F.round(F.when(union == 0, 1.0).otherwise(inter / union), 6).alias("jaccard"), (F.col("x")[0] != F.col("y")[0]).alias("top_changed"))


def o207_overlap_summary(spark, sf_dir):
    """Means of the comparison over all queries, per pair of personas."""
    return o206_persona_overlap(spark, sf_dir).groupBy("p1", "p2").agg(F.round(F.avg("overlap"), 6).alias("overlap"), F.round(F.avg("jaccard"), 6).alias("jaccard"), F.round(F.avg(F.col("top_changed").cast("double")), 6).alias("top_changed"))


TOKENS = """t as (select doc_id, lower(coalesce(text, '')) as low, source, doc_kind from documents),
h as (select doc_id, regexp_extract_all(low, '[a-z][a-z0-9]+') as latin, regexp_replace(low, '[^一-鿿]', '', 'g') as han from t),
tok as (select doc_id, list_concat(latin, [substring(han, i, 2) for i in range(1, length(han))]) as toks from h),
post as (select doc_id, term, count(*) as tf, any_value(len) as len from (select doc_id, len(toks) as len, unnest(toks) as term from tok) group by all),
dfs as (select term, count(*) as df from post group by term),
n as (select count(*) as n_docs, avg(len) as avg_len from (select doc_id, any_value(len) as len from post group by doc_id)),
q as (select doc_id as query_id, term from post where doc_id % 50 = 0),
w as (select query_id, term, greatest(0.0, ln(1 + (n_docs - df + 0.5) / (df + 0.5))) as idf, avg_len from q join dfs using (term), n),
m as (select query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as score from w join post using (term) group by all),
c as (select query_id, sum(idf) * 2.5 as ceiling from w group by query_id),
raw as (select query_id, doc_id, round(score, 6) as score from m),
nrm as (select query_id, doc_id, round(case when ceiling > 0 then score / ceiling else 0.0 end, 6) as score from m join c using (query_id)),
ovl as (select query_id, doc_id, round(k / n, 6) as score from (select query_id, doc_id, count(*) as k from q join post using (term) group by all) join (select query_id, count(*) as n from q group by 1) using (query_id))"""


def _top(source: str, where: str = "true") -> str:
    return f"select query_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {source} where {where}) where rank <= 5"


_PERSONA = """, boosts(persona, boosted, boost) as (values ('student', 'faq_export', 0.1::double), ('teacher', 'syllabus_portal', 0.1::double), ('visitor', 'course_wiki', 0.1::double)),
pr as (select persona, query_id, doc_id, row_number() over (partition by persona, query_id order by round(score + case when source = boosted then boost else 0 end, 6) desc, doc_id) as rank from nrm join documents using (doc_id), boosts),
pids as (select persona, query_id, list(doc_id order by rank) as ids from pr where rank <= 5 group by all),
cmp as (select a.query_id, a.persona as p1, b.persona as p2, len(list_intersect(a.ids, b.ids)) as i, len(list_distinct(list_concat(a.ids, b.ids))) as u, least(len(a.ids), len(b.ids)) as s, a.ids[1] <> b.ids[1] as top_changed from pids a join pids b using (query_id) where a.persona < b.persona)"""

_FILTER = "doc_id in (select doc_id from documents where source = 'syllabus_portal' and doc_kind in ('notes', 'faq'))"

SQL = {
    "o129_tokens": f"with {TOKENS} select doc_id, term, tf from post",
    "o130_term_set": f"with {TOKENS} select doc_id, len(list_distinct(toks))::int as n_terms from tok",
    "o85_lexical_stats": f"with {TOKENS} select * from dfs where df >= 2",
    "o85_corpus_size": f"with {TOKENS} select n_docs, round(avg_len, 6) as avg_len, (select count(*) from dfs) as vocabulary from n",
    "o131_idf": f"with {TOKENS} select term, round(greatest(0.0, ln(1 + (n_docs - df + 0.5) / (df + 0.5))), 6) as idf from dfs, n",
    "o128_bm25_topk": f"with {TOKENS} {_top('raw')}",
    "o133_bm25_normalized": f"with {TOKENS} {_top('nrm')}",
    "o135_overlap_topk": f"with {TOKENS} {_top('ovl')}",
    "o34_filtered_search": f"with {TOKENS} {_top('raw', _FILTER)}",
    "o134_scorer_schemes": f"with {TOKENS} select 'none' as scheme, query_id, doc_id, 0.0::double as score, rank from ({_top('nrm')}) union all select 'bm25', * from ({_top('nrm')}) union all select 'overlap', * from ({_top('ovl')})",
    "o124_topk_ids": f"with {TOKENS}{_PERSONA} select persona, query_id, ids from pids",
    "o206_persona_overlap": f"with {TOKENS}{_PERSONA} select query_id, p1, p2, round(i / greatest(s, 1), 6) as overlap, round(i / u, 6) as jaccard, top_changed from cmp",
    "o207_overlap_summary": f"with {TOKENS}{_PERSONA} select p1, p2, round(avg(round(i / greatest(s, 1), 6)), 6) as overlap, round(avg(round(i / u, 6)), 6) as jaccard, round(avg(top_changed::int::double), 6) as top_changed from cmp group by all",
}
QUERIES = {k: globals()[k] for k in SQL}
