"""Dense search, fusion with lexical search, pair scoring, clusters, votes.

Searches take the vectors whose id is divisible by 50 against all vectors. Both sides are packed into blocks of vectors and multiplied as matrices, block against block; each pair of blocks keeps its own best before anything is shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaspark.common import Steps, row_rank, table
from sylvaspark.functions import text as X
from sylvaspark.operators import lexical
from sylvaspark.operators.fields import key_sql
from sylvaspark.operators.lexical import half_up

BLOCK = 1024
# Weights of fusion and pair scoring, thresholds and bonuses.
VECTOR, LEXICAL, BOOST = 0.75, 0.15, 0.08
RRF = 60
ORDER_BONUS, DECAY, CONFIDENCE, TOP = 0.3, 0.85, 0.45, 5
CLUSTER = 0.94
MIN_VOTE = 0.6


def blocks(df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = BLOCK) -> DataFrame:
    """(ids, flat): blocks of about `size` vectors."""
    return df.where(f"{vector} is not null").select(F.expr(f"div({key}, {size})").alias("b"), F.struct(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).alias("x")).groupBy("b").agg(F.collect_list("x").alias("x")).select("b", F.col("x.id").alias("ids"), F.flatten("x.v").alias("flat"))


def _matrix(ids, flat) -> np.ndarray:
    m = np.asarray(flat, dtype=np.float64).reshape(len(ids), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def cosine_pairs(queries: DataFrame, vectors: DataFrame, k: int | None = None, least: float | None = None, key: str = "vec_id") -> DataFrame:
    """(query_id, id, cosine): of every pair of blocks the k best per query, or all of cosine `least` or more; a vector of zeros has cosine 0 to all."""
    q = blocks(queries, key).select(F.col("ids").alias("qi"), F.col("flat").alias("qf"))
    d = blocks(vectors, key).select("ids", "flat")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qf, ids, flat in zip(b["qi"], b["qf"], b["ids"], b["flat"]):
                qi, ids = np.asarray(qi), np.asarray(ids)
                c = np.clip(_matrix(qi, qf) @ _matrix(ids, flat).T, -1, 1)
                if least is not None:
                    r, s = np.nonzero(c >= least)
                elif k is not None and len(ids) > k:
                    bar = -np.partition(-c, k - 1, axis=1)[:, k - 1 : k]
                    r, s = np.nonzero(c >= bar - 1e-6)  # ties at the rounded score stay for the final order
                else:
                    r, s = np.nonzero(c > -2)
                yield pd.DataFrame({"query_id": qi[r], "id": ids[s], "cosine": c[r, s]})

    return d.join(q, F.lit(True)).mapInPandas(run, "query_id long, id long, cosine double")


def top_cosine(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    c = cosine_pairs(queries, vectors, k=k).withColumn("cosine", F.round("cosine", 6))
    return c.withColumn("rank", row_rank(["query_id"], F.col("cosine").desc(), F.col("id"))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Clamped cosine of two arrays; 0 for zero vectors and different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def o169_dense_topk(spark, sf_dir):
    """The ten nearest vectors of each query vector by cosine."""
    v = _vectors(spark, sf_dir)
    return top_cosine(v.where("vec_id % 50 = 0"), v, 10)


def o12_vector_index(spark, sf_dir):
    """Vectors with their attributes as they are stored: norm, size and scalar metadata."""
    dot = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return _vectors(spark, sf_dir).select("vec_id", F.size("embedding").alias("dims"), F.round(F.sqrt(dot), 5).alias("norm"), "label")


def _ranked_lists(spark, sf_dir, shares=None):
    """Dense and lexical lists of 20 of each query: documents and vectors share ids. Queries and documents without a vector are in the lexical lists only. `shares`: the lexical scores of a search that is there already."""
    v = _vectors(spark, sf_dir)
    dense = top_cosine(v.where("vec_id % 50 = 0"), v, 20).select("query_id", F.col("id").alias("doc_id"), F.col("cosine").alias("vec"), F.col("rank").alias("dense_rank"))
    bm = lexical.top(lexical.ranked(spark, sf_dir, 20, "normalized").drop("kind") if shares is None else shares, 20).select("query_id", "doc_id", F.col("score").alias("lex"), F.col("rank").alias("lex_rank"))
    return dense, bm


def _fused(spark, sf_dir, shares=None):
    dense, bm = _ranked_lists(spark, sf_dir, shares)
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_kind") == "syllabus").cast("double").alias("section"))
    return dense.join(bm, ["query_id", "doc_id"], "full").join(d, "doc_id", "left")


def o107_rrf_fusion(spark, sf_dir):
    """Reciprocal ranks of both lists, summed, and a section boost; where each hit came from."""
    part = lambda r: F.coalesce(1 / (RRF + F.col(r)), F.lit(0.0))
    j = _fused(spark, sf_dir).withColumn("score", F.round(part("dense_rank") + part("lex_rank") + BOOST * 0.1 * F.coalesce("section", F.lit(0.0)), 6))
    came = F.when(F.col("lex_rank").isNull(), "dense").when(F.col("dense_rank").isNull(), "bm25").otherwise("both")
    return lexical.top(j.select("query_id", "doc_id", "score", came.alias("found_by")), 10)


def _backfilled(spark, sf_dir, shares=None):
    """Candidates of both lists; lexical-only ones get their true cosine, null where the query or the document has no vector."""
    v = _vectors(spark, sf_dir)
    j = _fused(spark, sf_dir, shares)
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    e = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("de"))
    full = j.join(e, "doc_id", "left").join(q, "query_id", "left").withColumn("vec", F.coalesce("vec", F.when(F.col("de").isNotNull() & F.col("qe").isNotNull(), F.round(cosine(F.col("de"), F.col("qe")), 6))))
    return full.select("query_id", "doc_id", "vec", F.coalesce("lex", F.lit(0.0)).alias("lex"), F.coalesce("section", F.lit(0.0)).alias("section"), F.col("dense_rank").isNull().alias("lexical_only"))


def o106_linear_fusion(spark, sf_dir, shares=None):
    """Weighted vector, lexical and section scores of the candidates of both lists; lexical-only ones get their true cosine, 0 where there is no vector to compare."""
    j = _backfilled(spark, sf_dir, shares).withColumn("score", F.round(VECTOR * F.coalesce("vec", F.lit(0.0)) + LEXICAL * F.col("lex") + BOOST * F.col("section"), 8))
    return lexical.top(j.select("query_id", "doc_id", "score", "lexical_only"), 10)


def o267_lexical_only(spark, sf_dir):
    """Hits that only the lexical list has, with their cosine; those without a vector are dropped."""
    return _backfilled(spark, sf_dir).where("lexical_only and vec is not null").select("query_id", "doc_id", "vec", "lex")


def _gold(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl"))


def o239_weight_sweep(spark, sf_dir):
    """Recall at 5 and mean reciprocal rank of 100 weightings, all in one job, over the queries that have a label; a hit is relevant if it has the same."""
    grid = [(v, x, s) for v in (0.55, 0.65, 0.75, 0.85, 0.95) for x in (0.05, 0.15, 0.25, 0.35, 0.45) for s in (0.0, 0.04, 0.08, 0.12)]
    ql, dl = _gold(spark, sf_dir)
    j = Steps(spark).write(_backfilled(spark, sf_dir).join(ql, "query_id").join(dl, "doc_id", "left").where("query_id <> doc_id"))
    g = spark.createDataFrame(grid, "wv double, wl double, ws double")
    s = j.join(F.broadcast(g), F.lit(True)).withColumn("score", F.round(F.col("wv") * F.coalesce("vec", F.lit(0.0)) + F.col("wl") * F.col("lex") + F.col("ws") * F.col("section"), 8))  # 100 rows
    r = s.withColumn("rank", row_rank(["wv", "wl", "ws", "query_id"], F.col("score").desc(), F.col("doc_id")))
    hit = r.groupBy("wv", "wl", "ws", "query_id").agg(F.min(F.when(F.col("ql") == F.col("dl"), F.col("rank"))).alias("first"))
    return hit.groupBy("wv", "wl", "ws").agg(F.round(F.avg(F.coalesce((F.col("first") <= 5).cast("double"), F.lit(0.0))), 6).alias("recall5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def o240_sensitivity(spark, sf_dir):
    """One weight varied at a time around the best of the sweep."""
    s = Steps(spark).write(o239_weight_sweep(spark, sf_dir))
    best = s.agg(F.min_by(F.struct("wv", "wl", "ws"), F.struct(-F.col("mrr"), -F.col("recall5"), "wv", "wl", "ws")).alias("b"))
    j = s.join(F.broadcast(best), F.lit(True))
    same = [(F.col(c) == F.col("b")[c]).cast("int") for c in ("wv", "wl", "ws")]
    return j.where(same[0] + same[1] + same[2] >= 2).select("wv", "wl", "ws", "recall5", "mrr")


def concepts(v: DataFrame) -> DataFrame:
    """Vectors as concepts: discipline, Bloom level, semester, course and whether the course is required of all."""
    return v.select("vec_id", "embedding", F.col("label").alias("discipline"), (F.col("vec_id") % 3).alias("bloom"), F.when(F.col("vec_id") % 11 != 0, 1 + F.col("vec_id") % 8).alias("semester"), (F.col("vec_id") % 50).alias("course")).where("course % 17 <> 0")


def _concept_blocks(c: DataFrame) -> DataFrame:
    """Blocks of concepts with their attributes; -1 stands for no semester."""
    x = F.struct(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("discipline").cast("string").alias("d"), "bloom", F.coalesce("semester", F.lit(-1)).alias("s"), "course")
    g = c.where("embedding is not null").groupBy(F.expr(f"div(vec_id, {BLOCK})").alias("b")).agg(F.collect_list(x).alias("x"))
    return g.select(F.col("x.id").alias("ids"), F.flatten("x.v").alias("flat"), F.col("x.d").alias("d"), F.col("x.bloom").alias("bloom"), F.col("x.s").alias("s"), F.col("x.course").alias("course"))


def pair_scores(c: DataFrame, k: int = TOP) -> DataFrame:
    """(target, source, cosine, confidence) of the k best sources, and those that tie with them, of every pair of blocks for the targets whose id is divisible by 10: mean of cosine, order bonus and rule, less across disciplines, rounded before the threshold. What Bloom levels, semesters and courses exclude never leaves a task."""
    t = _concept_blocks(c.where("vec_id % 10 = 0"))
    t = t.select(*[F.col(x).alias(f"t_{x}") for x in t.columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                ti, si = np.asarray(r["t_ids"]), np.asarray(r["ids"])
                a = {x: (np.asarray(r[f"t_{x}"])[:, None], np.asarray(r[x])[None, :]) for x in ("bloom", "s", "course", "d")}
                cos = np.maximum(np.clip(_matrix(ti, r["t_flat"]) @ _matrix(si, r["flat"]).T, -1, 1), 0)
                same, known = a["d"][0] == a["d"][1], (a["s"][0] >= 0) & (a["s"][1] >= 0)
                score = (cos + np.where(known & (a["s"][1] < a["s"][0]), ORDER_BONUS, 0.0) + np.where(same, 1.0, 0.5)) / 3 * np.where(same, 1.0, DECAY)
                fits = (a["course"][0] != a["course"][1]) & (a["bloom"][1] <= a["bloom"][0]) & ~(known & (a["s"][1] > a["s"][0])) & (score >= CONFIDENCE - 1e-6)
                score = np.where(fits, score, -1.0)
                bar = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] if score.shape[1] > k else -1.0
                i, j = np.nonzero((score >= bar - 1e-6) & (score > 0))
                yield pd.DataFrame({"target": ti[i], "source": si[j], "cosine": cos[i, j], "confidence": score[i, j]})

    pairs = _concept_blocks(c).join(t, F.lit(True)).mapInPandas(run, "target long, source long, cosine double, confidence double")
    return pairs.select("target", "source", F.round("cosine", 6).alias("cosine"), F.round("confidence", 6).alias("confidence")).where(F.col("confidence") >= CONFIDENCE)


def cosine_deciles(queries: DataFrame, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """(decile, pairs): different pairs by tenth of their rounded cosine; each pair of blocks gives its counts only."""
    q = blocks(queries, key).select(F.col("ids").alias("qi"), F.col("flat").alias("qf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qf, ids, flat in zip(b["qi"], b["qf"], b["ids"], b["flat"]):
                c = half_up(np.clip(_matrix(qi, qf) @ _matrix(ids, flat).T, -1, 1))[np.asarray(qi)[:, None] != np.asarray(ids)[None, :]]
                d, n = np.unique(np.floor(c * 10).astype(np.int64), return_counts=True)
                yield pd.DataFrame({"decile": d, "pairs": n})

    return blocks(vectors, key).select("ids", "flat").join(q, F.lit(True)).mapInPandas(run, "decile long, pairs long").groupBy("decile").agg(F.sum("pairs").alias("pairs"))


def o170_concept_pairs(spark, sf_dir):
    """The five most confident sources of each target."""
    p = pair_scores(concepts(_vectors(spark, sf_dir)))
    return p.withColumn("rank", row_rank(["target"], F.col("confidence").desc(), F.col("cosine").desc(), F.col("source"))).where(F.col("rank") <= TOP)


def o92_merge_pairs(spark, sf_dir):
    """Pairs of two arms merged: best scores, arms and count."""
    p = o170_concept_pairs(spark, sf_dir)
    arm2 = p.select("target", "source", (F.col("cosine") * 0.9).alias("cosine"), (F.col("confidence") * 0.95).alias("confidence")).where("rank <= 3").withColumn("arm", F.lit("b"))
    both = p.select("target", "source", "cosine", "confidence").withColumn("arm", F.lit("a")).unionByName(arm2)
    return both.groupBy("target", "source").agg(F.round(F.max("cosine"), 6).alias("cosine"), F.round(F.max("confidence"), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set("arm")), "").alias("arms"), F.count("*").alias("n"))


def _votes(spark, sf_dir):
    p = o170_concept_pairs(spark, sf_dir)
    v = p.select("target", "source", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("vote"))
    return v.select("target", "source", "vote", ((F.col("source") * 31 + F.col("target") * 17 + F.col("vote")) % 5 < 4).alias("requires"), ((F.col("source") + F.col("target") * 3 + F.col("vote") * 7) % 100 / 100).alias("confidence"), F.concat(F.lit("r"), ((F.col("source") + F.col("vote")) % 3).cast("string")).alias("reason"))


def o93_vote_verify(spark, sf_dir):
    """Votes of each pair: unanimous with a mean of 0.6 or more, or a simple majority; the most frequent reason, ties longest, then first by letters."""
    v = _votes(spark, sf_dir)
    g = v.groupBy("target", "source").agg(F.bool_and("requires").alias("unanimous"), F.avg("confidence").alias("mean"), F.count_if("requires").alias("yes"), F.count("*").alias("n"))
    r = v.groupBy("target", "source", "reason").agg(F.count("*").alias("k")).groupBy("target", "source").agg(F.min_by("reason", F.struct(-F.col("k"), -F.length("reason"), "reason")).alias("reason"))
    return g.join(r, ["target", "source"]).select("target", "source", "unanimous", F.round("mean", 6).alias("mean"), (F.col("unanimous") & (F.col("mean") >= MIN_VOTE)).alias("strict"), (F.col("yes") * 2 > F.col("n")).alias("majority"), "reason")


def o101_merged_status(spark, sf_dir):
    """The worst outcome of the votes of each target."""
    v = _votes(spark, sf_dir)
    severity = F.when(~F.col("requires"), 5).when(F.col("confidence") < 0.3, 2).when(F.col("confidence") < 0.6, 1).otherwise(0)
    status = F.when(~F.col("requires"), "refused").when(F.col("confidence") < 0.3, "pruned").when(F.col("confidence") < 0.6, "rewritten").otherwise("passed")
    return v.groupBy("target").agg(F.max_by(status, severity).alias("status"), F.count("*").alias("attempts"), F.bool_and("requires").alias("verified"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the least id that links lead to. Labels move along links and to the label of their label, until none changes."""
    spark = nodes.sparkSession
    steps = Steps(spark)
    both = steps.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = steps.write(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m")).withColumnRenamed("a", "id")
        step = labels.join(near, "id", "left").select("id", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("was"))
        step = steps.write(step)
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = steps.write(step.join(jump, "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root"), "was"))
        changed = new.where("root <> was").limit(1).count()
        labels = new.select("id", "root")
        if not changed:
            return labels


def o137_clusters(spark, sf_dir):
    """Vectors of one exact key (their first ten values, rounded) or linked by cosines of 0.94 or more, each with the least id of its component. All vectors of a key are linked to the least of them, so copies don't pair up."""
    v = _vectors(spark, sf_dir)
    key = F.array_join(F.transform(F.slice("embedding", 1, 10), lambda x: F.round(x, 3).cast("string")), ",")
    keyed = v.where("embedding is not null").select("vec_id", key.alias("key"))
    same = keyed.join(keyed.groupBy("key").agg(F.min("vec_id").alias("first")), "key").where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    pairs = cosine_pairs(v, v, least=CLUSTER - 1e-9).where("query_id < id").select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    return components(pairs.unionByName(same), v.select(F.col("vec_id").alias("id")))


def o88_canonical(spark, sf_dir):
    """Alike course names of the syllabi as one concept: most frequent spelling, spellings in order, hashed id."""
    s = table(spark, sf_dir, "syllabus_courses").select("entry_id", "course_name").distinct().where("course_name is not null")
    g = s.withColumn("key", X.course_key(F.col("course_name"))).where("key <> ''").groupBy("key", "course_name").agg(F.count("*").alias("n"), F.min("entry_id").alias("first"))
    c = g.groupBy("key").agg(F.min_by("course_name", F.struct(-F.col("n"), "first")).alias("canonical"), F.array_sort(F.collect_set("course_name")).alias("aliases"), F.sum("n").alias("n"))
    return c.select(F.concat(F.lit("concept_"), F.substring(F.sha2("key", 256), 1, 16)).alias("id"), "canonical", F.size("aliases").alias("n_aliases"), "n")


def _signed(words: pd.Series, dims: int, name: str) -> list:
    out = []
    for t in words:
        v = np.zeros(dims)
        for w in t:
            h = hashlib.sha256(w.encode()).digest() if name == "sha256" else hashlib.md5(w.encode()).digest()
            if name == "sha256":
                v[int.from_bytes(h[:4], "little") % dims] += 1.0 if h[4] & 1 else -1.0
            else:
                v[int.from_bytes(h[:4], "big") % dims] += (1.0 if h[4] & 1 else -1.0) * (1 + h[5] / 255)
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def hash_embedding(df: DataFrame, key: str, text: str, dims: int = 384, name: str = "sha256") -> DataFrame:
    """(key, embedding): signed feature hashing of words, for sha256 in lower case; a text without words has zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = b["w"].map(lambda t: t.lower().split()) if name == "sha256" else b["w"]
            yield pd.DataFrame({key: b[key], "embedding": _signed(w, dims, name)})

    t = F.coalesce(text, F.lit(""))
    words = df.select(key, (t if name == "sha256" else F.filter(F.split(t, r"\s+"), lambda x: x != "")).alias("w"))
    return words.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")


def o167_hash_embedding(spark, sf_dir):
    """Hash vectors of all documents: their size, and the number of places in use."""
    d = table(spark, sf_dir, "documents")
    e = hash_embedding(d, "doc_id", "text")
    return e.select("doc_id", F.size("embedding").alias("dims"), F.size(F.filter("embedding", lambda x: x != 0)).alias("used"))


def o168_md5_embedding(spark, sf_dir):
    """Weighted hash vectors of block titles."""
    b = table(spark, sf_dir, "blocks").select("node_id", "title").distinct()
    return hash_embedding(b, "node_id", "title", 128, "md5").select("node_id", F.round(F.array_max("embedding"), 6).alias("largest"))


_VEC = "v as (select vec_id, embedding::double[] as e, label from embeddings)"
_CON = "c as (select vec_id, embedding::double[] as e, label as d, vec_id % 3 as b, case when vec_id % 11 <> 0 then 1 + vec_id % 8 end as s, vec_id % 50 as k from embeddings where (vec_id % 50) % 17 <> 0)"
_PAIR = f"{_CON}, sc as (select t.vec_id as target, s.vec_id as source, greatest(0.0, list_cosine_similarity(t.e, s.e)) as cs, case when s.d = t.d then 1.0 else 0.5 end as rule, case when coalesce(s.s < t.s, false) then 0.3 else 0.0 end as ord, case when s.d = t.d then 1.0 else 0.85 end as decay from c t, c s where t.vec_id % 10 = 0 and t.k <> s.k and s.b <= t.b and not coalesce(s.s > t.s, false)), cf as (select target, source, round(cs, 6) as cosine, round((cs + ord::double + rule::double) / 3 * decay::double, 6) as confidence from sc), pr as (select *, row_number() over (partition by target order by confidence desc, cosine desc, source)::int as rank from cf where confidence >= 0.45 qualify rank <= 5)"
_VOTE = f"{_PAIR}, vt as (select target, source, vote, (source * 31 + target * 17 + vote) % 5 < 4 as requires, ((source + target * 3 + vote * 7) % 100) / 100 as confidence, 'r' || ((source + vote) % 3) as reason from pr, range(0, 3) r(vote))"
_LISTS = f"""{lexical.TOKENS}, {_VEC}, dn as (select q.vec_id as query_id, d.vec_id as doc_id, round(list_cosine_similarity(q.e, d.e), 6) as vec from v q, v d where q.vec_id % 50 = 0), dense as (select *, row_number() over (partition by query_id order by vec desc, doc_id) as dense_rank from dn qualify dense_rank <= 20),
bmx as (select query_id, doc_id, score as lex from nrm), bm as (select *, row_number() over (partition by query_id order by lex desc, doc_id) as lex_rank from bmx qualify lex_rank <= 20),
fu as (select f.*, coalesce((doc_kind = 'syllabus')::int::double, 0.0) as section from (select * from dense full join bm using (query_id, doc_id)) f left join documents using (doc_id)),
bf as (select query_id, doc_id, coalesce(vec, round(list_cosine_similarity(q.e, d.e), 6)) as vec, coalesce(lex, 0.0) as lex, section, dense_rank is null as lexical_only from fu left join v q on q.vec_id = query_id left join v d on d.vec_id = doc_id)"""
_SWEEP = f"""{_LISTS}, grid as (select a::double as wv, b::double as wl, s::double as ws from unnest([0.55, 0.65, 0.75, 0.85, 0.95]) x(a), unnest([0.05, 0.15, 0.25, 0.35, 0.45]) y(b), unnest([0.0, 0.04, 0.08, 0.12]) z(s)), jj as (select bf.*, coalesce(q.label = d.label, false) as rel from bf join v q on q.vec_id = query_id left join v d on d.vec_id = doc_id where query_id <> doc_id),
rk as (select wv, wl, ws, query_id, rel, row_number() over (partition by wv, wl, ws, query_id order by round(wv * coalesce(vec, 0) + wl * lex + ws * section, 8) desc, doc_id) as rank from jj, grid), ft as (select wv, wl, ws, query_id, min(rank) filter (rel) as first from rk group by all), sw as (select wv, wl, ws, round(avg(coalesce((first <= 5)::int::double, 0)), 6) as recall5, round(avg(coalesce(1 / first, 0)), 6) as mrr from ft group by all)"""
SQL = {
    "o169_dense_topk": f"with {_VEC}, s as (select q.vec_id as query_id, d.vec_id as id, round(list_cosine_similarity(q.e, d.e), 6) as cosine from v q, v d where q.vec_id % 50 = 0) select *, row_number() over (partition by query_id order by cosine desc, id)::int as rank from s qualify rank <= 10",
    "o12_vector_index": f"with {_VEC} select vec_id, len(e)::int as dims, round(sqrt(list_dot_product(e, e)), 5) as norm, label from v",
    "o107_rrf_fusion": f"with {_LISTS}, s as (select query_id, doc_id, round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + lex_rank), 0) + 0.008::double * section, 6) as score, case when lex_rank is null then 'dense' when dense_rank is null then 'bm25' else 'both' end as found_by from fu) select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s qualify rank <= 10",
    "o106_linear_fusion": f"with {_LISTS}, s as (select query_id, doc_id, round(0.75::double * coalesce(vec, 0) + 0.15::double * lex + 0.08::double * section, 8) as score, lexical_only from bf) select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s qualify rank <= 10",
    "o267_lexical_only": f"with {_LISTS} select query_id, doc_id, vec, lex from bf where lexical_only and vec is not null",
    "o239_weight_sweep": f"with {_SWEEP} select * from sw",
    "o240_sensitivity": f"with {_SWEEP}, b as (select * from sw order by mrr desc, recall5 desc, wv, wl, ws limit 1) select sw.* from sw, b where (sw.wv = b.wv)::int + (sw.wl = b.wl)::int + (sw.ws = b.ws)::int >= 2",
    "o170_concept_pairs": f"with {_PAIR} select * from pr",
    "o92_merge_pairs": f"with {_PAIR}, both_ as (select target, source, cosine, confidence, 'a' as arm from pr union all select target, source, cosine * 0.9::double, confidence * 0.95::double, 'b' from pr where rank <= 3) select target, source, round(max(cosine), 6) as cosine, round(max(confidence), 6) as confidence, array_to_string(list_sort(list(distinct arm)), '') as arms, count(*) as n from both_ group by all",
    "o93_vote_verify": f"with {_VOTE}, g as (select target, source, bool_and(requires) as unanimous, avg(confidence) as mean, count(*) filter (requires) as yes, count(*) as n from vt group by all), r as (select target, source, arg_min(reason, (-k, -length(reason), reason)) as reason from (select target, source, reason, count(*) as k from vt group by all) group by all) select target, source, unanimous, round(mean, 6) as mean, unanimous and mean >= 0.6 as strict, yes * 2 > n as majority, reason from g join r using (target, source)",
    "o101_merged_status": f"with {_VOTE}, s as (select *, case when not requires then 5 when confidence < 0.3 then 2 when confidence < 0.6 then 1 else 0 end as sev from vt) select target, case max(sev) when 5 then 'refused' when 2 then 'pruned' when 1 then 'rewritten' else 'passed' end as status, count(*) as attempts, bool_and(requires) as verified from s group by target",
    "o88_canonical": f"with s as (select distinct entry_id, course_name from syllabus_courses where course_name is not null), g as (select {key_sql('course_name')} as key, course_name, count(*) as n, min(entry_id) as f from s group by all) select 'concept_' || substring(sha256(key), 1, 16) as id, arg_min(course_name, (-n, f)) as canonical, count(*)::int as n_aliases, sum(n)::bigint as n from g where key <> '' group by key",
    "o137_clusters": f"with recursive {_VEC}, e as (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and (list_cosine_similarity(a.e, b.e) >= 0.94 - 1e-9 or [round(x, 3) for x in a.e[1:10]] = [round(x, 3) for x in b.e[1:10]])), r as (select vec_id as id, vec_id as root from v union select e.b, r.root from r join e on e.a = r.id) select id, min(root) as root from r group by id",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit()}
