"""Prerequisite graphs: closures, layers, chains, neighbourhoods, acceptance of edges.

Edges are (src, dst): src comes before dst. Loops run over distances, never over nodes, and write each round."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvaspark.common import Grown, Steps, row_rank, table
from sylvaspark.operators.vectors import components


def part_edges(spark, sf_dir) -> DataFrame:
    """Course k is built on k div 2 and k div 3."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k")).where("k > 1")
    return k.select(F.explode(F.array(F.expr("div(k, 2)"), F.expr("div(k, 3)"))).alias("src"), F.col("k").alias("dst")).where("src > 0").distinct()


def closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node, distance): every node before each target, itself with 0, by breadth first; ends on cycles too. Each round writes its new pairs only."""
    seen = Grown(Steps(targets.sparkSession), targets.select(F.col("target"), F.col("target").alias("node"), F.lit(0).alias("distance")))
    front, d = seen.last, 0
    while True:
        d += 1
        new = front.select("target", F.col("node").alias("dst")).join(edges, "dst").select("target", F.col("src").alias("node")).distinct().join(seen.all(), ["target", "node"], "left_anti")
        front = seen.add(new.withColumn("distance", F.lit(d)))
        if not front.limit(1).count():
            return seen.all()


def layers(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, layer): the longest path that leads to a node; and the nodes that are never free, on or behind a cycle.

    A node is free once as many of its prerequisites are done as it has. Each round follows the links of the nodes that the last one freed, so every link is followed once, and writes only what is new."""
    steps = Steps(edges.sparkSession)
    e = steps.write(edges.select("src", "dst").distinct())
    nodes = steps.write(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    needed = steps.write(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("needed")))
    done = Grown(steps, nodes.join(needed, "node", "left_anti").withColumn("layer", F.lit(0)))
    front, met, n = done.last, None, 0
    while True:
        n += 1
        new = e.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("met"))
        if met is None:
            met = Grown(steps, new)
            new = met.last
        else:
            new = met.add(new)
        sums = met.all().join(new.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("met").alias("met"))
        front = done.add(sums.join(needed, "node").where("met = needed").select("node", F.lit(n).alias("layer")))
        if not front.limit(1).count():
            return done.all(), nodes.join(done.all(), "node", "left_anti")


def distances(edges: DataFrame, most: int = 3) -> DataFrame:
    """(src, dst, distance) of all pairs at most `most` links apart."""
    known = Grown(Steps(edges.sparkSession), edges.where("src <> dst").select("src", "dst", F.lit(1).alias("distance")).distinct())
    front = known.last
    for d in range(2, most + 1):
        new = front.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").where("src <> dst").distinct().join(known.all(), ["src", "dst"], "left_anti")
        front = known.add(new.withColumn("distance", F.lit(d)))
    return known.all()


def accept(candidates: DataFrame) -> DataFrame:
    """Candidate edges (src, dst, confidence) in order of confidence, without repetitions and without those that close a cycle.

    The order decides, so each connected part is settled in one task; parts without a cycle need no order and are passed whole."""
    best = candidates.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).where("src <> dst")
    _, stuck = layers(best.select("src", "dst"))
    loop = best.join(stuck.select(F.col("node").alias("src")), "src", "left_semi").join(stuck.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "confidence")
    roots = components(loop.select(F.col("src").alias("a"), F.col("dst").alias("b")), loop.select(F.explode(F.array("src", "dst")).alias("id")).distinct())

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        kept = []
        for src, dst, c in part.sort_values(["confidence", "src", "dst"], ascending=[False, True, True])[["src", "dst", "confidence"]].itertuples(index=False):
            seen, stack = {dst}, [dst]
            while stack:
                for x in after.get(stack.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        stack.append(x)
            if src not in seen:
                after.setdefault(src, []).append(dst)
                kept.append((src, dst, c))
        return pd.DataFrame(kept, columns=["src", "dst", "confidence"])

    free = best.join(loop.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "confidence")
    settled = loop.join(roots.withColumnRenamed("id", "src"), "src").groupBy("root").applyInPandas(settle, loop.schema)
    return free.unionByName(settled)


def _targets(edges):
    return edges.select(F.col("dst").alias("target")).where("target % 50 = 0").distinct()


def o177_closure(spark, sf_dir):
    """Everything before each target course, with the shortest distance."""
    e = part_edges(spark, sf_dir)
    return closure(e, _targets(e))


def o177_layers(spark, sf_dir):
    """Earliest layer in which a course can be taken: the longest chain that leads to it."""
    return layers(part_edges(spark, sf_dir))[0]


def study_plans(edges: DataFrame, offers: DataFrame, asked: DataFrame) -> DataFrame:
    """(target, program, status, available, selected, courses, stages, plan, warnings) of every question for a study plan.

    `offers`: node, program, semester. `asked`: target and the program, null for none. The first status that holds: unknown_course, cycle_detected (what comes before the target is on or behind a cycle), no_prerequisites, program_not_found, program_required (none named and several offer the course), ok. A node's stage is one more than the longest chain that leads to it; chains that lead to what comes before a target lie in its own plan, so stages are made once for all targets. `plan` lists the codes of each stage in order; `warnings` counts links whose first course comes no earlier than the second in the selected program (in any, earliest, where none is selected)."""
    steps = Steps(edges.sparkSession)
    e = steps.write(edges.distinct())
    targets = steps.write(asked.select("target").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).union(offers.select("node")).distinct()
    known = steps.write(targets.join(nodes.withColumnRenamed("node", "target"), "target", "left_semi"))
    before = steps.write(closure(e, known))
    stage, stuck = layers(e)
    sizes = before.groupBy("target").agg((F.count("*") - 1).alias("above"))
    ring = known.join(stuck.withColumnRenamed("node", "target"), "target", "left_semi").withColumn("ring", F.lit(True))
    own = offers.where("program is not null").select(F.col("node").alias("target"), "program").distinct()
    programs = known.join(own, "target").groupBy("target").agg(F.sort_array(F.collect_set("program")).alias("programs"))  # the programs of one course
    q = asked.join(known.withColumn("known", F.lit(True)), "target", "left").join(sizes, "target", "left").join(ring, "target", "left").join(programs, "target", "left")
    n = F.coalesce(F.size("programs"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    looped = e.where("src = dst").select(F.col("src").alias("target"), F.lit(True).alias("looped")).distinct()
    q = q.join(looped, "target", "left")
    status = (F.when(F.col("known").isNull(), "unknown_course").when(F.col("ring") | F.col("looped"), "cycle_detected").when(F.col("above") == 0, "no_prerequisites")
              .when(F.col("program").isNotNull() & (n > 0) & ~F.array_contains("programs", F.col("program")), "program_not_found").when(F.col("program").isNull() & (n > 1), "program_required").otherwise("ok"))
    q = q.select("target", "program", status.alias("status"), n.alias("available"), F.coalesce("program", F.when(n == 1, F.col("programs")[0])).alias("only")).withColumn("selected", F.when(F.col("status") == "ok", F.col("only"))).drop("only")
    q = steps.write(q)
    ok = q.where("status = 'ok'").select("target", "program", "selected")
    staged = ok.join(before.select("target", "node"), "target").join(stage, "node")
    per = staged.groupBy("target", "program", "layer").agg(F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("codes"))
    plan = per.groupBy("target", "program").agg(F.count("*").alias("stages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer", "codes"))), lambda x: F.concat((x["layer"] + 1).cast("string"), F.lit(":"), x["codes"])), ";").alias("plan"))
    courses = staged.groupBy("target", "program").agg(F.count("*").alias("courses"))
    at = offers.groupBy("node", "program").agg(F.min("semester").alias("semester"))
    any_ = offers.groupBy("node").agg(F.min("semester").alias("semester"))
    links = ok.join(before.select("target", F.col("node").alias("dst")), "target").join(e, "dst")
    def semester(side: str) -> tuple[DataFrame, DataFrame]:
        return at.select(F.col("node").alias(side), F.col("program").alias("selected"), F.col("semester").alias(f"{side}_p")), any_.select(F.col("node").alias(side), F.col("semester").alias(f"{side}_a"))

    for side in ("src", "dst"):
        in_program, anywhere = semester(side)
        links = links.join(in_program, [side, "selected"], "left").join(anywhere, side, "left").withColumn(f"{side}_s", F.when(F.col("selected").isNull(), F.col(f"{side}_a")).otherwise(F.col(f"{side}_p")))
    warned = links.where("src_s >= dst_s").groupBy("target", "program").agg(F.count("*").alias("warnings"))
    null_safe = lambda d: d.withColumn("program", F.coalesce(F.col("program").cast("string"), F.lit("")))
    out = null_safe(q)
    for d in (courses, plan, warned):
        out = out.join(null_safe(d), ["target", "program"], "left")
    return out.select("target", "program", "status", "available", "selected", F.coalesce("courses", F.lit(0)).alias("courses"), F.coalesce("stages", F.lit(0)).alias("stages"), "plan", F.coalesce("warnings", F.lit(0)).alias("warnings"))


def _offers(spark, sf_dir) -> DataFrame:
    """Courses of programmes with their semester: parts by supplier and line number."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("node"), F.col("l_suppkey").cast("long").alias("program")).agg(F.min("l_linenumber").cast("int").alias("semester"))


def o177_plan(spark, sf_dir):
    """Study plans of the targets, the first course, one that doesn't exist and targets behind a ring: without a programme, with the first that offers the course and with one that doesn't."""
    e = part_edges(spark, sf_dir)
    e = e.unionByName(e.where("dst % 1150 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("target")).where("target % 50 = 0 or target = 1")
    t = t.unionByName(spark.createDataFrame([(-1,)], "target long"))
    o = Steps(spark).write(_offers(spark, sf_dir))
    first = t.join(o.groupBy(F.col("node").alias("target")).agg(F.min("program").alias("program")), "target", "left")
    asked = t.withColumn("program", F.lit(None).cast("long")).unionByName(first.where("program is not null")).unionByName(t.withColumn("program", F.lit(-1).cast("long")))
    return study_plans(e, o, asked)


def o179_cycle_nodes(spark, sf_dir):
    """Courses that can never be taken once the last course comes before the first: on the cycle or behind it."""
    e = part_edges(spark, sf_dir)
    back = e.agg(F.max("dst").alias("src"), F.lit(1).cast("long").alias("dst"))
    return layers(e.unionByName(back))[1]


def o182_would_cycle(spark, sf_dir):
    """Proposed links from each target back to a course, and whether they would close a cycle."""
    e = part_edges(spark, sf_dir)
    t = _targets(e)
    c = closure(e, t).select("target", F.col("node").alias("to"), F.lit(True).alias("hit"))
    proposed = t.select("target", F.explode(F.array(F.expr("div(target, 6)"), F.expr("div(target, 5)"))).alias("to")).where("to > 0").distinct()
    return proposed.join(c, ["target", "to"], "left").select("target", "to", F.col("hit").isNotNull().alias("cycle"))


def o183_accept(spark, sf_dir):
    """Edges that are accepted in order of confidence, with reversed ones among the candidates."""
    e = part_edges(spark, sf_dir)
    c = e.select("src", "dst", ((F.col("src") * 7 + F.col("dst") * 3) % 100 / 100).alias("confidence"))
    back = e.where("dst % 40 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.5).alias("confidence"))
    return accept(c.unionByName(back))


def longest_chains(edges: DataFrame) -> DataFrame:
    """(node, layer, chain): a longest chain that leads to each node, of the smallest codes where several are as long; nodes on or behind a cycle are left out. Each layer is made from the one before and written once."""
    steps = Steps(edges.sparkSession)
    stage = steps.write(layers(edges)[0])
    up = edges.select("src", F.col("dst").alias("node")).distinct().join(stage, "node").join(stage.select(F.col("node").alias("src"), F.col("layer").alias("_l")), "src").where("_l = layer - 1")
    up = steps.write(up.groupBy("node", "layer").agg(F.min("src").alias("src")))
    out = Grown(steps, stage.where("layer = 0").select("node", "layer", F.array("node").alias("chain")))
    front, n = out.last, 0
    while front.limit(1).count():
        n += 1
        front = out.add(up.where(F.col("layer") == n).join(front.select(F.col("node").alias("src"), "chain"), "src").select("node", "layer", F.array_append("chain", F.col("node")).alias("chain")))
    return out.all()


def o184_longest_chain(spark, sf_dir):
    """The longest chain that leads to each target."""
    c = longest_chains(part_edges(spark, sf_dir)).where("node % 50 = 0")
    return c.select(F.col("node").alias("target"), "layer", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


def o186_relation_chain(spark, sf_dir):
    """Shortest chain of at most three links from each course to each target."""
    return distances(part_edges(spark, sf_dir)).where("dst % 50 = 0")


def o193_distances(spark, sf_dir):
    """Shortest distance of at most three links between any two courses, whichever comes first."""
    d = distances(part_edges(spark, sf_dir))
    return d.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("distance").alias("distance"))


def _paths(e):
    both = e.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.concat_ws("-", "src", "dst").alias("e")).unionByName(e.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.concat_ws("-", "src", "dst").alias("e")))
    return both


def _walks(spark, sf_dir) -> DataFrame:
    """(target, node, hops, e): walks of one to three links from each target in either direction with their last link; a walk uses no link twice but may come back to a course."""
    e = part_edges(spark, sf_dir)
    both = _paths(e)
    walk = _targets(e).join(both.withColumnRenamed("x", "target"), "target").select("target", F.col("y").alias("node"), F.lit(1).alias("hops"), F.array("e").alias("used"))
    out = walk
    for n in (2, 3):
        walk = walk.withColumnRenamed("node", "x").join(both, "x").where(~F.array_contains("used", F.col("e"))).select("target", F.col("y").alias("node"), F.lit(n).alias("hops"), F.array_append("used", F.col("e")).alias("used"))
        out = out.unionByName(walk)
    return Steps(spark).write(out.select("target", "node", "hops", F.element_at("used", -1).alias("e")))


def o181_walks(spark, sf_dir):
    """Courses one to three links away from each target, with the least number of links and the number of walks."""
    return _walks(spark, sf_dir).groupBy("target", "node").agg(F.min("hops").alias("hops"), F.count("*").alias("walks"))


def o181_edges(spark, sf_dir):
    """The links that those walks use, each once a target."""
    p = F.split("e", "-")
    return _walks(spark, sf_dir).select("target", p[0].cast("long").alias("src"), p[1].cast("long").alias("dst")).distinct()


def o180_pruned(spark, sf_dir):
    """At most thirty courses of the graph around each target: itself, then by distance, prerequisites first, more verified links, higher confidence, nearer semester, code."""
    w = _walks(spark, sf_dir)
    e = part_edges(spark, sf_dir)
    t = _targets(e)
    nodes = w.groupBy("target", "node").agg(F.min("hops").alias("hops")).where("node <> target").unionByName(t.select("target", F.col("target").alias("node"), F.lit(0).alias("hops")))
    p = F.split("e", "-")
    links = w.select("target", p[0].cast("long").alias("src"), p[1].cast("long").alias("dst")).distinct()
    links = links.withColumn("c", (F.col("src") * 7 + F.col("dst") * 3) % 100 / 100).withColumn("v", ((F.col("src") + F.col("dst")) % 3 != 0).cast("int"))
    ends = links.select("target", F.explode(F.array("src", "dst")).alias("node"), "c", "v").groupBy("target", "node").agg(F.sum("v").alias("verified"), F.max("c").alias("best"))
    before = _three(spark, sf_dir).select("target", "node", F.lit(0).alias("_pre")).distinct()
    at = _offers(spark, sf_dir).groupBy("node").agg(F.min("semester").alias("s"))
    j = nodes.join(ends, ["target", "node"], "left").join(before, ["target", "node"], "left").join(at, "node", "left").join(at.select(F.col("node").alias("target"), F.col("s").alias("ts")), "target", "left")
    gap = F.coalesce(F.abs(F.col("s") - F.col("ts")), F.lit(1000))
    j = j.withColumn("place", row_rank(["target"], (F.col("node") != F.col("target")).cast("int"), F.col("hops"), F.coalesce("_pre", F.lit(1)), -F.coalesce("verified", F.lit(0)), -F.coalesce("best", F.lit(0.0)), gap, F.col("node")))
    total = nodes.groupBy("target").agg(F.count("*").alias("total"))
    return j.where("place <= 30").join(total, "target").select("target", "node", "hops", "place", (F.col("total") > 30).alias("truncated"))


def o188_neighbours(spark, sf_dir):
    """The first twenty courses up to three links around each target, nearest first."""
    w = o181_walks(spark, sf_dir).where("node <> target")
    return w.withColumn("place", row_rank(["target"], F.col("hops"), F.col("node"))).where("place <= 20").select("target", "node", "place")


def o104_course_graph(spark, sf_dir):
    """Size of the graph around each target: courses before and after it, and links."""
    e = part_edges(spark, sf_dir)
    t = _targets(e)
    before = t.join(e.select(F.col("dst").alias("target"), "src"), "target").groupBy("target").agg(F.count("*").alias("before"))
    after = t.join(e.select(F.col("src").alias("target"), "dst"), "target").groupBy("target").agg(F.count("*").alias("after"))
    return t.join(before, "target", "left").join(after, "target", "left").select("target", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def _three(spark, sf_dir):
    e = part_edges(spark, sf_dir).withColumn("c", (F.col("src") * 7 + F.col("dst") * 3) % 100 / 100)
    p1 = e.where("dst % 50 = 0").select(F.col("dst").alias("target"), F.col("src").alias("node"), F.concat_ws(">", "src", "dst").alias("path"), F.col("c").alias("s"), F.lit(1).alias("n"))
    out, cur = p1, p1
    for _ in range(2):
        cur = cur.join(e.select(F.col("dst").alias("node"), F.col("src").alias("up"), "c"), "node").select("target", F.col("up").alias("node"), F.concat_ws(">", "up", "path").alias("path"), (F.col("s") + F.col("c")).alias("s"), (F.col("n") + 1).alias("n"))
        out = out.unionByName(cur)
    return out.select("target", "node", "path", F.round(F.col("s") / F.col("n"), 6).alias("mean"), F.col("n").alias("links"))


def o117_paths(spark, sf_dir):
    """Paths of one to three links to each target, the hundred of the best mean confidence."""
    p = _three(spark, sf_dir)
    return p.withColumn("place", row_rank(["target"], F.col("mean").desc(), F.col("path"))).where("place <= 100")


def o98_aggregated(spark, sf_dir):
    """Sources of the paths to each target by the course and chapter that they belong to: the different sources in order, paths and best mean."""
    at = _three(spark, sf_dir).withColumn("course", F.expr("div(node, 10)")).withColumn("chapter", F.col("node") % 10 % 3)
    g = at.groupBy("target", "course", "chapter").agg(F.sort_array(F.collect_set("node")).alias("c"), F.count("*").alias("paths"), F.max("mean").alias("best"))
    return g.select("target", "course", "chapter", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("concepts"), "paths", "best")


def _connecting(spark, sf_dir) -> DataFrame:
    """Paths whose ends are courses of different categories."""
    of = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_type").alias("grp"))
    return _three(spark, sf_dir).join(of, "node").join(of.select(F.col("node").alias("target"), F.col("grp").alias("own")), "target").where("grp <> own")


def o190_connecting(spark, sf_dir):
    """Paths whose ends belong to different groups of courses."""
    return _connecting(spark, sf_dir).select("target", "node", "path", "mean", "links")


def o191_mermaid(spark, sf_dir):
    """The links of each target's paths as text, each once, in order."""
    e = o117_paths(spark, sf_dir).select("target", F.split("path", ">").alias("p"))
    links = e.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.concat(F.element_at("p", i), F.lit(" --> "), F.element_at("p", i + 1)))).alias("l"))
    return links.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("l")), "; ").alias("diagram"))


def o292_path_summary(spark, sf_dir):
    """The first three paths of each target as text."""
    p = o117_paths(spark, sf_dir).where("place <= 3")
    return p.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), " | ").alias("summary"))


# What an explanation says without a model.
NO_PATHS = "当前图谱中没有检索到足够的先修依赖路径。"
SAID, ENDING = "图谱中检索到的先修知识：", "。先理解它们有助于掌握目标课程中的后续概念。"


def explained(spark, sf_dir, paths: DataFrame) -> DataFrame:
    """(target, sources, paths, best, phrase, table_rows): the sources of paths to each target; the five most certain as a phrase and as rows of a table."""
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_name").alias("name"))
    a = paths.groupBy("target", "node").agg(F.count("*").alias("paths"), F.max("mean").alias("best")).join(named, "node", "left")
    a = a.withColumn("place", row_rank(["target"], F.col("best").desc(), F.col("node")))
    top = F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "node", "name", "paths"))))
    g = a.groupBy("target").agg(F.count("*").alias("sources"), F.sum("paths").alias("paths"), F.max("best").alias("best"), top.alias("t"))
    said = F.transform("t", lambda x: F.concat(F.lit("《"), F.coalesce(x["name"], F.lit("")), F.lit("》"), x["node"].cast("string")))
    rows = F.transform("t", lambda x: F.concat(F.lit("| "), x["node"].cast("string"), F.lit(" | "), x["paths"].cast("string"), F.lit(" |")))
    return g.select("target", "sources", "paths", "best", F.concat(F.lit(SAID), F.array_join(said, "；"), F.lit(ENDING)).alias("phrase"), F.array_join(rows, "\n").alias("table_rows"))


def o290_fallback(spark, sf_dir):
    """The five most certain sources of each target as a phrase and as table rows."""
    return explained(spark, sf_dir, _three(spark, sf_dir)).select("target", "phrase", "table_rows")


def o192_dependency_answer(spark, sf_dir):
    """Answer of each target from the paths that connect different groups: sources, paths, best mean and phrase; the fixed sentence where there is none."""
    t = _targets(part_edges(spark, sf_dir))
    x = explained(spark, sf_dir, _connecting(spark, sf_dir))
    return t.join(x, "target", "left").select("target", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("paths", F.lit(0)).alias("paths"), "best", F.coalesce("phrase", F.lit(NO_PATHS)).alias("phrase"))


_E = "k as (select p_partkey::bigint as k from part where p_partkey > 1), e as (select distinct src, dst from (select unnest([k // 2, k // 3]) as src, k as dst from k) where src > 0), t as (select distinct dst as target from e where dst % 50 = 0)"
_CL = f"{_E}, cl as (select target, target as node, 0 as distance from t union select cl.target, e.src, cl.distance + 1 from cl join e on e.dst = cl.node), c as (select target, node, min(distance)::int as distance from cl group by all)"
_LA = f"{_E}, ll as (select src as node, 0 as layer from e where src not in (select dst from e) union select e.dst, ll.layer + 1 from ll join e on e.src = ll.node), la as (select node, max(layer)::int as layer from ll group by node)"
_D = f"{_E}, dd as (select src, dst, 1 as d from e union select dd.src, e.dst, d + 1 from dd join e on e.src = dd.dst where d < 3), di as (select src, dst, min(d)::int as distance from dd where src <> dst group by all)"
_W = f"{_E}, b as (select src as x, dst as y, src || '-' || dst as e from e union all select dst, src, src || '-' || dst from e), one as (select target, y, b.e from t join b on b.x = target), two as (select o.target, b.y, o.e as e1, b.e as e from one o join b on b.x = o.y where b.e <> o.e), three as (select o.target, b.y, b.e from two o join b on b.x = o.y where b.e <> o.e and b.e <> o.e1), ws as (select target, y as node, 1 as h, e from one union all select target, y, 2, e from two union all select target, y, 3, e from three), w as (select target, node, min(h)::int as hops, count(*) as walks from ws group by all), we as (select distinct target, split_part(e, '-', 1)::bigint as src, split_part(e, '-', 2)::bigint as dst from ws)"
_P = f"{_E}, pa as (select dst as target, src as node, src || '>' || dst as path, ((src * 7 + dst * 3) % 100) / 100 as s, 1 as n from e where dst % 50 = 0 union all select pa.target, e.src, e.src || '>' || path, s + ((e.src * 7 + e.dst * 3) % 100) / 100, n + 1 from pa join e on e.dst = pa.node where n < 3), p as (select target, node, path, round(s / n, 6) as mean, n::int as links from pa), top as (select *, row_number() over (partition by target order by mean desc, path)::int as place from p qualify place <= 100), ag as (select target, node, count(*) as paths, max(mean) as best from p group by all)"
_CX = "cx as (select p.* from p join part a on a.p_partkey = p.node join part b on b.p_partkey = p.target where a.p_type <> b.p_type)"
_EX = "ax as (select target, node, count(*) as paths, max(mean) as best from {0} group by all), rx as (select ax.*, p_name, row_number() over (partition by target order by best desc, node) as place from ax left join part on p_partkey = node), ex as (select target, count(*) as sources, sum(paths) as paths, max(best) as best, '" + SAID + "' || string_agg('《' || p_name || '》' || node, '；' order by place) filter (place <= 5) || '" + ENDING + "' as phrase, string_agg('| ' || node || ' | ' || paths || ' |', chr(10) order by place) filter (place <= 5) as table_rows from rx group by 1)"
_PLAN = f"""{_E}, g as (select src, dst from e union select dst, src from e where dst % 1150 = 0), ofr as (select l_partkey::bigint as node, l_suppkey::bigint as program, min(l_linenumber)::int as semester from lineitem group by all),
tg as (select p_partkey::bigint as target from part where p_partkey % 50 = 0 or p_partkey = 1 union all select -1), ask as (select target, null::bigint as program from tg union all select target, min(program) from tg join ofr on node = target group by 1 union all select target, -1 from tg),
nd as (select src as node from g union select dst from g union select node from ofr), kn as (select target from tg where target in (select node from nd)), bf as (select target, target as node from kn union select bf.target, g.src from bf join g on g.dst = bf.node),
rc as (select dst as a, src as b from g union select rc.a, g.src from rc join g on g.dst = rc.b), cy as (select a as node from rc where a = b), stk as (select node from cy union select a from rc where b in (select node from cy)),
ll as (select node, 0 as layer from (select src as node from g union select dst from g) where node not in (select dst from g) union select g.dst, ll.layer + 1 from ll join g on g.src = ll.node where g.dst not in (select node from stk)), la as (select node, max(layer) as layer from ll group by 1),
pg as (select target, list_sort(list(distinct program)) as programs from kn join ofr on node = target group by 1), up as (select target, count(*) - 1 as above from bf group by 1),
qq as (select ask.target, ask.program, case when kn.target is null then 'unknown_course' when ask.target in (select node from stk) then 'cycle_detected' when above = 0 then 'no_prerequisites' when ask.program is not null and len(programs) > 0 and not list_contains(programs, ask.program) then 'program_not_found' when ask.program is null and len(programs) > 1 then 'program_required' else 'ok' end as status, coalesce(len(programs), 0)::int as available, coalesce(ask.program, case when len(programs) = 1 then programs[1] end) as sole from ask left join kn using (target) left join up using (target) left join pg using (target)),
ok as (select target, program, sole as selected from qq where status = 'ok'), st as (select ok.target, ok.program, la.layer, bf.node from ok join bf using (target) join la using (node)), per as (select target, program, layer, count(*) as k, string_agg(node::varchar, ',' order by node) as codes from st group by all), pl as (select target, program, sum(k)::bigint as courses, count(*) as stages, string_agg((layer + 1) || ':' || codes, ';' order by layer) as plan from per group by all),
an as (select node, min(semester) as semester from ofr group by 1), lk as (select ok.target, ok.program, case when selected is null then a1.semester else o1.semester end as s1, case when selected is null then a2.semester else o2.semester end as s2 from ok join bf using (target) join g on g.dst = bf.node left join an a1 on a1.node = g.src left join an a2 on a2.node = g.dst left join ofr o1 on o1.node = g.src and o1.program = selected left join ofr o2 on o2.node = g.dst and o2.program = selected), wa as (select target, program, count(*) as warnings from lk where s1 >= s2 group by all),
fin as (select qq.target, coalesce(qq.program::varchar, '') as program, status, available, case when status = 'ok' then sole end as selected, coalesce(courses, 0) as courses, coalesce(stages, 0) as stages, plan, coalesce(warnings, 0) as warnings from qq left join pl on pl.target = qq.target and pl.program is not distinct from qq.program left join wa on wa.target = qq.target and wa.program is not distinct from qq.program)"""
SQL = {
    "o177_closure": f"with recursive {_CL} select * from c",
    "o177_layers": f"with recursive {_LA} select * from la",
    "o177_plan": f"with recursive {_PLAN} select target, program, status, available, selected, courses, stages, plan, warnings from fin",
    "o179_cycle_nodes": f"with recursive {_E}, f as (select src, dst from e union select max(dst), 1 from e), r as (select 1::bigint as node union select f.dst from r join f on f.src = r.node) select node from r",
    "o182_would_cycle": f"with recursive {_CL}, pr as (select distinct target, unnest([target // 6, target // 5]) as \"to\" from t) select target, \"to\", (target, \"to\") in (select (target, node) from c) as cycle from pr where \"to\" > 0",
    "o184_longest_chain": f"with recursive {_LA}, pr as (select e.dst as node, min(e.src) as src from e join la a on a.node = e.dst join la b on b.node = e.src and b.layer = a.layer - 1 group by 1), ch as (select node, layer, node::varchar as chain from la where layer = 0 union all select pr.node, la.layer, ch.chain || '>' || pr.node from pr join ch on ch.node = pr.src join la on la.node = pr.node) select node as target, layer, chain from ch where node % 50 = 0",
    "o186_relation_chain": f"with recursive {_D} select * from di where dst % 50 = 0",
    "o193_distances": f"with recursive {_D} select least(src, dst) as a, greatest(src, dst) as b, min(distance) as distance from di group by all",
    "o181_walks": f"with {_W} select * from w",
    "o181_edges": f"with {_W} select * from we",
    "o180_pruned": f"with recursive {_W}, {_P.split(', t as (')[1].split('), ', 1)[1]}, ed as (select target, node, sum(v)::bigint as verified, max(c) as best from (select target, unnest([src, dst]) as node, ((src * 7 + dst * 3) % 100) / 100 as c, ((src + dst) % 3 <> 0)::int as v from we) group by all), nd as (select target, node, hops from w where node <> target union all select target, target, 0 from t), se as (select l_partkey as node, min(l_linenumber) as s from lineitem group by 1), r as (select nd.*, row_number() over (partition by nd.target order by nd.node <> nd.target, hops, (nd.target, nd.node) not in (select (target, node) from p), -coalesce(verified, 0), -coalesce(best, 0), coalesce(abs(a.s - b.s), 1000), nd.node)::int as place, count(*) over (partition by nd.target) as total from nd left join ed on ed.target = nd.target and ed.node = nd.node left join se a on a.node = nd.node left join se b on b.node = nd.target) select target, node, hops, place, total > 30 as truncated from r where place <= 30",
    "o188_neighbours": f"with {_W} select target, node, row_number() over (partition by target order by hops, node)::int as place from w where node <> target qualify place <= 20",
    "o104_course_graph": f"with {_E} select target, (select count(*) from e where dst = target) as before, (select count(*) from e where src = target) as after from t",
    "o117_paths": f"with recursive {_P} select * from top",
    "o98_aggregated": f"with recursive {_P} select target, node // 10 as course, node % 10 % 3 as chapter, array_to_string(list_sort(list(distinct node)), ',') as concepts, count(*) as paths, max(mean) as best from p group by all",
    "o190_connecting": f"with recursive {_P}, {_CX} select target, node, path, mean, links from cx",
    "o192_dependency_answer": f"with recursive {_P}, {_CX}, {_EX.format('cx')} select t.target, coalesce(sources, 0) as sources, coalesce(paths, 0)::bigint as paths, best, coalesce(phrase, '{NO_PATHS}') as phrase from t left join ex using (target)",
    "o191_mermaid": f"with recursive {_P}, l as (select target, a[i] || ' --> ' || a[i + 1] as l from (select target, string_split(path, '>') as a from top), range(1, 4) r(i) where i < len(a)) select target, array_to_string(list_sort(list(distinct l)), '; ') as diagram from l group by target",
    "o292_path_summary": f"with recursive {_P} select target, string_agg(path, ' | ' order by place) as summary from top where place <= 3 group by target",
    "o290_fallback": f"with recursive {_P}, {_EX.format('p')} select target, phrase, table_rows from ex",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] == "o" and k[1:2].isdigit()}
