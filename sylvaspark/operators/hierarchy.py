"""Parent-child links of unknown depth to full hierarchies: rings by peeling, everything else from Euler tours and list ranking.

No loop runs over nodes: every round doubles the distance that it covers, so a forest of n nodes takes O(log n) shuffles of its rows. Rounds are written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaspark.common import Steps, global_index, join_lookup, table, trimmed

#: What stands for "no prerequisite".
PLACEHOLDERS = ["", "/", "／", "-", "—", "无", "暂无", "NONE", "NULL", "N/A", "TBD", "待定"]


def parent_links(catalog: DataFrame, code: str = "course_code", parents: str = "prerequisites") -> tuple[DataFrame, DataFrame]:
    """Nodes (code) and links (code, parent) of a table with an array of parent codes.

    Codes are compared trimmed and in upper case. Repeated rows count once; null and blank codes, null arrays, null elements, placeholders and codes without a row of their own give no link. A node linked to several listed codes keeps the smallest."""
    rows = catalog.select(F.upper(trimmed(F.col(code).cast("string"))).alias("code"), F.col(parents).alias("up")).where("code is not null and code <> ''")
    nodes = rows.select("code").distinct()
    links = rows.select("code", F.explode("up").alias("parent")).select("code", F.upper(trimmed(F.col("parent"))).alias("parent"))
    links = links.where(F.col("parent").isNotNull() & ~F.col("parent").isin(PLACEHOLDERS)).distinct()
    listed = links.join(nodes.select(F.col("code").alias("parent")), "parent", "left_semi")
    return nodes, listed.groupBy("code").agg(F.min("parent").alias("parent"))


def _doubled(steps: Steps, at: DataFrame, active: str, total: int) -> DataFrame:
    """One round of pointer doubling on (id, jump, low): twice the distance, the least id of twice the window."""
    ahead = at.select(F.col("id").alias("jump"), F.col("jump").alias("_j"), F.col("low").alias("_l"))
    near = join_lookup(at, ahead, "jump", "left", total)
    return near.select("id", F.col("_j").alias("jump"), F.least("low", F.coalesce("_l", "low")).alias("low"))


def hierarchy(spark: SparkSession, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row per node: id (rank of its code), code, parent_code, root_id, root_code, depth, entry, exit, n_below, ring.

    `nodes`: code, unique. `links`: code, parent; one parent at most per code, both in `nodes`. `ring` is 'on' for nodes of a ring (also a ring of one), 'below' for nodes under one, else 'none'. A ring is cut at its smallest code, which becomes the root of its tree, so entry-exit intervals hold for all rows: a is above b where root_id is equal and a.entry < b.entry < a.exit. `depth` counts the links to the root in the cut forest.

    An empty input gives no rows."""
    steps = Steps(spark)
    numbered = global_index(steps, nodes.select("code"), "code").select(F.col("idx").alias("id"), "code")
    ids = steps.write(numbered)
    total = ids.count()
    by_child = links.join(ids.withColumnRenamed("id", "_c"), "code").select(F.col("_c").alias("id"), "parent")
    up = join_lookup(by_child, ids.select(F.col("code").alias("parent"), F.col("id").alias("jump")), "parent", "inner", total).select("id", "jump")
    parents = steps.write(ids.select("id").join(up, "id", "left"))

    # Peeling: 2^k rounds of leaf removal leave the nodes that are somebody's 2^k-th ancestor. When that set no longer shrinks, only rings are left.
    at, old, size = steps.write(parents.withColumn("low", F.col("id"))), None, -1
    while True:
        left = at.where("jump is not null").select("jump").distinct().count()
        if left in (0, size):
            break
        size, path = left, steps.path
        at = steps.write(_doubled(steps, at, "jump", total), path)
    on = at.where("jump is not null").select(F.col("jump").alias("id")).distinct()
    rings = steps.write(parents.join(on, "id", "left_semi").withColumn("low", F.col("id")))
    if left:  # the least id of each ring, over windows that double until none changes
        while True:
            more = steps.write(_doubled(steps, rings, "jump", total))
            changed = more.join(rings.select("id", F.col("low").alias("_was")), "id").where("low <> _was").limit(1).count()
            rings = more
            if not changed:
                break
    flags = rings.select("id", "low")
    cut = parents.join(flags, "id", "left").select("id", F.col("jump").alias("parent"), F.col("low").alias("ring_head"))
    forest = steps.write(cut.withColumn("up", F.when(F.coalesce(F.col("ring_head") == F.col("id"), F.lit(False)), None).otherwise(F.col("parent"))))

    # Euler tour: element 2*id enters a node, 2*id+1 leaves it.
    order = global_index(steps, forest.where("up is not null").select("up", "id"), "up", "id")
    w = Window.partitionBy("pid").orderBy("idx")  # a range partition, not a group: a parent with many children spans several
    within = order.select("pid", "up", "id", F.lead("id").over(w).alias("_next"), F.lead("up").over(w).alias("_nup"), F.lag("up").over(w).alias("_pup"), F.lag("id").over(w).alias("_pid_id"))
    within = steps.write(within)
    edges = sorted((r["pid"], r["up"], r["id"], r["_pid_id"] is None, r["_next"] is None) for r in within.where("_pid_id is null or _next is null").collect())  # two rows a partition
    heads = [e for e in edges if e[3]]
    tails = {e[0]: e for e in edges if e[4]}
    seam = []
    for a, b in zip(heads, heads[1:]):
        seam.append((b[0], tails[a[0]][1], b[1], b[2], a[0]))
    seams = spark.createDataFrame([(s[4], s[2], s[3]) for s in seam], "pid int, _sup long, _sid long")
    firsts = spark.createDataFrame([(s[0], s[1]) for s in seam], "pid int, _fup long")
    sib = within.join(F.broadcast(seams), "pid", "left").join(F.broadcast(firsts), "pid", "left")
    sib = sib.select("up", "id", F.when(F.col("_next").isNotNull(), F.when(F.col("_nup") == F.col("up"), F.col("_next"))).otherwise(F.when(F.col("_sup") == F.col("up"), F.col("_sid"))).alias("sibling"), (~F.coalesce(F.when(F.col("_pid_id").isNotNull(), F.col("_pup")).otherwise(F.col("_fup")) == F.col("up"), F.lit(False))).alias("eldest"))
    sib = steps.write(sib)
    eldest = sib.where("eldest").select(F.col("up").alias("id"), F.col("id").alias("child"))
    enter = forest.select("id").join(eldest, "id", "left").select((2 * F.col("id")).alias("e"), F.when(F.col("child").isNull(), 2 * F.col("id") + 1).otherwise(2 * F.col("child")).alias("next"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("s"))
    leave = forest.select("id", "up").join(sib.select("id", "sibling"), "id", "left").select((2 * F.col("id") + 1).alias("e"), F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1).alias("next"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("s"))

    # List ranking: elements to the end of the tour, their sum of +1 and -1, and the last element reached. Pointers stay one-to-one, so no key is hot.
    tour = steps.write(enter.unionByName(leave).withColumn("end", F.col("e")))
    while tour.where("next is not null").limit(1).count():
        path = steps.path
        ahead = tour.select(F.col("e").alias("next"), F.col("next").alias("_n2"), F.col("n").alias("_c"), F.col("s").alias("_s"), F.col("end").alias("_e"))
        moved = tour.where("next is not null").join(ahead, "next").select("e", F.col("_n2").alias("next"), (F.col("n") + F.col("_c")).alias("n"), (F.col("s") + F.col("_s")).alias("s"), F.col("_e").alias("end"))
        tour = steps.write(moved.unionByName(tour.where("next is null")), path)
    ranked = tour.groupBy(F.shiftright("e", 1).alias("id")).agg(
        F.max(F.when(F.col("e") % 2 == 0, F.col("n"))).alias("n_in"), F.max(F.when(F.col("e") % 2 == 1, F.col("n"))).alias("n_out"), F.max(F.when(F.col("e") % 2 == 0, -F.col("s"))).alias("depth"), F.max(F.shiftright("end", 1)).alias("root_id"))
    ranked = steps.write(ranked)
    trees = ranked.where("id = root_id").select("root_id", F.col("n_in").alias("size")).join(ids.select(F.col("id").alias("root_id"), F.col("code").alias("root_code")), "root_id").join(flags.select(F.col("id").alias("root_id"), F.lit(True).alias("ringed")), "root_id", "left")
    whole = join_lookup(ranked, trees, "root_id", "inner", total)
    whole = whole.join(ids, "id").join(forest.select("id", "parent", "ring_head"), "id")
    whole = join_lookup(whole, ids.select(F.col("id").alias("parent"), F.col("code").alias("parent_code")), "parent", "left", total)
    ring = F.when(F.col("ring_head").isNotNull(), "on").when(F.col("ringed"), "below").otherwise("none")
    return whole.select("id", "code", "parent_code", "root_id", "root_code", F.col("depth").cast("int").alias("depth"), (F.col("size") - F.col("n_in")).alias("entry"), (F.col("size") - F.col("n_out")).alias("exit"), F.expr("div(n_in - n_out - 1, 2)").alias("n_below"), ring.alias("ring"))


def with_paths(spark: SparkSession, h: DataFrame) -> DataFrame:
    """`hierarchy` rows with `path`, the codes from the root to the node.

    A scan in tour order keeps the open intervals on a stack. Each range partition starts from the intervals that are open at its first row, which come with it as rows of their own: as many as that row is deep, not more than its path holds. They are found among the intervals that stay open at the end of the partition that holds them, as many a partition as its last row is deep."""
    steps = Steps(spark)
    order = steps.write(global_index(steps, h, "root_id", "entry"))
    edge = F.struct("root_id", "entry")
    bounds = steps.write(order.groupBy("pid").agg(F.min(edge).alias("_b"), F.max(edge).alias("_e")))  # one row a partition
    ends = bounds.select("pid", F.col("_e.root_id").alias("root_id"), F.col("_e.entry").alias("last"))
    held = order.select("pid", "root_id", "code", "entry", "exit").join(F.broadcast(ends), ["pid", "root_id"]).where("exit > last")
    starts = bounds.select(F.col("pid").alias("at"), F.col("_b.root_id").alias("root_id"), F.col("_b.entry").alias("first"))
    open_ = held.join(F.broadcast(starts), "root_id").where("pid < at and entry < first and first < exit").select("at", "code", "entry", "exit")
    columns = order.columns
    seeds = open_.select(*[(F.col("at").cast("int") if c == "pid" else F.col(c) if c in ("code", "entry", "exit") else F.lit(None).cast(dict(order.dtypes)[c])).alias(c) for c in columns], F.lit(0).alias("_kind"))
    rows = seeds.unionByName(order.withColumn("_kind", F.lit(1))).repartition("pid").sortWithinPartitions("pid", "_kind", "idx", "entry")
    out = T.StructType([*h.schema.fields, T.StructField("path", T.ArrayType(T.StringType()))])
    kept = h.columns

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[int, str]] = []
        pid = root = None
        for b in batches:
            made = []
            for p, k, r, code, exit_ in zip(b["pid"], b["_kind"], b["root_id"], b["code"], b["exit"]):
                if p != pid:
                    pid, root, stack = p, None, []
                if k == 0:
                    stack.append((exit_, code))
                    continue
                if root is not None and r != root:
                    stack = []
                root = r
                while stack and stack[-1][0] < exit_:
                    stack.pop()
                stack.append((exit_, code))
                made.append([c for _, c in stack])
            rows_ = b[b["_kind"] == 1][kept].copy()
            rows_["path"] = made
            yield rows_

    return rows.mapInPandas(scan, out)


def below_pairs(h_paths: DataFrame) -> DataFrame:
    """(code, below_code) for every node and each node under it: the paths turned over, as many rows as all depths together."""
    return h_paths.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("code"), F.col("code").alias("below_code"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(spark, *parent_links(table(spark, sf_dir, "course_catalog")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """course_code, root_code, depth; on a ring -1 and below one -2, with the ring's smallest code."""
    depth = F.when(F.col("ring") == "on", -1).when(F.col("ring") == "below", -2).otherwise(F.col("depth"))
    return _catalog(spark, sf_dir).select(F.col("code").alias("course_code"), "root_code", depth.cast("int").alias("depth"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every course with its path from the root, its tour interval and the number of courses below it."""
    h = with_paths(spark, _catalog(spark, sf_dir))
    return h.select(F.col("code").alias("course_code"), F.concat_ws(">", "path").alias("path"), "depth", "n_below")


def p2_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every course with each course below it."""
    return below_pairs(with_paths(spark, _catalog(spark, sf_dir)))


def p2_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of prerequisites: the smallest code and the length of each."""
    return _catalog(spark, sf_dir).where("ring = 'on'").groupBy("root_code").agg(F.count("*").alias("ring_length")).withColumnRenamed("root_code", "ring_code")


_LINKS = r"""
nodes as (select distinct upper(trim(course_code)) as code from course_catalog where course_code is not null and trim(course_code) <> ''),
raw as (select distinct upper(trim(course_code)) as code, upper(regexp_replace(u.p, '^\s+|\s+$', '', 'g')) as parent from course_catalog, unnest(prerequisites) as u(p)),
link as (select code, min(parent) as parent from raw where parent in (select code from nodes) group by code),
walk as (select code, parent as reached, 1 as d from link union select w.code, l.parent, w.d + 1 from walk w join link l on l.code = w.reached where w.d < 200),
ringed as (select code, min(d) as len from walk where reached = code group by code),
ring as (select r.code, least(r.code, min(w.reached)) as head from ringed r join walk w on w.code = r.code and w.d <= r.len group by r.code),
up as (select n.code, case when r.head = n.code then null else l.parent end as parent from nodes n left join link l using (code) left join ring r using (code)),
tree as (select code, code as root_code, 0 as depth, code as path from up where parent is null union all select u.code, t.root_code, t.depth + 1, t.path || '>' || u.code from up u join tree t on u.parent = t.code)"""

SQL = {
    "p2_found": f"with recursive {_LINKS} select t.code as course_code, t.root_code, (case when r.code is not null then -1 when h.code is not null then -2 else t.depth end)::int as depth from tree t left join ring r on r.code = t.code left join ring h on h.code = t.root_code",
    "p2_paths": f"with recursive {_LINKS}, pairs as (select t.code, unnest(string_split(t.path, '>')) as above from tree t), n as (select above, count(*) - 1 as k from pairs group by above) select t.code as course_code, t.path, t.depth::int as depth, n.k::bigint as n_below from tree t join n on n.above = t.code",
    "p2_below": f"with recursive {_LINKS}, pairs as (select t.code as below_code, unnest(string_split(t.path, '>')) as code from tree t) select code, below_code from pairs where code <> below_code",
    "p2_rings": f"with recursive {_LINKS} select head as ring_code, count(*)::bigint as ring_length from ring group by head",
}
QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_below": p2_below, "p2_rings": p2_rings}
