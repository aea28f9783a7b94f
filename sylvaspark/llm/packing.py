"""Items of varying size into containers of fixed capacity with little unused space.

The plan works on the histogram of sizes alone, at most one count per size up to the capacity, whatever the number of items. Sums of one, two and three sizes are indexed: take the largest size left, look up a combination whose sum is exactly the gap, and use it as often as the counts allow; where no sum fits, take the best-fitting size and look again. Items then find their container by their rank within their size, so nothing but the histogram reaches the driver."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaspark.common import Steps, global_index, table
from sylvaspark.llm.encoding import encode

CAPACITY = 4096


class Sums:
    """Index of the sums of one, two and three sizes: for each sum the combinations that make it, large sizes first.

    A sum's combinations are listed when it is first asked for, from the sizes there are by then: for two sizes the larger ones, for three the largest ones whose rest is a sum of two. Counts only fall, so a combination of which a size is used up is taken off its list for good, and every list is gone through once over all questions. At most one list of each kind per sum up to the capacity."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for s, n in counts.items():
            self.left[s] += n
        self.there = np.array(self.left) > 0
        self.pairs: dict[int, np.ndarray] = {}
        self.triples: dict[int, list[int]] = {}

    def use(self, sizes: Counter, times: int) -> None:
        for s, k in sizes.items():
            self.left[s] -= k * times
            if not self.left[s]:
                self.there[s] = False

    def two(self, total: int) -> np.ndarray:
        """The larger sizes of the pairs with this sum, the largest last; those used up are taken off when the largest is."""
        got = self.pairs.get(total)
        if got is None:
            got = np.flatnonzero(self.there[(total + 1) // 2 : max(total, 1)]) + (total + 1) // 2
        elif not len(got) or self.there[got[-1]] and self.there[total - got[-1]] and (got[-1] * 2 != total or self.left[got[-1]] > 1):
            return got
        got = got[self.there[got] & self.there[total - got]]
        if len(got) and got[0] * 2 == total and self.left[got[0]] < 2:
            got = got[1:]
        self.pairs[total] = got
        return got

    def three(self, total: int) -> list[int]:
        """The largest sizes of the triples with this sum, the largest last."""
        if total not in self.triples:
            first = np.flatnonzero(self.there[: max(total - 1, 0)])
            self.triples[total] = first[first * 3 >= total].tolist()
        return self.triples[total]

    def spare(self, sizes: tuple[int, ...], taken: Counter) -> bool:
        return all(self.left[s] - taken[s] >= sizes.count(s) for s in sizes)

    def fill(self, gap: int, taken: Counter) -> tuple[int, ...]:
        """One to three sizes with the sum `gap`, beside those that are taken already; () if there are none."""
        if self.left[gap] > taken[gap]:
            return (gap,)
        for a in self.two(gap)[::-1].tolist():
            if self.spare((a, gap - a), taken):
                return a, gap - a
        firsts = self.three(gap)
        for i in range(len(firsts) - 1, -1, -1):
            a = firsts[i]
            rest = self.two(gap - a) if self.there[a] else ()
            if not len(rest):
                del firsts[i]
                continue
            for b in rest[: np.searchsorted(rest, a, side="right")][::-1].tolist():
                if self.spare((a, b, gap - a - b), taken):
                    return a, b, gap - a - b
        return ()


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of sizes and how many containers each fills. Sizes are 1 to `capacity`."""
    sums = Sums(counts, capacity)
    out = []
    top = capacity
    while True:
        while top and not sums.left[top]:
            top -= 1
        if not top:
            return out
        taken, gap = Counter({top: 1}), capacity - top
        order = [top]
        while gap:
            found = sums.fill(gap, taken)
            if not found:  # the best fit, then look again
                fitting = np.flatnonzero(sums.there[: gap + 1])[::-1].tolist()
                size = next((s for s in fitting if sums.left[s] > taken[s]), 0)
                if not size:
                    break
                found = (size,)
            taken.update(found)
            order += found
            gap -= sum(found)
        times = min(sums.left[s] // n for s, n in taken.items())
        sums.use(taken, times)
        out.append((tuple(order), times))


def pack(sized: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, part, size, container_id) of every row.

    An item over the capacity is cut into full parts, each filling a container, and the rest; no other item is cut. Items of size 0 or null take no space and are dealt out over the containers in turn (container 0 if there is no other). Containers are numbered from 0. Equal sizes and repeated rows are items of their own."""
    if capacity < 1:
        raise ValueError("the capacity is 1 or more")
    spark = sized.sparkSession
    steps = Steps(spark)
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    parts = sized.select(F.col(key), n.alias("_n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int"))))
    parts = parts.select(key, "part", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("part").cast("long") * capacity).alias("_size"))
    ranked = global_index(steps, parts, "_size", key, "part")
    counts = {r[0]: r[1] for r in ranked.groupBy("_size").count().collect()}  # capacity + 1 rows at most
    empty = counts.pop(0, 0)
    next_rank, at = {}, empty
    for s in sorted(counts):
        next_rank[s], at = at, at + counts[s]
    begins, bases, uses = [], [], []
    container = 0
    for combo, times in plan(counts, capacity):
        for s, k in Counter(combo).items():
            begins.append(next_rank[s])
            bases.append(container)
            uses.append(k)
            next_rank[s] += k * times
        container += times
    order = np.argsort(np.array(begins, dtype=np.int64))
    shared = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64)[order] for x in (begins, bases, uses)))
    total = max(container, 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, base, k = shared.value
        for b in batches:
            idx = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(lo):
                at = np.maximum(np.searchsorted(lo, idx, side="right") - 1, 0)
                found = np.where(idx < empty, idx % total, base[at] + (idx - lo[at]) // k[at])
            else:
                found = idx % total
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found)], names=[key, "part", size, "container_id"])

    out = T.StructType([sized.schema[key], T.StructField("part", T.IntegerType()), T.StructField(size, T.LongType()), T.StructField("container_id", T.LongType())])
    return ranked.select(key, "part", "_size", "idx").mapInArrow(assign, out)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 4,096 tokens of every document, or of each part of a document that is longer."""
    sized = Steps(spark).write(encode(table(spark, sf_dir, "documents"), lengths_only=True))
    return pack(sized)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and used tokens of each container."""
    packed = p8_containers(spark, sf_dir)
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used"))


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and whether its containers keep to the capacity, its parts add up to its tokens and only a document over the capacity has more than one."""
    sized = Steps(spark).write(encode(table(spark, sf_dir, "documents"), lengths_only=True))
    packed = Steps(spark).write(pack(sized))
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    parts = packed.join(used, "container_id").groupBy("doc_id").agg(F.max("used").alias("most"), F.sum("n_tokens").alias("total"), F.count("*").alias("parts"))
    j = sized.join(parts, "doc_id", "left")
    return j.select("doc_id", F.coalesce((F.col("most") <= CAPACITY) & (F.col("total") == F.col("n_tokens")) & ((F.col("parts") == 1) | (F.col("n_tokens") > CAPACITY)), F.lit(False)).alias("whole"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_whole": p8_whole}
SQL: dict[str, str] = {"p8_whole": "select doc_id, true as whole from documents"}
