"""Helpers that every operator shares: reading tables, cutting lineage, global ordering and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_SHARE rows, so at most HOT_SHARE keys are hot: the bound of what `join_lookup` broadcasts.
HOT_SHARE = 1000
#: Fewer rows than this never make a key hot.
HOT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where that is unset, a session on one machine (local master, as in tests) gets a temporary folder; a cluster gets an error, as its machines share no such folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not hasattr(spark, "_own_dir"):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        spark._own_dir = "file://" + tempfile.mkdtemp(prefix="steps-")
        spark.sparkContext.setCheckpointDir(spark._own_dir)
    return spark._own_dir


class Steps:
    """Intermediate tables written to the shared folder. Lineage ends at each of them, and any executor can read them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.count = 0
        path, fs = self._fs(self.root)
        fs.deleteOnExit(path)

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, replaces: str | None = None, most: int = 0) -> DataFrame:
        """The same rows, read from a written table. `replaces`: the path of an earlier step that nothing reads any more. `most`: rows of a file at most (0: any number); a reader holds so many at once."""
        self.count += 1
        self.path = f"{self.root}/{self.count}"
        df.write.option("maxRecordsPerFile", most).parquet(self.path)
        if replaces:
            path, fs = self._fs(replaces)
            fs.delete(path, True)
        return self.spark.read.schema(df.schema).parquet(self.path)


class Grown:
    """A table that grows by parts, each written once and never again."""

    def __init__(self, steps: Steps, first: DataFrame):
        self.steps, self.schema, self.paths = steps, first.schema, []
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """The new part alone, read from where it was written."""
        part = self.steps.write(df)
        self.paths.append(self.steps.path)
        return part

    def all(self) -> DataFrame:
        return self.steps.spark.read.schema(self.schema).parquet(*self.paths)


def global_index(steps: Steps, df: DataFrame, *order: str, index: str = "idx", part: str = "pid") -> DataFrame:
    """Rows with their place (from 0) in the total order of the columns, and the range partition that holds them.

    Equal keys never meet in one task by force: the order columns together should be near unique. Only one count per partition goes to the driver."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    kept = steps.write(ranged.withColumn(part, F.shiftright("_m", 33).cast("int")).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"))
    total, starts = 0, []
    for p, n in sorted((r[0], r[1]) for r in kept.groupBy(part).count().collect()):
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], f"{part} int, _start long")
    return kept.join(F.broadcast(offsets), part).withColumn(index, F.col("_start") + F.col("_at")).drop("_start", "_at")


def join_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", total: int | None = None) -> DataFrame:
    """Join of many rows to a side with unique keys, safe when few keys hold most of the rows.

    Keys with more than one in HOT_SHARE rows (HOT_SHARE keys at most) are joined by broadcast, all others by shuffle. Null keys match nothing; with `how="left"` their rows are kept, and never shuffled."""
    if how not in ("left", "inner"):
        raise ValueError(how)
    total = left.count() if total is None else total
    hot = []
    if total > HOT_ROWS:  # in fewer rows no key can be hot
        counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
        hot = [r[0] for r in counts.where(F.col("count") > max(total / HOT_SHARE, HOT_ROWS)).select(key).collect()]
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
    parts = [left.where(F.col(key).isNotNull() & ~F.col(key).isin(hot) if hot else F.col(key).isNotNull()).join(right, key, how)]
    if hot:
        parts.append(left.where(F.col(key).isin(hot)).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how))
    if how == "left":
        parts.append(left.where(F.col(key).isNull()).select(key, *[c for c in left.columns if c != key], *added))
    return reduce(DataFrame.unionByName, parts)


def join_dealt(left: DataFrame, right: DataFrame, on: list[str], by: str) -> DataFrame:
    """Inner join on `on`, of which the first column may have hot keys on the left: their rows are dealt out by a hash of `by` over several tasks, with the matching rows of the right in each."""
    total = left.count()
    hot = left.where(F.col(on[0]).isNotNull()).groupBy(on[0]).count().where(F.col("count") > max(total / HOT_SHARE, HOT_ROWS)).collect() if total > HOT_ROWS else []  # HOT_SHARE keys at most
    if not hot:
        return left.join(right, on)
    shares = left.sparkSession.createDataFrame([(r[0], int(-(-r[1] * HOT_SHARE // total))) for r in hot], f"{on[0]} {dict(left.dtypes)[on[0]]}, _n int")
    deal = lambda d: d.join(F.broadcast(shares), on[0], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    a = deal(left).withColumn("_s", F.pmod(F.xxhash64(by), "_n").cast("int")).drop("_n")
    b = deal(right).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return a.join(b, [*on, "_s"]).drop("_s")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order; as an aggregate, so it combines before the shuffle and takes hot keys."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", "")


def row_rank(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def spread(df: DataFrame, waves: int = 3) -> DataFrame:
    """Rows over enough tasks for work that is heavy per row; input that already has enough partitions is not shuffled."""
    wanted = waves * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
