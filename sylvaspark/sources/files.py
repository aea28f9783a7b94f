"""JSON lines, published versions and pointers to them."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a given schema; a missing path gives no rows."""
    p, fs = _fs(spark, path)
    return spark.read.schema(schema).json(path) if fs.exists(p) else spark.createDataFrame([], schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def publish(df: DataFrame, root: str, alias: str, metrics: dict | None = None, note: str = "") -> str:
    """Writes the next version beside the others, then moves the pointer to it; readers see the old version or the new one, never a part."""
    spark = df.sparkSession
    root_path, fs = _fs(spark, root)
    known = [s.getPath().getName() for s in fs.listStatus(root_path)] if fs.exists(root_path) else []
    numbers = [int(n.rsplit("_v", 1)[1]) for n in known if n.startswith(f"{alias}_v") and n.rsplit("_v", 1)[1].isdigit()]
    name = f"{alias}_v{max(numbers, default=0) + 1}"
    df.write.parquet(f"{root}/{name}")
    point(spark, root, alias, name, metrics, note)
    return name


def record(spark: SparkSession, root: str, alias: str) -> dict:
    path, fs = _fs(spark, f"{root}/{alias}.json")
    if not fs.exists(path):
        return {"alias": alias, "active": alias, "history": []}
    stream = fs.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def point(spark: SparkSession, root: str, alias: str, active: str, metrics: dict | None = None, note: str = "", kept: int = 50) -> None:
    """Swaps the pointer by rename and keeps the last `kept` entries of its history."""
    old = record(spark, root, alias)
    entry = {"active": active, "at": datetime.now(timezone.utc).isoformat(), "metrics": metrics or {}, "note": note}
    new = {"alias": alias, "active": active, "history": [*old["history"], entry][-kept:]}
    temp, fs = _fs(spark, f"{root}/.{alias}.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(new, ensure_ascii=False).encode()))
    out.close()
    target, _ = _fs(spark, f"{root}/{alias}.json")
    fs.delete(target, False)
    fs.rename(temp, target)


def publish_if_better(df: DataFrame, root: str, alias: str, before: dict, after: dict, note: str = "") -> str | None:
    """Publishes unless a metric of `after` is below that of `before`."""
    if any(after.get(k, 0) < v for k, v in before.items()):
        return None
    return publish(df, root, alias, after, note)


def active(spark: SparkSession, root: str, alias: str) -> DataFrame:
    """Rows of the version that the alias points to; of the alias itself if that version is gone."""
    name = record(spark, root, alias)["active"]
    path, fs = _fs(spark, f"{root}/{name}")
    return spark.read.parquet(f"{root}/{name}" if fs.exists(path) else f"{root}/{alias}")


def snapshot(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """Copies of tables under `root`, with their row counts."""
    out = []
    for p in paths:
        df = spark.read.parquet(p)
        name = p.rstrip("/").rsplit("/", 1)[-1]
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        out.append((name, spark.read.parquet(f"{root}/{name}").count()))
    return spark.createDataFrame(out, "name string, rows long").withColumn("root", F.lit(root))
