"""Event streams: append-only logs, counts by time window with late data, a rate limit as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sylvaspark.operators.refresh import LIMIT, WINDOW_S


def read_log(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-line files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def append_log(stream: DataFrame, folder: str, checkpoint: str):
    """The stream appended to a folder of JSON lines, each record once."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def window_counts(stream: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Events by type and window; events later than `late` behind the newest are dropped by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def rate_limit(stream: DataFrame, client: str = "user_id", at: str = "ts", limit: int = LIMIT, window_s: int = WINDOW_S, late: str = "1 hour") -> DataFrame:
    """Events with `allowed`, by the same rule as the batch operator; the state of a client is its open window. It ends when the watermark, `late` behind the newest event, has passed it by ten windows."""
    kind = dict(stream.dtypes)[client]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_ = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for t in rows["at"]:
            s = t.timestamp()
            open_ = [x for x in open_ if s - x <= window_s]
            ok = len(open_) < limit
            if ok:
                open_.append(s)
            out.append(ok)
        state.update((open_,))
        state.setTimeoutTimestamp(int(max(rows["at"].iloc[-1].timestamp() + 10 * window_s, state.getCurrentWatermarkMs() / 1000 + 1) * 1000))
        yield pd.DataFrame({"client": key[0], "at": rows["at"].to_numpy(), "allowed": out})

    s = stream.select(F.col(client).alias("client"), F.col(at).alias("at")).withWatermark("at", late)
    return s.groupBy("client").applyInPandasWithState(step, f"client {kind}, at timestamp, allowed boolean", "open array<double>", "append", GroupStateTimeout.EventTimeTimeout)
