"""Structured Streaming forms of the continuously run operators.

Event time must be a timestamp (the supplied tables hold local timestamps: cast under session zone UTC).
Every job takes a streaming DataFrame (or a batch one, where that makes sense) and returns one; nothing
starts a query on its own but ``run_available``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming import store


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """A directory of Parquet files as a stream, a few files each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def events(stream: DataFrame) -> DataFrame:
    """Raw events as ranked signals with a true event time."""
    rank = F.get_json_object("props", "$.k").cast("int")
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("meme"), (F.col("user_id") % 3).cast("int").alias("platform"), rank.alias("rank"), F.col("value").alias("score"))


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Complete windows only (append mode): rows later than ``late`` are dropped by the watermark."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "meme")
    return g.agg(F.count("*").alias("n"), F.min("rank").alias("best"), F.sum("score").alias("score")).select(F.col("window.start").alias("start"), "meme", "n", "best", "score")


def sliding(stream: DataFrame, width: str = "3 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), "meme")
    return g.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "meme", "n", "users")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: scored titles are never scored again."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def live_levels(stream: DataFrame, weight: float = 0.3) -> DataFrame:
    """Per meme an exponential mean of 4 / best rank, one step for each micro-batch that holds the meme (state kept across batches)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, batches = state.get if state.exists else (0.0, 0)
        best = min(int(f["rank"].min()) for f in frames)
        level, batches = (1 - weight) * level + weight * 4 / max(best, 1), batches + 1
        state.update((level, batches))
        yield pd.DataFrame({"meme": [key[0]], "best": [best], "level": [level], "batches": [batches]})

    return stream.groupBy("meme").applyInPandasWithState(
        step, "meme string, best int, level double, batches int", "level double, batches int", "update", "NoTimeout"
    )


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Process what is there (or on a period: ``trigger={"processingTime": "1 hour"}``), a batch at a time, and stop."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    if trigger is None:
        q.awaitTermination()
    return q


def capture(stream: DataFrame, path: str, checkpoint: str, name: str = "capture", time: str = "ts", mode: str = "append") -> StreamingQuery:
    """Append-only sink partitioned by day (store.py): a batch that is replayed is there once. One name for each checkpoint."""
    return run_available(stream, lambda batch, number: store.append(batch, number, path, name, time), checkpoint, mode)
