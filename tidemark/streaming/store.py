"""A day-partitioned store that a stream appends to, safe to repeat.

A micro-batch goes to a folder named by its stream and number, which it replaces, and counts once its commit is written; readers see
committed batches alone. So a batch that is replayed after a failure, before or after its commit, is there once.
Retention first records the day before which nothing counts, then deletes: what is left by a failure in between is invisible, and goes next time.

    path/data/stream=S/batch=N/dt=D/*.parquet    path/commits/S-N/*.json    path/retention/*.json
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_COMMIT, _KEPT = "stream string, batch bigint, rows bigint", "since date"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    fs, at = _fs(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(at) or ()]


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return bool(fs.exists(at))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(stream, batch, rows) of the batches that count."""
    if not _listed(spark, f"{path}/commits/*/*.json"):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(f"{path}/commits/*")


def written(batch: DataFrame, number: int, path: str, stream: str, time: str = "ts") -> None:
    """The batch's rows, partitioned by day, in its own folder."""
    batch.withColumn("dt", F.to_date(time)).write.mode("overwrite").partitionBy("dt").parquet(f"{path}/data/stream={stream}/batch={number}")


def commit(spark: SparkSession, number: int, path: str, stream: str) -> None:
    rows = spark.read.parquet(f"{path}/data/stream={stream}/batch={number}").count()
    spark.createDataFrame([(stream, number, rows)], _COMMIT).coalesce(1).write.mode("overwrite").json(f"{path}/commits/{stream}-{number}")


def append(batch: DataFrame, number: int, path: str, stream: str, time: str = "ts") -> None:
    """Write and commit a micro-batch; an empty one leaves nothing, and one that is committed already stays as it is."""
    spark = batch.sparkSession
    if _listed(spark, f"{path}/commits/{stream}-{number}/*.json"):
        return
    if batch.isEmpty():
        return
    written(batch, number, path, stream, time)
    commit(spark, number, path, stream)


def kept_since(spark: SparkSession, path: str) -> DataFrame:
    """(since): the first day that counts; null where retention never ran."""
    if not _listed(spark, f"{path}/retention/*/*.json"):
        return spark.createDataFrame([(None,)], _KEPT)
    return spark.read.schema(_KEPT).json(f"{path}/retention/*").agg(F.max("since").alias("since"))


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store's rows (schema: those of the stream) with dt, stream and batch; days and batches are pruned by their folders."""
    fields = f"{schema}, dt date, stream string, batch bigint"
    if not _listed(spark, f"{path}/data/stream=*/batch=*/dt=*"):
        return spark.createDataFrame([], fields)
    every = spark.read.schema(fields).option("basePath", f"{path}/data").parquet(f"{path}/data/stream=*/batch=*")
    named = commits(spark, path).select("stream", "batch")
    since = kept_since(spark, path).select(F.col("since").alias("_since"))  # one row
    return every.join(named, ["stream", "batch"], "left_semi").join(F.broadcast(since)).filter("_since is null or dt >= _since").drop("_since")


def expire(spark: SparkSession, path: str, today: str, keep_days: int) -> list[str]:
    """Delete the days more than ``keep_days`` before ``today``, and folders of batches that no commit names (but for a stream's latest, which may be on
    its way); 0 keeps every day. Returns what went. Run again, it finishes what a failure has left."""
    gone = []
    if keep_days > 0:
        day = spark.range(1).select(F.date_sub(F.lit(today).cast("date"), keep_days).alias("since"))
        day.coalesce(1).write.mode("overwrite").json(f"{path}/retention/{uuid.uuid5(uuid.NAMESPACE_URL, f'{today}/{keep_days}').hex}")
        since = str(kept_since(spark, path).first()["since"])
        gone += [p for p in _listed(spark, f"{path}/data/stream=*/batch=*/dt=*") if p.rsplit("dt=", 1)[1] < since]
    named = {(r["stream"], r["batch"]) for r in commits(spark, path).collect()}  # a short row for each batch
    there = [(p, p.rsplit("stream=", 1)[1].split("/")[0], int(p.rsplit("batch=", 1)[1])) for p in _listed(spark, f"{path}/data/stream=*/batch=*")]
    latest = {s: max(n for _, t, n in there if t == s) for _, s, _ in there}
    gone += [p for p, s, n in there if (s, n) not in named and n < latest[s]]
    for p in gone:
        fs, at = _fs(spark, p)
        fs.delete(at, True)
    return gone
