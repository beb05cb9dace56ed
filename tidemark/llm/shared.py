"""Keys, shared-folder tables and connected components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: The internal document key: rows with equal doc_id and text are one document, other rows never are.
KEY = "_key"


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


#: Bytes of keys up to which a table of keys goes to all tasks; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: The same for the keys of the rows that a stage of the pipeline drops: each stage has such a table and it follows the input, so the driver
#: gathers a small fixed amount only. A row of such keys takes some 150 bytes of a broadcast table, whatever its file has.
DROPPED_BYTES, DROPPED_ROW = 2 << 20, 150


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, dealt anew where a few files would leave cores idle (never on a large input)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if docs.rdd.getNumPartitions() < cores else docs


#: The folder of a single process that names none, by application.
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One of our own only in a single process whose session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dir:
        _own_dir[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _own_dir[context.applicationId]


_scopes: list[list[DataFrame]] = []


def kept(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors. Inside scratch() it is removed
    at the end, unless it is to ``stay``: then with the scratch() around that one, if any."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    scopes = _scopes[:-1] if stay else _scopes
    if scopes:
        scopes[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that kept() makes inside are removed at the end, whatever happens."""
    _scopes.append([])
    try:
        yield
    finally:
        dropped(*_scopes.pop())


def dropped(*tables: DataFrame) -> None:
    """Remove tables made by kept() that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        files = t.inputFiles()
        if files:
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def copies(df: DataFrame, n: str, together: int = 4096) -> DataFrame:
    """Each row n times, with its number ``_copy`` from 0; in two steps, so that no array follows n."""
    some = df.withColumn("_some", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / together))))
    last = F.least(F.col(n) - F.col("_some") * together, F.lit(together)) - 1
    return some.withColumn("_one", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))).withColumn("_copy", F.col("_some") * together + F.col("_one")).drop("_some", "_one")


def few(keys: DataFrame, row_bytes: int, otherwise: str = "") -> DataFrame:
    """keys (a kept table) marked for broadcast if its rows, counted here, take BROADCAST_BYTES at most; else as it is, or with a hint."""
    if keys.count() * row_bytes <= BROADCAST_BYTES:
        return F.broadcast(keys)
    return keys.hint(otherwise) if otherwise else keys


def few_dropped(keys: DataFrame) -> DataFrame:
    """keys (a kept table) of rows to drop, marked for broadcast if they take DROPPED_BYTES at most; else for a merge join, whatever the
    session broadcasts: the driver gathers none of them."""
    if keys.count() * DROPPED_ROW <= min(DROPPED_BYTES, BROADCAST_BYTES):
        return F.broadcast(keys)
    return keys.hint("merge")


#: Of each kind of task that keeps something between its tasks, how to drop it.
kept_between: dict[str, Callable[[], None]] = {}


def only(owner: str = "") -> None:
    """Drop what tasks of other kinds have left in this Python worker."""
    for name, drop in kept_between.items():
        if name != owner:
            drop()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most, for what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def released() -> None:
    """Give memory that this Python worker has freed back to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library, which has no such call
            pass


def mapped(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str = "") -> DataFrame:
    """mapInArrow(); the worker drops what tasks of another ``owner`` keep, and gives its memory back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        try:
            yield from task(batches)
        finally:
            released()

    return df.mapInArrow(run, schema)


#: Shuffle partitions at most: beyond, partitions grow, which their sorts spill for; millions of them would burden the driver.
MOST_PARTITIONS = 100_000


def partitions_for(df: DataFrame, factor: float, each: int = 64 << 20) -> int:
    """How many shuffle partitions of about ``each`` bytes hold ``factor`` times the plan's estimated input; never under the session's
    number, and over MOST_PARTITIONS only if that is."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(MOST_PARTITIONS, int(size * factor / each))) if size < 1 << 58 else least  # beyond: Spark does not know


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for links (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps over DataFrames. A node's links are never gathered:
    its smallest neighbour comes from a partial aggregation and is joined back to the links. Joins are hinted
    to merge: none of a round's tables is gathered by the driver, whatever the session broadcasts. A round's
    end is told by numbers that its last write carries.
    """
    links = kept(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), "links"
    )
    seen = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # tables of their own: both sides of each join are plain exchanges then, so a hub's links can be split
        least = kept(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
        # large star: every larger neighbour u of v is tied to the smallest of v's neighbourhood
        large = kept(both.join(least.hint("merge"), "v").filter("u > v and u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "large")
        # small star: every smaller neighbour of v, and v itself, is tied to the smallest of them
        down = kept(large.groupBy("v").agg(F.min("u").alias("m")), "down")
        small = (
            large.join(down.hint("merge"), "v")
            .select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
            .filter("u <> v")
            .unionByName(down.select("v", F.col("m").alias("u")))
            .distinct()
        )
        told = Observation()
        following = kept(small.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")), "links")
        now = told.get
        dropped(links, least, large, down)
        links = following
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("v").alias("node"), F.col("u").alias("component"))
