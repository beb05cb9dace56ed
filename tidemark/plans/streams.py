"""Streaming jobs run to the end over a table, so that their results can be held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.plans.bindings import SIG
from tidemark.sources.tables import working_dir
from tidemark.streaming import candidates, jobs, store

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a file source wants a pattern or a folder; the pattern suits a table that is one file as well
    return jobs.events(spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*"))


def _finished(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """The rows of all batches, kept in the working folder."""
    at = f"{working_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:  # a batch that is replayed replaces itself
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    spark.createDataFrame([], df.schema).write.parquet(f"{at}/out/batch=-1")
    jobs.run_available(df, write, f"{at}/checkpoint", mode)
    return spark.read.schema(df.schema).parquet(f"{at}/out/batch=*")


@query(f"""WITH {SIG}, m AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM sig), d AS (SELECT date_trunc('day', ts) AS s, meme, count(*) AS n, min(rank) AS best FROM sig GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d') AS day, meme, n, best FROM d, m WHERE s + INTERVAL 1 DAY <= w""")
def stream_tumbling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete days only, as the watermark closes them."""
    return _finished(spark, jobs.tumbling(_stream(spark, sf_dir)), "append").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "meme", "n", "best")


@query(f"WITH {SIG} SELECT DISTINCT user_id, meme FROM sig")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(spark, jobs.once(_stream(spark, sf_dir), ["user_id", "meme"], "400 days"), "append").select("user_id", "meme")


@query(f"WITH {SIG} SELECT meme, min(rank)::INT AS best, round(0.3 * 4 / greatest(min(rank), 1), 6) AS level FROM sig GROUP BY meme")
def stream_live_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One micro-batch, so one step."""
    return _finished(spark, jobs.live_levels(_stream(spark, sf_dir)), "update").select("meme", "best", F.round("level", 6).alias("level"))


_NOISE, _UNANSWERED = ["error"], 7


def _service(title: str) -> float | None:
    """A stub of the scoring service: it has no answer for some titles, however often it is asked."""
    number = int(title.rsplit(" ", 1)[1])
    return None if number % _UNANSWERED == 0 else len(title) / 30


@query(f"""WITH s AS (SELECT DISTINCT event_type || ' topic ' || user_id AS title, user_id, date_trunc('hour', ts) AS h FROM events), m AS (SELECT max(h) - INTERVAL 48 HOUR AS w FROM s),
g AS (SELECT *, h - lag(h) OVER (PARTITION BY title ORDER BY h) <= INTERVAL 48 HOUR AS near FROM s), r AS (SELECT *, count(*) FILTER (near IS NOT true) OVER (PARTITION BY title ORDER BY h) AS run FROM g),
b AS (SELECT title, any_value(user_id) AS user_id, min(h) AS first, min(h) FILTER (near) AS met, max(h) AS last, max(run) AS runs FROM r GROUP BY title),
c AS (SELECT title, run, min(h) FILTER (near) AS since, max(h) AS fin, row_number() OVER (PARTITION BY title ORDER BY run DESC) AS k FROM r GROUP BY title, run HAVING count(*) > 1)
SELECT b.title, CASE WHEN contains(b.title, '{_NOISE[0]}') THEN 'rejected' WHEN user_id % {_UNANSWERED} <> 0 THEN 'scored' WHEN c.run < b.runs OR fin + INTERVAL 48 HOUR < w THEN 'expired' ELSE 'candidate' END AS status,
  strftime(CASE WHEN contains(b.title, '{_NOISE[0]}') THEN first WHEN user_id % {_UNANSWERED} <> 0 THEN met WHEN c.run < b.runs OR fin + INTERVAL 48 HOUR < w THEN fin + INTERVAL 48 HOUR ELSE c.since END, '%Y-%m-%d %H') AS since,
  round(CASE WHEN NOT contains(b.title, '{_NOISE[0]}') AND user_id % {_UNANSWERED} <> 0 THEN length(b.title) / 30 ELSE 0 END, 6)::DOUBLE AS score
FROM b LEFT JOIN c ON c.title = b.title AND k = 1, m WHERE contains(b.title, '{_NOISE[0]}') OR met IS NOT NULL""")
def stream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each title stands after the incremental detection has run over the events: rejected, candidate, expired or scored."""
    at = f"{working_dir(spark)}/candidates-{uuid.uuid4().hex}"
    e = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*")
    titles = e.select(F.concat_ws(" topic ", "event_type", F.col("user_id").cast("string")).alias("title"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("scrape"))
    jobs.capture(candidates.transitions(titles, _service, [], _NOISE), f"{at}/out", f"{at}/checkpoint", "candidates", "since", "update")
    s = candidates.standing(store.rows(spark, f"{at}/out", candidates.TRANSITION))
    return s.select("title", "status", F.date_format("since", "yyyy-MM-dd HH").alias("since"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query("""WITH d AS (SELECT ts::DATE AS dt, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(dt) AS today FROM d)
SELECT strftime(dt, '%Y-%m-%d') AS day, n FROM d, m WHERE dt >= today - INTERVAL 10 DAY""")
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the store of captures after retention has removed the days more than ten before the last one."""
    at = f"{working_dir(spark)}/retention-{uuid.uuid4().hex}"
    stream = _stream(spark, sf_dir)
    jobs.capture(stream, f"{at}/out", f"{at}/checkpoint")
    today = store.rows(spark, f"{at}/out", _CAPTURED).agg(F.max("dt").alias("d")).first()["d"]
    store.expire(spark, f"{at}/out", str(today), 10)
    left = spark.read.schema(f"{_CAPTURED}, dt date").option("basePath", f"{at}/out/data").parquet(f"{at}/out/data/stream=*/batch=*")  # the files that are there
    return left.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


_CAPTURED = "event_id bigint, ts timestamp, user_id bigint, meme string, platform int, rank int, score double"
