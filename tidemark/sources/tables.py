"""Sources and sinks: landed payloads, versioned documents, retention, upserts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ITEM = "rank int, title string, hot_score bigint, url string, platform string"
#: The landed payload of the first platform: a list of entries under data.realtime.
RANKED_LIST = "data struct<realtime: array<struct<word: string, num: bigint, url: string>>>"
NESTED_LIST = "data array<struct<target: struct<title: string, url: string>>>"
HOURLY = "version string, timestamp string, counts map<string,int>, headlines_embedded array<struct<title: string, platform: string, e: array<float>>>, top_per_platform map<string,array<struct<rank:int,title:string,hot_score:bigint>>>"


#: The folder of a single process that names none, by application.
_own_dir: dict[str, str] = {}


def working_dir(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir; one of our own only in a single process that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own_dir:
            _own_dir[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
        at = _own_dir[context.applicationId]
    return at.rstrip("/")


def ranked_list(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """Items of landed JSON payloads with a flat list; malformed files give no rows."""
    raw = spark.read.schema(RANKED_LIST).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    return raw.select(F.posexplode("data.realtime").alias("p", "x")).filter(F.col("p") < most).select(
        (F.col("p") + 1).alias("rank"), F.col("x.word").alias("title"), F.coalesce("x.num", F.lit(0)).alias("hot_score"), F.col("x.url").alias("url"), F.lit("ranked").alias("platform")
    )


def nested_list(spark: SparkSession, path: str, page: int = 0) -> DataFrame:
    """Items of payloads that nest the entry under ``target``; they carry no heat. page: entries of a payload, where a list is landed in pages (folders ``page=`` from 0)."""
    raw = spark.read.schema(NESTED_LIST).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    before = (F.col("page") * page).cast("int") if page else F.lit(0)
    return raw.select(before.alias("_b"), F.posexplode("data.target").alias("p", "x")).select((F.col("_b") + F.col("p") + 1).alias("rank"), F.col("x.title").alias("title"), F.lit(0).cast("bigint").alias("hot_score"), F.col("x.url").alias("url"), F.lit("nested").alias("platform"))


def html_items(pages: DataFrame, title: str, score: str, url: str, most: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of HTML texts (value): three lists of matches (group 1 of each pattern) put together by place."""
    lists = F.arrays_zip(*(F.regexp_extract_all("value", F.lit(p), F.lit(1)).alias(n) for n, p in (("title", title), ("score", score), ("url", url))))
    found = pages.select(*keep, F.posexplode(lists).alias("p", "x")).filter(F.col("p") < most)
    return found.select(*keep, (F.col("p") + 1).alias("rank"), F.col("x.title").alias("title"), F.col("x.score").try_cast("bigint").alias("hot_score"), F.col("x.url").alias("url"), F.lit("html").alias("platform"))


def html_list(spark: SparkSession, path: str, title: str, score: str, url: str, most: int = 50) -> DataFrame:
    return html_items(spark.read.text(path, wholetext=True), title, score, url, most)


def hit_count(html: str = "value"):
    """A number of hits from a page's text; -1 where there is none."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(html, r"([0-9][0-9,]*)\s*(?:results|条)", 1), ",", "").try_cast("bigint"), F.lit(-1))


def attention_json(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, month, value) from {"memes": {keyword: {month: value}}}; absent months stay absent."""
    raw = spark.read.schema("memes map<string,map<string,double>>").option("multiLine", True).json(path)
    return raw.select(F.explode("memes").alias("keyword", "m")).select("keyword", F.explode("m").alias("month", "value"))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key by arrival."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def narratives(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """One record for each name over several folders in turn: the first seen, unless a later one carries a source."""
    raw = spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("_file", F.col("_metadata.file_path"))
    raw = raw.filter(~F.col("_file").rlike(r"/_[^/]*$"))
    w = Window.partitionBy("meme_name").orderBy(F.when(F.col("_source").isNotNull(), 0).otherwise(1), "_file")
    return raw.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_file")


def hourly(items: DataFrame, signals: DataFrame, version: str = "2.0") -> DataFrame:
    """An hourly document for each capture time: counts, top ten by platform, signals."""
    top = items.filter("rank <= 10").groupBy("ts", "platform").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "hot_score"))).alias("top"), F.count("*").alias("n"))
    doc = top.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("platform", "top"))).alias("top_per_platform"), F.map_from_entries(F.collect_list(F.struct("platform", "n"))).alias("counts"))
    sig = signals.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("meme", "platform", "rank"))).alias("signals"))
    return doc.join(sig, "ts", "left").withColumn("version", F.lit(version))


def migrated(v1: DataFrame, page: int = 0) -> DataFrame:
    """First-version captures (three arrays) as flat items with the new version's label. page: items of an array, where a capture is in pages (column ``page`` from 0)."""
    one = F.array(*(F.struct(F.lit(p).alias("platform"), F.col(f"{p}_top10").alias("items")) for p in ("weibo", "zhihu", "baidu")))
    before = (F.col("page") * page).cast("int") if page else F.lit(0)
    flat = v1.select("ts", before.alias("_b"), F.inline(one)).select("ts", "_b", "platform", F.posexplode("items").alias("p", "title"))
    return flat.select("ts", "platform", (F.col("_b") + F.col("p") + 1).alias("rank"), F.trim("title").alias("title"), F.lit("2.0-backfill").alias("version")).filter("title <> ''")


def append_by_day(df: DataFrame, path: str, time: str = "ts") -> None:
    df.withColumn("dt", F.to_date(time)).write.mode("append").partitionBy("dt").parquet(path)


def recent(spark: SparkSession, path: str, since: str) -> DataFrame:
    """A scan of partitions from a day on (pruned by the partition column)."""
    return spark.read.parquet(path).filter(F.col("dt") >= F.lit(since).cast("date"))


def expired(spark: SparkSession, path: str, today: str, keep_days: int) -> DataFrame:
    """The partitions a retention rule would remove; 0 keeps everything."""
    days = spark.read.parquet(path).select("dt").distinct()
    return days.filter(F.lit(keep_days) > 0).filter(F.col("dt") < F.date_sub(F.lit(today).cast("date"), keep_days))


def upsert_if_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return table.unionByName(new.join(table, key, "left_anti"))


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(text, start, duration) of transcript reports; a missing end is five seconds on."""
    raw = spark.read.schema("transcript array<struct<text: string, start_sec: double, end_sec: double>>").option("multiLine", True).json(path)
    x = raw.select(F.explode("transcript").alias("t"))
    return x.select("t.text", F.col("t.start_sec").alias("start"), (F.coalesce("t.end_sec", F.col("t.start_sec") + 5) - F.col("t.start_sec")).alias("duration"))


def interest_snapshot(landed: DataFrame) -> DataFrame:
    """(keyword, avg_interest, max_interest) of landed (keyword, value) rows."""
    return landed.groupBy("keyword").agg(F.avg("value").alias("avg_interest"), F.max("value").alias("max_interest"))


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """(keyword, day, value) of overlapping chunks (keyword, chunk, day, value): the earliest chunk's value of each day; zeros are not stored."""
    return chunks.groupBy("keyword", "day").agg(F.min_by("value", "chunk").alias("value")).filter("value > 0")


def publish_months(pages: DataFrame) -> DataFrame:
    """(keyword, month, n) of paged search results (keyword, pubdate in epoch seconds)."""
    month = F.date_format(F.timestamp_seconds("pubdate"), "yyyy-MM").alias("month")
    return pages.groupBy("keyword", month).agg(F.count("*").alias("n"))


def curated(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Curated entries with defaults for what is missing."""
    schema = "name string, aliases array<string>, category string, year int, tags array<string>, platforms array<string>, duration_months double, chaos double"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    return raw.filter(~F.col("name").isin(*exclude) if exclude else F.lit(True)).select(
        "name", F.coalesce("aliases", none).alias("aliases"), F.coalesce("category", F.lit("unknown")).alias("category"), "year",
        F.coalesce("tags", none).alias("tags"), F.coalesce("platforms", none).alias("platforms"),
        F.when(F.col("duration_months") >= 999, 18.0).otherwise(F.coalesce("duration_months", F.lit(3.0))).alias("duration_months"), F.coalesce("chaos", F.lit(0.0)).alias("chaos"),
    )


def months_available(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct months of several day-partitioned folders."""
    out = None
    for p in paths:
        m = spark.read.parquet(p).select(F.date_format("dt", "yyyy-MM").alias("month"))
        out = m if out is None else out.unionByName(m)
    return out.distinct()


def by_stem(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Narratives keyed by their file's name without its ending."""
    raw = spark.read.schema(schema).option("multiLine", True).json(paths)
    return raw.withColumn("stem", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def captured_at(field: str, path: str):
    """Capture time from a field or else the file's name (yyyyMMdd_HHmmss)."""
    stamp = F.coalesce(F.nullif(F.substring(field, 1, 15), F.lit("")), F.regexp_extract(path, r"([0-9]{8}_[0-9]{6})", 1))
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))


def versioned_json(df: DataFrame, path: str, version: str = "2.1") -> None:
    """A JSON sink whose records carry their schema's version."""
    df.withColumn("schema_version", F.lit(version)).write.mode("overwrite").json(path)
