"""Queries of the sources and sinks: the supplied tables are landed in the payloads' forms and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import r6
from tidemark.operators.windows import first_of_each, numbered
from tidemark.sources import tables as T
from tidemark.plans.bindings import ATT, attention, table


#: Entries of one document of a list that is landed whole.
PAGE = 10_000


def place(spark: SparkSession, name: str) -> str:
    """A folder of the shared one for a landing; a later run of the session lands over it."""
    return f"{T.working_dir(spark)}/tidemark/landed/{spark.sparkContext.applicationId}/{name}"


def land_json(df: DataFrame, by: str, path: str) -> None:
    """A JSON file for each row."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).json(path)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, through the file system of the path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


_DAILY = "e AS (SELECT ts::DATE AS day, event_id, event_type || '_' || event_id AS title, round(value * 100)::BIGINT AS hot, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS rank FROM events)"


def daily_lists(spark: SparkSession, sf_dir: str, entry, most: int = 60) -> DataFrame:
    """Each day's list of its first events: the sources' lists have some dozens of entries."""
    e = first_of_each(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["day"], ["event_id"], most)
    return e.groupBy("day").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "value"))), entry).alias("items"))


def lists(rows: DataFrame, entry: str, path: str, each: int = 500) -> None:
    """Rows as JSON documents, lists of about ``each`` entries, a file for each."""
    files = max(1, -(-rows.count() // each))
    own = rows.withColumn("file", F.pmod(F.xxhash64(F.to_json(entry)), F.lit(files)))
    made = own.groupBy("file").agg(F.to_json(F.collect_list(entry)).alias("value"))
    made.repartition("file").write.mode("overwrite").partitionBy("file").text(path)


def _title(x):
    return F.concat_ws("_", x["event_type"], x["event_id"])


@query(f"WITH {_DAILY} SELECT rank::INT AS rank, title, hot AS hot_score, '/s/' || title AS url, 'ranked' AS platform FROM e WHERE rank <= 50")
def ranked_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty of each landed list; a broken payload gives no rows."""
    entry = lambda x: F.struct(_title(x).alias("word"), F.round(x["value"] * 100).cast("bigint").alias("num"), F.concat(F.lit("/s/"), _title(x)).alias("url"))
    path = place(spark, "ranked")
    land_json(daily_lists(spark, sf_dir, entry).select("day", F.struct(F.col("items").alias("realtime")).alias("data")), "day", path)
    put(spark, f"{path}/day=1900-01-01/broken.json", '{"data": {"realtime": [{"word": "cut')
    return T.ranked_list(spark, path)


@query(f"WITH {_DAILY} SELECT rank::INT AS rank, title, 0::BIGINT AS hot_score, '/q/' || title AS url, 'nested' AS platform FROM e")
def nested_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of each day's list, which is landed in pages."""
    entry = lambda x: F.struct(F.struct(_title(x).alias("title"), F.concat(F.lit("/q/"), _title(x)).alias("url")).alias("target"))
    path = place(spark, "nested")
    e = numbered(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["day"], "event_id")
    pages = e.groupBy("day", F.floor((F.col("rank") - 1) / PAGE).alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "value"))), entry).alias("data"))
    pages.repartition("day", "page").write.mode("overwrite").partitionBy("day", "page").json(path)
    return T.nested_list(spark, path, PAGE)


@query("""WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS u, regexp_extract_all(html, 'track\\(([0-9]+)\\)', 1) AS s FROM pages),
x AS (SELECT page_id, t, u, s, unnest(range(1, greatest(len(t), len(u), len(s)) + 1)) AS i FROM p)
SELECT page_id, i::INT AS rank, t[i] AS title, coalesce(try_cast(s[i] AS BIGINT), -1) AS hot_score, u[i] AS url, 'html' AS platform FROM x WHERE i <= 50""")
def html_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of web pages: three lists of matches put together by place, the shorter ones filled with nulls."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("value"))
    return T.html_items(pages, r'<li><a href="[^"]*">([^<]*)</a>', r"track\(([0-9]+)\)", r'<li><a href="([^"]*)"', keep=("page_id",)).na.fill(-1, ["hot_score"])


@query(f"WITH {ATT} SELECT keyword, round(avg(value) + 1e-7, 4) AS avg_interest, max(value) AS max_interest FROM att GROUP BY keyword")
def interest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest interest; the means are rounded so that halves go up in either engine."""
    s = T.interest_snapshot(attention(spark, sf_dir))
    return s.select("keyword", F.round(F.col("avg_interest") + 1e-7, 4).alias("avg_interest"), "max_interest")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_partkey * 3701 END AS hits FROM part")
def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit("nothing found")).otherwise(F.concat(F.lit("about "), F.format_number(F.col("p_partkey") * 3701, 0), F.lit(" results in 0.3 s")))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("value")).select("p_partkey", T.hit_count("value").alias("hits"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS name, max(event_id) AS arrival, arg_max(value, event_id) AS value FROM events WHERE event_id % 10 <> 3 GROUP BY 1, 2")
def last_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with broken ones among them; of each day and name the last record counts."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("name"), F.col("event_id").alias("arrival"), "value")
    line = F.to_json(F.struct(*e.columns))
    path = place(spark, "lines")
    e.select(F.when(F.col("arrival") % 10 == 3, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.mode("overwrite").text(path)
    return T.last_wins(T.json_lines(spark, path, "day string, name string, arrival bigint, value double"), ["day", "name"], "arrival")


@query("""WITH m AS (SELECT o_orderpriority AS key, strftime(o_orderdate, '%Y-%m') AS month, avg(CASE WHEN o_orderpriority[1] = '1' THEN 0 ELSE o_totalprice END) AS v FROM orders GROUP BY 1, 2)
SELECT key, month, round(v + 1e-7, 4) AS value FROM m WHERE key IN (SELECT key FROM m GROUP BY key HAVING max(v) > 0)""")
def monthly_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means; series that are all zero are left out."""
    from tidemark.operators.curation import interest

    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), "o_orderdate", F.when(F.col("o_orderpriority").startswith("1"), 0.0).otherwise(F.col("o_totalprice")).alias("value"))
    return interest(o, "key", "o_orderdate", "value").select("key", "month", F.round(F.col("value") + 1e-7, 4).alias("value"))


@query("""WITH d AS (SELECT o_orderstatus AS keyword, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT keyword, day, 0 AS chunk, n - 1 AS value FROM d UNION ALL SELECT keyword, (day + INTERVAL 3 DAY)::DATE, 1, n * 10 FROM d)
SELECT keyword, day::VARCHAR AS day, arg_min(value, chunk)::BIGINT AS value FROM c GROUP BY keyword, c.day HAVING arg_min(value, chunk) > 0""")
def chunked_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks: the earliest one's value of each day; zeros are not stored."""
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("keyword"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    first = d.select("keyword", "day", F.lit(0).alias("chunk"), (F.col("n") - 1).alias("value"))
    second = d.select("keyword", F.date_add("day", 3).alias("day"), F.lit(1).alias("chunk"), (F.col("n") * 10).alias("value"))
    return T.joined_chunks(first.unionByName(second)).select("keyword", F.col("day").cast("string").alias("day"), "value")


@query("""WITH t AS (SELECT c_custkey, c_name AS v FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT c_custkey, 'new' AS v FROM customer)
SELECT * FROM t UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM t)""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return T.upsert_if_absent(c.filter("c_custkey % 3 = 0").select("c_custkey", F.col("c_name").alias("v")), c.select("c_custkey", F.lit("new").alias("v")), "c_custkey")


@query("SELECT event_type AS keyword, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2")
def publish_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.publish_months(table(spark, sf_dir, "events").select(F.col("event_type").alias("keyword"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("pubdate")))


@query("SELECT text, turn * 10.0::DOUBLE AS start, CASE WHEN turn % 2 = 1 THEN 5.0 ELSE 7.5 END::DOUBLE AS duration FROM conversations")
def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of landed reports; one without an end lasts five seconds."""
    start = (F.col("turn") * 10).cast("double")
    c = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 40).alias("part"), "conv_id").agg(
        F.collect_list(F.struct(F.col("text"), start.alias("start_sec"), F.when(F.col("turn") % 2 == 0, start + 7.5).alias("end_sec"))).alias("transcript")
    )
    path = place(spark, "transcripts")
    land_json(c.groupBy("part").agg(F.flatten(F.collect_list("transcript")).alias("transcript")), "part", path)
    return T.transcript(spark, path)


@query("""WITH p AS (SELECT * FROM part WHERE p_name <> 'red widget') SELECT p_partkey::VARCHAR || ':' || p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n_aliases, CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE p_type END AS category,
  CASE WHEN p_size > 45 THEN 18 WHEN p_size % 10 = 0 THEN 3 ELSE p_size END::DOUBLE AS duration_months, 0.0::DOUBLE AS chaos FROM p""")
def curated_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated entries of landed documents with defaults for what is missing, one name excluded."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(F.col("p_name") == "red widget", F.lit("excluded")).otherwise(F.concat_ws(":", k.cast("string"), "p_name"))
    entry = F.struct(name.alias("name"), F.when(k % 2 == 0, F.array("p_name")).alias("aliases"), F.when(k % 3 != 0, F.col("p_type")).alias("category"), F.lit(2020).alias("year"),
                     F.when(s > 45, 999.0).when(s % 10 != 0, s.cast("double")).alias("duration_months"))
    path = place(spark, "curated")
    lists(p.select(entry.alias("x")), "x", path)
    c = T.curated(spark, path, ("excluded",))
    return c.select("name", F.size("aliases").alias("n_aliases"), "category", "duration_months", "chaos")


@query("""WITH n AS (SELECT p_name AS meme_name, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT meme_name, CASE WHEN k % 2 = 0 THEN 'second' WHEN k % 3 <> 0 THEN 'first' ELSE 'second' END AS v FROM n""")
def narrative_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of landed records: the first seen of a name, unless a later one carries a source."""
    n = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("meme_name")).agg(F.min("p_partkey").alias("k"))
    a, b = place(spark, "narratives/a"), place(spark, "narratives/b")
    record = F.struct("meme_name", "v", "_source").alias("x")
    lists(n.filter("k % 3 <> 0").select("meme_name", F.lit("first").alias("v"), F.lit(None).cast("string").alias("_source")).select(record), "x", a)
    lists(n.select("meme_name", F.lit("second").alias("v"), F.when(F.col("k") % 2 == 0, "model").alias("_source")).select(record), "x", b)
    return T.narratives(spark, [f"{a}/*", f"{b}/*"], "meme_name string, v string, _source string").select("meme_name", "v")


@query(f"WITH {ATT} SELECT keyword, month, value FROM att")
def attention_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse nested map of monthly attention, landed for each category and read back as rows."""
    a = attention(spark, sf_dir).groupBy("category", "keyword").agg(F.map_from_entries(F.collect_list(F.struct("month", "value"))).alias("m"))
    path = place(spark, "attention")
    land_json(a.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("keyword", "m"))).alias("memes")), "category", path)
    return T.attention_json(spark, path)


@query("SELECT n_name AS stem, 'about ' || n_name AS narrative FROM nation")
def narratives_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records keyed by their file's name."""
    path = place(spark, "stems")
    for r in table(spark, sf_dir, "nation").select("n_name").collect():  # 25 rows, whatever the scale
        put(spark, f"{path}/{r['n_name']}.json", f'{{"narrative": "about {r["n_name"]}"}}')
    return T.by_stem(spark, [path], "narrative string").select("stem", "narrative")


def _daily_store(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = place(spark, name)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    T.append_by_day(table(spark, sf_dir, "events").repartition(F.to_date("ts")), path)
    return path


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= DATE '2024-01-20' GROUP BY 1")
def recent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended by day; only the wanted days' folders are read."""
    r = T.recent(spark, _daily_store(spark, sf_dir, "days"), "2024-01-20")
    return r.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT strftime(ts, '%Y-%m') AS month FROM events UNION SELECT DISTINCT strftime(o_orderdate, '%Y-%m') FROM orders")
def months_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _daily_store(spark, sf_dir, "days-and-orders")
    path = place(spark, "order-months")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("dt"))
    o.repartition("dt").write.mode("overwrite").partitionBy("dt").parquet(path)
    return T.months_available(spark, days, path)


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts < DATE '2024-01-21'")
def expired_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retention of ten days would remove on the last day of January."""
    path = _daily_store(spark, sf_dir, "days-kept")
    gone = T.expired(spark, path, "2024-01-31", 10)
    return gone.unionByName(T.expired(spark, path, "2024-01-31", 0)).select(F.date_format("dt", "yyyy-MM-dd").alias("day"))


@query("""WITH e AS (SELECT date_trunc('hour', ts) AS ts, event_id, trim(CASE WHEN event_id % 11 = 0 THEN ' ' ELSE ' ' || event_type || event_id || ' ' END) AS title, (user_id % 3)::INT AS p FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY ts, p ORDER BY event_id) AS rank FROM e)
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, ['weibo', 'zhihu', 'baidu'][p + 1] AS platform, rank::INT AS rank, title, '2.0-backfill' AS version FROM r WHERE title <> ''""")
def migrated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-version captures (three arrays, in pages) as flat items of the new version; blank titles go."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("ts"), "event_id", (F.col("user_id") % 3).alias("p"), F.when(F.col("event_id") % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "event_type", "event_id", F.lit(" "))).alias("title"))
    e = numbered(e, ["ts", "p"], "event_id").withColumn("page", F.floor((F.col("rank") - 1) / PAGE))
    # no array where an hour has nothing of a platform
    arrays = [F.transform(F.sort_array(F.collect_list(F.when(F.col("p") == i, F.struct("event_id", "title")))), lambda s: s["title"]).alias(f"{n}_top10") for i, n in enumerate(("weibo", "zhihu", "baidu"))]
    m = T.migrated(e.groupBy("ts", "page").agg(*arrays), PAGE)
    return m.select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "platform", "rank", "title", "version")


@query("""WITH e AS (SELECT date_trunc('hour', ts) AS h, (user_id % 3)::VARCHAR AS platform, (1 + event_id % 20)::INT AS rank, event_type FROM events),
t AS (SELECT h, platform, count(*) FILTER (rank <= 10) AS n FROM e GROUP BY 1, 2), s AS (SELECT h, count(*) AS signals FROM e WHERE event_type = 'error' GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, platform, n, coalesce(signals, 0)::INT AS signals, '2.0' AS version FROM t LEFT JOIN s USING (h) WHERE n > 0""")
def hourly_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly documents (counts and top ten by platform, signals), opened again."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("ts"), (F.col("user_id") % 3).cast("string").alias("platform"), (1 + F.col("event_id") % 20).cast("int").alias("rank"),
                                              F.col("event_type").alias("title"), F.col("event_id").alias("hot_score"), F.col("event_type").alias("meme"))
    d = T.hourly(e, e.filter("meme = 'error'"))
    n = F.coalesce(F.size("signals"), F.lit(0))
    flat = d.select("ts", F.explode("counts").alias("platform", "n"), F.when(F.col("signals").isNull(), 0).otherwise(n).alias("signals"), "version")
    return flat.select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "platform", "n", "signals", "version")


@query("SELECT p_partkey, p_name, '2.1' AS schema_version FROM part")
def versioned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON sink whose records carry their schema's version, read back."""
    path = place(spark, "versioned")
    T.versioned_json(table(spark, sf_dir, "part").select("p_partkey", F.struct("p_name", "p_type").alias("entry")), path)
    back = spark.read.schema("p_partkey bigint, entry struct<p_name: string, p_type: string>, schema_version string").json(path)
    return back.select("p_partkey", "entry.p_name", "schema_version")
