"""Signal queries over the event stream's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import r6
from tidemark.operators import signals as S
from tidemark.plans.bindings import SIG, signals, table


@query(f"""WITH {SIG} SELECT day::VARCHAR AS day, meme, platform, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY day, meme, platform ORDER BY rank, event_id) AS k FROM sig) WHERE k = 1""")
def dedupe_best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_rank(signals(spark, sf_dir), ["day", "meme", "platform"]).select(F.col("day").cast("string").alias("day"), "meme", "platform", "event_id", "rank")


@query(f"""WITH {SIG} SELECT meme, count(*) AS n, min(rank) AS best, count(*) FILTER (platform = 0) AS p0, count(*) FILTER (platform = 1) AS p1, count(*) FILTER (platform = 2) AS p2 FROM sig GROUP BY meme""")
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(signals(spark, sf_dir), "meme").select("meme", "n", "best", *(F.coalesce(F.col("platforms")[p], F.lit(0)).alias(f"p{p}") for p in range(3)))


@query(f"""WITH {SIG}, s AS (SELECT platform AS src, lead(platform) OVER (PARTITION BY meme ORDER BY ts, event_id) AS dst FROM sig)
SELECT src, dst, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 3) AS p FROM s WHERE dst IS NOT NULL GROUP BY src, dst""")
def platform_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.platform_transitions(signals(spark, sf_dir), "meme", ["ts", "event_id"])


def _expanding(s: DataFrame, by: str) -> DataFrame:
    f = S.flow_patterns(s, by, ["ts", "event_id"])
    return f.select(by, "entry", *(F.size(c).cast("long").alias(c) for c in ("early", "late", "new")), "expanding")


@query(f"""WITH {SIG}, s AS (SELECT meme, platform, row_number() OVER (PARTITION BY meme ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY meme) AS n FROM sig),
h AS (SELECT meme, arg_min(platform, i) AS entry, count(DISTINCT platform) FILTER (i < n // 2) AS early, count(DISTINCT platform) FILTER (i >= n // 2) AS late FROM s WHERE n >= 2 GROUP BY meme),
w AS (SELECT meme, count(*) AS new FROM (SELECT DISTINCT meme, platform FROM s WHERE n >= 2 AND i >= n // 2 EXCEPT SELECT DISTINCT meme, platform FROM s WHERE n >= 2 AND i < n // 2) GROUP BY meme)
SELECT meme, entry, early, late, coalesce(new, 0) AS new, late > early AS expanding FROM h LEFT JOIN w USING (meme)""")
def platform_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanding(signals(spark, sf_dir), "meme")


_TOPIC = f"""{SIG}, tp AS (SELECT day, ts, event_id, meme || ':' || (rank // 10) AS topic, score FROM sig),
per AS (SELECT day, topic, sum(score) AS s, count(*) AS n FROM tp GROUP BY 1, 2), sh AS (SELECT *, s / sum(s) OVER (PARTITION BY day) AS p FROM per),
d AS (SELECT day, count(*) AS k, sum(n) AS signals, sum(-p * ln(p)) AS h FROM sh GROUP BY day),
c AS (SELECT a.day, count(*) AS c FROM per a JOIN per b ON a.topic = b.topic AND b.day = a.day - 1 GROUP BY a.day),
m AS (SELECT d.day, d.k, d.signals, CASE WHEN p.day IS NULL THEN 1 ELSE 1 - coalesce(c, 0) / (d.k + p.k - coalesce(c, 0)) END AS turnover, d.h / ln(d.k + 1) AS entropy,
  CASE WHEN p.day IS NULL THEN 1 ELSE 1 - coalesce(c, 0) / d.k END AS novelty FROM d LEFT JOIN d p ON p.day = d.day - 1 LEFT JOIN c ON c.day = d.day),
mb AS (SELECT *, least(greatest(0.3 * turnover + 0.25 * (1 - entropy) + 0.25 * novelty + 0.2 * least(signals / 10, 1.0), 0), 1) AS score FROM m)"""


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    return s.withColumn("topic", F.concat_ws(":", "meme", F.floor(F.col("rank") / 10).cast("string")))


def _daily(topics: DataFrame) -> DataFrame:
    m = S.daily_metrics(topics, "topic")
    return m.select(F.col("day").cast("string").alias("day"), "topics", *(r6(F.col(c)).alias(c) for c in ("turnover", "entropy", "novelty", "score")), "signals")


@query(f"WITH {_TOPIC} SELECT day::VARCHAR AS day, k AS topics, round(turnover, 6) AS turnover, round(entropy, 6) AS entropy, round(novelty, 6) AS novelty, signals::BIGINT AS signals, round(score, 6) AS score FROM mb")
def daily_turnover_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(_topics(spark, sf_dir))


def _burst(topics: DataFrame) -> DataFrame:
    m = S.micro_correction(S.daily_metrics(topics, "topic"))
    return m.select(r6(F.col("mean3")).alias("mean3"), "rising", r6(F.col("factor")).alias("factor"))


@query(f"""WITH {_TOPIC}, l AS (SELECT * FROM mb ORDER BY day DESC LIMIT 3), a AS (SELECT avg(score) AS m, arg_max(score, day) > arg_min(score, day) AS r FROM l)
SELECT round(m, 6) AS mean3, r AS rising, round(CASE WHEN m > 0.5 AND r THEN 1 + 0.3 * m WHEN m > 0.4 THEN 1 + 0.15 * m WHEN m < 0.2 THEN 0.85 ELSE 1 END, 6) AS factor FROM a""")
def micro_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _burst(_topics(spark, sf_dir))


@query(f"""WITH {SIG}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM sig),
r AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM r GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.sessions(signals(spark, sf_dir), "user_id", "ts", "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query(f"""WITH {SIG} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, meme, count(*) AS n, round(sum(score), 4) AS score FROM sig GROUP BY 1, 2""")
def tumbling_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = signals(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "meme").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "meme", "n", "score")


@query(f"""WITH {SIG}, e AS (SELECT max(ts) AS t FROM sig) SELECT meme, count(*) AS n, count(DISTINCT platform) AS platforms FROM sig, e WHERE ts > t - INTERVAL 168 HOUR GROUP BY meme ORDER BY n DESC, meme LIMIT 20""")
def recent_memes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top report of the last 168 hours before the newest event."""
    s = signals(spark, sf_dir)
    since = s.agg((F.max("ts") - F.expr("interval 168 hours")).alias("since"))
    return s.join(since).filter(F.col("ts") > F.col("since")).groupBy("meme").agg(F.count("*").alias("n"), F.countDistinct("platform").alias("platforms")).orderBy(F.desc("n"), "meme").limit(20)


@query(f"""WITH {SIG}, d AS (SELECT day, sum(score) AS v FROM sig GROUP BY day) SELECT a.day::VARCHAR AS day, round(a.v, 4) AS value, round(b.v, 4) AS previous FROM d a LEFT JOIN d b ON b.day = a.day - 1""")
def asof_prev_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.windows import previous_day

    d = signals(spark, sf_dir).groupBy("day").agg(F.sum("score").alias("v"))
    return previous_day(d, "day", "v").select(F.col("day").cast("string").alias("day"), F.round("v", 4).alias("value"), F.round("previous", 4).alias("previous"))


@query(f"""WITH {SIG}, l AS (SELECT event_id, user_id, ts FROM sig WHERE meme = 'purchase'), r AS (SELECT event_id, user_id, ts, score FROM sig WHERE meme = 'click'),
j AS (SELECT l.event_id, r.score, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC, r.event_id DESC) AS k FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts <= l.ts)
SELECT event_id, round(score, 4) AS score FROM j WHERE k = 1""")
def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the value of the same user's last click up to then."""
    from tidemark.operators.windows import asof_previous

    s = signals(spark, sf_dir)
    j = asof_previous(s.filter("meme = 'purchase'").select("event_id", "user_id", "ts"), s.filter("meme = 'click'"), "user_id", "ts", "score")
    return j.select("event_id", F.round("score", 4).alias("score"))


@query(f"""WITH {SIG}, a AS (SELECT DISTINCT user_id FROM sig WHERE platform = 0 AND rank < 50), b AS (SELECT DISTINCT user_id FROM sig WHERE platform = 0 AND rank >= 50)
SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'first', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'any', count(*) FROM (FROM a UNION FROM b)""")
def set_diff_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).filter("platform = 0")
    a, b = s.filter("rank < 50").select("user_id"), s.filter("rank >= 50").select("user_id")
    parts = (("both", a.intersect(b)), ("first", a.subtract(b)), ("any", a.union(b).distinct()))
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {SIG}, b AS (SELECT platform, (rank // 5) AS bin, sum(score) AS level FROM sig GROUP BY 1, 2), g AS (SELECT p AS platform, k AS bin FROM (SELECT unnest(range(0, 3)) AS p), (SELECT unnest(range(0, 20)) AS k)),
f AS (SELECT g.platform, g.bin, coalesce(level, 0) AS level FROM g LEFT JOIN b ON b.platform = g.platform AND b.bin = g.bin)
SELECT platform::INT AS platform, bin::INT AS bin, round(level, 4) AS level, round(avg(level) OVER (PARTITION BY platform ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth FROM f""")
def timeline_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.binned(signals(spark, sf_dir), "platform", "rank", "score", 5, 20)
    return t.select("platform", "bin", F.round("level", 4).alias("level"), F.round("smooth", 4).alias("smooth"))


@query(f"""WITH {SIG} SELECT meme, min(rank) AS best, count(DISTINCT platform) AS platforms, round(0.7 * 1.0 + 0.3 * 4 / greatest(min(rank), 1), 6) AS level FROM sig GROUP BY meme""")
def live_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.emphasised(signals(spark, sf_dir), "meme", 1.0).select("meme", "best", "platforms", r6(F.col("level")).alias("level"))


@query("""WITH c AS (SELECT conv_id % 50 AS scrape, (turn % 3)::INT AS platform, w AS title, length(text)::DOUBLE AS score FROM (SELECT conv_id, turn, text, unnest(string_split(text, ' ')) AS w FROM conversations)),
d AS (SELECT scrape, title, max(score) AS score FROM c GROUP BY 1, 2),
k AS (SELECT title, count(*) AS n, avg(score) AS score FROM d WHERE NOT contains(title, 'tion') AND NOT contains(title, '.') AND length(title) BETWEEN 4 AND 30 AND NOT (regexp_matches(title, '[0-9]') AND length(title) < 10) GROUP BY title),
t AS (SELECT * FROM k ORDER BY n DESC, title LIMIT 30)
SELECT t.title, t.n, round(t.score, 4) AS score, count(DISTINCT platform) AS platforms FROM t JOIN c USING (title) WHERE t.n >= 2 GROUP BY ALL""")
def candidate_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words of conversations as candidate titles: the top 30."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("scrape"), (F.col("turn") % 3).cast("int").alias("platform"),
                                                     F.explode(F.split("text", " ")).alias("title"), F.length("text").cast("double").alias("score"))
    return S.candidates(c, ["tion"], ["."]).select("title", "n", F.round("score", 4).alias("score"), F.size("platforms").cast("long").alias("platforms"))


@query(f"""WITH {SIG}, s AS (SELECT user_id, avg(score) AS m, count(*) AS n FROM sig GROUP BY user_id) SELECT user_id, n, round(m, 6) AS mean FROM s ORDER BY m DESC, user_id LIMIT 10""")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = signals(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    return g.orderBy(F.desc("m"), "user_id").limit(10).select("user_id", "n", r6(F.col("m")).alias("mean"))


