"""The domain's tables over the supplied ones, in Spark and in SQL (as common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Category scores in the order of the region keys.
CATEGORY_SCORE = {0: -0.33, 1: -0.62, 2: -0.59, 3: 0.34, 4: 0.19}
STAGES = ("origin", "emergence", "peak", "controversy", "fixation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, keyword, category, value): order volume by month and nation, summed exactly."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        orders.join(nations, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("month", F.col("n_name").alias("keyword"), F.col("n_regionkey").alias("category"))
        .agg(F.sum("v").cast("double").alias("value"))
    )


ATT = """att AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, n_name AS keyword, n_regionkey AS category, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def score_of(category):
    return F.coalesce(*(F.when(category == k, F.lit(v)) for k, v in CATEGORY_SCORE.items()), F.lit(0.0))


SCORE = "CASE category " + " ".join(f"WHEN {k} THEN {v}" for k, v in CATEGORY_SCORE.items()) + " ELSE 0 END"


def regime_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, month, label): the category with most attention in each observed month, the lowest key on a tie."""
    from tidemark.operators.windows import over

    sums = attention(spark, sf_dir).groupBy("month", "category").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    best = sums.groupBy("month").agg(F.max(F.struct("v", (-F.col("category")).alias("k"))).alias("m"))
    return best.select("month", (-F.col("m.k")).alias("label")).withColumn("t", (F.row_number().over(over("month")) - 1).cast("int")).select("t", "month", "label")


REGIME = ATT + """,
cat AS (SELECT month, category, sum(value::DECIMAL(18,2)) AS v FROM att GROUP BY 1, 2),
best AS (SELECT month, category AS label FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC, category) AS k FROM cat) WHERE k = 1),
regime AS (SELECT (row_number() OVER (ORDER BY month) - 1)::INT AS t, month, label FROM best)"""


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, month, x, total): the category-weighted score of each month."""
    from tidemark.operators.windows import over

    a = attention(spark, sf_dir)
    m = a.groupBy("month").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.sum((score_of(F.col("category")) * F.col("value")).cast("decimal(24,4)")).cast("double").alias("s"))
    return m.select("month", (F.col("s") / F.col("total")).alias("x"), "total").withColumn("t", (F.row_number().over(over("month")) - 1).cast("int"))


AXIS = ATT + f""",
axis0 AS (SELECT month, sum(value::DECIMAL(18,2))::DOUBLE AS total, sum(({SCORE} * value)::DECIMAL(24,4))::DOUBLE AS s FROM att GROUP BY 1),
axis AS (SELECT (row_number() OVER (ORDER BY month) - 1)::INT AS t, month, s / total AS x, total FROM axis0)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, day, meme, platform, rank, score): the events as ranked signals of three platforms."""
    e = table(spark, sf_dir, "events")
    rank = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), F.col("event_type").alias("meme"),
                    (F.col("user_id") % 3).cast("int").alias("platform"), rank.alias("rank"), F.col("value").alias("score"), "user_id")


SIG = """sig AS (SELECT event_id, ts, ts::DATE AS day, event_type AS meme, (user_id % 3)::INT AS platform,
  json_extract_string(props, '$.k')::INT AS rank, value AS score, user_id FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, day, e): the embeddings as headlines of 30 days on the labels' platforms."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.col("vec_id") % 30).cast("int").alias("day"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


VEC = """vec AS (SELECT vec_id, label, (vec_id % 30)::INT AS day, embedding::DOUBLE[] AS e FROM embeddings),
dim AS (SELECT vec_id, label, day, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM vec)"""
