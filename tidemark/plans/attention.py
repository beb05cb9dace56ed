"""Attention queries: monthly series by keyword and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import r6
from tidemark.operators import attention as A, windows as W
from tidemark.plans.bindings import ATT, AXIS, CATEGORY_SCORE, SCORE, attention, axis, score_of, table


@query(f"WITH {ATT} SELECT month, keyword, round(value, 2) AS value FROM att")
def attention_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention(spark, sf_dir).select("month", "keyword", F.round("value", 2).alias("value"))


@query(f"""WITH {ATT}, s AS (SELECT *, value / sum(value) OVER (PARTITION BY month) AS p FROM att WHERE value > 0),
c AS (SELECT month, category, sum(value::DECIMAL(18,2)) AS v FROM att GROUP BY 1, 2),
d AS (SELECT month, category AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC, category) AS k FROM c) WHERE k = 1)
SELECT month, round(sum(value), 2) AS total, count(*) AS active, round(sum(p * p), 6) AS hhi, round(-sum(p * ln(p)), 6) AS entropy,
       round(sum({SCORE} * value) / sum(value), 6) AS axis, any_value(dominant) AS dominant
FROM s JOIN d USING (month) GROUP BY month""")
def attention_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: total, active keywords, concentration, entropy, category axis and dominant category by month."""
    a = attention(spark, sf_dir)
    shape = A.structure(a, "month")
    level = a.groupBy("month").agg(A.weighted_mean(score_of(F.col("category")), F.col("value")).alias("axis"))
    cats = a.groupBy("month", "category").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    top = cats.groupBy("month").agg(F.max(F.struct("v", (-F.col("category")).alias("k"))).alias("m")).select("month", (-F.col("m.k")).alias("dominant"))
    return shape.join(level, "month").join(top, "month").select(
        "month", F.round("total", 2).alias("total"), "active", r6(F.col("hhi")).alias("hhi"), r6(F.col("entropy")).alias("entropy"), r6(F.col("axis")).alias("axis"), "dominant"
    )


@query(f"""WITH {ATT}, m AS (SELECT DISTINCT month FROM att), c AS (SELECT r_regionkey AS category FROM region), s AS (SELECT month, category, sum(value) AS v FROM att GROUP BY 1, 2)
SELECT month, category, round(coalesce(v, 0) / sum(coalesce(v, 0)) OVER (PARTITION BY month), 6) AS share FROM m CROSS JOIN c LEFT JOIN s USING (month, category)""")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shares(attention(spark, sf_dir), "month", "category", list(CATEGORY_SCORE)).select("month", "category", r6(F.col("share")).alias("share"))


@query(f"""WITH {ATT}, s AS (SELECT month, category, sum(value) AS v FROM att GROUP BY 1, 2), p AS (SELECT *, v / sum(v) OVER (PARTITION BY month) AS p FROM s)
SELECT month, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY month""")
def category_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.category_entropy(attention(spark, sf_dir), "month", "category", "value").select("month", r6(F.col("entropy")).alias("entropy"))


@query(f"""WITH {ATT} SELECT month, {", ".join(f"round(coalesce(sum(value) FILTER (category = {k}), 0), 2) AS c{k}" for k in CATEGORY_SCORE)} FROM att GROUP BY month""")
def attention_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = attention(spark, sf_dir).groupBy("month").pivot("category", list(CATEGORY_SCORE)).agg(F.sum("value")).na.fill(0.0)
    return wide.select("month", *(F.round(F.col(f"`{k}`"), 2).alias(f"c{k}") for k in CATEGORY_SCORE))


@query(f"""WITH {ATT}, i AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY month) - 1 AS i, max(value) OVER (PARTITION BY keyword) AS peak FROM att),
p AS (SELECT *, min(CASE WHEN value = peak THEN i END) OVER (PARTITION BY keyword) AS ip, (value + lag(value) OVER (PARTITION BY keyword ORDER BY month)) / 2 AS trap FROM i),
f AS (SELECT *, min(CASE WHEN i > ip AND value < 0.1 * peak THEN i END) OVER (PARTITION BY keyword) AS fell FROM p)
SELECT keyword, round(max(peak), 2) AS peak, min(CASE WHEN i = ip THEN month END) AS peak_at, count(*) AS n,
       min(CASE WHEN value >= greatest(0.5, 0.1 * peak) THEN i END) AS first_i, max(CASE WHEN value >= greatest(0.5, 0.1 * peak) THEN i END) AS last_i,
       round(coalesce(sum(trap), 0), 4) AS area, coalesce(bool_or(i > fell AND value > 0.3 * peak), false) AS resurgence
FROM f GROUP BY keyword""")
def keyword_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.life_cycle(attention(spark, sf_dir), "keyword", "month")
    return c.select("keyword", F.round("peak", 2).alias("peak"), "peak_at", "n", F.col("first_i").cast("long"), F.col("last_i").cast("long"), F.round("area", 4).alias("area"), "resurgence")


_STAGES = f"""{ATT}, i AS (SELECT *, (row_number() OVER (PARTITION BY keyword ORDER BY month) - 1)::INT AS i, max(value) OVER (PARTITION BY keyword) AS peak FROM att),
p AS (SELECT *, min(CASE WHEN value = peak THEN i END) OVER (PARTITION BY keyword) AS ip FROM i),
k AS (SELECT keyword, max(ip) AS ip, max(i) AS last, min(CASE WHEN i BETWEEN ip + 3 AND ip + 5 AND value < 0.3 * peak THEN i END) AS dip FROM p
      GROUP BY keyword HAVING count(*) FILTER (value >= greatest(0.1 * peak, 2.0)) >= 3),
c AS (SELECT *, least(4, ip) AS span, coalesce(dip, ip + 5) AS c FROM k),
s AS (SELECT keyword, last, 0 AS pos, 'origin' AS stage, 0 AS lo, greatest(0, ip - span - 1) AS hi FROM c UNION ALL
      SELECT keyword, last, 1, 'emergence', ip - span, ip - 1 FROM c UNION ALL SELECT keyword, last, 2, 'peak', ip - 2, ip + 2 FROM c UNION ALL
      SELECT keyword, last, 3, 'controversy', ip + 3, c FROM c UNION ALL SELECT keyword, last, 4, 'fixation', c + 1, last FROM c),
st AS (SELECT keyword, pos, stage, greatest(lo, 0) AS lo, least(hi, last) AS hi FROM s WHERE greatest(lo, 0) <= least(hi, last))"""


@query(f"WITH {_STAGES} SELECT keyword, pos, stage, lo, hi FROM st")
def stage_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stage_intervals(attention(spark, sf_dir), "keyword", "month")


@query(f"""WITH {_STAGES}, o AS (SELECT month, stage, row_number() OVER (PARTITION BY i.keyword, i.i ORDER BY pos) AS k FROM i JOIN st ON i.keyword = st.keyword AND i.i BETWEEN lo AND hi)
SELECT month, stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY month), 6) AS share FROM o WHERE k = 1 GROUP BY month, stage""")
def stage_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    a = attention(spark, sf_dir)
    placed = A.stage_of(a, A.stage_intervals(a, "keyword", "month"), "keyword", "month").filter("stage is not null")
    n = placed.groupBy("month", "stage").agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("month"))))


@query(f"""WITH {AXIS}, w AS (SELECT t, month, avg(x) OVER a AS m1, count(*) OVER a AS c1, avg(x) OVER b AS m0, count(*) OVER b AS c0 FROM axis
  WINDOW a AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), b AS (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT t, month, round(m1 - m0, 6) AS shift FROM w WHERE c1 = 6 AND c0 = 6""")
def phase_shift_6v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.before_after(axis(spark, sf_dir), "x", "t").filter("shift is not null").select("t", "month", r6(F.col("shift")).alias("shift"))


@query(f"""WITH RECURSIVE {AXIS}, w AS (SELECT t, avg(x) OVER a - avg(x) OVER b AS s, count(*) OVER a AS c1, count(*) OVER b AS c0 FROM axis
  WINDOW a AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), b AS (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
f AS (SELECT t FROM w WHERE c1 = 6 AND c0 = 6 AND abs(s) > 0.02),
r AS (SELECT min(t) AS t FROM f UNION ALL SELECT (SELECT min(f.t) FROM f WHERE f.t - r.t > 6) FROM r WHERE r.t IS NOT NULL)
SELECT t FROM r WHERE t IS NOT NULL""")
def phase_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts of more than .02 (the supplied axis moves less than the domain's), six rows apart at least."""
    return W.refractory(W.before_after(axis(spark, sf_dir), "x", "t"), F.abs("shift") > 0.02, "t")


@query(f"""WITH {ATT}, k AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY month DESC) AS k, count(*) OVER (PARTITION BY keyword) AS n FROM att),
g AS (SELECT keyword, avg(value) FILTER (k <= 3) AS recent, avg(value) FILTER (k > 3) AS mean, stddev_pop(value) FILTER (k > 3) AS sd FROM k WHERE n >= 12 GROUP BY keyword)
SELECT keyword, round((recent - mean) / sd, 6) AS z FROM g WHERE sd > 0 AND (recent - mean) / sd > -0.5""")
def trend_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomaly score of recent months, from -.5 up (so that quiet data still show some)."""
    return A.anomalies(attention(spark, sf_dir), "keyword", "month", z=-0.5).select("keyword", r6(F.col("z")).alias("z"))


@query(f"""WITH {ATT}, i AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY month) AS i, count(*) OVER (PARTITION BY keyword) AS n, max(value) OVER (PARTITION BY keyword) AS peak FROM att),
p AS (SELECT *, min(CASE WHEN value = peak THEN i END) OVER (PARTITION BY keyword) AS ip FROM i),
g AS (SELECT keyword, max(peak) AS peak, max(n) AS n, avg(value) FILTER (i > n - 12) AS recent12, count(*) FILTER (value > 0.15 * peak) AS active, coalesce(max(value) FILTER (i > ip), 0) AS after FROM p GROUP BY keyword)
SELECT keyword, active, CASE WHEN recent12 > 0.4 * peak AND n > 24 THEN 'persistent' WHEN peak > 50 AND active < 6 THEN 'pulse' WHEN after > 0.3 * peak THEN 'rebound'
  WHEN recent12 < 0.15 * peak THEN 'fading' ELSE 'long tail' END AS shape FROM g""")
def curve_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.curve_shape(attention(spark, sf_dir), "keyword", "month").select("keyword", "active", "shape")


@query(f"""WITH {ATT}, d AS (SELECT strptime(month || '-01', '%Y-%m-%d')::DATE AS d, sum(value) AS value FROM att GROUP BY 1),
e AS (SELECT (SELECT min(d) FROM d) AS a, (SELECT max(d) FROM d) AS b)
SELECT strftime(s, '%Y-%m') AS month, round(coalesce(value, 0), 2) AS value, value IS NULL AS missing
FROM (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS s FROM e) LEFT JOIN d ON d.d = s::DATE""")
def calendar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = attention(spark, sf_dir).groupBy("month").agg(F.sum("value").alias("value"))
    return W.month_spine(m).join(m, "month", "left").select("month", F.round(F.coalesce("value", F.lit(0.0)), 2).alias("value"), F.col("value").isNull().alias("missing"))


@query(f"""WITH {ATT}, m AS (SELECT DISTINCT month FROM att), g AS (SELECT month, n_name AS keyword FROM m CROSS JOIN nation),
v AS (SELECT month, keyword, CASE WHEN hash_bucket <> 0 THEN value END AS value FROM (SELECT *, (month[6:7]::INT + category) % 4 AS hash_bucket FROM att))
SELECT month, keyword, round(last_value(value IGNORE NULLS) OVER (PARTITION BY keyword ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS value FROM g LEFT JOIN v USING (month, keyword)""")
def locf_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month x keyword grid with a quarter of the values missing, carried forward."""
    a = attention(spark, sf_dir)
    gone = (F.substring("month", 6, 2).cast("int") + F.col("category")) % 4 == 0
    v = a.select("month", "keyword", F.when(~gone, F.col("value")).alias("value"))
    grid = a.select("month").distinct().join(a.select("keyword").distinct())
    return W.carried_forward(grid.join(v, ["month", "keyword"], "left"), "value", "month", ["keyword"]).select("month", "keyword", F.round("value", 2).alias("value"))


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))


def _stitched(windows: DataFrame) -> DataFrame:
    own = windows.select("w", "day", (F.col("v") * (1 + F.col("w") * 0.5)).alias("v"))
    return A.stitched(own, "w", "day", "v").select(F.col("day").cast("string").alias("day"), F.round("v", 2).alias("value"))


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1), e AS (SELECT min(day) AS a, max(day) AS b FROM d),
n AS (SELECT unnest(range(0, greatest(0, ceil((b - a - 74) / 45))::BIGINT + 1)) AS w FROM e),
s AS (SELECT w, day, v * (1 + w * 0.5) AS v FROM d, e, n WHERE day - a >= w * 45 AND day - a < w * 45 + 75),
o AS (SELECT b.w, avg(a.v) AS x, avg(b.v) AS y, count(*) AS c FROM s a JOIN s b ON a.w + 1 = b.w AND a.day = b.day GROUP BY b.w),
f AS (SELECT w, exp(sum(ln(coalesce(CASE WHEN c >= 5 THEN x / y END, 1))) OVER (ORDER BY w)) AS f FROM (SELECT DISTINCT w FROM s) LEFT JOIN o USING (w))
SELECT day::VARCHAR AS day, round(arg_min(v * f, w), 2) AS value FROM s JOIN f USING (w) GROUP BY day""")
def stitch_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping 75-day windows, 45 days apart, from the first day's daily volume to the last one's, each on a scale of its own, stitched."""
    d = _volume(spark, sf_dir)
    ends = d.agg(F.min("day").alias("first"), F.max("day").alias("final"))
    k, span = F.datediff("day", "first"), F.datediff("final", "first")
    most = F.greatest(F.lit(0), F.ceil((span - 74) / 45)).cast("int")  # the window that reaches the last day is the last one
    lo = F.greatest(F.lit(0), F.floor((k - 75) / 45) + 1).cast("int")
    hi = F.least(F.floor(k / 45).cast("int"), most)
    return _stitched(d.join(ends).withColumn("w", F.explode(F.sequence(lo, hi))))


@query(f"WITH {AXIS} SELECT round(regr_slope(x, t), 9) AS slope, round(corr(x, t), 6) AS r, count(*) AS n FROM axis")
def regr_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis(spark, sf_dir).agg(F.round(F.regr_slope("x", F.col("t").cast("double")), 9).alias("slope"), r6(F.corr("x", "t")).alias("r"), F.count("*").alias("n"))
