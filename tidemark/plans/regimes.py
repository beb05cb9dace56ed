"""Regime sequence queries: transitions, dwells, switches, steps, recurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import distance, r6
from tidemark.operators import recurrence as R, windows as W
from tidemark.plans.bindings import ATT, AXIS, REGIME, attention, axis, regime_sequence

_RUNS = f"""{REGIME}, ch AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (ORDER BY t) THEN 0 ELSE 1 END AS c FROM regime),
runs AS (SELECT t, month, label, sum(c) OVER (ORDER BY t) AS run FROM ch),
ep AS (SELECT label, run, min(t) AS s, max(t) AS e, count(*) AS length FROM runs GROUP BY label, run)"""


@query(f"WITH {REGIME} SELECT t, month, label FROM regime")
def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime_sequence(spark, sf_dir)


@query(f"""WITH {REGIME}, p AS (SELECT label AS src, lead(label) OVER (ORDER BY t) AS dst FROM regime), c AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY 1, 2),
l AS (SELECT DISTINCT label FROM regime)
SELECT a.label AS src, b.label AS dst, coalesce(n, 0) AS n, round(coalesce(n / sum(n) OVER (PARTITION BY a.label), 0), 6) AS p
FROM l a CROSS JOIN l b LEFT JOIN c ON c.src = a.label AND c.dst = b.label""")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regime_sequence(spark, sf_dir)
    return W.on_grid(W.transitions(r, "label", "t"), r.select("label").distinct()).select("src", "dst", "n", r6(F.col("p")).alias("p"))


@query(f"WITH {_RUNS} SELECT label, s AS start, e AS \"end\", length FROM ep")
def dwell_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.episodes(regime_sequence(spark, sf_dir), "label", "t").select("label", "start", "end", "length")


@query(f"""WITH {_RUNS} SELECT label, count(*) AS episodes, round(avg(length), 6) AS mean, round(quantile_cont(length, 0.5), 6) AS median, min(length) AS shortest, max(length) AS longest,
  count(*) FILTER (length >= 6) AS locked FROM ep GROUP BY label""")
def dwell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.episodes(regime_sequence(spark, sf_dir), "label", "t")
    return e.groupBy("label").agg(F.count("*").alias("episodes"), r6(F.avg("length")).alias("mean"), r6(F.percentile("length", 0.5)).alias("median"),
                                  F.min("length").alias("shortest"), F.max("length").alias("longest"), F.count_if(F.col("length") >= 6).alias("locked"))


@query(f"""WITH {_RUNS}, sw AS (SELECT label, count(*) AS c FROM (SELECT label, lag(label) OVER (ORDER BY t) AS p FROM regime) WHERE p <> label GROUP BY 1),
a AS (SELECT sum(c) AS n, sum(c * ln(c)) AS s FROM sw), b AS (SELECT count(*) AS n_rows, count(DISTINCT label) AS k FROM regime), d AS (SELECT max(c) AS top FROM (SELECT count(*) AS c FROM regime GROUP BY label))
SELECT n_rows, n::BIGINT AS n_switches, round(n / (n_rows - 1), 6) AS switch_rate, round(ln(n) - s / n, 6) AS switch_entropy, round((ln(n) - s / n) / ln(k), 6) AS normalised,
       round(top / n_rows, 6) AS dominant_share FROM a, b, d""")
def switch_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.switch_stats(regime_sequence(spark, sf_dir), "label", "t")
    return s.select("n_rows", "n_switches", *(r6(F.col(c)).alias(c) for c in ("switch_rate", "switch_entropy", "normalised", "dominant_share")))


@query(f"WITH {_RUNS} SELECT label, s AS start, length FROM ep WHERE length >= 2")
def locked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.episodes(regime_sequence(spark, sf_dir), "label", "t").filter("length >= 2").select("label", "start", "length")


@query(f"WITH {_RUNS} SELECT t, label, row_number() OVER (PARTITION BY run ORDER BY t) AS dwell FROM runs")
def current_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.current_dwell(regime_sequence(spark, sf_dir), "label", "t").select("t", "label", F.col("dwell").cast("long").alias("dwell"))


@query(f"""WITH {REGIME}, p AS (SELECT t, label, lead(label) OVER (ORDER BY t) AS dst, CASE WHEN month < '1998-01' THEN 'pre' ELSE 'post' END AS part FROM regime),
q AS (SELECT part, label AS src, CASE WHEN lead(t) OVER (PARTITION BY part ORDER BY t) IS NOT NULL THEN lead(label) OVER (PARTITION BY part ORDER BY t) END AS dst FROM p)
SELECT part, src, dst, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY part, src), 6) AS p FROM q WHERE dst IS NOT NULL GROUP BY part, src, dst""")
def transition_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regime_sequence(spark, sf_dir).withColumn("part", F.when(F.col("month") < "1998-01", "pre").otherwise("post"))
    pairs = r.select("part", F.col("label").alias("src"), F.lead("label").over(W.over("t", ["part"])).alias("dst")).filter("dst is not null")
    n = pairs.groupBy("part", "src", "dst").agg(F.count("*").alias("n"))
    return n.withColumn("p", r6(F.col("n") / F.sum("n").over(Window.partitionBy("part", "src"))))


@query(f"""WITH {AXIS}, p AS (SELECT a.t AS t0, b.x, lead(b.x) OVER (PARTITION BY a.t ORDER BY b.t) AS nx FROM axis a JOIN axis b ON b.t BETWEEN a.t AND a.t + 23),
m AS (SELECT t0, avg(x) AS m, count(*) AS c FROM p GROUP BY t0)
SELECT p.t0 AS t, round(sum((x - m) * (nx - m)) / (sum((x - m) * (x - m)) + 1e-12), 5) AS ar1, round(sum((x - m) * (x - m)) / 24, 8) AS var FROM p JOIN m USING (t0) WHERE c = 24 GROUP BY p.t0""")
def rolling_ar1_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = W.rolling_ar1(axis(spark, sf_dir), "x", "t", 24).filter("ar1 is not null")
    return r.select("t", F.round("ar1", 5).alias("ar1"), F.round("var", 8).alias("var"))


@query(f"""WITH {AXIS}, l AS (SELECT unnest(range(-12, 13)) AS lag)
SELECT lag::INT AS lag, count(*) AS n, round(corr(a.x, b.total), 6) AS r FROM l JOIN axis a ON true JOIN axis b ON b.t = a.t + lag GROUP BY lag""")
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.lead_lag(axis(spark, sf_dir), "x", "total", "t").select("lag", "n", r6(F.col("r")).alias("r"))


_STATE = f"""{ATT}, s AS (SELECT month, {", ".join(f"coalesce(sum(value) FILTER (category = {k}), 0) / sum(value) AS c{k}" for k in range(5))} FROM att GROUP BY month),
state AS (SELECT (row_number() OVER (ORDER BY month) - 1)::INT AS t, month, [c0, c1, c2, c3, c4] AS x FROM s)"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, month, x): the five category shares of each month as a state vector."""
    wide = attention(spark, sf_dir).groupBy("month").pivot("category", list(range(5))).agg(F.sum("value")).na.fill(0.0)
    total = sum((F.col(f"`{k}`") for k in range(1, 5)), F.col("`0`"))
    x = F.array(*(F.col(f"`{k}`") / total for k in range(5)))
    return wide.select("month", x.alias("x")).withColumn("t", (F.row_number().over(W.over("month")) - 1).cast("int"))


@query(f"""WITH {_STATE}, d AS (SELECT t, month, list_distance(x, lag(x) OVER (ORDER BY t)) AS step FROM state), g AS (SELECT stddev_pop(step) AS sd FROM d)
SELECT t, month, round(step, 6) AS step, step > 2 * sd AS shock FROM d, g WHERE step IS NOT NULL""")
def state_step_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    d = s.withColumn("step", distance(F.col("x"), F.lag("x").over(W.over("t")))).filter("step is not null")
    return d.join(d.agg(F.stddev_pop("step").alias("sd"))).select("t", "month", r6(F.col("step")).alias("step"), (F.col("step") > 2 * F.col("sd")).alias("shock"))


@query(f"""WITH {AXIS}, e AS (SELECT t, x, lead(x, 2) OVER (ORDER BY t) AS b, lead(x, 4) OVER (ORDER BY t) AS c FROM axis)
SELECT t, round(x, 6) AS x0, round(b, 6) AS x1, round(c, 6) AS x2 FROM e WHERE c IS NOT NULL""")
def takens_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.takens(axis(spark, sf_dir), "x", "t", 3, 2)
    return e.select("t", *(r6(F.element_at("embedded", i + 1)).alias(f"x{i}") for i in range(3)))


_NEAR = f"""{_STATE}, p AS (SELECT a.t AS i, b.t AS j, list_distance(a.x, b.x) AS d FROM state a JOIN state b ON abs(a.t - b.t) >= 12),
eps AS (SELECT quantile_cont(d, 0.1) AS eps FROM p WHERE i < j)"""


@query(f"WITH {_NEAR} SELECT i AS t, count(*) FILTER (d <= eps) AS n, round(min(d), 6) AS nearest FROM p, eps GROUP BY i")
def recurrence_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of each month within the tenth percentile of distances, twelve rows away at least."""
    pairs = R.far_pairs(state(spark, sf_dir), "t", "x", 12)
    eps = pairs.filter("i < j").agg(F.percentile("d", 0.1).alias("eps"))
    return pairs.join(eps).groupBy(F.col("i").alias("t")).agg(F.count_if(F.col("d") <= F.col("eps")).alias("n"), r6(F.min("d")).alias("nearest"))


@query(f"""WITH {REGIME}, {_STATE[len(ATT) + 1:]},
g AS (SELECT a.label AS a, b.label AS b, list_distance(sa.x, sb.x) AS d FROM regime a JOIN regime b ON a.label < b.label JOIN state sa ON sa.t = a.t JOIN state sb ON sb.t = b.t)
SELECT a, b, count(*) AS pairs, round(min(d), 6) AS nearest, round(avg(d), 6) AS mean FROM g GROUP BY a, b""")
def cross_regime_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir).join(regime_sequence(spark, sf_dir).select("t", "label"), "t")
    d = R.group_distances(s, "label", "x")
    return d.select("a", "b", "pairs", r6(F.col("nearest")).alias("nearest"), r6(F.col("mean")).alias("mean"))


@query(f"""WITH {AXIS}, p AS (SELECT a.t AS i, b.t AS j, abs(a.x - b.x) AS d FROM axis a CROSS JOIN axis b), eps AS (SELECT quantile_cont(d, 0.1) AS e FROM p WHERE i < j),
r AS (SELECT i, j, j - i AS k FROM p, eps WHERE d <= e), n AS (SELECT count(*) AS n FROM axis),
dg AS (SELECT k, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM r), dr AS (SELECT k, g, count(*) AS l FROM dg GROUP BY k, g),
vt AS (SELECT j, i - row_number() OVER (PARTITION BY j ORDER BY i) AS g FROM r), vr AS (SELECT j, g, count(*) AS l FROM vt GROUP BY j, g)
SELECT round((SELECT count(*) FROM r) / (n * n), 6) AS rec, round((SELECT sum(l) FILTER (l >= 2) / sum(l) FROM dr), 6) AS det, round((SELECT sum(l) FILTER (l >= 2) / sum(l) FROM vr), 6) AS lam,
       (SELECT max(l) FROM dr WHERE k <> 0) AS l_max, round((SELECT avg(l) FROM vr WHERE l >= 2), 6) AS trapping, round((SELECT avg(l) FROM dr WHERE l >= 2), 6) AS l_mean,
       (SELECT round(coalesce(sum(-c / a * ln(c / a)), 0), 6) + 0.0 FROM (SELECT count(*) AS c, any_value(a) AS a FROM (SELECT l, a, CASE WHEN hi = lo THEN 0 ELSE least(floor(round((l - lo) * least(a, 20) / (hi - lo), 9)), least(a, 20) - 1) END AS bin
         FROM (SELECT l, min(l) OVER () AS lo, max(l) OVER () AS hi, count(*) OVER () AS a FROM dr WHERE l >= 2)) GROUP BY bin)) AS entr FROM n""")
def rqa_det_lam(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.quantification(axis(spark, sf_dir), "t", "x")
    return q.select(*(r6(F.col(c)).alias(c) for c in ("rec", "det", "lam")), "l_max", *(r6(F.col(c)).alias(c) for c in ("trapping", "l_mean")), (r6(F.col("entr")) + F.lit(0.0)).alias("entr"))


@query(f"""WITH {AXIS}, l AS (SELECT unnest(range(1, 21)) AS tau), m AS (SELECT avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM axis)
SELECT tau::INT AS tau, round(sum((a.x - m) * (b.x - m)) / (any_value(n) * any_value(v)), 6) AS acf FROM l JOIN axis a ON true JOIN axis b ON b.t = a.t + tau, m GROUP BY tau""")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.autocorrelation(axis(spark, sf_dir), "x", "t", 20).select("tau", r6(F.col("acf")).alias("acf"))
