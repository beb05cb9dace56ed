"""Queries of series statistics that have a closed form or a short recursion, each with SQL: autoregressions, tests, filters, backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions import numerics as N, rules as R
from tidemark.functions.columns import r6
from tidemark.operators import curation as K, matching as M, replicates as P, validation as V
from tidemark.plans.bindings import ATT, AXIS, axis, regime_sequence, table
from tidemark.plans.rules import _X, curated


def series(spark: SparkSession, sf_dir: str):
    return P.matrix(axis(spark, sf_dir), "t", ["x"])[:, 0]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], schema)


_AR = f"{AXIS}, d AS (SELECT t, x AS y, lag(x) OVER (ORDER BY t) AS p FROM axis), a AS (SELECT regr_intercept(y, p) AS b0, regr_slope(y, p) AS b1, count(p) AS n FROM d WHERE p IS NOT NULL), e AS (SELECT t, y, p, y - b0 - b1 * p AS e, n FROM d, a WHERE p IS NOT NULL)"


@query(f"WITH {_AR} SELECT round(b0, 7) AS intercept, round(b1, 7) AS slope, round((SELECT sum(e * e) FROM e), 8) AS rss, n FROM a")
def first_autoregression(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, e = N.ar_fit(series(spark, sf_dir), 1)
    return frame(spark, [(round(float(b[0]), 7), round(float(b[1]), 7), round(float((e**2).sum()), 8), len(e))], "intercept double, slope double, rss double, n bigint")


_AIC2 = """w AS (SELECT y - avg(y) OVER () AS y, p - avg(p) OVER () AS p, q - avg(q) OVER () AS q FROM (SELECT x AS y, lag(x) OVER (ORDER BY t) AS p, lag(x, 2) OVER (ORDER BY t) AS q FROM axis) WHERE q IS NOT NULL),
s AS (SELECT sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq, sum(p * y) AS py, sum(q * y) AS qy, sum(y * y) AS yy, count(*) AS n FROM w),
two AS (SELECT n, yy - ((qq * py - pq * qy) * py + (pp * qy - pq * py) * qy) / (pp * qq - pq * pq) AS rss FROM s)"""


@query(f"WITH {_AR}, {_AIC2}, c AS (SELECT 1 AS p, n * ln(sum(e * e) / n) + 4 AS aic FROM e GROUP BY n UNION ALL SELECT 2, n * ln(rss / n) + 6 FROM two) SELECT p, round(aic, 5) AS aic, aic = min(aic) OVER () AS chosen FROM c")
def autoregression_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information criteria of the first two orders, and which one is chosen of them."""
    import math

    y = series(spark, sf_dir)
    rows = []
    for p in (1, 2):
        e = N.ar_fit(y, p)[1]
        rows.append((p, round(len(e) * math.log((e**2).sum() / len(e)) + 2 * (p + 1), 5), N.ar_order(y, 2) == p))
    return frame(spark, rows, "p int, aic double, chosen boolean")


@query(f"""WITH {_AR}, c AS (SELECT t, e - avg(e) OVER () AS c, count(*) OVER () AS n FROM e), v AS (SELECT sum(c * c) AS v FROM c),
r AS (SELECT k, max(a.n) AS n, sum(a.c * b.c) / max(v) AS r FROM range(1, 11) AS g(k), c a, c b, v WHERE b.t = a.t - k GROUP BY k) SELECT k::INT AS lag, round(r, 6) AS r, round(sum(n * (n + 2) * r * r / (n - k)) OVER (ORDER BY k), 5) AS q FROM r""")
def residual_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelations of the first autoregression's residuals and the portmanteau statistic up to each lag."""
    e = N.ar_fit(series(spark, sf_dir), 1)[1]
    c = e - e.mean()
    rows = [(k, round(float((c[k:] * c[:-k]).sum() / (c**2).sum()), 6), round(float(N.ljung_box(e, k)[0]), 5)) for k in range(1, 11)]
    return frame(spark, rows, "lag int, r double, q double")


@query(f"""WITH {_AR}, f AS (SELECT t, n, sum(e) OVER (ORDER BY t) AS s0, sum(p * e) OVER (ORDER BY t) AS s1, e AS f0, p * e AS f1 FROM e), m AS (SELECT sum(f0 * f0) / max(n) AS a, sum(f0 * f1) / max(n) AS b, sum(f1 * f1) / max(n) AS c FROM f)
SELECT round(sum((s0 * s0 * c - 2 * s0 * s1 * b + s1 * s1 * a) / (a * c - b * b)) / (max(n) * max(n)), 6) AS statistic FROM f, m""")
def coefficient_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistic of constant coefficients of the first autoregression, from cumulative scores."""
    return frame(spark, [(round(N.nyblom(series(spark, sf_dir), 1), 6),)], "statistic double")


_Q = 0.01


@query(f"""WITH RECURSIVE {AXIS}, z AS (SELECT t, x AS y, lag(x) OVER (ORDER BY t) AS p FROM axis),
k AS (SELECT 0 AS t, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 1e6::DOUBLE AS c00, 0.0::DOUBLE AS c01, 1e6::DOUBLE AS c11 UNION ALL
  SELECT t, b0 + g0 * v, b1 + g1 * v, c00 - g0 * h0, c01 - g0 * h1, c11 - g1 * h1 FROM (SELECT *, h0 / f AS g0, h1 / f AS g1, y - b0 - b1 * p AS v FROM
    (SELECT *, h0 + p * h1 + 1 AS f FROM (SELECT z.t, y, p, b0, b1, c00 + {_Q} AS c00, c01, c11 + {_Q} AS c11, c00 + {_Q} + c01 * p AS h0, c01 + (c11 + {_Q}) * p AS h1 FROM k JOIN z ON z.t = k.t + 1))))
SELECT t, round(b0, 5) AS intercept, round(b1, 5) AS slope FROM k WHERE t > 5""")
def filtered_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first autoregression whose coefficients walk, filtered forward from a diffuse start."""
    z, y = N.ar_design(series(spark, sf_dir), 1)
    b = N.kalman(z, y, _Q)[1]
    return frame(spark, [(t + 1, round(float(r[0]), 5), round(float(r[1]), 5)) for t, r in enumerate(b) if t + 1 > 5], "t int, intercept double, slope double")


@query(f"""WITH RECURSIVE {_AR}, l AS (SELECT x FROM axis ORDER BY t DESC LIMIT 1), f AS (SELECT 0 AS step, x, b0, b1 FROM l, a UNION ALL SELECT step + 1, b0 + b1 * x, b0, b1 FROM f WHERE step < 12)
SELECT step, round(x, 7) AS x FROM f WHERE step > 0""")
def recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve steps ahead, each from the one before."""
    y = series(spark, sf_dir)
    path = N.ar_forecast(y, 1, 12)
    return frame(spark, [(k + 1, round(float(v), 7)) for k, v in enumerate(path)], "step int, x double")


_HALF = "h AS (SELECT t, x, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n, lag(x) OVER (ORDER BY t) AS p FROM axis)"


@query(f"""WITH {AXIS}, {_HALF} SELECT round(corr(i, x), 6) AS r, round(var_pop(x) FILTER (i >= n // 2) / var_pop(x) FILTER (i < n // 2), 5) AS variance_ratio,
  round(abs(arg_max(x, i) - arg_min(x, i)) / (stddev_pop(x - p) * sqrt(max(n))), 6) AS excess FROM h""")
def drift_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation with time, variance ratio of the halves, and end-to-end move over a random walk's."""
    import numpy as np

    y = series(spark, sf_dir)
    d = N.drift_within(y[:, None], np.arange(len(y)))[0]
    return frame(spark, [(round(d["r"], 6), round(d["variance_ratio"], 5), round(d["excess"], 6))], "r double, variance_ratio double, excess double")


@query(f"""WITH {AXIS}, s AS (SELECT t, x, ln(total) AS z FROM axis), d AS (SELECT x - lag(x) OVER (ORDER BY t) AS dx, z - lag(z) OVER (ORDER BY t) AS dz, t FROM s), c AS (SELECT *, lag(dx) OVER (ORDER BY t) AS px, lag(dz) OVER (ORDER BY t) AS pz FROM d WHERE dx IS NOT NULL)
SELECT round(avg(sqrt(dx * dx + dz * dz)), 6) AS mean_step, round(avg((dx * px + dz * pz) / (sqrt(dx * dx + dz * dz) * sqrt(px * px + pz * pz))), 6) AS step_cosine FROM c""")
def step_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean step of the state and the mean cosine between steps in a row (the seeded shuffles apart)."""
    m = P.matrix(axis(spark, sf_dir).withColumn("z", F.ln("total")), "t", ["x", "z"])
    r = N.time_reversal(m, shuffles=20)
    return frame(spark, [(round(r["mean_step"], 6), round(r["step_cosine"], 6))], "mean_step double, step_cosine double")


_STATES = """cat AS (SELECT month, category, sum(value::DECIMAL(18,2)) AS v FROM att GROUP BY 1, 2), best AS (SELECT month, category AS label FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC, category) AS k FROM cat) WHERE k = 1),
j AS (SELECT t, label, x, total / 1e7 AS z FROM axis JOIN best USING (month))"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis(spark, sf_dir).join(regime_sequence(spark, sf_dir).select("month", "label"), "month").withColumn("z", F.col("total") / 1e7)


@query(f"WITH {AXIS}, {_STATES}, m AS (SELECT label, avg(x) AS mx, avg(z) AS mz FROM j GROUP BY label) SELECT label, count(*) AS n, round(sum((x - mx) ** 2 + (z - mz) ** 2), 6) AS dispersion FROM j JOIN m USING (label) GROUP BY label")
def within_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.within_dispersion(states(spark, sf_dir), "label", ["x", "z"]).select("label", "n", r6(F.col("dispersion")).alias("dispersion"))


@query(f"""WITH {AXIS}, {_STATES}, d AS (SELECT j.label, substr(a.month, 1, 4) AS human, count(*) AS c FROM j JOIN axis a USING (t) GROUP BY 1, 2),
t AS (SELECT label, arg_min(human, (-c, human)) AS dominant FROM d GROUP BY label)
SELECT label, count(*) AS n, round(avg(x), 6) AS x, round(avg(z), 6) AS z, any_value(dominant) AS dominant FROM j JOIN t USING (label) GROUP BY label""")
def cluster_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each cluster its size, mean vector and commonest outside label (the year)."""
    d = K.described(states(spark, sf_dir).withColumn("human", F.substring("month", 1, 4)), "label", "human", ["x", "z"])
    return d.select("label", "n", r6(F.col("x")).alias("x"), r6(F.col("z")).alias("z"), "dominant")


@query("""WITH s AS (SELECT p_partkey, (p_partkey % 2)::INT + (p_size % 3 = 0)::INT + (p_partkey % 5 = 0)::INT AS n FROM part) SELECT p_partkey, n, CASE WHEN n >= 2 THEN 'PROCEED_TO_PHASE_2' WHEN n = 1 THEN 'WEAK_SIGNAL' ELSE 'NO_EVIDENCE' END AS verdict FROM s""")
def overall_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict from how many of three tests are significant."""
    k, s = F.col("p_partkey"), F.col("p_size")
    n, v = R.overall_verdict(k % 2 == 1, s % 3 == 0, k % 5 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), v.alias("verdict"))


@query(f"""WITH {_X}, q AS (SELECT 2010 + p_partkey % 9 AS year, p_brand AS g, r0 FROM r), b AS (SELECT DISTINCT year AS cut FROM q WHERE year BETWEEN 2011 AND 2017),
t AS (SELECT cut, g, avg(r0) AS m, stddev_pop(r0) AS sd FROM q JOIN b ON year <= cut GROUP BY cut, g)
SELECT cut::INT AS train_end, count(*) AS n, round(avg(abs(r0 - m)), 6) AS mae, round(sqrt(avg((r0 - m) ** 2)), 6) AS rmse, round(corr(r0, m), 6) AS r, round(avg((abs(r0 - m) <= 2 * sd)::INT), 6) AS covered FROM q JOIN t USING (g) WHERE year > cut GROUP BY cut""")
def rolling_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means of all entries up to a year against the later ones, year by year."""
    q = curated(spark, sf_dir).select((2010 + F.col("p_partkey") % 9).cast("int").alias("year"), F.col("p_brand").alias("g"), "r0")
    b = V.rolling_backtest(q, "g", "r0", "year", list(range(2011, 2018)))
    return b.select("train_end", "n", *(r6(F.col(c)).alias(c) for c in ("mae", "rmse", "r", "covered")))


_NOISE = "(((p_partkey * 7919 + k * 104729) % 1000) / 1000.0::DOUBLE - 0.5) * 0.1"


@query(f"""WITH {_X}, n AS (SELECT k, p_partkey, r0, x + {_NOISE} AS y FROM r, range(20) AS g(k)), c AS (SELECT k, p_partkey, r0, CASE WHEN least(greatest(y, 0.01), 0.99) >= 0.99 THEN 10 ELSE -0.999 * ln(greatest(1e-12, 1 - least(greatest(y, 0.01), 0.99) / 0.999)) / least(greatest(y, 0.01), 0.99) END AS r1 FROM n),
o AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY r0, p_partkey) AS a, row_number() OVER (PARTITION BY k ORDER BY r1, p_partkey) AS b FROM c) SELECT k::INT AS replicate, round(corr(a, b), 5) AS spearman FROM o GROUP BY k""")
def noisy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the entries' order by R0 stands noise in the share reached: rank correlation of each of twenty fixed draws."""
    noise = (((F.col("p_partkey") * 7919 + F.col("replicate") * 104729) % 1000) / F.lit(1000.0) - 0.5) * 0.1
    draws = curated(spark, sf_dir).select("p_partkey", "r0", "x", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("replicate"))
    moved = draws.withColumn("r1", R.r0_of(F.least(F.greatest(F.col("x") + noise, F.lit(0.01)), F.lit(0.99))))
    return V.rank_correlation(moved, "replicate", "r0", "r1", "p_partkey").select("replicate", F.round("r", 5).alias("spearman"))


@query("""WITH p AS (SELECT p_partkey, p_size % 11 / 10.0::DOUBLE AS a, p_partkey % 13 / 12.0::DOUBLE AS b FROM part), c(form, ca, cb) AS (VALUES ('calm', 0.2::DOUBLE, 0.2::DOUBLE), ('split', 0.8, 0.3), ('storm', 0.5, 0.9)),
d AS (SELECT p_partkey, form, sqrt((a - ca) ** 2 + (b - cb) ** 2) AS d FROM p, c) SELECT p_partkey, arg_min(form, (d, form)) AS form, round(greatest(0, 1 - min(d)), 6) AS confidence FROM d GROUP BY p_partkey""")
def order_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a few named centres, with confidence one minus the distance, zero at least."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 11 / F.lit(10.0)).alias("a"), (F.col("p_partkey") % 13 / F.lit(12.0)).alias("b"))
    centres = spark.createDataFrame([("calm", 0.2, 0.2), ("split", 0.8, 0.3), ("storm", 0.5, 0.9)], "form string, ca double, cb double")
    d = F.sqrt((F.col("a") - F.col("ca")) ** 2 + (F.col("b") - F.col("cb")) ** 2)
    near = M.nearest(p, centres, d, "p_partkey", "form")
    return near.select("p_partkey", "form", r6(F.greatest(1 - F.col("d"), F.lit(0.0))).alias("confidence"))


@query(f"""WITH {ATT}, o AS (SELECT month, keyword, CASE WHEN keyword IN ('NATION_1', 'NATION_2') AND month >= '1998-01' THEN avg(value) FILTER (month <= '1997-12') OVER (PARTITION BY keyword) ELSE value END AS v, value FROM att)
SELECT month, round(sum(v), 2) AS counterfactual, round(sum(value), 2) AS observed FROM o GROUP BY month""")
def counterfactual_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months' totals had two keywords stayed at their level of before 1998."""
    from tidemark.plans.bindings import attention

    a = attention(spark, sf_dir).withColumn("kept", F.col("value"))
    o = M.overwritten(a, "keyword", "month", "value", F.col("keyword").isin("NATION_1", "NATION_2"), "1997-12", "1998-01")
    return o.groupBy("month").agg(F.round(F.sum("value"), 2).alias("counterfactual"), F.round(F.sum("kept"), 2).alias("observed"))


@query()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge, elastic net and a forest of the next month's axis on the six before, over expanding folds."""
    from tidemark.operators import models

    rows = K.lookback(axis(spark, sf_dir).select("t", "x"), ["x"], "t", 6)
    return models.compared(rows, "x", [f"x_{k}" for k in range(1, 7)], "t")

