"""Queries of permutation tests, each with SQL that draws the same permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import r6
from tidemark.operators import permutations as P
from tidemark.plans.bindings import AXIS, REGIME, axis, regime_sequence
from tidemark.plans.rules import _X, curated
from tidemark.plans.series import _STATES, states

SWITCH_DRAWS, DIFFERENCE_DRAWS, REVERSAL_DRAWS = 10000, 5000, 500


def _ranked(rows: str, columns: str, n: int) -> str:
    return f"(SELECT {columns}, rep, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || ':' || t || ':'), t) AS rank FROM {rows}, range({n}) AS g(rep))"


@query(f"""WITH {AXIS}, {_STATES}, s AS (SELECT t, label, x, lead(label) OVER (ORDER BY t) AS nxt FROM j), w AS (SELECT nxt, x FROM s WHERE nxt <> label),
o AS (SELECT -1 AS target, count(*) AS switches, avg(x) AS observed FROM w UNION ALL SELECT nxt, count(*), avg(x) FROM w GROUP BY nxt HAVING count(*) >= 3),
n AS (SELECT target, switches, observed, rep, avg(x) AS m FROM {_ranked('j', 'x', SWITCH_DRAWS)} JOIN o ON rank <= switches WHERE switches > 0 GROUP BY ALL)
SELECT target::INT AS target, switches, round(observed, 6) AS observed, round(avg(m), 6) AS null_mean, round(2 * least(avg((round(m, 9) >= round(observed, 9))::INT), avg((round(m, 9) <= round(observed, 9))::INT)), 6) AS p FROM n GROUP BY target, switches, observed""")
def switch_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether regimes switch at unusual values of the axis: all switches (-1), and those into each regime."""
    t = P.switch_test(states(spark, sf_dir), "label", "t", "x", SWITCH_DRAWS)
    return t.select(F.coalesce("into", F.lit(-1)).alias("target"), "switches", *(r6(F.col(c)).alias(c) for c in ("observed", "null_mean", "p")))


def _difference(rows: str) -> str:
    """(rep, difference) of rows (rep, rank, label)."""
    return f"""(SELECT rep, sqrt(sum(d * d)) AS difference FROM (SELECT rep, label, nxt, sum(CASE WHEN late THEN -p ELSE p END) AS d FROM
  (SELECT rep, late, label, nxt, count(*) / sum(count(*)) OVER (PARTITION BY rep, late, label) AS p FROM (SELECT rep, late, label, lead(label) OVER (PARTITION BY rep, late ORDER BY rank) AS nxt FROM
    (SELECT *, rank > (SELECT count(*) // 2 FROM regime) AS late FROM {rows})) WHERE nxt IS NOT NULL GROUP BY rep, late, label, nxt) GROUP BY rep, label, nxt) GROUP BY rep)"""


@query(f"""WITH {REGIME}, o AS (SELECT difference AS observed FROM {_difference('(SELECT 0 AS rep, t + 1 AS rank, label FROM regime)')}), n AS (SELECT difference FROM {_difference(_ranked('regime', 'label', DIFFERENCE_DRAWS))})
SELECT round(observed, 6) AS observed, round(avg(difference), 6) AS null_mean, round(stddev_pop(difference), 6) AS null_sd, round(avg((round(difference, 9) >= round(observed, 9))::INT), 6) AS p FROM n, o GROUP BY observed""")
def difference_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the regimes' transitions differ between the halves of the series more than by chance."""
    t = P.difference_test(regime_sequence(spark, sf_dir), "label", "t", DIFFERENCE_DRAWS)
    return t.select(*(r6(F.col(c)).alias(c) for c in ("observed", "null_mean", "null_sd", "p")))


@query(f"""WITH {AXIS}, s AS (SELECT t, x, ln(total) AS z FROM axis), o AS (SELECT avg(sqrt((x - px) ** 2 + (z - pz) ** 2)) AS observed FROM (SELECT x, z, lag(x) OVER (ORDER BY t) AS px, lag(z) OVER (ORDER BY t) AS pz FROM s)),
n AS (SELECT rep, avg(sqrt((x - px) ** 2 + (z - pz) ** 2)) AS m FROM (SELECT rep, x, z, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM {_ranked('s', 'x, z', REVERSAL_DRAWS)} WINDOW w AS (PARTITION BY rep ORDER BY rank)) GROUP BY rep)
SELECT round(observed, 6) AS observed, round(avg(m), 6) AS null_mean, round(avg((round(m, 9) >= round(observed, 9))::INT), 6) AS p FROM n, o GROUP BY observed""")
def reversal_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the state's steps are as long as those of its months in random order."""
    t = P.reversal_test(axis(spark, sf_dir).withColumn("z", F.ln("total")), ["x", "z"], "t", REVERSAL_DRAWS)
    return t.select(*(r6(F.col(c)).alias(c) for c in ("observed", "null_mean", "p")))


RESAMPLES = 5000


@query(f"""WITH {REGIME}, h AS (SELECT t, label, t >= (SELECT count(*) // 2 FROM regime) AS late FROM regime), w AS (SELECT late, t, label AS src, lead(label) OVER (PARTITION BY late ORDER BY t) AS dst FROM h),
m AS (SELECT late, src, dst, row_number() OVER (PARTITION BY late ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY late) AS size FROM w WHERE dst IS NOT NULL),
d AS (SELECT late, rep, ('0x' || substr(md5(rep || ':' || i || ':'), 1, 8))::BIGINT % size AS i FROM m, range({RESAMPLES}) AS g(rep)),
c AS (SELECT d.late, rep, src, dst, count(*) AS c FROM d JOIN m ON m.late = d.late AND m.i = d.i GROUP BY ALL), s AS (SELECT late, rep, src, sum(c) AS t FROM c GROUP BY ALL),
o AS (SELECT late, src, dst, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY late, src) AS p FROM o),
e AS (SELECT p.late, p.src, p.dst, n, p, coalesce(c / t, 0) AS x FROM p CROSS JOIN range({RESAMPLES}) AS g(rep) LEFT JOIN c ON c.late = p.late AND c.rep = g.rep AND c.src = p.src AND c.dst = p.dst LEFT JOIN s ON s.late = p.late AND s.rep = g.rep AND s.src = p.src)
SELECT late, src, dst, n, round(p, 6) AS p, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM e GROUP BY late, src, dst, n, p""")
def transition_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of either half of the series, with intervals from resampled moves."""
    r = regime_sequence(spark, sf_dir)
    w = Window.partitionBy("late").orderBy("t")
    m = r.withColumn("late", F.col("t") >= F.lit(r.count() // 2)).select("late", "t", F.col("label").alias("src"), F.lead("label").over(w).alias("dst")).filter("dst is not null")
    t = P.transition_intervals(m.withColumn("i", F.row_number().over(w) - 1), "late", "src", "dst", "i", RESAMPLES)
    return t.select("late", "src", "dst", "n", *(r6(F.col(c)).alias(c) for c in ("p", "lo", "hi")))


NOISE_DRAWS, NOISE = 200, 0.05


def _uniform(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


@query(f"""WITH {_X}, n AS (SELECT k, p_partkey, r0, least(greatest(x + {NOISE} * sqrt(-2 * ln({_uniform("k || ':' || p_partkey || ':a'")})) * cos(2 * pi() * {_uniform("k || ':' || p_partkey || ':b'")}), 0.03), 0.92) AS y FROM r, range({NOISE_DRAWS}) AS g(k)),
c AS (SELECT k, p_partkey, r0, -0.999 * ln(greatest(1e-12, 1 - y / 0.999)) / y AS r1 FROM n),
o AS (SELECT k, r0 > 1 AS f, r1 > 1 AS g, row_number() OVER (PARTITION BY k ORDER BY r0, p_partkey) AS a, row_number() OVER (PARTITION BY k ORDER BY r1, p_partkey) AS b FROM c),
s AS (SELECT k, corr(a, b) AS rho, avg((f = g)::INT) AS same FROM o GROUP BY k)
SELECT count(*) AS draws, round(avg(rho), 5) AS mean_rank_correlation, round(min(rho), 5) AS least, round(avg(same), 5) AS same_side FROM s""")
def noise_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the entries' order by R0, and whether they spread, stand normal noise in the share reached: two hundred draws."""
    parts = curated(spark, sf_dir).select("p_partkey", "r0", "x")
    each = P.rank_robustness(parts, NOISE_DRAWS, NOISE)
    return each.agg(F.count("*").alias("draws"), F.round(F.avg("r"), 5).alias("mean_rank_correlation"), F.round(F.min("r"), 5).alias("least"), F.round(F.avg("same"), 5).alias("same_side"))
