"""Queries of the rule and closed-form functions over the catalogue of parts, and of validation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.catalog import query
from tidemark.functions import rules as R
from tidemark.functions.columns import r6
from tidemark.operators import validation as V
from tidemark.plans.bindings import AXIS, axis, table

_X = """p AS (SELECT p_partkey, p_brand, p_type, (p_size % 7 + 1)::DOUBLE AS circles, (p_retailprice % 100) / 100 AS peak, (p_size % 36 + 1)::DOUBLE AS months, (p_size * 9.0)::DOUBLE AS days FROM part),
x AS (SELECT *, 0.03 + 0.89 / (1 + exp(-6 * (0.5 * least(greatest((circles - 1) / 6, 0), 1) + 0.3 * least(greatest(peak, 0), 1) + 0.2 * least(greatest(months / 48, 0), 1) - 0.5))) AS x FROM p),
r AS (SELECT *, CASE WHEN x >= 0.99 THEN 10 WHEN x <= 0.001 THEN 0.1 ELSE -0.999 * ln(greatest(1e-12, 1 - x / 0.999)) / x END AS r0, 2 / greatest(days, 1) AS gamma FROM x)"""


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as curated entries: circles, peak, months, days and the closed-form estimates."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    p = p.select("p_partkey", "p_brand", "p_type", (size % 7 + 1).cast("double").alias("circles"), (F.col("p_retailprice") % 100 / 100).alias("peak"), (size % 36 + 1).cast("double").alias("months"), (size * 9.0).alias("days"))
    p = p.withColumn("x", R.total_infected(F.col("circles"), F.col("peak"), F.col("months")))
    return p.withColumn("r0", R.r0_of(F.col("x"))).withColumn("gamma", R.gamma_of(F.col("days")))


@query(f"WITH {_X} SELECT p_partkey, round(x, 6) AS x, round(r0, 6) AS r0, round(gamma, 6) AS gamma FROM r")
def sir_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated(spark, sf_dir).select("p_partkey", *(r6(F.col(c)).alias(c) for c in ("x", "r0", "gamma")))


@query(f"""WITH {_X} SELECT p_partkey, CASE WHEN r0 < 0.8 THEN 'abortive' WHEN days < 30 AND peak > 0.3 THEN 'pulse' WHEN days > 90 THEN 'long-tail' WHEN r0 > 1 THEN 'outbreak' ELSE 'abortive' END AS kind,
  round(CASE WHEN r0 < 0.8 THEN 0.9 WHEN days < 30 AND peak > 0.3 THEN least(0.9, (r0 - 1) / 3 + 0.5) WHEN days > 90 THEN 0.7 WHEN r0 > 1 THEN least(0.9, (r0 - 1) / 2 + 0.5) ELSE 0.6 END, 6) AS confidence FROM r""")
def meme_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, sure = R.meme_type(F.col("r0"), F.col("days"), F.col("peak"))
    return curated(spark, sf_dir).select("p_partkey", kind.alias("kind"), r6(sure).alias("confidence"))


@query(f"WITH {_X} SELECT p_brand, count(*) AS n, round(avg(r0), 6) AS mean, round(stddev_pop(r0), 6) AS sd, round(min(r0), 6) AS least, round(max(r0), 6) AS most FROM r GROUP BY p_brand")
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curated(spark, sf_dir)
    return c.groupBy("p_brand").agg(F.count("*").alias("n"), *(r6(f("r0")).alias(n) for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"), (F.min, "least"), (F.max, "most"))))


@query(f"WITH {_X}, z AS (SELECT p_partkey, (r0 - avg(r0) OVER (PARTITION BY p_brand)) / nullif(stddev_pop(r0) OVER (PARTITION BY p_brand), 0) AS z FROM r) SELECT p_partkey, round(z, 6) AS z FROM z WHERE abs(z) > 2")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.z_scores(curated(spark, sf_dir), "p_brand", "r0").filter(F.abs("z") > 2).select("p_partkey", r6(F.col("z")).alias("z"))


@query(f"WITH {_X}, s AS (SELECT p_partkey, r0, (sum(r0) OVER (PARTITION BY p_brand) - r0) / nullif(count(*) OVER (PARTITION BY p_brand) - 1, 0) AS g FROM r) SELECT count(g) AS n, round(avg(abs(r0 - g)), 6) AS mae, round(sqrt(avg((r0 - g) ** 2)), 6) AS rmse FROM s")
def loo_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.leave_one_out(curated(spark, sf_dir), "p_brand", "r0")
    return e.agg(F.count("error").alias("n"), r6(F.avg(F.abs("error"))).alias("mae"), r6(F.sqrt(F.avg(F.col("error") * F.col("error")))).alias("rmse"))


@query(f"""WITH {_X}, t AS (SELECT p_brand, avg(r0) AS m, stddev_pop(r0) AS sd FROM r WHERE p_partkey % 5 <> 0 GROUP BY p_brand)
SELECT count(*) AS n, round(avg(abs(r0 - m)), 6) AS mae, round(sqrt(avg((r0 - m) ** 2)), 6) AS rmse, round(corr(r0, m), 6) AS r, round(avg((abs(r0 - m) <= 2 * sd)::INT), 6) AS covered FROM r JOIN t USING (p_brand) WHERE p_partkey % 5 = 0""")
def backtest_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means of four fifths of the parts held against the last fifth (the split is the backtest's)."""
    c = curated(spark, sf_dir)
    b = V.group_mean_backtest(c.filter("p_partkey % 5 <> 0"), c.filter("p_partkey % 5 = 0"), "p_brand", "r0")
    return b.select("n", *(r6(F.col(x)).alias(x) for x in ("mae", "rmse", "r", "covered")))


@query("""WITH c AS (SELECT p_type AS a, p_size % 5 AS b, count(*) AS n FROM part GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS s FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS s FROM c GROUP BY b),
q AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS i, (SELECT sum(s * (s - 1) / 2.0) FROM ra) AS x, (SELECT sum(s * (s - 1) / 2.0) FROM rb) AS y, (SELECT sum(n) FROM c) AS t),
m AS (SELECT sum(n / t * ln(n * t / (ra.s * rb.s))) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b), q), h AS (SELECT (SELECT -sum(s / t * ln(s / t)) FROM ra, q) AS ha, (SELECT -sum(s / t * ln(s / t)) FROM rb, q) AS hb)
SELECT round((i - x * y / (t * (t - 1) / 2.0)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2.0)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness FROM q, m, h""")
def contingency_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("a"), (F.col("p_size") % 5).alias("b"))
    return V.agreement(p, "a", "b").select(*(r6(F.col(c)).alias(c) for c in ("ari", "nmi", "homogeneity", "completeness")))


@query("""WITH v AS (SELECT l_returnflag AS g, l_quantity AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')), n AS (SELECT count(*) FILTER (g = 'A') AS a, count(*) FILTER (g = 'R') AS b FROM v),
c AS (SELECT x, sum(count(*) FILTER (g = 'A')) OVER (ORDER BY x) AS ca, sum(count(*) FILTER (g = 'R')) OVER (ORDER BY x) AS cb FROM v GROUP BY x)
SELECT a AS n_a, b AS n_b, round(max(abs(ca / a - cb / b)), 6) AS d FROM c, n GROUP BY a, b""")
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).select((F.col("l_returnflag") == "A").alias("first"), F.col("l_quantity").alias("x"))
    return V.ks_statistic(v, "first", "x").select("n_a", "n_b", r6(F.col("d")).alias("d"))


@query(f"""WITH {AXIS}, d AS (SELECT x - (SELECT avg(x) FROM axis) AS y, t - (SELECT avg(t) FROM axis) AS a, ln(total) - (SELECT avg(ln(total)) FROM axis) AS b FROM axis),
s AS (SELECT sum(a * a) + 1 AS aa, sum(b * b) + 1 AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS vy FROM d)
SELECT round((bb * ay - ab * vy) / (aa * bb - ab * ab), 7) AS w_t, round((aa * vy - ab * ay) / (aa * bb - ab * ab), 7) AS w_total FROM s""")
def ridge_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge (alpha 1) of the axis on time and log volume, from one pass of moments."""
    a = axis(spark, sf_dir).select("x", F.col("t").cast("double").alias("t"), F.ln("total").alias("total"))
    w = V.ridge(a, ["t", "total"], "x", 1.0)
    return spark.createDataFrame([(round(float(w[0]), 7), round(float(w[1]), 7))], "w_t double, w_total double")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 15 AND list_contains(string_split(p_name, ' '), 'red')")
def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category equality, closed range and tag membership in one scan."""
    p = table(spark, sf_dir, "part")
    return p.filter((F.col("p_type") == "ECONOMY") & F.col("p_size").between(5, 15) & F.array_contains(F.split("p_name", " "), "red")).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_name", "p_retailprice")


@query("""WITH y AS (SELECT year(o_orderdate) AS y, avg(o_totalprice) / 100000 AS m FROM orders GROUP BY 1), d AS (SELECT y, m, m - lag(m) OVER (ORDER BY y) AS d FROM y) SELECT y::INT AS year, round(d, 6) AS shift, abs(d) > 0.05 AS jump FROM d WHERE d IS NOT NULL""")
def yearly_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 100000).alias("m"))
    d = y.withColumn("d", F.col("m") - F.lag("m").over(Window.partitionBy(F.lit(0)).orderBy("year"))).filter("d is not null")
    return d.select("year", r6(F.col("d")).alias("shift"), (F.abs("d") > 0.05).alias("jump"))


@query(f"WITH {AXIS}, c AS (SELECT t, x, lag(x) OVER (ORDER BY t) AS p, (SELECT avg(x) FROM axis) AS m FROM axis) SELECT t, CASE WHEN x > m THEN 'up' ELSE 'down' END AS direction FROM c WHERE (p < m AND x > m) OR (p > m AND x < m)")
def level_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = axis(spark, sf_dir)
    level = a.agg(F.avg("x").alias("level"))
    return V.crossings(a.join(level), "x", "t", F.col("level")).select("t", "direction")


@query(f"""WITH {AXIS}, g AS (SELECT t, CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS g FROM axis WINDOW w AS (ORDER BY t)),
z AS (SELECT t, (g - avg(g) OVER ()) / stddev_pop(g) OVER () AS z FROM g) SELECT t, round(z, 6) AS z FROM z WHERE abs(z) > 1.5""")
def gradient_surges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gradient_z(axis(spark, sf_dir), "x", "t").filter(F.abs("z") > 1.5).select("t", r6(F.col("z")).alias("z"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, list_sort(list(DISTINCT c_nationkey))[1]::INT AS first_nation, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def distribution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    s = F.sort_array(F.collect_set("c_nationkey"))
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), s.alias("s")).select("segment", "n", F.col("s")[0].alias("first_nation"), F.size("s").cast("long").alias("nations"))
