"""Catalogue and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import r6
from tidemark.functions.udfs import embed
from tidemark.operators import curation as C
from tidemark.plans.bindings import AXIS, axis, table
from tidemark.plans.rules import _X, curated


@query(f"""WITH {_X} SELECT p_type, count(*) AS n, round(avg(r0), 6) AS r0_centre, round(1.5 * stddev_pop(r0), 6) AS r0_radius, round(avg(x), 6) AS x_centre, round(1.5 * stddev_pop(x), 6) AS x_radius, min(p_partkey) AS first FROM r GROUP BY p_type""")
def phase_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.regions(curated(spark, sf_dir), "p_type", ["r0", "x"], "p_partkey")
    return g.select("p_type", "n", *(r6(F.col(c)).alias(c) for c in ("r0_centre", "r0_radius", "x_centre", "x_radius")), F.col("members")[0].alias("first"))


@query(f"WITH {_X} SELECT 'r0' AS axis, 1.3::DOUBLE AS cut, count(*) FILTER (r0 < 1.3) AS below, count(*) FILTER (r0 >= 1.3) AS above FROM r UNION ALL SELECT 'x', 0.4::DOUBLE, count(*) FILTER (x < 0.4), count(*) FILTER (x >= 0.4) FROM r")
def phase_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.boundaries(curated(spark, sf_dir), {"r0": 1.3, "x": 0.4})


@query(f"WITH {_X} SELECT CASE WHEN r0 < 1.2 THEN 'quiet' WHEN r0 < 1.5 THEN 'edge' ELSE 'live' END AS basin, count(*) AS n, round(min(r0), 6) AS low, round(max(r0), 6) AS high FROM r GROUP BY 1")
def phase_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = C.basins(curated(spark, sf_dir), "r0", [1.2, 1.5], ["quiet", "edge", "live"])
    return b.select("basin", "n", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(f"""WITH {AXIS}, s AS (SELECT t, x, CASE WHEN abs(x - lag(x) OVER (ORDER BY t)) < 0.05 THEN 0 ELSE 1 END AS n FROM axis), r AS (SELECT t, x, sum(n) OVER (ORDER BY t) AS run FROM s)
SELECT run::BIGINT AS run, count(*) AS n, round(avg(x), 6) AS mean, min(t) AS first, max(t) AS last FROM r GROUP BY run""")
def steady_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.steady_runs(axis(spark, sf_dir), "x", "t").select("run", "n", r6(F.col("mean")).alias("mean"), "first", "last")


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("k")), F.col("l_partkey") == F.col("p_partkey"))
    daily = lines.groupBy("k", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("v"))
    monthly = lines.groupBy("k", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").cast("double").alias("anchor"))
    return C.anchored(daily, monthly, "k", "day", "v", "anchor").groupBy("k", "month").agg(F.round(F.sum("v"), 4).alias("scaled"))


@query("""WITH l AS (SELECT p_brand AS k, l_shipdate::DATE AS day, l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT k, strftime(day, '%Y-%m') AS month, day, sum(v) AS v FROM l GROUP BY ALL), m AS (SELECT k, month, avg(v) AS mv FROM d GROUP BY ALL),
a AS (SELECT k, strftime(day, '%Y-%m') AS month, count(*)::DOUBLE AS anchor FROM l GROUP BY ALL)
SELECT k, month, round(sum(v * anchor / mv), 4) AS scaled FROM d JOIN m USING (k, month) JOIN a USING (k, month) GROUP BY k, month""")
def anchor_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantities by brand on the scale of monthly counts."""
    return _anchored(spark, sf_dir)


@query("""WITH l AS (SELECT p_brand AS k, l_shipdate, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT k, strftime(l_shipdate, '%Y-%m') AS month, avg(l_quantity) AS a, count(*) AS b FROM l GROUP BY ALL)
SELECT k, count(*) AS n, round(corr(a, b), 5) AS r, corr(a, b) >= 0.8 AS reliable FROM m GROUP BY k HAVING count(*) >= 6""")
def monthly_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("k")), F.col("l_partkey") == F.col("p_partkey"))
    monthly = lines.groupBy("k", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("anchor"))
    return C.reliability(lines, monthly, "k", "l_shipdate", "l_quantity", "anchor").select("k", "n", F.round("r", 5).alias("r"), "reliable")


@query("""SELECT n_name AS name, s::DATE::VARCHAR AS "from", least(s::DATE + 250, DATE '1996-12-31')::VARCHAR AS "to" FROM nation, (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-31', INTERVAL 150 DAY)) AS s)""")
def backfill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = C.overlapping_windows(F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.explode(w).alias("w"))
    return n.select("name", F.col("w.from").cast("string").alias("from"), F.col("w.to").cast("string").alias("to"))


@query(f"WITH {AXIS}, l AS (SELECT t, x, {', '.join(f'lag(x, {k}) OVER (ORDER BY t) AS x_{k}' for k in range(1, 7))} FROM axis) SELECT t, {', '.join(f'round({c}, 6) AS {c}' for c in ('x', *(f'x_{k}' for k in range(1, 7))))} FROM l WHERE x_6 IS NOT NULL")
def lookback_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.lookback(axis(spark, sf_dir).select("t", "x"), ["x"], "t")
    return f.select("t", *(r6(F.col(c)).alias(c) for c in ("x", *(f"x_{k}" for k in range(1, 7)))))


@query()
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as hashed vectors (a pandas UDF)."""
    return table(spark, sf_dir, "benchmark").select("item_id", embed("text").alias("e"))
