"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import r6
from tidemark.operators import semantic as S
from tidemark.plans.bindings import VEC, vectors

_MEAN = f"{VEC}, mu AS (SELECT label, i, avg(x) AS m, count(*) AS n, var_pop(x) AS v, sum(x) AS s, sum(x * x) AS q FROM dim GROUP BY 1, 2), cen AS (SELECT label, list(m ORDER BY i) AS mean, max(n) AS n FROM mu GROUP BY label)"
_COS = "list_cosine_similarity"


@query(f"WITH {_MEAN} SELECT label, i::INT AS i, n, round(m, 6) AS mean FROM mu")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.means(vectors(spark, sf_dir), ["label"])
    return c.select("label", "n", F.posexplode("mean").alias("i", "mean")).select("label", (F.col("i") + 1).alias("i"), "n", r6(F.col("mean")).alias("mean"))


@query(f"WITH {_MEAN}, g AS (SELECT label, sum(v) AS t, sum(m * m) AS mm FROM mu GROUP BY label) SELECT label, round(t, 6) AS trace, round(t + (sqrt(mm) - sqrt(mm) / (sqrt(mm) + 1e-10)) ** 2, 6) AS dispersion FROM g")
def covariance_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.dispersion(vectors(spark, sf_dir), ["label"])
    return d.select("label", r6(F.col("trace")).alias("trace"), r6(F.col("dispersion_about_unit_mean")).alias("dispersion"))


@query(f"WITH {_MEAN} SELECT label, max(n) AS n, round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 6) AS concentration FROM mu GROUP BY label")
def pairwise_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.concentration(vectors(spark, sf_dir), ["label"]).select("label", "n", r6(F.col("concentration")).alias("concentration"))


@query(f"""WITH {_MEAN}, d AS (SELECT label, list_distance(e, mean) AS d FROM vec JOIN cen USING (label)),
q AS (SELECT label, quantile_cont(d, 0.5) AS a, quantile_cont(d, 0.9) AS b, quantile_cont(d, 0.99) AS c FROM d GROUP BY label)
SELECT label, round(a, 6) AS median, round(b, 6) AS p90, round(c, 6) AS p99, round(b / a, 6) AS ratio, b / a > 2 AS alert FROM q""")
def distance_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.distance_quantiles(vectors(spark, sf_dir), ["label"])
    return d.select("label", *(r6(F.col(c)).alias(c) for c in ("median", "p90", "p99", "ratio")), "alert")


@query(f"""WITH {_MEAN}, p AS (SELECT a.label AS a, b.label AS b, 1 - {_COS}(a.mean, b.mean) AS d FROM cen a JOIN cen b ON a.label < b.label WHERE a.n >= 10 AND b.n >= 10)
SELECT a, b, round(d, 6) AS distance, CASE WHEN d > 0.3 THEN 'divergent' WHEN d < 0.15 THEN 'converging' ELSE 'ambiguous' END AS kind FROM p""")
def platform_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_cosines(vectors(spark, sf_dir), "label").select("a", "b", r6(F.col("distance")).alias("distance"), "kind")


@query(f"""WITH {VEC}, mu AS (SELECT day, i, avg(x) AS m, count(*) AS n FROM dim GROUP BY 1, 2), cen AS (SELECT day, list(m ORDER BY i) AS mean, max(n) AS n FROM mu GROUP BY day)
SELECT a.day, a.n, round(CASE WHEN b.day IS NULL THEN 1 ELSE 1 - greatest(0, {_COS}(a.mean, b.mean)) END, 6) AS novelty FROM cen a LEFT JOIN cen b ON b.day = a.day - 1""")
def novelty_prev_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.novelty(vectors(spark, sf_dir), "day").select("day", "n", r6(F.col("novelty")).alias("novelty"))


@query(f"""WITH {VEC}, mu AS (SELECT day, i, avg(x) AS m FROM dim GROUP BY 1, 2), cen AS (SELECT day, list(m ORDER BY i) AS mean FROM mu GROUP BY day),
p AS (SELECT day, mean, lag(mean) OVER (ORDER BY day) AS b FROM cen) SELECT day, round(1 - {_COS}(mean, b), 6) AS drift FROM p WHERE b IS NOT NULL""")
def semantic_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.means(vectors(spark, sf_dir), ["day"])
    return S.drift(m, "day").filter("drift is not null").select("day", r6(F.col("drift")).alias("drift"))


_PAIR = f"{_MEAN}, s AS (SELECT v.vec_id AS id, v.label, c.label AS node, {_COS}(v.e, c.mean) AS cos FROM vec v CROSS JOIN cen c)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v.select(F.col("vec_id").alias("id"), "label", "e"), S.means(v, ["label"]).select(F.col("label").alias("node"), F.col("mean").alias("v"))


@query(f"WITH {_PAIR} SELECT node, round(avg(cos), 6) AS mean_sim, round(max(cos), 6) AS max_sim, count(*) FILTER (cos > 0.5) AS n_hits FROM s GROUP BY node")
def meme_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = _sides(spark, sf_dir)
    return S.similarities(q, n).select("node", r6(F.col("mean_sim")).alias("mean_sim"), r6(F.col("max_sim")).alias("max_sim"), "n_hits")


_PROJ = f"""{_PAIR}, z AS (SELECT *, exp((cos - max(cos) OVER (PARTITION BY id)) / 0.1) AS z, row_number() OVER (PARTITION BY id ORDER BY cos DESC, node) AS k FROM s),
p AS (SELECT *, z / sum(z) OVER (PARTITION BY id) AS p FROM z),
g AS (SELECT id, max(node) FILTER (k = 1) AS best, max(cos) FILTER (k = 1) AS top, max(cos) FILTER (k = 1) - coalesce(max(cos) FILTER (k = 2), 0) AS gap,
  sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS entropy, count(*) FILTER (p > 0.01) AS active FROM p GROUP BY id),
pr AS (SELECT *, CASE WHEN top > 0.55 AND gap > 0.06 THEN 'HIGH' WHEN top > 0.4 AND gap > 0.03 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN top < 0.3 THEN 'noise' WHEN gap < 0.03 THEN 'ambiguous' ELSE 'projected' END AS status FROM g)"""


@query(f"WITH {_PROJ} SELECT id, best, round(top, 6) AS top, round(gap, 6) AS gap, round(entropy, 6) AS entropy, active, confidence, status FROM pr")
def persona_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.project(*_sides(spark, sf_dir))
    return p.select("id", "best", *(r6(F.col(c)).alias(c) for c in ("top", "gap", "entropy")), "active", "confidence", "status")


@query(f"WITH {_PROJ} SELECT CASE status WHEN 'noise' THEN 'unknown' WHEN 'ambiguous' THEN 'ambiguous' ELSE CASE confidence WHEN 'HIGH' THEN 'known' WHEN 'MEDIUM' THEN 'partial' ELSE 'unknown' END END AS state, count(*) AS n FROM pr GROUP BY 1")
def persona_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assessed(S.project(*_sides(spark, sf_dir))).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {_PAIR}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, node) AS k FROM s) SELECT count(*) AS n, round(avg((k = 1)::INT), 6) AS top1, round(avg((k <= 3)::INT), 6) AS topk FROM r WHERE node = label")
def persona_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = _sides(spark, sf_dir)
    return S.retrieval(q, n, "label").select("n", r6(F.col("top1")).alias("top1"), r6(F.col("topk")).alias("topk"))


@query(f"""WITH {VEC}, s AS (SELECT a.vec_id AS id, b.vec_id, round({_COS}(a.e, b.e), 9) AS cos FROM vec a JOIN vec b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, vec_id) AS rank FROM s) SELECT id, rank, vec_id, round(cos, 6) AS cos FROM r WHERE rank <= 5""")
def knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of each row whose id 50 divides, against all rows."""
    v = vectors(spark, sf_dir)
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "e")
    return S.nearest_rows(q, v).select("id", F.col("rank").cast("long").alias("rank"), "vec_id", r6(F.col("cos")).alias("cos"))

