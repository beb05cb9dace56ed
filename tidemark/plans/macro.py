"""Queries of the macro state: monthly features, indicators without a spectrum, the leading component, density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions import numerics as N
from tidemark.functions.columns import r6
from tidemark.operators import attention as A, components as C, hierarchy as H, indicators as I, replicates as P, validation as V
from tidemark.plans.attention import _STAGES
from tidemark.plans.bindings import ATT, AXIS, attention, axis, vectors
from tidemark.plans.kernels import indicator_states, month_vectors
from tidemark.plans.series import _STATES, frame, states

_AXIS = AXIS[len(ATT) + 1 :]
_OCC = """o AS (SELECT month, stage, row_number() OVER (PARTITION BY i.keyword, i.i ORDER BY pos) AS k FROM i JOIN st ON i.keyword = st.keyword AND i.i BETWEEN lo AND hi),
occ AS (SELECT month, avg((stage = 'origin')::INT) AS origin, avg((stage = 'emergence')::INT) AS emergence, avg((stage = 'fixation')::INT) AS fixation FROM o WHERE k = 1 GROUP BY month)"""
_MACRO = f"""{_STAGES}, {_AXIS}, {_OCC}, sh AS (SELECT month, {', '.join(f'coalesce(sum(value) FILTER (category = {k}), 0) / sum(value) AS c{k}' for k in range(5))} FROM att GROUP BY month),
q AS (SELECT a.t, a.month, [c0, c1, c2, c3, c4] AS x, [a.x, ln(a.total)] AS u, abs(a.x) AS heat, coalesce(origin, 0) AS origin, coalesce(emergence, 0) AS emergence, coalesce(fixation, 0) AS fixation FROM axis a JOIN sh USING (month) LEFT JOIN occ USING (month)),
dm AS (SELECT t, d, v, lag(v) OVER (PARTITION BY d ORDER BY t) AS p FROM (SELECT t, unnest(range(1, 6)) AS d, unnest(x) AS v FROM q)),
sp AS (SELECT t, coalesce(list_distance(x, lag(x) OVER (ORDER BY t)), 0) AS step, coalesce(list_distance(u, lag(u) OVER (ORDER BY t)), 0) AS force FROM q),
cr AS (SELECT q.t, CASE WHEN q.t >= 3 THEN greatest(0, corr(dm.p, dm.v)) ELSE 0 END AS ac FROM q LEFT JOIN dm ON dm.t BETWEEN greatest(q.t - 10, 1) AND q.t GROUP BY q.t),
bv AS (SELECT avg(v) AS base FROM (SELECT var_pop(v) AS v FROM dm WHERE t BETWEEN 13 AND 36 GROUP BY d)),
vr AS (SELECT q.t, dm.d, var_pop(v) FILTER (dm.t >= q.t - 11) AS recent, var_pop(v) AS ever FROM q JOIN dm ON dm.t <= q.t GROUP BY q.t, dm.d),
va AS (SELECT t, avg(recent) AS recent, least(3, count(*) FILTER (recent / greatest(ever, 1e-12) > 2)) AS alerts FROM vr GROUP BY t),
gn AS (SELECT q.t, avg(step) / greatest(avg(force), 1e-12) AS gain FROM q JOIN sp ON sp.t BETWEEN q.t - 11 AND q.t GROUP BY q.t),
lm AS (SELECT q.t, coalesce(2 * stddev_pop(step), 0) AS lim FROM q LEFT JOIN sp ON sp.t BETWEEN 1 AND q.t GROUP BY q.t),
sk AS (SELECT lm.t, sp.t AS s, lim, row_number() OVER (PARTITION BY lm.t ORDER BY sp.t DESC) AS r FROM lm JOIN sp ON sp.t BETWEEN 1 AND lm.t AND lim > 0 AND step > lim),
rt AS (SELECT sk.t, sk.s, sk.r, coalesce(min(b.t - sk.s), 12) AS k FROM sk JOIN q a ON a.t = sk.s - 1 LEFT JOIN q b ON b.t BETWEEN sk.s + 1 AND least(sk.s + 17, sk.t) AND list_distance(b.x, a.x) < 0.5 * lim GROUP BY sk.t, sk.s, sk.r),
rc AS (SELECT t, avg(k) FILTER (r <= 12) AS recovery, count(*) FILTER (s > t - 24) AS shocks FROM rt GROUP BY t),
mn AS (SELECT q.t, dm.d, avg(v) AS m FROM q JOIN dm ON dm.t BETWEEN q.t - 23 AND q.t GROUP BY q.t, dm.d),
aw AS (SELECT mn.t, dm.t AS s, sqrt(sum((v - m) ** 2)) AS d FROM mn JOIN dm ON dm.d = mn.d AND dm.t BETWEEN mn.t - 23 AND mn.t GROUP BY mn.t, dm.t),
fr AS (SELECT t, CASE WHEN count(*) > 2 AND stddev_pop(d) > 0 THEN least(max(d) FILTER (s = t) / stddev_pop(d), 5) ELSE 0 END AS fragility FROM aw GROUP BY t),
ind AS (SELECT q.t, q.month, 0.4 * least(greatest(fixation / (greatest(origin + emergence, 0.01) + fixation + 0.05), 0), 1) + 0.3 * ac + 0.3 * fixation AS inertia,
  0.35 * least(least(greatest(va.recent / greatest(base, 1e-12) * ac, 0), 3) / 1.5, 1) + 0.35 * least(least(greatest(gain, 0), 3) / 2, 1) + 0.30 * alerts / 3 AS sensitivity,
  coalesce(recovery, 12) AS recovery, fragility, coalesce(shocks, 0)::INT AS shocks, heat / (SELECT max(heat) FROM q) AS temperature
  FROM q JOIN cr USING (t) JOIN va USING (t) JOIN gn USING (t) JOIN fr USING (t) LEFT JOIN rc USING (t), bv)"""


@query(f"""WITH {_MACRO} SELECT t, month, round(inertia, 5) AS inertia, CASE WHEN inertia > 0.65 THEN 'high' WHEN inertia > 0.40 THEN 'medium' ELSE 'low' END AS inertia_label, round(sensitivity, 5) AS sensitivity,
  CASE WHEN sensitivity > 0.60 THEN 'high' WHEN sensitivity > 0.35 THEN 'medium' ELSE 'low' END AS sensitivity_label, round(recovery, 5) AS recovery, round(fragility, 5) AS fragility, shocks, round(temperature, 5) AS temperature FROM ind""")
def macro_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertia, sensitivity, and what resilience is made of (its spectral radius apart), as of each month."""
    h = I.labelled(I.history(indicator_states(spark, sf_dir), cells=False))
    five = lambda c: F.round(c, 5).alias(c)
    return h.select("t", "month", five("inertia"), "inertia_label", five("sensitivity"), "sensitivity_label", five("recovery"), five("fragility"), "shocks", five("temperature"))


_FIVE = ("origin", "emergence", "peak", "controversy", "fixation")
_POSITION = f"""{_STAGES}, {_AXIS}, o AS (SELECT month, stage, row_number() OVER (PARTITION BY i.keyword, i.i ORDER BY pos) AS k FROM i JOIN st ON i.keyword = st.keyword AND i.i BETWEEN lo AND hi),
occ AS (SELECT month, {', '.join(f"avg((stage = '{s}')::INT) AS {s}" for s in _FIVE)} FROM o WHERE k = 1 GROUP BY month), five AS (SELECT t, a.month, [{', '.join(f'coalesce({s}, 0)' for s in _FIVE)}] AS s FROM axis a LEFT JOIN occ USING (month)),
ranked AS (SELECT t, month, i, row_number() OVER (PARTITION BY t ORDER BY s[i] DESC, i) AS r FROM (SELECT *, unnest(range(1, 6)) AS i FROM five)),
two AS (SELECT t, month, max(i) FILTER (r = 1) AS d, max(i) FILTER (r = 2) AS e FROM ranked GROUP BY t, month), moved AS (SELECT *, coalesce((lag(d) OVER (ORDER BY t) <> d)::INT, 0) AS m FROM two)"""


@query(f"""WITH {_POSITION} SELECT t, month, [{', '.join(f"'{s}'" for s in _FIVE)}][d] AS dominant, [{', '.join(f"'{s}'" for s in _FIVE)}][e] AS second, sum(m) OVER (ORDER BY t RANGE BETWEEN 12 PRECEDING AND CURRENT ROW)::BIGINT AS moves FROM moved""")
def stage_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's first and second stage, and how often the first has changed in a year."""
    return I.positions(indicator_states(spark, sf_dir))


@query()
def attractor_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's cell of the state space: how many months are in it, and whether the month is a typical one. Tests hold it against plain loops."""
    s = indicator_states(spark, sf_dir)
    cells = H.kmeans(s, "t", "x", max(1, min(5, s.count() // 12))).withColumnRenamed("cluster", "cell")
    return I.basins(s, cells)


@query(f"""WITH {_MACRO} SELECT month, round(inertia, 5) AS inertia, round(sensitivity, 5) AS sensitivity, shocks FROM ind ORDER BY month DESC LIMIT 1""")
def macro_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query interface in its macro mode: the latest month's state."""
    from tidemark.plans.bindings import regime_sequence, vectors

    nodes = vectors(spark, sf_dir).limit(0).select(F.col("label").alias("node"), F.col("e").alias("v"))
    engine = I.Engine(I.history(indicator_states(spark, sf_dir), cells=False), regime_sequence(spark, sf_dir), nodes)
    return engine.query("macro").select("month", F.round("inertia", 5).alias("inertia"), F.round("sensitivity", 5).alias("sensitivity"), "shocks")


@query(f"""WITH {_STAGES}, {_AXIS}, {_OCC}, d AS (SELECT month, value / sum(value) OVER (PARTITION BY month) AS s FROM att WHERE value > 0), h AS (SELECT month, sum(s * s) AS hhi, -sum(s * ln(s)) AS entropy FROM d GROUP BY month)
SELECT t, month, round(x, 6) AS x, round(hhi, 6) AS hhi, round(entropy, 6) AS entropy, round(coalesce(origin, 0), 6) AS origin, round(coalesce(emergence, 0), 6) AS emergence, round(coalesce(fixation, 0), 6) AS fixation
FROM axis JOIN h USING (month) LEFT JOIN occ USING (month)""")
def month_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months' feature table: axis, concentration, entropy and shares of stages."""
    s = A.structure(attention(spark, sf_dir), "month").select("month", "hhi", "entropy")
    stages = indicator_states(spark, sf_dir).select("month", "origin", "emergence", "fixation")
    f = axis(spark, sf_dir).select("t", "month", "x").join(s, "month").join(stages, "month")
    return f.select("t", "month", *(r6(F.col(c)).alias(c) for c in ("x", "hhi", "entropy", "origin", "emergence", "fixation")))


@query(f"""WITH RECURSIVE {ATT}, k AS (SELECT n_name AS keyword, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation), g AS (SELECT month, k.i, coalesce(value, 0) AS v FROM (SELECT DISTINCT month FROM att) CROSS JOIN k LEFT JOIN att USING (month, keyword)),
z AS (SELECT month, i, (v - avg(v) OVER (PARTITION BY i)) / nullif(stddev_pop(v) OVER (PARTITION BY i), 0) AS z FROM g), c AS (SELECT a.i, b.i AS j, avg(a.z * b.z) AS c FROM z a JOIN z b USING (month) GROUP BY 1, 2),
m AS (SELECT list(r ORDER BY i) AS m, sum(tr) AS trace FROM (SELECT i, list(c ORDER BY j) AS r, sum(c) FILTER (i = j) AS tr FROM c GROUP BY i)),
p AS (SELECT 0 AS n, list_transform(range(1, (SELECT count(*) + 1 FROM k)), lambda i: 1.0::DOUBLE + i / 100.0) AS v, 0.0::DOUBLE AS l UNION ALL
  SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))), list_inner_product(v, w) FROM (SELECT n, v, list_transform(m, lambda r: list_inner_product(r, v)) AS w FROM p, m WHERE n < 4000)),
f AS (SELECT v, l FROM p WHERE n = 4000), s AS (SELECT v, l, CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END AS sg FROM f)
SELECT keyword, round(sg * v[i], 4) + 0.0 AS loading, round(l / trace, 5) AS share FROM s, m, k""")
def leading_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of the standardised keywords on the first component, and its share of the variance."""
    rows, keys = month_vectors(spark, sf_dir)
    b = C.bases(rows, "v")[0]
    c = b.components[0] * (1 if b.components[0].max() >= -b.components[0].min() else -1)
    return frame(spark, [(k, round(float(v), 4) + 0.0, round(float(b.shares[0]), 5)) for k, v in zip(keys, c, strict=True)], "keyword string, loading double, share double")


@query("""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT vec_id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v), a AS (SELECT i, avg(x) AS m FROM d GROUP BY i),
z AS (SELECT vec_id, d.i, x - m AS z FROM d JOIN a USING (i)), c AS (SELECT a.i, b.i AS j, avg(a.z * b.z) AS c FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2),
m AS (SELECT list(r ORDER BY i) AS m, sum(tr) AS trace FROM (SELECT i, list(c ORDER BY j) AS r, sum(c) FILTER (i = j) AS tr FROM c GROUP BY i))
SELECT i::INT AS i, j::INT AS j, round(c, 6) + 0.0 AS covariance, round(trace, 5) AS total FROM c, m WHERE i <= j""")
def embedding_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of the embeddings' entries, from one aggregation of their products."""
    b = C.bases(vectors(spark, sf_dir), "e", scaled=False)[0]
    q, total = b.matrix, round(float(b.matrix.trace()), 5)
    return frame(spark, [(i + 1, j + 1, round(float(q[i, j]), 6) + 0.0, total) for i in range(len(q)) for j in range(i, len(q))], "i int, j int, covariance double, total double")


@query()
def embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's first three components. A test holds them against a singular value decomposition."""
    v = vectors(spark, sf_dir)
    b = C.bases(v, "e", scaled=False)[0]
    s = v.select("vec_id", C.scores("e", b, 3).alias("s"))
    return s.select("vec_id", *(F.col("s")[i].alias(f"z{i + 1}") for i in range(3)))


@query()
def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward's clusters of all embeddings: silhouette and inertia for each number of clusters from 2 to 12. Tests hold it against plain loops."""
    return H.sweep(vectors(spark, sf_dir), "vec_id", "e")


@query()
def blind_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far Ward's clusters of the embeddings, as many as there are labels, agree with the labels: all five indices."""
    v = vectors(spark, sf_dir)
    k = v.select("label").distinct().count()
    found = v.select("vec_id", "label").join(H.cut(H.ward(v, "vec_id", "e"), v, "vec_id", k), "vec_id")
    return V.agreement(found, "label", "cluster").select(*(F.round(c, 6).alias(c) for c in ("ari", "nmi", "homogeneity", "completeness", "v")))


_DENSE = f"""{AXIS}, {_STATES}, n AS (SELECT t, label, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (z - avg(z) OVER ()) / stddev_pop(z) OVER () AS z FROM j),
e AS (SELECT a.t AS i, b.t AS j FROM n a, n b WHERE sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 0.45), core AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 5),
ce AS (SELECT e.i, e.j FROM e WHERE e.i IN (SELECT i FROM core) AND e.j IN (SELECT i FROM core)), r AS (SELECT i AS a, i AS b FROM core UNION SELECT r.a, ce.j FROM r JOIN ce ON r.b = ce.i),
cc AS (SELECT a AS t, min(b) AS c FROM r GROUP BY a), bo AS (SELECT e.i AS t, min(cc.c) AS c FROM e JOIN cc ON e.j = cc.t WHERE e.i NOT IN (SELECT i FROM core) GROUP BY e.i),
db AS (SELECT n.t, n.label, coalesce(cc.c, bo.c, -1)::INT AS cluster FROM n LEFT JOIN cc USING (t) LEFT JOIN bo ON bo.t = n.t)"""


@query(f"WITH RECURSIVE {_DENSE} SELECT t, cluster FROM db")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months grouped by density on the standardised state: a cluster's smallest place names it, -1 is noise."""
    m = P.matrix(states(spark, sf_dir), "t", ["x", "z"])
    label = N.density_clusters(N.standardised(m), 0.45, 5)
    return frame(spark, [(t, int(c)) for t, c in enumerate(label)], "t int, cluster int")


@query(f"""WITH RECURSIVE {_DENSE}, c AS (SELECT label AS a, cluster AS b, count(*) AS n FROM db GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS s FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS s FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
m AS (SELECT sum(n / t * ln(n * t / (ra.s * rb.s))) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b), t), ha AS (SELECT -sum(s / t * ln(s / t)) AS h FROM ra, t) SELECT round(mi / h, 5) AS homogeneity FROM m, ha""")
def blind_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far density clusters, found without them, agree with the regimes."""
    found = density_clusters(spark, sf_dir).join(states(spark, sf_dir).select("t", "label"), "t")
    return V.agreement(found, "label", "cluster").select(F.round("homogeneity", 5).alias("homogeneity"))
