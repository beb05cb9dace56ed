"""Queries of the spread models. Their SQL runs the same Runge-Kutta steps in a recursive table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import r6
from tidemark.operators import curation as K, simulation as S, validation as V
from tidemark.functions import rules as R
from tidemark.plans.bindings import STAGES, table
from tidemark.plans.rules import _X, curated

_H = "(200.0::DOUBLE / 999)"
_FIELD = {"s": "(sigma + mu * {i}) * {r} - beta * {s} * {i}", "i": "beta * {s} * {i} - gamma * {i}", "r": "gamma * {i} - (sigma + mu * {i}) * {r}"}


def _steps(state: dict[str, str], constants: str, start: str, name: str = "y") -> str:
    """Recursive tables of a field: ``state`` has the derivative of each variable, in terms of all of them; ``start`` gives id, constants and variables at step 0."""
    at = lambda suffix: {v: f"{v}{suffix}" for v in state}
    vs = ", ".join(state)

    def derived(tag: str, suffix: str) -> str:
        return ", ".join(f"{f.format(**at(suffix))} AS {v}_{tag}" for v, f in state.items())

    def moved(suffix: str, tag: str, share: str) -> str:
        return ", ".join(f"{v} + {_H} * {share} * {v}_{tag} AS {v}{suffix}" for v in state)

    a = f"SELECT *, {derived('a', '')} FROM {name} WHERE k < 999"
    b = f"SELECT *, {derived('b', '2')} FROM (SELECT *, {moved('2', 'a', '0.5')} FROM ({a}))"
    c = f"SELECT *, {derived('c', '3')} FROM (SELECT *, {moved('3', 'b', '0.5')} FROM ({b}))"
    d = f"SELECT *, {derived('d', '4')} FROM (SELECT *, {moved('4', 'c', '1')} FROM ({c}))"
    step = ", ".join(f"{v} + {_H} / 6 * ({v}_a + 2 * {v}_b + 2 * {v}_c + {v}_d) AS {v}" for v in state)
    return f"{name} AS (SELECT id, 0 AS k, {constants}, {vs} FROM ({start}) UNION ALL SELECT id, k + 1 AS k, {constants}, {step} FROM ({d}))"


def spread_sql(configs: str) -> str:
    """Tables y (id, k, s, i, r) and o (the summary of each id) for configs (id, beta, gamma, sigma, mu)."""
    start = f"SELECT id, beta, gamma, sigma, mu, 0.999::DOUBLE AS s, 0.001::DOUBLE AS i, 0.0::DOUBLE AS r FROM ({configs})"
    e = " + ".join(f"CASE WHEN {v} > 0 THEN -{v} * ln({v}) ELSE 0 END" for v in "sir")
    return f"""{_steps(_FIELD, 'beta, gamma, sigma, mu', start)},
sp AS (SELECT id, beta / gamma AS r0, max(i) AS peak, 1 - min(s) AS total, max({e}) AS entropy, max(k) FILTER (i >= 0.01) AS last_on, min(k) FILTER (i >= 0.01) AS first_on FROM y GROUP BY id, beta, gamma),
o AS (SELECT sp.id, r0, peak, total, entropy, min(k) FILTER (i = peak) * {_H} AS peak_day, (max(k) FILTER (i > 0.01 * peak) - min(k) FILTER (i > 0.01 * peak)) * {_H} AS duration, first_on * {_H} AS birth,
  CASE WHEN first_on IS NULL THEN 'never' WHEN last_on = 999 THEN 'endemic' ELSE 'died' END AS status, CASE WHEN last_on < 999 THEN last_on * {_H} END AS ended FROM sp JOIN y USING (id) GROUP BY ALL)"""


#: The suppliers as configurations of a sweep: their keys say which.
_GRID = "SELECT s_suppkey AS id, 0.05 + floor(s_suppkey / 5) % 12 * 0.08 AS beta, 0.05 + s_suppkey % 5 * 0.05 AS gamma, 0.0::DOUBLE AS sigma, 0.0::DOUBLE AS mu FROM supplier"
_MEASURES = ("r0", "peak", "peak_day", "total", "duration", "entropy")


def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"))


@query(f"WITH RECURSIVE {spread_sql(_GRID)} SELECT id, {', '.join(f'round({m}::DOUBLE, 6) AS {m}' for m in _MEASURES)}, status FROM o")
def outbreak_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact by recovery rate, 12 x 5."""
    grid = configurations(spark, sf_dir).select("id", (0.05 + F.floor(F.col("id") / 5) % 12 * 0.08).cast("double").alias("beta"), (0.05 + F.col("id") % 5 * 0.05).alias("gamma"), F.lit(0.0).alias("sigma"), F.lit(0.0).alias("mu"))
    return S.outbreaks(grid.repartition(8)).select("id", *(r6(F.col(m)).alias(m) for m in _MEASURES), "status")


_SWEEP = "SELECT s_suppkey AS id, s_suppkey % 40 * 0.1 + 0.05 AS beta, 0.1::DOUBLE AS gamma, 0.0::DOUBLE AS sigma, 0.0::DOUBLE AS mu FROM supplier"


@query(f"WITH RECURSIVE {spread_sql(_SWEEP)} SELECT id, round(r0::DOUBLE, 6) AS r0, round(peak, 6) AS peak, r0 > 1 AS spreads FROM o")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks over a range of reproduction numbers: they rise with it, and spread begins at one."""
    grid = configurations(spark, sf_dir).select("id", (F.col("id") % 40 * 0.1 + 0.05).alias("beta"), F.lit(0.1).alias("gamma"), F.lit(0.0).alias("sigma"), F.lit(0.0).alias("mu"))
    return S.outbreaks(grid.repartition(8)).select("id", r6(F.col("r0")).alias("r0"), r6(F.col("peak")).alias("peak"), (F.col("r0") > 1).alias("spreads"))


_ENDEMIC = "SELECT s_suppkey AS id, 0.1 + (s_suppkey % 6) * 0.12 AS beta, 0.1::DOUBLE AS gamma, floor(s_suppkey / 12) % 4 * 0.015 AS sigma, floor(s_suppkey / 6) % 2 * 0.1 AS mu FROM supplier"


@query(f"WITH RECURSIVE {spread_sql(_ENDEMIC)} SELECT id, round(peak, 6) AS peak, round(total, 6) AS total, round(birth, 6) AS birth, round(ended, 6) AS ended, status FROM o")
def endemic_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With loss of immunity and mutation feedback: when a meme is born, and whether it ends."""
    k = F.col("id")
    grid = configurations(spark, sf_dir).select("id", (0.1 + k % 6 * 0.12).alias("beta"), F.lit(0.1).alias("gamma"), (F.floor(k / 12) % 4 * 0.015).cast("double").alias("sigma"), (F.floor(k / 6) % 2 * 0.1).cast("double").alias("mu"))
    return S.outbreaks(grid.repartition(8)).select("id", r6(F.col("peak")).alias("peak"), r6(F.col("total")).alias("total"), r6(F.col("birth")).alias("birth"), r6(F.col("ended")).alias("ended"), "status")


_POINTS = "SELECT p_partkey AS id, p_size % 10 / 10.0::DOUBLE AS a, p_partkey % 7 / 7.0::DOUBLE AS b, (p_partkey % 9) / 10.0::DOUBLE AS beta, (p_size % 5) / 10.0::DOUBLE AS gamma, (p_partkey % 4) / 50.0::DOUBLE AS sigma, (p_size % 3) / 10.0::DOUBLE AS mu FROM part"


@query(f"""WITH x AS (SELECT *, a * (1 - b) AS s, a * b AS i, 1 - a AS r FROM ({_POINTS}))
SELECT id, {', '.join(f"round({f.format(s='s', i='i', r='r')}, 9) + 0.0 AS d{v}" for v, f in _FIELD.items())}, true AS conserved FROM x""")
def spread_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field (with both feedbacks; zero rates give the plainer models) at many states; its parts add up to nothing."""
    p, k = F.col("p_size"), F.col("p_partkey")
    a, b = p % 10 / F.lit(10.0), k % 7 / F.lit(7.0)
    x = table(spark, sf_dir, "part").select(k.alias("id"), (a * (1 - b)).alias("s"), (a * b).alias("i"), (1 - a).alias("r"), (k % 9 / F.lit(10.0)).alias("beta"), (p % 5 / F.lit(10.0)).alias("gamma"), (k % 4 / F.lit(50.0)).alias("sigma"), (p % 3 / F.lit(10.0)).alias("mu"))
    return S.fields(x).select("id", *((F.round(f"d{v}", 9) + F.lit(0.0)).alias(f"d{v}") for v in "sir"), (F.abs(F.col("ds") + F.col("di") + F.col("dr")) < 1e-12).alias("conserved"))


@query(f"""WITH x AS (SELECT *, a * (1 - b) AS s, a * b AS i, 1 - a AS r FROM ({_POINTS}))
SELECT id, round(gamma * r - beta * s * i, 9) + 0.0 AS ds, round(beta * s * i - sigma * i + mu * r, 9) + 0.0 AS di, round(sigma * i - gamma * r - mu * r, 9) + 0.0 AS dr FROM x""")
def mutation_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field in which those who are over it take it up again in another form, at many states."""
    p, k = F.col("p_size"), F.col("p_partkey")
    a, b = p % 10 / F.lit(10.0), k % 7 / F.lit(7.0)
    x = table(spark, sf_dir, "part").select(k.alias("id"), (a * (1 - b)).alias("s"), (a * b).alias("i"), (1 - a).alias("r"), (k % 9 / F.lit(10.0)).alias("beta"), (p % 5 / F.lit(10.0)).alias("gamma"), (k % 4 / F.lit(50.0)).alias("sigma"), (p % 3 / F.lit(10.0)).alias("mu"))
    return S.mutating_fields(x).select("id", *((F.round(f"d{v}", 9) + F.lit(0.0)).alias(f"d{v}") for v in "sir"))


_TWO = {"sc": "-beta * {sc} * {ic}", "ic": "beta * {sc} * {ic} - gamma * {ic}", "rc": "gamma * {ic}",
        "sm": "-(mass * {sm} * {im} + across * {sm} * {ic})", "im": "mass * {sm} * {im} + across * {sm} * {ic} - gamma * {im}", "rm": "gamma * {im}"}
_TWO_START = "SELECT s_suppkey AS id, 0.5::DOUBLE AS beta, 0.15::DOUBLE AS mass, 0.1::DOUBLE AS gamma, 0.02 + s_suppkey % 12 * 0.03 AS across, 0.99::DOUBLE AS sc, 0.01::DOUBLE AS ic, 0.0::DOUBLE AS rc, 1.0::DOUBLE AS sm, 0.0::DOUBLE AS im, 0.0::DOUBLE AS rm FROM supplier"


@query(f"""WITH RECURSIVE {_steps(_TWO, 'beta, mass, gamma, across', _TWO_START)}, p AS (SELECT id, max(ic) AS core_peak, max(im) AS mass_peak FROM y GROUP BY id)
SELECT id, round(core_peak, 6) AS core_peak, round(mass_peak, 6) AS mass_peak, round(min(k) FILTER (ic = core_peak) * {_H}, 6) AS core_day, round(min(k) FILTER (im = mass_peak) * {_H}, 6) AS mass_day FROM p JOIN y USING (id) GROUP BY id, core_peak, mass_peak""")
def two_population_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A core and the mass it spills over to, by the strength of the spill: the core peaks first."""
    c = configurations(spark, sf_dir).select("id", F.lit(0.5).alias("beta"), F.lit(0.15).alias("mass"), F.lit(0.1).alias("gamma"), (0.02 + F.col("id") % 12 * 0.03).alias("across"))
    return S.two_populations(S.dealt(c)).select("id", *(r6(F.col(x)).alias(x) for x in ("core_peak", "mass_peak", "core_day", "mass_day")))


_NEAR = "SELECT 2 * s_suppkey + later AS id, 0.15 + s_suppkey % 5 * 0.1 AS beta, 0.1::DOUBLE AS gamma, 0.01::DOUBLE AS sigma, 0.0::DOUBLE AS mu FROM supplier, range(2) AS r(later)"
_NEAR_START = f"SELECT id, beta, gamma, sigma, mu, 1 - i AS s, i, 0.0::DOUBLE AS r FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 0.001 ELSE 0.0011 END::DOUBLE AS i FROM ({_NEAR}))"


@query(f"""WITH RECURSIVE {_steps(_FIELD, 'beta, gamma, sigma, mu', _NEAR_START)},
d AS (SELECT a.id // 2 AS id, a.k, sqrt((a.s - b.s) ** 2 + (a.i - b.i) ** 2 + (a.r - b.r) ** 2) AS d FROM y a JOIN y b ON b.id = a.id + 1 AND a.k = b.k WHERE a.id % 2 = 0)
SELECT id, round(ln(max(d) FILTER (k = 999) / max(d) FILTER (k = 0)) / 200, 6) AS rate FROM d GROUP BY id""")
def divergence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log growth of the distance between two runs that start a little apart."""
    c = configurations(spark, sf_dir).select("id", (0.15 + F.col("id") % 5 * 0.1).alias("beta"), F.lit(0.1).alias("gamma"), F.lit(0.01).alias("sigma"))
    return S.divergences(S.dealt(c), 0.001, 0.0011).select("id", r6(F.col("rate")).alias("rate"))


_PARTS = f"WITH RECURSIVE {_X}, {spread_sql('SELECT p_partkey AS id, r0 * gamma AS beta, gamma, 0.0::DOUBLE AS sigma, 0.0::DOUBLE AS mu FROM r')}"
_PROFILE = """, f AS (SELECT o.id, o.r0, o.peak, o.peak_day, o.duration, o.entropy, o.status, CASE WHEN o.r0 < 0.8 THEN 'abortive' WHEN o.duration < 30 AND o.peak > 0.3 THEN 'pulse' WHEN o.duration > 90 THEN 'long-tail' WHEN o.r0 > 1 THEN 'outbreak' ELSE 'abortive' END AS kind FROM o)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, r0, peak, peak_day, duration, entropy, status, kind): each curated entry's estimates run through the model."""
    c = curated(spark, sf_dir).select(F.col("p_partkey").alias("id"), (F.col("r0") * F.col("gamma")).alias("beta"), "gamma", F.lit(0.0).alias("sigma"), F.lit(0.0).alias("mu"))
    o = S.outbreaks(c.repartition(spark.sparkContext.defaultParallelism))
    return o.withColumn("kind", R.meme_type(F.col("r0"), F.col("duration"), F.col("peak"))[0])


@query(f"{_PARTS}{_PROFILE} SELECT id, round(r0, 5) AS r0, round(peak, 5) AS peak, round(duration, 5) AS duration, round(entropy, 5) AS entropy, status, kind FROM f")
def lifecycle_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("id", *(F.round(x, 5).alias(x) for x in ("r0", "peak", "duration", "entropy")), "status", "kind")


@query(f"{_PARTS}{_PROFILE} SELECT kind, status, count(*) AS n, round(avg(r0), 5) AS r0, round(avg(entropy), 5) AS entropy, round(1.5 * stddev_pop(r0), 5) AS radius FROM f GROUP BY kind, status")
def phase_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the entries' states: count, centre and radius by type and outcome."""
    p = profiles(spark, sf_dir)
    return p.groupBy("kind", "status").agg(F.count("*").alias("n"), F.round(F.avg("r0"), 5).alias("r0"), F.round(F.avg("entropy"), 5).alias("entropy"), F.round(1.5 * F.stddev_pop("r0"), 5).alias("radius"))


# trajectories and their validators


_MAP = {"start": "origin", "rise": "emergence", "top": "peak", "fight": "controversy", "end": "fixation"}
_NODES = """ph AS (SELECT p_partkey AS id, p_size, (p_size % 5)::INT AS n FROM part),
raw AS (SELECT id, j, ['start', 'rise', 'odd', 'top', 'fight', 'end'][(id * 3 + j * (1 + id % 3)) % 6 + 1] AS w, ((id + 3 * j) % 10 / 10.0)::DOUBLE AS x FROM (SELECT *, unnest(range(0, n)) AS j FROM ph)),
mapped AS (SELECT id, j, CASE w WHEN 'start' THEN 'origin' WHEN 'rise' THEN 'emergence' WHEN 'top' THEN 'peak' WHEN 'fight' THEN 'controversy' WHEN 'end' THEN 'fixation' ELSE 'emergence' END AS phase, x FROM raw UNION ALL SELECT id, 0, 'origin', 0.1 FROM ph WHERE n = 0),
tail AS (SELECT id, max(j) AS j, arg_max(phase, j) AS last FROM mapped GROUP BY id),
nodes AS (SELECT id, j, phase, x FROM mapped UNION ALL SELECT id, j + 1, 'fixation', 0.1 FROM tail WHERE last <> 'fixation')"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, nodes) of the parts' invented phases."""
    k = F.col("p_partkey")
    word = lambda j: F.get(F.array(*map(F.lit, ("start", "rise", "odd", "top", "fight", "end"))), ((k * 3 + j * (1 + k % 3)) % 6).cast("int"))
    n = F.col("p_size") % 5
    phases = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: F.struct(word(j).alias("phase"), ((k + 3 * j) % 10 / F.lit(10.0)).alias("intensity"))))
    none = F.array().cast("array<struct<phase:string,intensity:double>>")
    return K.trajectory_nodes(table(spark, sf_dir, "part").select(k.alias("name"), F.coalesce(phases, none).alias("spread_phases")), _MAP)


def flat(t: DataFrame) -> DataFrame:
    return t.select(F.col("name").alias("id"), F.posexplode("nodes").alias("j", "node")).select("id", "j", "node.phase", F.col("node.intensity").alias("x"))


@query(f"WITH {_NODES} SELECT id, j::INT AS j, phase, round(x, 6) AS x FROM nodes")
def trajectory_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(trajectories(spark, sf_dir)).select("id", "j", "phase", r6(F.col("x")).alias("x"))


@query(f"WITH {_NODES}, m AS (SELECT id, coalesce(max(x) FILTER (j = 1), max(x) FILTER (j = 0)) AS metric FROM nodes GROUP BY id) SELECT id, round(metric, 6) AS metric, row_number() OVER (ORDER BY metric DESC, id)::INT AS place FROM m ORDER BY 3 LIMIT 20")
def ranked_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty entries with the highest intensity at their second node."""
    top = K.ranked_by(trajectories(spark, sf_dir), "intensity").limit(20)
    rows = top.agg(F.collect_list(F.struct("metric", "name")).alias("r")).select(F.posexplode(F.array_sort("r", lambda a, b: F.when(a["metric"] > b["metric"], -1).when(a["metric"] < b["metric"], 1).when(a["name"] < b["name"], -1).otherwise(1))).alias("p", "x"))
    return rows.select(F.col("x.name").alias("id"), r6(F.col("x.metric")).alias("metric"), (F.col("p") + 1).alias("place"))


_PLACE = "CASE phase " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STAGES)) + " END"
_PHASE_BAD = f"""pv AS (SELECT id, j, CASE WHEN a IS NULL OR b IS NULL OR b - a < -1 THEN 'violation' WHEN b - a = -1 OR b - a > 2 THEN 'warning' END AS problem
  FROM (SELECT id, j, {_PLACE} AS b, lag({_PLACE}) OVER w AS a, lag(j) OVER w AS before FROM nodes WINDOW w AS (PARTITION BY id ORDER BY j)) WHERE before IS NOT NULL)"""


@query(f"WITH {_NODES}, {_PHASE_BAD} SELECT id, j::INT AS j, problem FROM pv WHERE problem IS NOT NULL")
def phase_order_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases that go back by more than one, or back by one or ahead by more than two."""
    return V.phase_violations(flat(trajectories(spark, sf_dir)), "id", "j", "phase", STAGES)


_R0, _CHAOS = "(x * 4)", "((id + 5 * j) % 9 - 4) / 10.0::DOUBLE"
_DYNAMIC = f"""dn AS (SELECT id, j, phase, {_R0} AS r0, {_CHAOS} AS c, lag({_R0}) OVER (PARTITION BY id ORDER BY j) AS p, lag(phase) OVER (PARTITION BY id ORDER BY j) AS f FROM nodes),
dv AS (SELECT id, j, unnest(list_filter([CASE WHEN phase = 'peak' AND r0 < 1 THEN 'peak' END, CASE WHEN round(abs(r0 - p), 9) > 1.5 AND NOT (f = 'origin' OR (phase = 'fixation' AND r0 < 0.1)) THEN 'jump' END, CASE WHEN phase = 'controversy' AND c > -0.1 THEN 'no drift' END,
  CASE WHEN phase = 'fixation' AND NOT (r0 > 0.5 AND r0 < 2 AND abs(c) < 0.9) AND r0 >= 1 AND abs(c) < 0.1 THEN 'still active' END], lambda x: x IS NOT NULL)) AS problem FROM dn)"""


def dynamic(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("r0", F.col("x") * 4).withColumn("chaos", ((F.col("id") + 5 * F.col("j")) % 9 - 4) / F.lit(10.0))


@query(f"WITH {_NODES}, {_DYNAMIC} SELECT id, j::INT AS j, problem FROM dv")
def dynamics_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks under one, jumps of R0 that no phase explains, controversy without drift, and fixation that is still active."""
    return V.dynamics_violations(dynamic(flat(trajectories(spark, sf_dir))), "id", "j", "r0", "phase", "chaos")


_CONS = "cn AS (SELECT id, j, list_transform(range(0, 5), lambda k: (id * (k + 2) + j * (k + 1) * (id % 3)) % 10 / 10.0::DOUBLE) AS c FROM nodes)"
_STEP = """sv AS (SELECT id, j, unnest(list_filter([CASE WHEN list_max(list_transform(d, lambda x: abs(x))) > 0.35 THEN 'dimension' END, CASE WHEN round(sqrt(list_sum(list_transform(d, lambda x: x * x))), 9) > 0.5 THEN 'norm' END,
  CASE WHEN d[1] > 0.15 AND d[3] > 0.15 THEN 'co-rise' END], lambda x: x IS NOT NULL)) AS problem
  FROM (SELECT id, j, list_transform(range(1, 6), lambda k: round(c[k] - p[k], 9)) AS d FROM (SELECT id, j, c, lag(c) OVER (PARTITION BY id ORDER BY j) AS p FROM cn) WHERE p IS NOT NULL))"""


def constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("id") * (k + 2) + F.col("j") * (k + 1) * (F.col("id") % 3)) % 10 / F.lit(10.0))
    return dynamic(flat(trajectories(spark, sf_dir))).withColumn("c", c)


@query(f"WITH {_NODES}, {_CONS}, {_STEP} SELECT id, j::INT AS j, problem FROM sv")
def constraint_step_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a constraint that are too large in a dimension or in all, and pairs that rise together."""
    return V.step_violations(constrained(spark, sf_dir), "id", "j", "c")


@query(f"""WITH {_NODES}, {_PHASE_BAD}, {_DYNAMIC}, {_CONS}, {_STEP}, a AS (SELECT id FROM pv WHERE problem = 'violation' UNION SELECT id FROM dv WHERE problem IN ('peak', 'jump') UNION SELECT id FROM sv WHERE problem IN ('dimension', 'norm'))
SELECT DISTINCT n.id, a.id IS NULL AS valid FROM nodes n LEFT JOIN a USING (id)""")
def valid_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all three validators let a trajectory pass; warnings do not count."""
    return V.trajectories_valid(constrained(spark, sf_dir), "id", "j", "c", "phase", "r0", "chaos", STAGES)
