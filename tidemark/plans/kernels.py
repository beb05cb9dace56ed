"""Queries that run numpy kernels: spectra, mixtures, resampling, simulation, indicators. SQL can't express them; tests do."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions import numerics as N
from tidemark.operators import components as C, indicators as I, replicates as R, simulation as S
from tidemark.plans.bindings import attention, axis, regime_sequence, table, vectors


def _wide(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, list[str]]:
    """The month x keyword matrix on the driver: a row for each month, a column for each name in the table of nations."""
    keys = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    w = attention(spark, sf_dir).groupBy("month").pivot("keyword", keys).agg(F.sum("value")).na.fill(0.0)
    return R.matrix(w, "month", keys), keys


def month_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(month, v): an entry for each name in the table of nations, in the order of their keys."""
    keys = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    place = F.array_position(F.array(*map(F.lit, keys)), F.col("keyword")).cast("int") - 1
    return C.wide(attention(spark, sf_dir).withColumn("i", place), "month", "i", "value", len(keys)), keys


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows], schema)


@query()
def state_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components for 90, 95 and 99 % of the variance of the standardised keyword matrix."""
    rows, keys = month_vectors(spark, sf_dir)
    b = C.bases(rows, "v")[0]
    return _frame(spark, [(b.n, len(keys), *b.dimensions(0.9, 0.95, 0.99), round(float(b.shares[0]), 6))], "n int, features int, d90 int, d95 int, d99 int, first double")


@query()
def state_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _ = _wide(spark, sf_dir)
    s = N.pca(N.standardised(x))[0][:, :5]
    v = N.varx(s)
    return _frame(spark, [(v["alpha"], v["r2"], v["r2_last"])], "alpha double, r2 double, r2_last double")


@query()
def regimes_by_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _ = _wide(spark, sf_dir)
    k, label = N.mixture_by_bic(N.pca(N.standardised(x))[0][:, :3])
    return _frame(spark, [(t, int(v), k) for t, v in enumerate(label)], "t int, label int, k int")


@query()
def control_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _ = _wide(spark, sf_dir)
    z = N.diffusion_map(N.standardised(x))
    return _frame(spark, [(t, *map(float, r)) for t, r in enumerate(z)], "t int, z1 double, z2 double, z3 double")


@query()
def axis_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each control axis the eight keywords whose own series go with it most."""
    x, keys = _wide(spark, sf_dir)
    z = N.diffusion_map(N.standardised(x))
    r = np.corrcoef(z.T, x.T)[:3, 3:]
    rows = [(a + 1, i + 1, keys[j], float(r[a, j])) for a in range(3) for i, j in enumerate(np.argsort(-np.abs(r[a]))[:8])]
    return _frame(spark, rows, "axis int, rank int, keyword string, r double")


@query()
def transition_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = R.matrix(regime_sequence(spark, sf_dir), "t", ["label"])[:, 0].astype(int)
    return R.transition_bootstrap(spark, label, 5)


@query()
def nyblom_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nyblom_test(spark, R.matrix(axis(spark, sf_dir), "t", ["x"])[:, 0])


@query()
def drifting_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = R.matrix(axis(spark, sf_dir), "t", ["x"])[:, 0]
    p = N.ar_order(y)
    d = N.drifting_ar(y, p)
    return _frame(spark, [(p, d["q"], d["lr"], d["root_first"], d["root_second"])], "order int, q double, lr double, root_first double, root_second double")


@query()
def drifting_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the coefficients drift more than chance lets constant ones seem to: five hundred surrogates."""
    return R.drifting_test(spark, R.matrix(axis(spark, sf_dir), "t", ["x"])[:, 0])


@query()
def cluster_discreteness(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _ = _wide(spark, sf_dir)
    s = N.pca(N.standardised(x))[0][:, :3]
    k, gap = N.gap_statistic(s, 6, 100)
    rows = [(i + 1, k, g, N.silverman(s[:, i], 500) if i < 3 else None) for i, g in enumerate(gap)]
    return _frame(spark, rows, "k int, chosen int, gap double, silverman_p double")


@query()
def curation_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _ = _wide(spark, sf_dir)
    return R.jackknife(spark, x)


@query()
def slice_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _ = _wide(spark, sf_dir)
    return R.block_null(spark, x, 24)


@query()
def keyword_attractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attention(spark, sf_dir)
    return R.by_group(a, "keyword", "month", ["value"], lambda m: N.attractor(m[:, 0]), "delay int, dim int, rec double, det double, lyapunov double, regime string")


@query()
def curve_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyword's whole series."""
    return S.fits(attention(spark, sf_dir), "keyword", "month", "value")


@query()
def crowd_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id")).select("id", (0.02 + F.col("id") % 8 * 0.05).alias("contagion"), (F.floor(F.col("id") / 8) % 3 * 0.4).cast("double").alias("chaos"), (F.col("id") % 2 == 0).alias("scale_free"), F.col("id").alias("seed"))
    return S.crowds(c.repartition(8))


def indicator_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, month, x, u, stage shares, mutation, drift) as the indicators take them."""
    from tidemark.operators import attention as A
    from tidemark.plans.regimes import state

    a = attention(spark, sf_dir)
    placed = A.stage_of(a, A.stage_intervals(a, "keyword", "month"), "keyword", "month").groupBy("month").agg(
        *(F.avg((F.col("stage") == s).cast("double")).alias(s) for s in I.STAGES)
    )
    m = axis(spark, sf_dir)
    s = state(spark, sf_dir).drop("t").join(placed, "month", "left").na.fill(0.0, list(I.STAGES))
    own = m.select("t", "month", F.array("x", F.ln("total")).alias("u"), F.abs("x").alias("mutation"), F.abs("x").alias("drift"))
    return own.join(s.select("month", "x", *I.STAGES), "month")


@query()
def indicator_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.labelled(I.history(indicator_states(spark, sf_dir)))


@query()
def engine_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query interface: every vector's projection with the latest month's state."""
    from tidemark.operators.semantic import means

    v = vectors(spark, sf_dir)
    nodes = means(v, ["label"]).select(F.col("label").alias("node"), F.col("mean").alias("v"))
    engine = I.Engine(I.history(indicator_states(spark, sf_dir)), regime_sequence(spark, sf_dir), nodes)
    return engine.query("full", vectors=v.select(F.col("vec_id").alias("id"), "e"))
