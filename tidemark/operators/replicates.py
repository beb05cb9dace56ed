"""Replicate harness: resampling jobs in parallel, each replicate seeded by its number."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def replicated(spark: SparkSession, n: int, draw: Callable[[np.random.Generator], dict], schema: str, seed: int = 0, tasks: int = 0) -> DataFrame:
    """A row for each of n replicates. ``draw`` gets a generator seeded by (seed, replicate): a retry gives the same rows."""
    tasks = tasks or min(n, spark.sparkContext.defaultParallelism * 2)

    def run(frames):
        for f in frames:
            rows = [{"replicate": int(k), **draw(np.random.default_rng([seed, int(k)]))} for k in f["id"]]
            if rows:
                yield pd.DataFrame(rows)

    return spark.range(0, n, 1, tasks).mapInPandas(run, f"replicate bigint, {schema}")


def by_group(df: DataFrame, key: str, order: str, columns: list[str], kernel: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """A kernel over each group's rows in order, as a matrix. Groups are series after aggregation: short by construction."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[columns].to_numpy(float)
        return pd.DataFrame([{key: pdf[key].iloc[0], **kernel(x)}])

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def matrix(df: DataFrame, order: str, columns: list[str], most: int = 20_000) -> np.ndarray:
    """A short series on the driver, its length checked."""
    rows = df.select(order, *columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; aggregate first")
    return np.array([[r[c] for c in columns] for r in sorted(rows, key=lambda r: r[order])], float)


# Resampling tests of label sequences


def transition_table(labels: np.ndarray, k: int) -> np.ndarray:
    n = np.zeros((k, k))
    np.add.at(n, (labels[:-1], labels[1:]), 1)
    return n / np.maximum(n.sum(1, keepdims=True), 1)


def transition_bootstrap(spark: SparkSession, labels: np.ndarray, k: int, draws: int = 10_000, seed: int = 42, as_is: bool = False) -> DataFrame:
    """(src, dst, mean, lo, hi): resampled (from, to) pairs; ``as_is`` resamples sorted rows instead, which inflates staying."""
    n = len(labels)

    def draw(rng: np.random.Generator) -> dict:
        if as_is:
            t = transition_table(labels[np.sort(rng.integers(n, size=n))], k)
        else:
            pick = rng.integers(n - 1, size=n - 1)
            c = np.zeros((k, k))
            np.add.at(c, (labels[:-1][pick], labels[1:][pick]), 1)
            t = c / np.maximum(c.sum(1, keepdims=True), 1)
        return {"p": t.ravel().tolist()}

    r = replicated(spark, draws, draw, "p array<double>", seed).select(F.posexplode("p").alias("i", "p"))
    return r.groupBy("i").agg(F.avg("p").alias("mean"), F.percentile("p", 0.025).alias("lo"), F.percentile("p", 0.975).alias("hi")).select(
        F.floor(F.col("i") / k).cast("int").alias("src"), (F.col("i") % k).cast("int").alias("dst"), "mean", "lo", "hi"
    )


def permutation_p(spark: SparkSession, observed: float, draw: Callable[[np.random.Generator], float], draws: int = 5000, seed: int = 0) -> DataFrame:
    """(observed, null_mean, p): share of draws at least as far from the null's mean, two-sided."""
    r = replicated(spark, draws, lambda g: {"v": float(draw(g))}, "v double", seed)
    m = r.agg(F.avg("v").alias("null_mean"))
    far = F.abs(F.col("v") - F.col("null_mean")) >= F.abs(F.lit(observed) - F.col("null_mean"))
    return r.join(m).agg(F.lit(observed).alias("observed"), F.first("null_mean").alias("null_mean"), F.avg(far.cast("double")).alias("p"))


def nyblom_test(spark: SparkSession, y: np.ndarray, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(order, statistic, p): share of surrogates of the fitted AR whose statistic is as large."""
    from tidemark.functions import numerics as N

    p = N.ar_order(y)
    own = N.nyblom(y, p)
    r = replicated(spark, draws, lambda g: {"v": N.nyblom(N.ar_surrogate(y, p, g), p)}, "v double", seed)
    return r.agg(F.lit(p).alias("order"), F.lit(own).alias("statistic"), F.avg((F.col("v") >= own).cast("double")).alias("p"))


def jackknife(spark: SparkSession, x: np.ndarray, draws: int = 100, keep: float = 0.8, seed: int = 0) -> DataFrame:
    """(replicate, d90, k): dimension and mixture size of column subsets."""
    from tidemark.functions import numerics as N

    def draw(rng: np.random.Generator) -> dict:
        cols = np.sort(rng.choice(x.shape[1], max(2, int(keep * x.shape[1])), replace=False))
        z = N.standardised(x[:, cols])
        scores, _, ratio = N.pca(z)
        return {"d90": N.dimensions(ratio)[0], "k": N.mixture_by_bic(scores[:, :3], range(1, 5))[0]}

    return replicated(spark, draws, draw, "d90 int, k int", seed)


def block_null(spark: SparkSession, x: np.ndarray, size: int, draws: int = 800, k: int = 4, seed: int = 0) -> DataFrame:
    """(angle, gap) at the 95th percentile over pairs of random contiguous blocks that do not overlap."""
    from tidemark.functions import numerics as N

    def draw(rng: np.random.Generator) -> dict:
        a = int(rng.integers(0, len(x) - 2 * size + 1))
        b = int(rng.integers(a + size, len(x) - size + 1))
        xa, xb = N.standardised(x[a : a + size]), N.standardised(x[b : b + size])
        ca, cb = N.pca(xa)[1][:k], N.pca(xb)[1][:k]
        own, cross = N.reconstruction_r2(xb, cb, xb.mean(0)), N.reconstruction_r2(xb, ca, xb.mean(0))
        return {"angle": float(N.principal_angles(ca, cb).max()), "gap": own - cross}

    r = replicated(spark, draws, draw, "angle double, gap double", seed)
    return r.agg(F.percentile("angle", 0.95).alias("angle_p95"), F.percentile("gap", 0.95).alias("gap_p95"))


def drifting_test(spark: SparkSession, y: np.ndarray, n: int = 500, together: int = 16) -> DataFrame:
    """(order, q, lr, p, at_zero): the variance ratio of a series' drifting coefficients, its likelihood ratio, the share of ``n`` surrogates with constant
    coefficients whose ratio is as large, and of those whose variance ratio is 0. Surrogates are seeded by number and spread over tasks, some at a time."""
    from tidemark.functions import numerics as N

    order = N.ar_order(y)
    own = N.drifting_ar(y, order)
    lr = own["lr"]

    def run(frames):
        for f in frames:
            for lo in range(0, len(f), together):
                q, ratio = N.drifting_surrogates(y, order, f["id"].to_numpy()[lo : lo + together], N.Q_GRID)
                yield pd.DataFrame({"q": q, "lr": ratio})

    tasks = max(1, min(n // together, spark.sparkContext.defaultParallelism))
    null = spark.range(n).repartition(tasks).mapInPandas(run, "q double, lr double")
    as_large = F.avg((F.round("lr", 9) >= F.round(F.lit(lr), 9)).cast("double")).alias("p")
    return null.agg(as_large, F.avg((F.col("q") == 0).cast("double")).alias("at_zero")).select(F.lit(order).alias("order"), F.lit(own["q"]).alias("q"), F.lit(lr).alias("lr"), "p", "at_zero")
