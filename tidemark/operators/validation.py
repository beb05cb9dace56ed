"""Validation statistics: group means, leave-one-out, agreement, distribution tests, ridge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


def z_scores(df: DataFrame, by: str, value: str) -> DataFrame:
    w = Window.partitionBy(by)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def leave_one_out(df: DataFrame, by: str, value: str) -> DataFrame:
    """Adds ``error``: the value less the mean of the rest of its group; null where it is alone. Sums are pre-aggregated and joined."""
    g = df.groupBy(by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return df.join(g, by).withColumn("error", F.col(value) - (F.col("_s") - F.col(value)) / F.nullif(F.col("_n") - 1, F.lit(0))).drop("_s", "_n")


def group_mean_backtest(train: DataFrame, test: DataFrame, by: str, value: str) -> DataFrame:
    m = train.groupBy(by).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
    e = F.col(value) - F.col("m")
    return test.join(m, by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(value, "m").alias("r"), F.avg((F.abs(e) <= 2 * F.col("sd")).cast("double")).alias("covered")
    )


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information, homogeneity, completeness and V of two labellings, from their contingency table."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    ra, rb = c.groupBy("a").agg(F.sum("n").alias("sa")), c.groupBy("b").agg(F.sum("n").alias("sb"))
    pairs = lambda x: x * (x - 1) / 2
    total = c.agg(F.sum("n").alias("t"), F.sum(pairs(F.col("n"))).alias("i"))
    xa = ra.join(total.select("t")).agg(F.sum(pairs(F.col("sa"))).alias("x"), F.sum(-F.col("sa") / F.col("t") * F.ln(F.col("sa") / F.col("t"))).alias("ha"))
    xb = rb.join(total.select("t")).agg(F.sum(pairs(F.col("sb"))).alias("y"), F.sum(-F.col("sb") / F.col("t") * F.ln(F.col("sb") / F.col("t"))).alias("hb"))
    mi = c.join(ra, "a").join(rb, "b").join(total.select("t")).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("sa") * F.col("sb")))).alias("mi"))
    all_ = total.join(xa).join(xb).join(mi)
    chance = F.col("x") * F.col("y") / pairs(F.col("t"))
    h, k = F.col("mi") / F.col("ha"), F.col("mi") / F.col("hb")
    return all_.select(((F.col("i") - chance) / ((F.col("x") + F.col("y")) / 2 - chance)).alias("ari"), (2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"), h.alias("homogeneity"), k.alias("completeness"), (2 * h * k / (h + k)).alias("v"))


def ks_statistic(df: DataFrame, first: str, value: str) -> DataFrame:
    """(n_a, n_b, d) of the two-sample test. Counts are aggregated by value first, so the running sums see distinct values only."""
    c = df.groupBy(value).agg(F.count_if(F.col(first)).alias("a"), F.count_if(~F.col(first)).alias("b"))
    n = c.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    w = Window.partitionBy(F.lit(0)).orderBy(value)
    run = c.select(F.sum("a").over(w).alias("ca"), F.sum("b").over(w).alias("cb"))
    return run.join(n).groupBy("n_a", "n_b").agg(F.max(F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))).alias("d"))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p of the two-sample statistic."""
    import math

    en = math.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def ridge(df: DataFrame, features: list[str], target: str, alpha: float) -> np.ndarray:
    """Centred ridge weights from one aggregation of moments; the solve is features x features on the driver."""
    cols = [*features, target]
    want = [F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols))]
    want += [F.sum(F.col(a) * F.col(b)).alias(f"q{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    r = df.agg(*want).first()
    k, n = len(cols), r["n"]
    s = np.array([r[f"s{i}"] for i in range(k)])
    q = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - np.outer(s, s) / n
    return np.linalg.solve(q[:-1, :-1] + alpha * np.eye(k - 1), q[:-1, -1])


def crossings(df: DataFrame, value: str, order: str, level: Column) -> DataFrame:
    """Places where the value passes the level strictly, and the direction."""
    prev = F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(order))
    x = F.col(value)
    up, down = (prev < level) & (x > level), (prev > level) & (x < level)
    return df.withColumn("direction", F.when(up, "up").when(down, "down")).filter("direction is not null")


def gradient_z(df: DataFrame, value: str, order: str) -> DataFrame:
    """Adds the z-score (population sd) of the central difference; one-sided at the ends; rows evenly spaced."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    a, b, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    g = df.withColumn("g", F.when(a.isNull(), b - x).when(b.isNull(), x - a).otherwise((b - a) / 2))
    return g.join(g.agg(F.avg("g").alias("gm"), F.stddev_pop("g").alias("gs"))).withColumn("z", (F.col("g") - F.col("gm")) / F.col("gs"))


def step_violations(df: DataFrame, by: str, order: str, vector: str, dim: float = 0.35, norm: float = 0.5, rise: float = 0.15, pair: tuple[int, int] = (0, 2)) -> DataFrame:
    """(by, order, problem): steps of a dimension over ``dim``, of the norm over ``norm``; a warning where the two axes of ``pair`` (identity and conflict) rise together."""
    pairs = df.withColumn("_p", F.lag(vector).over(Window.partitionBy(by).orderBy(order))).filter("_p is not null")
    step = F.zip_with(vector, "_p", lambda a, b: F.round(a - b, 9))  # nine digits: the bounds are sharp
    size = F.round(F.sqrt(F.aggregate(step, F.lit(0.0), lambda s, x: s + x * x)), 9)
    a, b = (F.try_element_at(step, F.lit(i + 1)) for i in pair)
    notes = F.array(
        F.when(F.exists(step, lambda x: F.abs(x) > dim), "dimension"), F.when(size > norm, "norm"), F.when((a > rise) & (b > rise), "co-rise"),
    )
    return pairs.select(by, order, F.explode(F.array_compact(notes)).alias("problem"))


def phase_violations(df: DataFrame, by: str, order: str, phase: str, phases: tuple[str, ...]) -> DataFrame:
    """(by, order, problem): phases that are unknown, or come after one, or go back by more than one (violation), back by one or ahead by more than two (warning)."""
    at = F.array_position(F.array(*map(F.lit, phases)), F.coalesce(F.col(phase), F.lit(""))).cast("int")
    w = Window.partitionBy(by).orderBy(order)
    d = df.withColumn("_at", at).withColumn("_before", F.lag(at).over(w)).filter("_before is not null").withColumn("_d", F.col("_at") - F.col("_before"))
    unknown = (F.col("_at") == 0) | (F.col("_before") == 0)
    problem = F.when(unknown | (F.col("_d") < -1), "violation").when((F.col("_d") == -1) | (F.col("_d") > 2), "warning")
    return d.withColumn("problem", problem).filter("problem is not null").select(by, order, "problem")


def dynamics_violations(df: DataFrame, by: str, order: str, r0: str, phase: str, chaos: str) -> DataFrame:
    """(by, order, problem): peak nodes with R0 under 1, and jumps of R0 over 1.5 (but from origin, or to fixation under .1), are violations; controversy
    without a drift of the chaos axis under -.1, and fixation that is still active (R0 of 2 or more, chaos axis within .1), are warnings."""
    w = Window.partitionBy(by).orderBy(order)
    p, r, c = F.col(phase), F.col(r0), F.col(chaos)
    exempt = (F.lag(phase).over(w) == "origin") | ((p == "fixation") & (r < 0.1))
    jump = (F.round(F.abs(r - F.lag(r0).over(w)), 9) > 1.5) & ~F.coalesce(exempt, F.lit(False))
    calm = (r > 0.5) & (r < 2.0) & (F.abs(c) < 0.9)
    notes = F.array(
        F.when((p == "peak") & (r < 1), "peak"), F.when(jump, "jump"), F.when((p == "controversy") & (c > -0.1), "no drift"),
        F.when((p == "fixation") & ~calm & (r >= 1) & (F.abs(c) < 0.1), "still active"),
    )
    return df.withColumn("_n", F.array_compact(notes)).select(by, order, F.explode("_n").alias("problem"))


def trajectories_valid(df: DataFrame, by: str, order: str, vector: str, phase: str, r0: str, chaos: str, phases: tuple[str, ...]) -> DataFrame:
    """(by, valid): whether none of the three validators finds a violation (warnings are none)."""
    bad = step_violations(df, by, order, vector).filter("problem in ('dimension', 'norm')").select(by)
    bad = bad.unionByName(phase_violations(df, by, order, phase, phases).filter("problem = 'violation'").select(by))
    bad = bad.unionByName(dynamics_violations(df, by, order, r0, phase, chaos).filter("problem in ('peak', 'jump')").select(by))
    return df.select(by).distinct().join(bad.distinct().withColumn("_bad", F.lit(True)), by, "left").select(by, F.col("_bad").isNull().alias("valid"))


def within_dispersion(df: DataFrame, by: str, axes: list[str]) -> DataFrame:
    """(by, n, dispersion): sum of squared distances to the group's centre, from sums alone."""
    parts = [F.var_pop(a) * F.count("*") for a in axes]
    return df.groupBy(by).agg(F.count("*").alias("n"), sum(parts[1:], parts[0]).alias("dispersion"))


def rolling_backtest(df: DataFrame, by: str, value: str, year: str, cuts: list[int]) -> DataFrame:
    """(train_end, n, mae, rmse, r, covered): for each cut the group means of the years up to it against the later years.

    Sums of each group and year are taken once; the training side of a cut is a sum of those.
    """
    y = df.groupBy(by, year).agg(F.count(value).alias("c"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    at = F.explode(F.array(*map(F.lit, cuts))).alias("train_end")
    t = y.select("*", at).filter(F.col(year) <= F.col("train_end")).groupBy("train_end", by).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    m = F.col("s") / F.col("c")
    t = t.select("train_end", by, m.alias("m"), F.sqrt(F.greatest(F.col("q") / F.col("c") - m * m, F.lit(0.0))).alias("sd"))
    e = F.col(value) - F.col("m")
    return df.join(t, by).filter(F.col(year) > F.col("train_end")).groupBy("train_end").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(value, "m").alias("r"), F.avg((F.abs(e) <= 2 * F.col("sd")).cast("double")).alias("covered")
    )


def rank_correlation(df: DataFrame, by: str, a: str, b: str, tie: str) -> DataFrame:
    """(by, r): correlation of ranks within each group, ties by ``tie``."""
    rank = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(c, tie))
    return df.select(by, rank(a).alias("_a"), rank(b).alias("_b")).groupBy(by).agg(F.corr("_a", "_b").alias("r"))
