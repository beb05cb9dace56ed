"""Distances of a short series with itself: returns, recurrence quantification, autocorrelation.

These self-joins are over months (a few hundred rows after aggregation), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.columns import distance, entropy_term


def far_pairs(df: DataFrame, order: str, x: str, apart: int = 12) -> DataFrame:
    """(i, j, d): ordered pairs at least ``apart`` rows from each other (temporal exclusion) and their distance."""
    a = df.select(F.col(order).alias("i"), F.col(x).alias("xa"))
    b = df.select(F.col(order).alias("j"), F.col(x).alias("xb"))
    return a.join(b, F.abs(F.col("i") - F.col("j")) >= apart).select("i", "j", distance(F.col("xa"), F.col("xb")).alias("d"))


def group_distances(df: DataFrame, group: str, x: str) -> DataFrame:
    """(a, b, pairs, nearest, mean): distances between members of each pair of groups."""
    a = df.select(F.col(group).alias("a"), F.col(x).alias("xa"))
    b = df.select(F.col(group).alias("b"), F.col(x).alias("xb"))
    d = distance(F.col("xa"), F.col("xb"))
    return a.join(b, F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("pairs"), F.min(d).alias("nearest"), F.avg(d).alias("mean"))


def quantification(df: DataFrame, order: str, x: str, quantile: float = 0.1, shortest: int = 2) -> DataFrame:
    """Recurrence rate, determinism, laminarity (main diagonal included), longest diagonal off the main one, trapping time; mean length of the diagonals
    and the entropy of their lengths over twenty equal bins, or as many as there are diagonals if those are fewer (0 where all fall in one)."""
    a = df.select(F.col(order).alias("i"), F.col(x).alias("xa"))
    b = df.select(F.col(order).alias("j"), F.col(x).alias("xb"))
    pairs = a.join(b).select("i", "j", F.abs(F.col("xa") - F.col("xb")).alias("d"))
    eps = pairs.filter("i < j").agg(F.percentile("d", quantile).alias("eps"))
    r = pairs.join(eps).filter(F.col("d") <= F.col("eps")).select("i", "j", (F.col("j") - F.col("i")).alias("k"))

    def lines(by: str) -> DataFrame:
        g = F.col("i") - F.row_number().over(Window.partitionBy(by).orderBy("i"))
        return r.withColumn("g", g).groupBy(by, "g").agg(F.count("*").alias("l"))

    long = F.when(F.col("l") >= shortest, F.col("l"))
    across = lines("k")
    diagonal = across.agg((F.sum(long) / F.sum("l")).alias("det"), F.max(F.when(F.col("k") != 0, F.col("l"))).alias("l_max"), F.sum("l").alias("points"), F.avg(long).alias("l_mean"))
    some = across.filter(F.col("l") >= shortest)
    ends = some.agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count("*").alias("all"))
    bins = F.least(F.col("all"), F.lit(20))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.round((F.col("l") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")), 9)), bins - 1))
    entropy = some.join(ends).groupBy(place.alias("bin"), "all").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(entropy_term(F.col("c") / F.col("all"))), F.lit(0.0)).alias("entr"))
    vertical = lines("j").agg((F.sum(long) / F.sum("l")).alias("lam"), F.avg(long).alias("trapping"))
    n = df.agg(F.count("*").alias("n"))
    return diagonal.join(vertical).join(n).join(entropy).select((F.col("points") / (F.col("n") * F.col("n"))).alias("rec"), "det", "lam", "l_max", "trapping", "l_mean", "entr")


def autocorrelation(df: DataFrame, value: str, order: str, most: int) -> DataFrame:
    """(tau, acf) with the whole series' mean and variance."""
    m = df.agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count("*").alias("n"))
    c = df.join(m).select(F.col(order).alias("t"), (F.col(value) - F.col("m")).alias("c"), "v", "n")
    left = c.withColumn("tau", F.explode(F.sequence(F.lit(1), F.lit(most))))
    right = c.select((F.col("t")).alias("u"), F.col("c").alias("c2"))
    return left.join(right, F.col("t") + F.col("tau") == F.col("u")).groupBy("tau").agg((F.sum(F.col("c") * F.col("c2")) / (F.max("n") * F.max("v"))).alias("acf"))


def embedding_delay(df: DataFrame, value: str, order: str, most: int = 20) -> DataFrame:
    """First tau whose autocorrelation is under 1/e; a quarter of ``most`` where none is."""
    import math

    acf = autocorrelation(df, value, order, most)
    return acf.agg(F.coalesce(F.min(F.when(F.col("acf") < 1 / math.e, F.col("tau"))), F.lit(max(1, most // 4))).alias("delay"))
