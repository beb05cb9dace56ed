"""The four indicators, their labels, and the query interface over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import rules as R
from tidemark.functions.columns import distance
from tidemark.operators.hierarchy import kmeans, table_of
from tidemark.operators.semantic import means

SCHEMA = "t int, inertia double, resilience double, sensitivity double, recovery double, fragility double, shocks int, radius double"


def as_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The indicators of the last of a series' rows, by it and those before it."""
    pdf = pdf.sort_values("s")
    x, u = np.stack(pdf["x"]), np.stack(pdf["u"])
    r = pdf.iloc[-1]
    t = len(x) - 1
    step = np.r_[0, np.linalg.norm(np.diff(x, axis=0), axis=1)]
    force = np.r_[0, np.linalg.norm(np.diff(u, axis=0), axis=1)]
    past = x[max(0, t - 11) :]
    a, b = past[:-1].ravel(), past[1:].ravel()
    corr = float(np.corrcoef(a, b)[0, 1]) if len(past) > 3 and a.std() > 0 and b.std() > 0 else 0.0
    seen = step[1:]
    limit = 2 * seen.std() if len(seen) else 0.0
    shocks = [s for s in range(1, t + 1) if limit and step[s] > limit]
    times = []
    for s in shocks[-12:]:
        ok = [k for k in range(1, 18) if s + k <= t and np.linalg.norm(x[s + k] - x[s - 1]) < 0.5 * limit]
        times.append(ok[0] if ok else 12)
    recovery = float(np.mean(times)) if times else 12.0
    recent = x[max(0, t - 23) :]
    away = np.linalg.norm(recent - recent.mean(0), axis=1)
    fragility = float(min(away[-1] / away.std(), 5)) if len(away) > 2 and away.std() > 0 else 0.0
    n24 = sum(s > t - 24 for s in shocks)
    radius = spectral_radius(past)
    resilience = 0.3 * (1 - recovery / 12) + 0.3 * (1 - min(fragility / 3, 1)) + 0.2 * (1 - min(n24 / 6, 1)) + 0.2 * min(max(1 - radius, 0), 1)
    stage = min(max(r.fixation / (max(r.origin + r.emergence, 0.01) + r.fixation + 0.05), 0), 1)
    inertia = 0.4 * stage + 0.3 * max(0.0, corr) + 0.3 * r.fixation
    ratio = past.var(axis=0).mean() / max(r.base, 1e-12)
    gain = step[max(0, t - 11) :].mean() / max(force[max(0, t - 11) :].mean(), 1e-12)
    alerts = int((np.sort(past.var(axis=0) / np.maximum(x.var(axis=0), 1e-12))[::-1][:3] > 2).sum())
    csi, amp = min(max(ratio * max(0.0, corr), 0), 3), min(max(gain, 0), 3)
    sensitivity = 0.35 * min(csi / 1.5, 1) + 0.35 * min(amp / 2, 1) + 0.30 * alerts / 3
    return pd.DataFrame([(int(r.t), inertia, resilience, sensitivity, recovery, fragility, n24, radius)], columns=[f.split()[0] for f in SCHEMA.split(", ")])


def spectral_radius(past: np.ndarray) -> float:
    """Largest modulus of the eigenvalues of the least-squares map from each row to the next, about the rows' mean; 0 for four rows or fewer."""
    if len(past) <= 4:
        return 0.0
    w = np.linalg.lstsq(past[:-1] - past.mean(0), past[1:] - past.mean(0), rcond=None)[0]
    return float(np.abs(np.linalg.eigvals(w)).max())


def mean_variance(states: DataFrame) -> DataFrame:
    """(base): the mean over dimensions of the variance of x; of rows 13 to 36 where there are more than twenty, else of all."""
    n = states.agg(F.count("*").alias("n"))
    some = states.join(F.broadcast(n)).filter((F.col("n") <= 20) | F.col("t").between(13, 36))
    return some.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v")).agg(F.avg("v").alias("base"))


def history(states: DataFrame, cells: bool = True) -> DataFrame:
    """Indicators of each month from rows (t, month, x array, u array, stage shares, mutation, drift); t counts from 0.

    Each month is a group of its own: the month and those before it (no look-ahead), so months are worked out side by side. Twelve rows make a
    window; before there are that many the correlation is 0. The cells, if wanted, are k-means clusters of the states of all months.
    """
    states = table_of(states, "states")  # read several times
    past = states.select(F.col("t").alias("s"), "x", "u")
    own = states.select("t", "origin", "emergence", "fixation").join(F.broadcast(mean_variance(states)))
    group = own.join(past, F.col("s") <= F.col("t"))
    found = group.groupBy("t").applyInPandas(lambda pdf: as_of(pdf), SCHEMA)
    top = states.agg(F.max("mutation").alias("_m"), F.max("drift").alias("_d"))  # one row
    heat = 0.5 * F.col("mutation") / F.greatest("_m", F.lit(1e-12)) + 0.5 * F.col("drift") / F.greatest("_d", F.lit(1e-12))
    warm = states.join(F.broadcast(top)).select("t", "month", F.least(F.greatest(heat, F.lit(0.0)), F.lit(1.0)).alias("temperature"))
    out = found.join(warm, "t")
    if not cells:
        return out
    own_cell = kmeans(states, "t", "x", max(1, min(5, states.count() // 12)))
    return out.join(own_cell, "t").withColumnRenamed("cluster", "cell")


#: Stages in their order, and how many months back moves are counted.
STAGES, BACK = ("origin", "emergence", "peak", "controversy", "fixation"), 12


def positions(states: DataFrame) -> DataFrame:
    """(t, month, dominant, second, moves): the stage with the largest share and the one after it (the earlier stage on a tie), and how often the dominant
    one has changed in this and the twelve months before. states: a row for each month."""
    ranked = F.array_sort(F.array(*(F.struct((-F.col(s)).alias("less"), F.lit(i).alias("i"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES))))
    w = Window.partitionBy(F.lit(0)).orderBy("t")
    r = states.select("t", "month", ranked.alias("r")).select("t", "month", F.col("r")[0]["stage"].alias("dominant"), F.col("r")[1]["stage"].alias("second"))
    moved = r.withColumn("_m", (F.lag("dominant").over(w) != F.col("dominant")).cast("int"))
    return moved.withColumn("moves", F.coalesce(F.sum("_m").over(w.rangeBetween(-BACK, 0)), F.lit(0))).drop("_m")


def basins(states: DataFrame, cells: DataFrame) -> DataFrame:
    """(t, cell, share, away, typical): each month's cell, the percentage of months in it, the distance to its centre, and whether that is under one
    and a half times the cell's mean distance. cells: (t, cell)."""
    j = states.select("t", "x").join(cells.select("t", "cell"), "t")
    centre = means(j.withColumnRenamed("x", "e"), ["cell"]).select("cell", F.col("mean").alias("c"), "n")
    d = j.join(centre, "cell").withColumn("away", distance(F.col("x"), F.col("c")))
    per = d.groupBy("cell").agg(F.avg("away").alias("_mean"))
    whole = states.agg(F.count("*").alias("_all"))
    return d.join(per, "cell").join(F.broadcast(whole)).select("t", "cell", F.round(100 * F.col("n") / F.col("_all"), 1).alias("share"), "away", (F.col("away") < 1.5 * F.col("_mean")).alias("typical"))


def labelled(h: DataFrame) -> DataFrame:
    """Adds labels, diagnosis, risk text and the out-of-domain flag."""
    i, r, s = F.col("inertia"), F.col("resilience"), F.col("sensitivity")
    return h.select(
        "*", R.three_way(i, 0.65, 0.40).alias("inertia_label"), F.when(r < 0.30, "fragile").when(r > 0.60, "robust").otherwise("moderate").alias("resilience_label"),
        R.three_way(s, 0.60, 0.35).alias("sensitivity_label"), R.diagnosis(i, r, s).alias("diagnosis"), R.risks(i, s).alias("risks"), R.out_of_domain(i, r, s).alias("out_of_domain"),
    )


class Engine:
    """query(mode, month, vectors): macro state, projection of vectors onto nodes, or both."""

    def __init__(self, indicators: DataFrame, regimes: DataFrame, nodes: DataFrame):
        from tidemark.operators.windows import over

        # how many months in a row each month's regime has lasted by then
        broken = F.max(F.when(F.col("_new"), F.col("_i"))).over(over("month").rowsBetween(Window.unboundedPreceding, 0))
        seen = regimes.select("month", "label", F.row_number().over(over("month")).alias("_i"), (~F.lag("label").over(over("month")).eqNullSafe(F.col("label"))).alias("_new"))
        self.indicators, self.nodes = labelled(indicators), nodes
        self.regimes = seen.select("month", "label", (F.col("_i") - broken + 1).alias("dwell"))

    def macro(self, month: str | None = None) -> DataFrame:
        """One month's state; the latest where none is named."""
        j = self.indicators.join(self.regimes.select("month", F.col("label").alias("regime"), "dwell"), "month", "left")
        j = j.withColumn("risks", R.risks(F.col("inertia"), F.col("sensitivity"), F.col("regime"), F.col("dwell")))
        return j.filter(F.col("month") == month) if month else j.orderBy(F.desc("month")).limit(1)

    def persona(self, vectors: DataFrame, month: str | None = None) -> DataFrame:
        from tidemark.operators.semantic import assessed, project

        known = assessed(project(vectors, self.nodes))
        flag = self.macro(month).select("out_of_domain", F.col("month").alias("as_of"))
        return known.join(flag, F.lit(True), "left").withColumn("state", F.when(F.col("out_of_domain"), "unknown").otherwise(F.col("state")))

    def query(self, mode: str, month: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
        if mode == "macro":
            return self.macro(month)
        if mode in ("persona", "full"):
            if vectors is None:
                raise ValueError("this mode needs vectors")
            p = self.persona(vectors, month)
            return p if mode == "persona" else p.join(self.macro(month).drop("out_of_domain"))
        raise ValueError(f"no mode {mode!r}: macro, persona or full")
