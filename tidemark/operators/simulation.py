"""Simulations as Spark jobs: one row per configuration, solved in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import dynamics as D


def per_row(df: DataFrame, solve: Callable[[dict], dict], schema: str) -> DataFrame:
    """A kernel over each row's values; rows are configurations and independent."""

    def run(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame([solve(r) for r in f.to_dict("records")])

    return df.mapInPandas(run, schema)


TOGETHER = 256
_OUTBREAK = "r0 double, peak double, peak_day double, total double, duration double, entropy double, birth double, ended double, status string"


def outbreaks(df: DataFrame, key: str = "id", threshold: float = 0.01) -> DataFrame:
    """(key, r0, peak, peak_day, total, duration, entropy, birth, ended, status) of rows (key, beta, gamma, sigma, mu), some hundreds solved together."""

    def solved(f: pd.DataFrame) -> pd.DataFrame:
        s = D.Spread(*(f[c].to_numpy(float) for c in ("beta", "gamma", "sigma", "mu")))
        t = np.linspace(0, 200.0, 1000)
        n = len(f)
        y = D.rk4(s.field, np.array([np.full(n, 0.999), np.full(n, 0.001), np.zeros(n)]), t)
        i = y[:, 1]
        peak = i.max(0)
        up, on = i > 0.01 * peak, i >= threshold
        first, last = on.argmax(0), len(t) - 1 - on[::-1].argmax(0)
        ever, still = on.any(0), on[-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            e = -np.where(y > 0, y * np.log(y), 0).sum(1)
        return pd.DataFrame({
            key: f[key], "r0": s.beta / s.gamma, "peak": peak, "peak_day": t[i.argmax(0)], "total": 1 - y[:, 0].min(0), "duration": t[len(t) - 1 - up[::-1].argmax(0)] - t[up.argmax(0)], "entropy": e.max(0),
            "birth": np.where(ever, t[first], np.nan), "ended": np.where(ever & ~still, t[last], np.nan), "status": np.where(~ever, "never", np.where(still, "endemic", "died")),
        })

    def run(frames):
        for f in frames:
            for lo in range(0, len(f), TOGETHER):
                yield solved(f.iloc[lo : lo + TOGETHER])

    made = df.select(key, "beta", "gamma", "sigma", "mu").mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {_OUTBREAK}")
    return made.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("birth", "ended")})


def fields(df: DataFrame) -> DataFrame:
    """(id, ds, di, dr): the model's field at rows (id, s, i, r, beta, gamma, sigma, mu)."""

    def run(frames):
        for f in frames:
            s = D.Spread(*(f[c].to_numpy() for c in ("beta", "gamma", "sigma", "mu")))
            d = s.field(np.array([f["s"], f["i"], f["r"]]))
            yield pd.DataFrame({"id": f["id"], "ds": d[0], "di": d[1], "dr": d[2]})

    return df.mapInPandas(run, "id bigint, ds double, di double, dr double")


def dealt(df: DataFrame) -> DataFrame:
    """Configurations dealt to all cores: their table is small beside what they cost, so its files are too few."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def together(df: DataFrame, solved: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """solved() over some hundreds of rows at a time."""

    def run(frames):
        for f in frames:
            for lo in range(0, len(f), TOGETHER):
                yield solved(f.iloc[lo : lo + TOGETHER])

    return df.mapInPandas(run, schema)


def two_populations(df: DataFrame) -> DataFrame:
    """(id, core_peak, mass_peak, core_day, mass_day) of rows (id, beta, mass, gamma, across), some hundreds solved together."""

    def solved(f: pd.DataFrame) -> pd.DataFrame:
        beta, mass, gamma, across = (f[c].to_numpy(float) for c in ("beta", "mass", "gamma", "across"))
        t, y = D.two_populations(D.Spread(beta, gamma), D.Spread(mass, gamma), across)
        core, many = y[:, 1], y[:, 4]
        return pd.DataFrame({"id": f["id"], "core_peak": core.max(0), "mass_peak": many.max(0), "core_day": t[core.argmax(0)], "mass_day": t[many.argmax(0)]})

    return together(df, solved, "id bigint, core_peak double, mass_peak double, core_day double, mass_day double")


def divergences(df: DataFrame, first: float, second: float) -> DataFrame:
    """(id, rate) of rows (id, beta, gamma, sigma): growth of the distance of two runs from two starts, some hundreds solved together."""

    def solved(f: pd.DataFrame) -> pd.DataFrame:
        s = D.Spread(*(f[c].to_numpy(float) for c in ("beta", "gamma", "sigma")))
        return pd.DataFrame({"id": f["id"], "rate": D.divergence(s.solve(i0=first)[1], s.solve(i0=second)[1], 200.0)})

    return together(df, solved, "id bigint, rate double")


def agent_paths(df: DataFrame, events: list[float], noise: float = 0.0, seed: int = 42) -> DataFrame:
    """(id, step, x) of agents (id, lean, openness, memory) under a row of events, some hundreds walking together."""
    v = np.array(events)

    def walked(f: pd.DataFrame) -> pd.DataFrame:
        lean, openness, memory = (f[c].to_numpy(float) for c in ("lean", "openness", "memory"))
        x = D.individual(np.array([lean, openness, np.full(len(f), noise), memory]), v, seed)
        return pd.DataFrame({"id": np.repeat(f["id"].to_numpy(), len(v)), "step": np.tile(np.arange(1, len(v) + 1, dtype=np.int32), len(f)), "x": x.T.reshape(-1)})

    return together(df, walked, "id bigint, step int, x double")


def crowds(df: DataFrame) -> DataFrame:
    """(id, peak, reached, final, mood_sd) of rows (id, contagion, chaos, scale_free, seed)."""

    def solve(r: dict) -> dict:
        c = D.Crowd(contagion=r["contagion"], chaos=r["chaos"], scale_free=bool(r["scale_free"]), seed=int(r["seed"]))
        return {"id": r["id"], **D.simulated(c)}

    return per_row(df, solve, "id bigint, peak double, reached double, final double, mood_sd double")


def fits(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, beta, gamma, r0) fitted to each key's curve, scaled to its share of the peak."""
    from tidemark.operators.replicates import by_group

    def kernel(x: np.ndarray) -> dict:
        y = x[:, 0] / max(x[:, 0].max(), 1e-9) * 0.3
        s = D.fitted(np.arange(len(y), dtype=float), y, max(float(y[0]), 1e-3))
        return {"beta": s.beta, "gamma": s.gamma, "r0": s.r0}

    return by_group(df, key, order, [value], kernel, "beta double, gamma double, r0 double")


_ROBUST = "beta double, sigma double, gamma double, mu double, r0 double, scale double, loss double, active int"


def robust_fits(df: DataFrame, key: str, order: str, value: str, category: str | None = None) -> DataFrame:
    """(key, points, beta, sigma, gamma, mu, r0, scale, loss, active): robust fits to each key's series (a row for each whole time, some hundreds at most),
    TOGETHER at a time; nulls where a series can't be fitted. category: a column that chooses the prior."""
    kind = F.max(category) if category else F.lit(None).cast("string")
    rows = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("v"), kind.alias("c"))

    def run(frames):
        for f in frames:
            for lo in range(0, len(f), TOGETHER):
                some = f.iloc[lo : lo + TOGETHER]
                priors = np.array([D.CONTACT_PRIOR.get(c, D.NO_PRIOR) for c in some["c"]])
                made = D.robustly_fitted([np.asarray(v, float) for v in some["v"]], priors)
                names = [x.split()[0] for x in _ROBUST.split(", ")]
                out = pd.DataFrame([{n: (m or {}).get(n) for n in names} for m in made], columns=names)
                out["active"] = out["active"].astype("Int32")
                yield pd.concat([some[[key]].reset_index(drop=True), pd.Series([len(v) for v in some["v"]], name="points", dtype="int32"), out], axis=1)

    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, points int, {_ROBUST}")


def mutating_fields(df: DataFrame) -> DataFrame:
    """df with ds, di, dr: the model with mutation at rows (s, i, r, beta, sigma, gamma, mu)."""
    new, back = F.col("beta") * F.col("s") * F.col("i"), F.col("mu") * F.col("r")
    out = F.col("sigma") * F.col("i")
    return df.withColumn("ds", F.col("gamma") * F.col("r") - new).withColumn("di", new - out + back).withColumn("dr", out - F.col("gamma") * F.col("r") - back)
