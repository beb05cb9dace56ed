"""Principal components of any number of rows: one aggregation of moments, eigenvectors of a features x features matrix, scores in Spark.

Each task adds its rows up to a count, a sum and a matrix of products for each group; Spark sums those. What reaches the driver is
features x features numbers for each group, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Features, and groups, at most: both sizes are the driver's.
MOST_FEATURES, MOST_GROUPS = 2048, 64


@dataclass
class Basis:
    n: int
    mean: np.ndarray
    sd: np.ndarray  # 1 where a feature is constant, or where features are only centred
    matrix: np.ndarray  # of covariances of the centred (and scaled) features
    components: np.ndarray  # a row each, the largest loading positive, by falling share
    shares: np.ndarray

    def dimensions(self, *shares: float) -> list[int]:
        """How many components hold each share of the variance."""
        total = np.cumsum(self.shares)
        return [int(min(np.searchsorted(total, q - 1e-12) + 1, len(total))) for q in shares]

    def explained(self, components: np.ndarray) -> float:
        """The share of this basis' variance that other components (orthonormal rows) hold."""
        return float(np.trace(components @ self.matrix @ components.T) / max(np.trace(self.matrix), 1e-300))


def products(df: DataFrame, vector: str, by: str | None = None) -> DataFrame:
    """(by, i, j, q): sums of products of the vectors' entries, the place before the first being 1, so that sums and counts are among them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            if not len(lists):
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
            x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
            for g in np.unique(group).tolist():
                own = x[group == g]
                held[g] = held.get(g, 0) + own.T @ own
        for g, q in held.items():
            i, j = np.indices(q.shape)
            yield pa.record_batch([pa.array(np.full(q.size, g), pa.int64()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(q.ravel())], names=["by", "i", "j", "q"])

    rows = df.select((F.col(by) if by else F.lit(0)).cast("bigint").alias("by"), F.col(vector).cast("array<double>").alias("v")).filter("by is not null and v is not null")
    return rows.mapInArrow(task, "by bigint, i int, j int, q double").groupBy("by", "i", "j").agg(F.sum("q").alias("q"))


def bases(df: DataFrame, vector: str, by: str | None = None, scaled: bool = True) -> dict[int, Basis]:
    """The basis of each group (0 without ``by``) of vectors of one length; rows without a vector are left out."""
    first = df.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    if first is None:
        return {}
    if first["n"] > MOST_FEATURES:
        raise ValueError(f"{first['n']} features; {MOST_FEATURES} at most")
    found = products(df, vector, by).toArrow()
    groups, d = np.unique(found.column("by").to_numpy()), first["n"] + 1
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"{len(groups)} groups; {MOST_GROUPS} at most")
    out = {}
    for g in groups.tolist():
        own = found.column("by").to_numpy() == g
        q = np.zeros((d, d))
        q[found.column("i").to_numpy()[own], found.column("j").to_numpy()[own]] = found.column("q").to_numpy()[own]
        n, mean = q[0, 0], q[0, 1:] / q[0, 0]
        cov = q[1:, 1:] / n - np.outer(mean, mean)
        var = np.diag(cov).copy()
        flat = var <= 1e-12 * np.maximum(np.diag(q)[1:] / n, 1e-300)  # constant but for rounding
        sd = np.where(flat, 1.0, np.sqrt(np.maximum(var, 0))) if scaled else np.ones(d - 1)
        matrix = cov / np.outer(sd, sd)
        matrix[flat] = matrix[:, flat] = 0
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = np.maximum(values[::-1], 0), vectors.T[::-1]
        vectors = vectors * np.where(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)] < 0, -1, 1)[:, None]
        out[int(g)] = Basis(int(n), mean, sd, matrix, vectors, values / max(values.sum(), 1e-300))
    return out


def scores(vector: Column | str, basis: Basis, k: int) -> Column:
    """The vector's first k components, inside the row."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def one(c: np.ndarray) -> Column:
        weight, shift = c / basis.sd, float((c / basis.sd) @ basis.mean)
        terms = F.zip_with(v, F.array(*(F.lit(float(w)) for w in weight)), lambda x, w: x.cast("double") * w)
        return F.aggregate(terms, F.lit(-shift), lambda a, x: a + x)

    return F.array(*(one(c) for c in basis.components[:k]))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Principal angles, in degrees, between the spaces that two sets of orthonormal rows span."""
    return np.degrees(np.arccos(np.clip(np.linalg.svd(a @ b.T, compute_uv=False), -1, 1)))


def wide(long: DataFrame, row: str, feature: str, value: str, features: int) -> DataFrame:
    """(row, v): an array of ``features`` entries for each row from (row, feature from 0, value) rows, 0 where there is none."""
    held = long.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(feature, value))).alias("_m"))  # features entries at most
    return held.select(row, F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("v"))
