"""Embedding rollups: centroids, dispersion, concentration, similarity, projection onto nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import cosine, distance, entropy_term, let, norm, vsum
from tidemark.operators.matching import in_blocks

#: Nodes up to which they stand beside each query in its row.
STATED = 1000


def long_form(df: DataFrame, keep: list[str], e: str = "e") -> DataFrame:
    return df.select(*keep, F.posexplode(e).alias("i", "x"))


def means(df: DataFrame, by: list[str], e: str = "e") -> DataFrame:
    """(by..., n, mean): mean vectors by partial aggregation over dimensions; no group's vectors are gathered."""
    per = long_form(df, by, e).groupBy(*by, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def unit(v: Column) -> Column:
    n = norm(v) + 1e-10
    return F.transform(v, lambda x: x / n)


def concentration(df: DataFrame, by: list[str], e: str = "e") -> DataFrame:
    """Mean pairwise inner product within each group, in one pass: (|sum v|^2 - sum |v|^2) / (n (n - 1))."""
    per = long_form(df, by, e).groupBy(*by, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    g = per.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("a"), F.sum("q").alias("b"), F.max("n").alias("n"))
    return g.select(*by, "n", F.when(F.col("n") > 1, (F.col("a") - F.col("b")) / (F.col("n") * (F.col("n") - 1))).alias("concentration"))


def dispersion(df: DataFrame, by: list[str], e: str = "e") -> DataFrame:
    """Trace of the covariance (population) and the mean squared distance to the mean scaled to unit length."""
    per = long_form(df, by, e).groupBy(*by, "i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    g = per.groupBy(*by).agg(F.sum("v").alias("trace"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    away = F.sqrt("mm") - F.sqrt("mm") / (F.sqrt("mm") + 1e-10)
    return g.select(*by, "trace", (F.col("trace") + away * away).alias("dispersion_about_unit_mean"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """(by..., a column for each share): exact interpolated quantiles of each group, however large.

    A histogram of ``bins`` equal bins says which bin each wanted place is in; the values of those bins alone are
    numbered, by a sort that can spill. No task holds a group's distinct values.
    """
    own = Window.partitionBy(*by)
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    wide = F.col("_hi") > F.col("_lo")
    at = F.when(wide, F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    placed = df.filter(F.col(value).isNotNull()).join(ends, by).withColumn("_bin", at)
    counts = placed.groupBy(*by, "_bin", "_n").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(own.orderBy("_bin")) - F.col("_c"))
    rank = {n: F.col("_n") - 1 for n in shares}
    wanted = [w for n, q in shares.items() for w in (F.floor(rank[n] * q), F.ceil(rank[n] * q))]
    met = before.filter(F.exists(F.array(*wanted), lambda w: (w >= F.col("_before")) & (w < F.col("_before") + F.col("_c")))).select(*by, "_bin", "_before")
    order = Window.partitionBy(*by, "_bin").orderBy(value)
    numbered = placed.join(met, [*by, "_bin"]).select(*by, "_n", value, (F.col("_before") + F.row_number().over(order) - 1).alias("_k"))
    at_rank = lambda w: F.max(F.when(F.col("_k") == w, F.col(value)))
    out = []
    for n, q in shares.items():
        x = rank[n] * F.lit(q)
        lo, hi = at_rank(F.floor(x)), at_rank(F.ceil(x))
        out.append((lo + (hi - lo) * F.max(x - F.floor(x))).alias(n))
    return numbered.groupBy(*by).agg(*out)


def distance_quantiles(df: DataFrame, by: list[str], e: str = "e") -> DataFrame:
    """Median, p90 and p99 of the distance to the group's mean, p90 over the median, and an alert above 2."""
    j = df.join(means(df, by, e).select(*by, "mean"), by)
    d = exact_quantiles(j.select(*by, distance(F.col(e), F.col("mean")).alias("d")), by, "d", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return d.withColumn("ratio", F.col("p90") / F.col("median")).withColumn("alert", F.col("ratio") > 2.0)


def group_cosines(df: DataFrame, by: str, least: int = 10, e: str = "e") -> DataFrame:
    """(a, b, distance, kind) of pairs of groups of ``least`` vectors or more: one minus the cosine of their means."""
    m = means(df, [by], e).filter(F.col("n") >= least)
    a, b = m.select(F.col(by).alias("a"), F.col("mean").alias("ma")), m.select(F.col(by).alias("b"), F.col("mean").alias("mb"))
    d = a.join(b, F.col("a") < F.col("b")).select("a", "b", (1 - cosine(F.col("ma"), F.col("mb"))).alias("distance"))
    return d.withColumn("kind", F.when(F.col("distance") > 0.3, "divergent").when(F.col("distance") < 0.15, "converging").otherwise("ambiguous"))


def novelty(df: DataFrame, day: str, e: str = "e") -> DataFrame:
    """Per day one minus the cosine of its mean with the day before's (0 if that is negative); 1 where the day before is missing."""
    m = means(df, [day], e).select(day, "n", unit(F.col("mean")).alias("mean"))
    prev = m.select((F.col(day) + 1).alias(day), F.col("mean").alias("before"))
    return m.join(prev, day, "left").select(day, "n", F.when(F.col("before").isNull(), 1.0).otherwise(1 - F.greatest(F.lit(0.0), cosine(F.col("mean"), F.col("before")))).alias("novelty"))


def drift(df: DataFrame, order: str, e: str = "mean") -> DataFrame:
    """Adds one minus the cosine to the previous available row."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    prev = F.lag(e).over(w)
    return df.withColumn("drift", F.when(prev.isNotNull(), 1 - cosine(F.col(e), prev)))


def against(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every query vector (id, e) with every node (node, v) and their cosine; nodes are the stated side."""
    return in_blocks(queries, nodes).withColumn("cos", cosine(F.col("e"), F.col("v")))


def similarities(queries: DataFrame, nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per node (and ``by``) mean and largest cosine over the queries and how many exceed .5."""
    return against(queries, nodes).groupBy(*(by or []), "node").agg(F.avg("cos").alias("mean_sim"), F.max("cos").alias("max_sim"), F.count_if(F.col("cos") > 0.5).alias("n_hits"))


def beside(queries: DataFrame, nodes: DataFrame, most: int = STATED) -> DataFrame | None:
    """The queries with all nodes, and the cosine to each, in an array ``_s`` of struct(cos, k): k is the node's negative, so the largest entry is the best
    node, the lowest name on a tie. None where there are more than ``most`` nodes: then they don't go to all tasks."""
    if nodes.limit(most + 1).count() > most:
        return None
    all_ = nodes.agg(F.collect_list(F.struct("node", "v")).alias("_nodes"))
    s = F.transform("_nodes", lambda n: F.struct(cosine(F.col("e"), n["v"]).alias("cos"), (-n["node"]).alias("k")))
    return queries.join(F.broadcast(all_)).withColumn("_s", s).drop("_nodes")


def project(queries: DataFrame, nodes: DataFrame, temperature: float = 0.1, noise: float = 0.30, ambiguous: float = 0.03, most: int = STATED) -> DataFrame:
    """(id, best, top, gap, entropy, active, confidence, status): softmax over the cosines to the nodes, with two guards. While there are ``most`` nodes at most,
    everything about a query happens in its row."""
    s = beside(queries, nodes, most)
    if s is not None:
        top = F.array_max("_s")
        cos = F.transform("_s", lambda x: x["cos"])
        z = lambda c: F.transform(c, lambda x: F.exp((x - F.array_max(c)) / temperature))
        shares = let(z(cos), lambda v: let(vsum(v), lambda total: F.transform(v, lambda x: x / total)))
        s = s.filter(F.size("_s") > 0).select("id", top.alias("_t"), F.slice(F.sort_array(cos, False), 1, 2).alias("two"), shares.alias("_p"))
        g = s.select("id", F.col("_t").alias("t"), "two", vsum(F.transform("_p", entropy_term)).alias("entropy"), F.size(F.filter("_p", lambda p: p > 0.01)).cast("bigint").alias("active"))
    else:
        w = Window.partitionBy("id")
        s = against(queries, nodes)
        s = s.withColumn("z", F.exp((F.col("cos") - F.max("cos").over(w)) / temperature)).withColumn("p", F.col("z") / F.sum("z").over(w))
        g = s.groupBy("id").agg(
            F.max(F.struct("cos", (-F.col("node")).alias("k"))).alias("t"), F.slice(F.sort_array(F.collect_list("cos"), False), 1, 2).alias("two"),
            F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("entropy"), F.count_if(F.col("p") > 0.01).alias("active"),
        )
    top, gap = F.col("t.cos"), F.col("two")[0] - F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))
    g = g.select("id", (-F.col("t.k")).alias("best"), top.alias("top"), gap.alias("gap"), "entropy", "active")
    level = F.when((F.col("top") > 0.55) & (F.col("gap") > 0.06), "HIGH").when((F.col("top") > 0.40) & (F.col("gap") > 0.03), "MEDIUM").otherwise("LOW")
    status = F.when(F.col("top") < noise, "noise").when(F.col("gap") < ambiguous, "ambiguous").otherwise("projected")
    return g.withColumn("confidence", level).withColumn("status", status)


def assessed(projected: DataFrame) -> DataFrame:
    """Adds the cognitive state: known, partial, unknown or ambiguous."""
    state = F.when(F.col("status") == "noise", "unknown").when(F.col("status") == "ambiguous", "ambiguous").when(F.col("confidence") == "HIGH", "known").when(F.col("confidence") == "MEDIUM", "partial").otherwise("unknown")
    return projected.withColumn("state", state)


def retrieval(queries: DataFrame, nodes: DataFrame, truth: str, k: int = 3, most: int = STATED) -> DataFrame:
    """Share of queries whose true node (column of queries) is first, and among the first k."""
    s = beside(queries, nodes, most)
    if s is not None:
        own = F.filter("_s", lambda x: x["k"] == -F.col(truth))
        s = s.withColumn("_own", F.get(own, F.lit(0))).filter("_own is not null")
        r = s.withColumn("rank", 1 + F.size(F.filter("_s", lambda x: x > F.col("_own"))))
    else:
        w = Window.partitionBy("id").orderBy(F.desc("cos"), "node")
        r = against(queries, nodes).withColumn("rank", F.row_number().over(w)).filter(F.col("node") == F.col(truth))
    return r.agg(F.count("*").alias("n"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"), F.avg((F.col("rank") <= k).cast("double")).alias("topk"))


#: Cosines are ranked at nine digits: what a product of matrices puts further below the k-th best is not among the k best.
_SLACK = 2e-9


def nearest_rows(queries: DataFrame, base: DataFrame, k: int = 5, block: int = 1024, rows: int = 8192) -> DataFrame:
    """(id, rank, vec_id, cos): exact k nearest rows of a stated query set.

    Blocks of queries meet blocks of rows. A product of matrices tells which rows of a block can be among a query's k best; their cosines are then
    computed as cosine() does. Of equal vectors in a block the first k + 1 are enough, the query itself may be one of them.
    """
    n, m = max(1, -(-queries.count() // block)), max(1, -(-base.count() // rows))
    left = queries.filter("e is not null").groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct("id", "e")).alias("qs"))
    right = base.filter("e is not null").groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(m)).alias("_c")).agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "e")).alias("vs"))

    def side(held: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        ids, e = held.values.field("id"), held.values.field("e")
        return ids.to_numpy(zero_copy_only=False), e.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.add.accumulate(x, axis=1)[:, -1]  # from left to right

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, vs in zip(batch.column(0), batch.column(1), strict=True):
                (own, q), (ids, v) = side(qs), side(vs)
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v[order]
                _, first, kind = np.unique(v, axis=0, return_index=True, return_inverse=True)
                kind = kind.reshape(-1)
                by = np.argsort(kind, kind="stable")  # rows by vector, their ids rising
                begin = np.searchsorted(kind[by], np.arange(len(first) + 1))
                v = v[first]
                nq, nv = np.sqrt(summed(q * q)), np.sqrt(summed(v * v))
                for lo in range(0, len(q), 128):
                    some = slice(lo, lo + 128)
                    size = nq[some, None] * nv[None]
                    near = np.divide(q[some] @ v.T, size, out=np.zeros_like(size), where=size > 0)
                    best = min(k + 1, len(v))  # one may be the query itself
                    least = np.partition(near, len(v) - best, axis=1)[:, len(v) - best]
                    i, j = np.nonzero(near >= least[:, None] - _SLACK)
                    i += lo
                    d = np.concatenate([summed(q[i[x : x + 65536]] * v[j[x : x + 65536]]) for x in range(0, len(i), 65536)])
                    size = nq[i] * nv[j]
                    cos = np.divide(d, size, out=np.zeros_like(d), where=size > 0)
                    times = np.minimum(begin[j + 1] - begin[j], k + 1)
                    at = np.repeat(begin[j] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    yield pa.record_batch([pa.array(own[np.repeat(i, times)], pa.int64()), pa.array(ids[by[at]], pa.int64()), pa.array(np.repeat(cos, times))], names=["id", "vec_id", "cos"])

    pairs = left.join(right, F.lit(True)).repartition(max(1, min(n * m, 2000)), "_b", "_c").select("qs", "vs")
    s = pairs.mapInArrow(task, "id bigint, vec_id bigint, cos double").withColumn("cos", F.round("cos", 9)).filter(F.col("id") != F.col("vec_id"))
    w = Window.partitionBy("id").orderBy(F.desc("cos"), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "rank", "vec_id", "cos")
