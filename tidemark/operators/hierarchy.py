"""Ward's hierarchy by rounds of reciprocal nearest neighbours, and the choice of the number of clusters.

Ward's distance of two clusters follows from their sizes and centres alone, n m / (n + m) |c - d|^2. In each round every cluster finds its
nearest one, block against block of clusters, and pairs that are nearest to each other merge; as merging never brings a cluster nearer to a
third, the tree is that of merging the nearest pair each time, and a cluster whose nearest one is still there meets the new clusters alone. Ties go by the pair's smaller, then larger name, so some pair always merges.

Silhouettes are those of squared Euclidean distance, in closed form: the mean distance of a point to a cluster's members is its squared distance to their
centre and their variance, so clusters' sums are enough and no pair of points is made.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import dot
from tidemark.sources.tables import working_dir

#: Clusters that are compared with as many at once (four times as many travel together), and clusters up to which the rounds go on within one task.
BLOCK, ONE_TASK = 1024, 16_384
_MERGE = "node bigint, a bigint, b bigint, height double, n bigint"


def _kept(df: DataFrame, at: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")


def table_of(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder."""
    return _kept(df, f"{working_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", "rows")


def open_pairs(i: np.ndarray, n: np.ndarray, c: np.ndarray, j: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, height): Ward's distances of clusters i[x] to clusters j[y] where they can be the least of a row; none to itself.

    A product of matrices in single precision bounds all distances from below; those that its error leaves open are then summed from differences, so that
    equal centres are at no distance to the bit, from either side.
    """
    far = (c * c).sum(-1), (d * d).sum(-1)
    middle = c.mean(axis=0)
    p, q = c - middle, d - middle
    a, b = (p * p).sum(-1), (q * q).sum(-1)
    error = 4 * (c.shape[1] + 6) * (np.finfo(np.float32).eps * (a + b.max()) + np.finfo(float).eps * (far[0] + far[1].max()))
    with np.errstate(over="ignore", invalid="ignore"):
        left = np.concatenate([-2 * p, (a - error)[:, None], np.ones((len(p), 1))], axis=1).astype(np.float32)
        right = np.concatenate([q, np.ones((len(q), 1)), b[:, None]], axis=1).astype(np.float32)
        low = left @ right.T
        share = (1 / n).astype(np.float32)[:, None] + (1 / m).astype(np.float32)[None]
        low /= share
    if len(same := np.intersect1d(i, j)):
        order = np.argsort(i), np.argsort(j)
        low[order[0][np.searchsorted(i, same, sorter=order[0])], order[1][np.searchsorted(j, same, sorter=order[1])]] = np.inf
    at = low.argmin(axis=1)
    least = low[np.arange(len(low)), at].astype(float)
    most = least + 3 * error / share[np.arange(len(low)), at]
    # too large for single precision, or too small for it: all are open
    plain = ~np.isfinite(a + b.max()) | (a + b.max() > 1e30) | (error < 1e-30)
    limit = np.nextafter(most.astype(np.float32), np.float32(np.inf))
    x, y = np.nonzero((low <= limit[:, None]) | plain[:, None])
    own = i[x] == j[y]
    x, y = x[~own], y[~own]
    height = np.empty(len(x))
    for at in range(0, len(x), 1 << 16):
        u, v = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        total = np.zeros(len(u))
        for lo in range(0, c.shape[1], 8):
            total += ((c[u, lo : lo + 8] - d[v, lo : lo + 8]) ** 2).sum(-1)
        height[at : at + (1 << 16)] = total * (n[u] * m[v] / (n[u] + m[v]))
    return x, y, height


def least_heights(i: np.ndarray, n: np.ndarray, c: np.ndarray, j: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """open_pairs() as a matrix, infinite elsewhere."""
    far = np.full((len(i), len(j)), np.inf)
    x, y, height = open_pairs(i, n, c, j, m, d)
    far[x, y] = height
    return far


def nearest_of(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, height) by id: for each cluster of x the nearest one of y. Both: names, sizes, centres. What has none but itself is left out."""
    (i, n, c), (j, m, d) = x, y
    found = [(i[:0], j[:0], np.zeros(0))]
    for lo in range(0, len(i), BLOCK):
        here = slice(lo, lo + BLOCK)
        for at in range(0, len(j), BLOCK):
            there = slice(at, at + BLOCK)
            u, v, height = open_pairs(i[here], n[here], c[here], j[there], m[there], d[there])
            found.append((i[here][u], j[there][v], height))
    return nearest_rows(*(np.concatenate(f) for f in zip(*found, strict=True)))


def nearest_rows(a: np.ndarray, b: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a the row with the least height, by names where several have it."""
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), height, a))
    a, b, height = a[order], b[order], height[order]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    return a[first], b[first], height[first]


def nearest(some: DataFrame, few: int, clusters: DataFrame, count: int) -> DataFrame:
    """(id, other, height): for each of some clusters (``few`` of them) the nearest of all clusters. Both: (id, n, c)."""

    def held(df: DataFrame, rows: int, name: str, into: str) -> tuple[DataFrame, int]:
        blocks = max(1, -(-rows // (4 * BLOCK)))
        dealt = df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return dealt.groupBy(F.col("_b").alias(name)).agg(F.collect_list(F.struct("id", "n", "c")).alias(into)), blocks  # a block's rows: 4 * BLOCK or so

    (left, p), (right, q) = held(some, few, "p", "x"), held(clusters, count, "q", "y")
    pairs = left.join(right, F.lit(True)).repartition(max(1, min(p * q, 2000)), "p", "q")

    def matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, n, c = (rows.field(f) for f in ("id", "n", "c"))
        return ids.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False).astype(float), c.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                (i, n, c), (j, m, d) = matrix(x.values), matrix(y.values)
                yield pa.record_batch(list(map(pa.array, nearest_of((i, n, c), (j, m, d)))), names=["id", "other", "height"])

    return pairs.select("x", "y").mapInArrow(task, "id bigint, other bigint, height double")


def nearer(*each: DataFrame) -> DataFrame:
    """Of several (id, other, height) the nearest for each id."""
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    best = F.min(F.struct("height", F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"), "other")).alias("m")
    return every.groupBy("id").agg(best).select("id", "m.other", "m.height")


def finished(clusters: DataFrame, done: int) -> DataFrame:
    """The merges of ONE_TASK clusters at most in one task: by rounds as before, and of the last 2 * BLOCK nearest pair after nearest pair."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                ids, n, c = (rows.values.field(f) for f in ("id", "n", "c"))
                ids, n, c = ids.to_numpy(zero_copy_only=False).copy(), n.to_numpy(zero_copy_only=False).astype(float), c.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).copy()
                order = np.argsort(ids)
                ids, n, c = ids[order], n[order], c[order]
                out, made = [], done
                if len(ids) > 2 * BLOCK:
                    _, to, height = nearest_of((ids, n, c), (ids, n, c))
                while len(ids) > 2 * BLOCK:
                    at = np.searchsorted(ids, to)
                    i = np.nonzero((to[at] == ids) & (ids < to))[0]
                    j = at[i]
                    size, names = n[i] + n[j], -(made + 1 + np.arange(len(i)))
                    centre = (c[i] * n[i][:, None] + c[j] * n[j][:, None]) / size[:, None]
                    out += zip(*(v.tolist() for v in (names, ids[i], ids[j], height[i], size.astype(int))), strict=True)
                    made += len(i)
                    gone = np.zeros(len(ids), bool)
                    gone[i] = gone[j] = True
                    good, stale = ~gone & ~gone[at], ~gone & gone[at]
                    new, kept = (names, size, centre), (ids[good], n[good], c[good])
                    rest = tuple(map(np.concatenate, zip(new, (ids[stale], n[stale], c[stale]), strict=True)))
                    known = (ids[good], to[good], height[good])
                    ids, n, c = map(np.concatenate, zip(rest, kept, strict=True))
                    order = np.argsort(ids)
                    ids, n, c = ids[order], n[order], c[order]
                    _, to, height = nearest_rows(*map(np.concatenate, zip(known, nearest_of(rest, (ids, n, c)), nearest_of(kept, new), strict=True)))

                def away(i: int) -> np.ndarray:
                    d = ((c - c[i]) ** 2).sum(axis=1) * n * n[i] / (n + n[i])
                    d[i] = np.inf
                    return d

                far = np.stack([away(i) for i in range(len(ids))])
                low, to = np.full(len(ids), np.inf), np.zeros(len(ids), int)

                def look(r: int) -> None:
                    """The nearest one of r; by names where several are."""
                    low[r] = far[r].min()
                    at = np.nonzero(far[r] == low[r])[0]
                    to[r] = at[0] if len(at) == 1 else min(at, key=lambda y: (min(ids[r], ids[y]), max(ids[r], ids[y])))

                for r in range(len(ids)):
                    look(r)
                for k in range(len(ids) - 1):
                    x = np.nonzero(low == low.min())[0]
                    i = int(min(x, key=lambda p: (min(ids[p], ids[to[p]]), max(ids[p], ids[to[p]]))))
                    j, height = int(to[i]), low[i]
                    a, b = sorted((int(ids[i]), int(ids[j])))
                    c[i], total = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j]), n[i] + n[j]
                    n[i], ids[i] = total, -(made + k + 1)
                    gone = np.isinf(far[i])  # of those merged before, and itself
                    out.append((int(ids[i]), a, b, float(height), int(total)))
                    row = np.where(gone, np.inf, away(i))
                    far[i], far[:, i] = row, row
                    far[j], far[:, j] = np.inf, np.inf
                    low[j] = np.inf
                    if k < len(ids) - 2:
                        for r in np.nonzero((np.isfinite(low) & ((to == i) | (to == j))) | (far[:, i] <= low) & np.isfinite(far[:, i]))[0]:
                            look(r)
                        look(i)
                yield pa.RecordBatch.from_pylist([dict(zip(("node", "a", "b", "height", "n"), r, strict=True)) for r in out], pa.schema([("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("height", pa.float64()), ("n", pa.int64())]))

    held = clusters.agg(F.collect_list(F.struct("id", "n", "c")).alias("rows"))
    return held.mapInArrow(task, _MERGE)


def ward(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(node, a, b, height, n): the merges, n rows making n - 1 of them. A node's name is the negative of its number; rows keep theirs (whole numbers from 0,
    each once). Rows without a vector are left out."""
    spark = df.sparkSession
    at = f"{working_dir(spark)}/ward-{uuid.uuid4().hex}"
    now = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("n"), F.col(vector).cast("array<double>").alias("c"))
    clusters = _kept(now, at, "clusters-0")
    merges, done, count, k = [], 0, clusters.count(), 0
    kept = new = None
    fresh = 0
    while count > 1:
        k += 1
        if count <= ONE_TASK:  # what one task can hold is finished there
            merges.append(_kept(finished(clusters, done), at, "finished"))
            break
        if kept is None:
            near = nearer(nearest(clusters, count, clusters, count))
        else:
            old = clusters.join(kept.select("id"), "id", "left_semi").select("id", "n", "c")
            rest = clusters.join(kept.select("id"), "id", "left_anti").select("id", "n", "c")
            n = kept.count()
            near = nearer(kept, nearest(rest, count - n, clusters, count), nearest(old, n, new, fresh))
        near = _kept(near, at, f"near-{k}")
        back = near.select(F.col("id").alias("other"), F.col("other").alias("_back"))
        pairs = near.join(back, "other").filter("_back = id and id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), "height")
        named = _kept(_numbered(pairs, done), at, f"named-{k}")
        x, y = (clusters.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("c").alias(f"c{s}")) for s in "ab")
        both = named.join(x, "a").join(y, "b")
        centre = F.zip_with("ca", "cb", lambda p, q: (p * F.col("na") + q * F.col("nb")) / (F.col("na") + F.col("nb")))
        made = _kept(both.select("node", "a", "b", "height", (F.col("na") + F.col("nb")).alias("n"), centre.alias("c")), at, f"made-{k}")
        merges.append(made.select("node", "a", "b", "height", "n"))
        gone = named.select(F.explode(F.array("a", "b")).alias("id"))
        rest = clusters.join(gone, "id", "left_anti").select("id", "n", "c").unionByName(made.select(F.col("node").alias("id"), "n", "c"))
        clusters = _kept(rest, at, f"clusters-{k}")
        left = clusters.count()
        fresh, new = count - left, made.select(F.col("node").alias("id"), "n", "c")
        kept = _kept(near.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("other")), "other", "left_anti").select("id", "other", "height"), at, f"kept-{k}")
        done, count = done + fresh, left
    if not merges:
        return spark.createDataFrame([], _MERGE)
    out = merges[0]
    for m in merges[1:]:
        out = out.unionByName(m)
    return out


def _numbered(pairs: DataFrame, done: int) -> DataFrame:
    """Names without a sort in one task: numbers within partitions, behind those of the partitions before."""
    placed = pairs.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    per = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a number for each partition
    sofar, before = 0, {}
    for p in sorted(per):
        before[p], sofar = sofar, sofar + per[p]
    shift = F.create_map(*(x for p, n in before.items() for x in (F.lit(p), F.lit(n))))
    own = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    return placed.withColumn("node", -(own + shift[F.col("_p")] + 1 + done).cast("bigint")).drop("_p", "_i")


def roots(merges: DataFrame, rows: DataFrame, key: str, k: int) -> DataFrame:
    """(id, root): the rows' nodes (or rows) when k clusters are left. Ties in height go by the node made first."""
    last = merges.orderBy(F.desc("height"), "node").limit(k - 1).select("node")  # k - 1 rows
    tree = merges.join(F.broadcast(last), "node", "left_anti")
    at = f"{working_dir(rows.sparkSession)}/cut-{uuid.uuid4().hex}"
    up = _kept(tree.select(F.explode(F.array("a", "b")).alias("id"), F.col("node").alias("up")), at, "up-0")
    for i in range(1, 64):  # each round doubles how far up a name points
        onward = up.select(F.col("id").alias("up"), F.col("up").alias("_far"))
        moved = _kept(up.join(onward, "up", "left").select("id", F.coalesce("_far", "up").alias("up"), F.col("_far").isNotNull().alias("_on")), at, f"up-{i}")
        up = moved.select("id", "up")
        if not moved.filter("_on").take(1):
            break
    return rows.select(F.col(key).cast("bigint").alias("id")).join(up, "id", "left").select("id", F.coalesce("up", "id").alias("root"))


def cut(merges: DataFrame, rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, cluster): the rows' clusters when k are left; a cluster is named by its smallest row."""
    n = rows.count()
    if not 1 <= k <= max(n, 1):
        raise ValueError(f"{k} clusters of {n} rows")
    own = roots(merges, rows, key, k)
    names = own.groupBy("root").agg(F.min("id").alias("cluster"))
    return own.join(names, "root").select(F.col("id").alias(key), "cluster")


def silhouettes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """The rows with ``silhouette``, by squared Euclidean distance; 0 for a row that is alone in its cluster, null where there is one cluster. A row for
    each cluster goes to all tasks."""
    d = df.select(F.size(vector).alias("d")).first()
    if d is None:
        return df.withColumn("silhouette", F.lit(None).cast("double"))
    v = F.col(vector)
    sums = F.array(*(F.sum(v[i].cast("double")) for i in range(d["d"])))
    per = df.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("n"), F.sum(dot(v, v)).alias("q"), sums.alias("s"))
    every = per.agg(F.collect_list(F.struct("c", "n", "q", "s")).alias("_all"))
    own = df.crossJoin(F.broadcast(every)).withColumn("_q", dot(v, v))

    def mean(c: Column, others: bool) -> Column:
        """Of squared distances to the members of c; of its own cluster the row itself is none."""
        total = c["n"] * F.col("_q") - 2 * dot(v, c["s"]) + c["q"]
        return F.greatest(total, F.lit(0.0)) / (c["n"] if others else F.nullif(c["n"] - 1, F.lit(0)))

    mine = F.filter("_all", lambda c: c["c"] == F.col(label))[0]
    a, b = mean(mine, False), F.array_min(F.transform(F.filter("_all", lambda c: c["c"] != F.col(label)), lambda c: mean(c, True)))
    out = own.withColumn("_a", a).withColumn("_b", b)
    value = F.when(F.col("_b").isNull(), None).when(F.col("_a").isNull(), 0.0).when(F.greatest("_a", "_b") == 0, 0.0).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))
    return out.withColumn("silhouette", value).drop("_all", "_q", "_a", "_b")


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 50) -> DataFrame:
    """(key, cluster): Lloyd's rounds from k rows far apart: the first by ``key``, then each time the row farthest from those taken. Clusters are numbered in that
    order. What goes to and fro are k centres; rows are assigned inside the row, the lower number on a tie."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = table_of(df.select(key, v.alias("_v")), "kmeans")
    first = rows.orderBy(key).first()
    if first is None:
        return rows.select(key, F.lit(0).alias("cluster"))
    taken = [list(first["_v"])]

    def away(centres: list[list[float]]) -> Column:
        return F.array(*(F.aggregate(F.zip_with("_v", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centres))

    while len(taken) < k:
        far = rows.select(key, "_v", F.array_min(away(taken)).alias("d")).orderBy(F.desc("d"), key).first()
        if not far["d"]:
            break  # fewer distinct rows than k
        taken.append(list(far["_v"]))
    centres = taken
    for _ in range(rounds):
        d = away(centres)
        placed = rows.select(key, "_v", (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("cluster"))
        means = placed.groupBy("cluster").agg(F.array(*(F.avg(F.col("_v")[i]) for i in range(len(centres[0])))).alias("c")).collect()  # k rows
        moved = {r["cluster"]: list(r["c"]) for r in means}
        following = [moved.get(i, c) for i, c in enumerate(centres)]
        if all(abs(a - b) <= 1e-12 * max(1.0, abs(b)) for c, o in zip(following, centres, strict=True) for a, b in zip(c, o, strict=True)):
            break
        centres = following
    return placed.select(key, "cluster")


def sweep(df: DataFrame, key: str, vector: str, ks: range = range(2, 13)) -> DataFrame:
    """(k, silhouette, inertia): of Ward's clusters for each k. inertia: summed squared distances to the centres."""
    spark = df.sparkSession
    at = f"{working_dir(spark)}/sweep-{uuid.uuid4().hex}"
    merges = _kept(ward(df, key, vector), at, "merges")
    most = min(max(ks), df.count())
    top = merges.orderBy(F.desc("height"), "node").limit(most - 1).collect()  # under ``most`` rows
    total = merges.agg(F.coalesce(F.sum("height"), F.lit(0.0)).alias("t")).first()["t"]
    own = _kept(df.join(roots(merges, df, key, most).withColumnRenamed("id", key), key), at, "rows")
    out = None
    for k in ks:
        if k > most:
            break
        into = {m[s]: m["node"] for m in top[k - 1 :] for s in "ab"}  # the merges among the top ones that are done when k are left

        def end(i: int, into: dict = into) -> int:
            return end(into[i]) if i in into else i

        moved = {i: end(i) for i in into}
        label = F.coalesce(F.create_map(*(F.lit(x) for pair in moved.items() for x in pair))[F.col("root")], F.col("root")) if moved else F.col("root")
        mean = silhouettes(own.withColumn("_cluster", label), "_cluster", vector).agg(F.avg("silhouette").alias("silhouette"))
        # merging adds its height to the inertia
        row = mean.select(F.lit(k).alias("k"), "silhouette", F.lit(total - sum(m["height"] for m in top[: k - 1])).alias("inertia"))
        out = row if out is None else out.unionByName(row)
    return out
