"""Permutation tests as DataFrame jobs. A replicate's permutation is the order of a hash of (replicate, row): every engine and every run ranks
alike, replicates spread over the tasks, and none depends on another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numerics import md5_head
from tidemark.operators.windows import placed


def replicated(rows: DataFrame, order: str, n: int, salt: str = "") -> DataFrame:
    """The rows n times, with ``rep`` from 0 and ``rank`` from 1: each replicate's rows in the order of md5(rep:row:salt). order: a whole number that tells rows apart."""
    partitions = max(1, min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("rep"))
    key = F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col(order).cast("string"), F.lit(salt)).cast("binary"))
    w = Window.partitionBy("rep").orderBy("_key", order)
    return every.repartition(partitions, "rep").withColumn("_key", key).withColumn("rank", F.row_number().over(w)).drop("_key")


def two_sided(null: Column, observed: Column) -> Column:
    """Twice the smaller share of replicates on either side, nine digits telling ties."""
    a, b = F.round(null, 9), F.round(observed, 9)
    return 2 * F.least(F.avg((a >= b).cast("double")), F.avg((a <= b).cast("double")))


def switches(series: DataFrame, label: str, order: str) -> DataFrame:
    """The rows after which the label changes, with what it changes to (``into``)."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return series.withColumn("into", F.lead(label).over(w)).filter(F.col("into") != F.col(label))


def switch_test(series: DataFrame, label: str, order: str, value: str, n: int = 10000, least: int = 3) -> DataFrame:
    """(into, switches, observed, null_mean, p): the mean value where the label switches, against as many rows drawn without replacement. ``into`` is null for
    all switches together; a label that is switched into fewer than ``least`` times isn't tested. series: some hundreds of rows."""
    own = switches(series, label, order)
    whole = own.agg(F.lit(None).cast("int").alias("into"), F.count("*").alias("switches"), F.avg(value).alias("observed"))
    per = own.groupBy(F.col("into").cast("int").alias("into")).agg(F.count("*").alias("switches"), F.avg(value).alias("observed")).filter(F.col("switches") >= least)
    tests = whole.filter("switches > 0").unionByName(per)
    means = replicated(series.select(order, value), order, n).join(F.broadcast(tests), F.col("rank") <= F.col("switches"))  # a test for each label at most
    null = means.groupBy("into", "switches", "observed", "rep").agg(F.avg(value).alias("null"))
    return null.groupBy("into", "switches", "observed").agg(F.avg("null").alias("null_mean"), two_sided(F.col("null"), F.col("observed")).alias("p"))


def half_difference(rows: DataFrame, by: list[str], label: str, place: str, half: int) -> DataFrame:
    """(by..., difference): Frobenius distance of the transition matrices of rows up to place ``half`` and of those after it."""
    w = Window.partitionBy(*by, "_late").orderBy(place)
    moves = rows.withColumn("_late", F.col(place) > half).withColumn("_next", F.lead(label).over(w)).filter("_next is not null")
    n = moves.groupBy(*by, "_late", F.col(label).alias("_src"), F.col("_next").alias("_dst")).agg(F.count("*").alias("_n"))
    sums = n.groupBy(*by, "_late", "_src").agg(F.sum("_n").alias("_t"))
    p = n.join(sums, [*by, "_late", "_src"]).withColumn("_p", F.col("_n") / F.col("_t") * F.when(F.col("_late"), -1).otherwise(1))
    return p.groupBy(*by, "_src", "_dst").agg(F.sum("_p").alias("_d")).groupBy(*by).agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("difference"))


def difference_test(series: DataFrame, label: str, order: str, n: int = 5000) -> DataFrame:
    """(observed, null_mean, null_sd, p): how far the transition matrices of a series' halves are apart, against its labels in random order."""
    half = series.count() // 2
    placed = series.select(order, label, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)).alias("rank")).withColumn("rep", F.lit(-1).cast("bigint"))
    observed = half_difference(placed, ["rep"], label, "rank", half).select(F.col("difference").alias("observed"))
    null = half_difference(replicated(series.select(order, label), order, n), ["rep"], label, "rank", half)
    return null.crossJoin(F.broadcast(observed)).groupBy("observed").agg(
        F.avg("difference").alias("null_mean"), F.stddev_pop("difference").alias("null_sd"), F.avg((F.round("difference", 9) >= F.round("observed", 9)).cast("double")).alias("p")
    )


def mean_step(rows: DataFrame, by: list[str], values: list[str], place: str) -> DataFrame:
    """(by..., step): mean length of the steps from row to row."""
    w = Window.partitionBy(*by).orderBy(place)
    moves = [F.col(v) - F.lag(v).over(w) for v in values]
    length = F.sqrt(sum((m * m for m in moves[1:]), moves[0] * moves[0]))
    return rows.withColumn("_l", length).groupBy(*by).agg(F.avg("_l").alias("step"))


def reversal_test(series: DataFrame, values: list[str], order: str, n: int = 500) -> DataFrame:
    """(observed, null_mean, p): the series' mean step against that of its rows in random order."""
    own = mean_step(series.withColumn("rep", F.lit(-1).cast("bigint")), ["rep"], values, order).select(F.col("step").alias("observed"))
    null = mean_step(replicated(series.select(order, *values), order, n), ["rep"], values, "rank")
    return null.crossJoin(F.broadcast(own)).groupBy("observed").agg(F.avg("step").alias("null_mean"), F.avg((F.round("step", 9) >= F.round("observed", 9)).cast("double")).alias("p"))


def drawn(rows: DataFrame, place: str, size: Column, n: int, salt: str = "") -> DataFrame:
    """(rep, draw, place): of each replicate and each row one draw, with replacement, of a place from 0 to ``size``: the first eight hexadecimal digits of
    md5(rep:row:salt), modulo size. rows: (place, ...) of some hundreds."""
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    digits = F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col(place).cast("string"), F.lit(salt)).cast("binary")), 1, 8)
    return reps.withColumn("draw", F.conv(digits, 16, 10).cast("bigint") % size)


def transition_intervals(moves: DataFrame, by: str, src: str, dst: str, place: str, n: int = 5000) -> DataFrame:
    """(by, src, dst, n, p, lo, hi): of each part's transitions their share and a 95 % interval over ``n`` resamples of its moves. moves: a row for each
    move, numbered from 0 in its part by ``place``."""
    sizes = moves.groupBy(by).agg(F.count("*").alias("_size"))
    d = drawn(moves.join(sizes, by).select(by, place, "_size"), place, F.col("_size"), n)
    got = d.select(by, "rep", F.col("draw").alias(place)).join(F.broadcast(moves.select(by, place, src, dst)), [by, place])  # some hundreds of moves
    c = got.groupBy(by, "rep", src, dst).agg(F.count("*").alias("_c"))
    t = c.groupBy(by, "rep", src).agg(F.sum("_c").alias("_t"))
    own = moves.groupBy(by, src, dst).agg(F.count("*").alias("n"))
    whole = own.groupBy(by, src).agg(F.sum("n").alias("_n"))
    p = own.join(whole, [by, src]).select(by, src, dst, "n", (F.col("n") / F.col("_n")).alias("p"))
    grid = p.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    each = grid.join(c.join(t, [by, "rep", src]), [by, "rep", src, dst], "left").withColumn("_p", F.coalesce(F.col("_c") / F.col("_t"), F.lit(0.0)))
    return each.groupBy(by, src, dst, "n", "p").agg(F.percentile("_p", 0.025).alias("lo"), F.percentile("_p", 0.975).alias("hi"))


#: Values of x stay between these; rows that a task takes together, and rows of a draw that are sorted together.
LEAST, MOST, BLOCK, RANGE = 0.03, 0.92, 1 << 16, 1 << 20
_PIECE = "k int, bucket int, first bigint, n bigint, rows bigint, known bigint, same bigint, sa double, sp double, r binary, a binary"
_NAMES = [f.split()[0] for f in _PIECE.split(", ")]


def _r0(y: np.ndarray) -> np.ndarray:
    return -0.999 * np.log(np.maximum(1e-12, 1 - y / 0.999)) / y


def _noise(key: np.ndarray, k: int) -> np.ndarray:
    """Standard normal noise of draw k, from MD5 of draw and key."""
    head = np.char.add(f"{k}:".encode(), key)
    u = [(md5_head(np.char.add(head, s)) + 0.5) / 4294967296.0 for s in (b":a", b":b")]
    return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])


def rank_robustness(df: DataFrame, draws: int, noise: float) -> DataFrame:
    """(k, r, same) of rows (p_partkey, r0, x): of each draw the rank correlation of r0 with R0 after noise in x, ties by p_partkey, and the share of rows that stay on their side of 1.

    Ranks by r0 are the same in all draws and made once. What r0 becomes is dealt to ranges of its values that are sorted apart, RANGE rows of a draw at
    most (the noise spreads each x); rows at either bound are equal, so their order is that of p_partkey and they are summed where they are."""
    n = df.count()
    ranked = placed(df.withColumn("_all", F.lit(0)), "_all", ["r0", "p_partkey"]).select("p_partkey", "r0", "x", (F.col("i") - (n - 1) / 2).alias("a"))
    # no stretch of y has a larger share of the rows than the density of the noise at its middle allows
    ranges = max(1, -(-int((MOST - LEAST) / (noise * 2.5) * n) // RANGE))
    edges = _r0(np.linspace(LEAST, MOST, ranges + 1))
    low, high = edges[0], edges[-1]
    cores = df.sparkSession.sparkContext.defaultParallelism
    dealt = ranked.repartitionByRange(max(1, min(n, max(2 * cores, -(-n // BLOCK)))), "p_partkey").sortWithinPartitions("p_partkey")

    def summed(k, bucket, first, side, a, r=None):
        """A piece's row: the sum of the ranks, and that of the products of rank and place where the order is known already."""
        blobs = [None, None] if r is None else [r.tobytes(), a.tobytes()]
        return [k, bucket, first, len(a), *side, float(a.sum()), 0.0 if r is not None else float((a * np.arange(len(a))).sum()), *blobs]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r0, x, a = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3))
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            key = np.array([str(p).encode() for p in b.column(0).to_pylist()])
            x[b.column(0).is_null().to_numpy(zero_copy_only=False)] = np.nan
            first = b.column(0)[0].as_py() if b.column(0)[0].is_valid else -(2**63)
            rows = []
            for k in range(draws):
                y = x + noise * _noise(key, k)
                r = _r0(np.where(np.isnan(y), LEAST, np.clip(y, LEAST, MOST)))  # no x: the lower bound, as greatest() leaves nulls out
                same = int((((r0 > 1) == (r > 1)) & known).sum())
                rows.append(summed(k, 0, first, (len(r), int(known.sum()), same), a[r <= low]))
                rows.append(summed(k, ranges + 1, first, (0, 0, 0), a[r >= high]))
                own = np.flatnonzero((r > low) & (r < high))
                own = own[np.argsort(r[own], kind="stable")]
                cut = np.searchsorted(r[own], edges[1:-1])
                for j, at in enumerate(np.split(own, cut)):
                    if len(at):
                        rows.append(summed(k, j + 1, first, (0, 0, 0), a[at], r[at]))
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 256]), _TYPES, strict=True)], names=_NAMES)

    def merged(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("first")
        n, sa, sp = (piece[c].to_numpy() for c in ("n", "sa", "sp"))
        if piece["r"].null_count:  # equal values: one piece follows the other
            total = float((sp + sa * (np.cumsum(n) - n)).sum())
        else:
            r, a = (np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in piece[c]]) for c in ("r", "a"))
            total = float((a[np.argsort(r, kind="stable")] * np.arange(len(a))).sum())
        sums = [int(piece[c].to_numpy().sum()) for c in ("n", "rows", "known", "same")]
        return pa.table([pa.array([v]) for v in (piece["k"][0].as_py(), piece["bucket"][0].as_py(), *sums, float(sa.sum()), total)], names=["k", "bucket", "n", "rows", "known", "same", "sa", "sp"]).cast(_MERGED)

    each = dealt.mapInArrow(drawn, _PIECE).groupBy("k", "bucket").applyInArrow(merged, "k int, bucket int, n bigint, rows bigint, known bigint, same bigint, sa double, sp double")
    before = F.sum("n").over(Window.partitionBy("k").orderBy("bucket")) - F.col("n")  # a row for each draw and range
    count = F.sum("rows").cast("double")
    out = each.withColumn("_p", F.col("sp") + F.col("sa") * before).groupBy("k")
    return out.agg(F.when(count > 1, 12 * F.sum("_p") / (count * (count * count - 1))).alias("r"), F.when(F.sum("known") > 0, F.sum("same") / F.sum("known")).alias("same"))


_TYPES = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.float64(), pa.float64(), pa.binary(), pa.binary()]
_MERGED = pa.schema([("k", pa.int32()), ("bucket", pa.int32()), *((c, pa.int64()) for c in ("n", "rows", "known", "same")), ("sa", pa.float64()), ("sp", pa.float64())])
