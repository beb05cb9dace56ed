"""Ordered-sequence operators: islands, transitions, rolling moments, lead-lag, spines, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import entropy_term


def over(order: str, by: list[str] | None = None):
    """Window of a series; the series of one key is small once aggregated to months (see README)."""
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)


def islands(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``run``: the number of the stretch of equal values a row is in."""
    w = over(order, by)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")


def episodes(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """A row for each run: its value, first and last place, length. The run at the end counts as ended."""
    keys = [*(by or []), "run", value]
    return islands(df, value, order, by).groupBy(*keys).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))


def transitions(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """(src, dst, n, p): first-order transition counts and row probabilities."""
    pairs = df.select(F.col(value).alias("src"), F.lead(value).over(over(order, by)).alias("dst")).filter("dst is not null")
    counts = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def on_grid(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """A transition table on the full grid of labels (label); pairs never seen have 0."""
    a, b = labels.select(F.col("label").alias("src")), labels.select(F.col("label").alias("dst"))
    return a.join(b).join(counts, ["src", "dst"], "left").na.fill(0, ["n", "p"])  # labels are a handful


def switch_stats(df: DataFrame, value: str, order: str) -> DataFrame:
    """Switches, their rate, entropy over targets and normalised, share of the commonest label."""
    w = over(order)
    seq = df.withColumn("prev", F.lag(value).over(w))
    total = df.agg(F.count("*").alias("n_rows"), F.countDistinct(value).alias("k"))
    dominant = df.groupBy(value).agg(F.count("*").alias("c")).agg(F.max("c").alias("top"))
    targets = seq.filter(F.col("prev") != F.col(value)).groupBy(value).agg(F.count("*").alias("c"))
    t = targets.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_switches"), F.coalesce(F.sum(F.col("c") * F.ln("c")), F.lit(0.0)).alias("s"))
    entropy = F.when(F.col("n_switches") > 0, F.ln("n_switches") - F.col("s") / F.col("n_switches")).otherwise(F.lit(0.0))
    return total.join(dominant).join(t).select(
        "n_rows", "n_switches", (F.col("n_switches") / F.greatest(F.col("n_rows") - 1, F.lit(1))).alias("switch_rate"),
        entropy.alias("switch_entropy"), F.when(F.col("k") > 1, entropy / F.ln("k")).otherwise(F.lit(0.0)).alias("normalised"),
        (F.col("top") / F.col("n_rows")).alias("dominant_share"),
    )


def current_dwell(df: DataFrame, value: str, order: str) -> DataFrame:
    """Adds ``dwell``: how long the run that a row is in has lasted at that row."""
    return islands(df, value, order).withColumn("dwell", F.row_number().over(Window.partitionBy("run").orderBy(order))).drop("run")


def before_after(df: DataFrame, value: str, order: str, n: int = 6) -> DataFrame:
    """Adds ``shift``: mean of the n rows from here on minus that of the n before; null without n on both sides."""
    w = over(order)
    after, before = w.rowsBetween(0, n - 1), w.rowsBetween(-n, -1)
    whole = (F.count(value).over(after) == n) & (F.count(value).over(before) == n)
    return df.withColumn("shift", F.when(whole, F.avg(value).over(after) - F.avg(value).over(before)))


def refractory(df: DataFrame, flag: Column, place: str, gap: int = 6) -> DataFrame:
    """The flagged places taken in order, each more than ``gap`` after the last one taken."""
    listed = df.filter(flag).agg(F.sort_array(F.collect_list(place)).alias("at"))
    taken = F.aggregate(
        "at",
        F.expr("cast(array() as array<int>)"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > gap), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return listed.select(F.explode(taken).alias(place))


def rolling_ar1(df: DataFrame, value: str, order: str, n: int = 36) -> DataFrame:
    """Adds ``ar1`` and ``var`` of the n rows from each row on (full windows only): sum s_t s_(t-1) / (sum s^2 + 1e-12)."""
    w = over(order)
    frame = w.rowsBetween(0, n - 1)
    m, c = F.avg(value).over(frame), F.count(value).over(frame)
    nxt = F.lead(value).over(w)
    df = df.withColumn("_p", F.col(value) * nxt)
    # sum over the window's n-1 adjacent pairs of (a - m)(b - m), from sums
    short = w.rowsBetween(0, n - 2)
    head, tail = F.sum(value).over(short), F.sum(value).over(w.rowsBetween(1, n - 1))
    cross = F.sum("_p").over(short) - m * (head + tail) + (n - 1) * m * m
    square = F.sum(F.col(value) * F.col(value)).over(frame) - n * m * m
    return df.select("*", F.when(c == n, cross / (square + 1e-12)).alias("ar1"), F.when(c == n, square / n).alias("var")).drop("_p")


def lead_lag(df: DataFrame, a: str, b: str, order: str, most: int = 12) -> DataFrame:
    """(lag, n, r): correlation of a at t with b at t + lag. The series is small; each row meets 2 * most + 1 others."""
    left = df.select(F.col(order).alias("t"), F.col(a).alias("a"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    right = df.select(F.col(order).alias("u"), F.col(b).alias("b"))
    return left.join(right, left["t"] + left["lag"] == right["u"]).groupBy("lag").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))


def carried_forward(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Last observation carried forward."""
    w = over(order, by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def month_spine(df: DataFrame, month: str = "month") -> DataFrame:
    """Every calendar month (yyyy-MM text) from the first to the last of df."""
    edge = df.agg(F.min(F.to_date(month, "yyyy-MM")).alias("a"), F.max(F.to_date(month, "yyyy-MM")).alias("b"))
    return edge.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias(month))


def asof_previous(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """As-of join: each row of left with the last ``value`` of right at or before its time, by key.

    One union and one window, so both sides are shuffled once and no pairs are made.
    """
    a = left.select(key, time, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"))
    b = right.select(key, time, F.col(value).alias("_v"), F.lit(0).alias("_left"), F.lit(None).alias("_row"))
    w = Window.partitionBy(key).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_at", F.last("_v", ignorenulls=True).over(w))
    return both.filter("_left = 1").select("_row.*", F.col("_at").alias(value))


def previous_day(df: DataFrame, day: str, value: str) -> DataFrame:
    """Adds ``previous``: the value of the day before, null where that day is missing (an equi-join, not a lag)."""
    prev = df.select(F.date_add(day, 1).alias(day), F.col(value).alias("previous"))
    return df.join(prev, day, "left")


def takens(df: DataFrame, value: str, order: str, dim: int = 3, delay: int = 2, by: list[str] | None = None) -> DataFrame:
    """Delay vectors [x_i, x_(i + delay), ...]."""
    w = over(order, by)
    parts = [F.lead(value, k * delay).over(w) for k in range(dim)]
    return df.withColumn("embedded", F.array(*parts)).filter(F.element_at("embedded", dim).isNotNull())


def category_entropy(df: DataFrame, by: str, category: str, weight: str) -> DataFrame:
    """Entropy of weight shares over categories within each ``by``."""
    sums = df.groupBy(by, category).agg(F.sum(weight).alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy(by))
    return sums.select(by, entropy_term(share).alias("e")).groupBy(by).agg(F.sum("e").alias("entropy"))


def at_places(df: DataFrame, order: str, places: list[int]) -> DataFrame:
    """The rows of a series at the given places."""
    return df.filter(F.col(order).isin(*places))


def ranged(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with ``_part``: rows dealt by ranges of (by, order), so that a key with most of the rows spans many parts. A table of its own: the parts stay
    as they are. order must tell a key's rows apart."""
    import uuid

    from tidemark.sources.tables import working_dir

    spark = df.sparkSession
    at = f"{working_dir(spark)}/ranged-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(at)
    return spark.read.schema(dealt.schema).parquet(at)


def placed(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with each row's place among its key's rows (``i``, from 0) and their number (``n``), counted part by part."""
    r = ranged(df, by, order)
    sizes = r.groupBy(by, "_part").agg(F.count("*").alias("_c"))  # a row for each key and part
    w = Window.partitionBy(by).orderBy("_part")
    before = sizes.select(by, "_part", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(by)).alias("n"))
    own = F.row_number().over(Window.partitionBy("_part", by).orderBy(*order)) - 1
    return r.withColumn("_own", own).join(before, [by, "_part"]).withColumn("i", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def following(df: DataFrame, by: str, order: list[str], column: str, name: str = "next") -> DataFrame:
    """df with the ``column`` of the key's next row: inside a part by a window, at its end the first row of the key's next part."""
    r = ranged(df, by, order)
    w = Window.partitionBy("_part", by).orderBy(*order)
    firsts = r.groupBy(by, "_part").agg(F.min_by(column, F.struct(*order)).alias("_first"))  # a row for each key and part
    carried = firsts.select(by, "_part", F.lead("_first").over(Window.partitionBy(by).orderBy("_part")).alias("_carried"))
    inside = r.withColumn("_inside", F.lead(F.struct(F.col(column).alias("v"))).over(w))
    return inside.join(carried, [by, "_part"]).withColumn(name, F.when(F.col("_inside").isNotNull(), F.col("_inside.v")).otherwise(F.col("_carried"))).drop("_part", "_inside", "_carried")


def first_of_each(df: DataFrame, by: list[str], order: list, most: int, buckets: int = 256) -> DataFrame:
    """The first ``most`` rows of each key, with ``rank`` from 1: first those of buckets of its rows, so that no task sorts all of a key's. order must tell rows apart."""
    own = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    few = own.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))).filter(F.col("rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most).drop("_b")


def numbered(df: DataFrame, by: list[str], order: str, name: str = "rank", width: int = 4096) -> DataFrame:
    """The rows with their number within the key, from 1, by ``order`` (whole numbers that tell a key's rows apart): numbers within stretches of ``width``
    values of it, behind the counts of the stretches before. No task sorts all of a key's rows."""
    own = df.withColumn("_s", F.floor(F.col(order) / width))
    counts = own.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_s")) - F.col("_n")).drop("_n")
    # a value for each row is there on both sides: nulls of the key meet
    meets = F.lit(True)
    right = before.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_s"])), "_before")
    for i, c in enumerate([*by, "_s"]):
        meets = meets & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy(*by, "_s").orderBy(order))
    return own.withColumn("_i", place).join(right, meets).withColumn(name, F.col("_i") + F.col("_before")).drop("_s", "_i", "_before", *(f"_k{i}" for i in range(len(by) + 1)))
