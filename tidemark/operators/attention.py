"""Monthly attention: structure, shares, life cycles, stages, anomalies, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import entropy_term


def structure(att: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Per ``by``: total, active count, HHI and entropy (ln) of the positive values' shares; one active alone: 1 and 0."""
    pos = att.filter(F.col(value) > 0)
    share = F.col(value) / F.sum(value).over(Window.partitionBy(by))
    made = pos.withColumn("_s", share).groupBy(by).agg(
        F.sum(value).alias("total"), F.count("*").alias("active"), F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.sum(entropy_term(F.col("_s"))).alias("entropy")
    )
    return att.select(by).distinct().join(made, by, "left").na.fill(0, ["total", "active", "hhi", "entropy"])


def weighted_mean(x: Column, w: Column) -> Column:
    """sum(w x) / sum(w), 0 without weight."""
    return F.when(F.sum(w) > 0, F.sum(x * w) / F.sum(w)).otherwise(F.lit(0.0))


def shares(att: DataFrame, by: str, category: str, categories: list, value: str = "value") -> DataFrame:
    """(by, category, share) for every category; uniform where a month has nothing mapped."""
    wide = att.groupBy(by).pivot(category, categories).agg(F.sum(value)).na.fill(0.0)
    names = [str(c) for c in categories]
    total = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
    pairs = F.array(*(F.struct(F.lit(c).alias(category), F.when(total > 0, F.col(f"`{n}`") / total).otherwise(F.lit(1 / len(names))).alias("share")) for c, n in zip(categories, names, strict=True)))
    return wide.select(by, F.inline(pairs))


def life_cycle(att: DataFrame, key: str, order: str, value: str = "value") -> DataFrame:
    """Per key: peak and its first place, first and last place at a tenth of it, area under the curve, resurgence.

    Resurgence: after the peak the curve falls below a tenth of it and later exceeds three tenths.
    """
    peak = Window.partitionBy(key)
    w = peak.orderBy(order)
    df = att.withColumn("i", F.row_number().over(w) - 1).withColumn("peak", F.max(value).over(peak))
    df = df.withColumn("peak_i", F.min(F.when(F.col(value) == F.col("peak"), F.col("i"))).over(peak))
    low = F.when((F.col("i") > F.col("peak_i")) & (F.col(value) < 0.1 * F.col("peak")), F.col("i"))
    df = df.withColumn("fell", F.min(low).over(peak)).withColumn("trap", (F.col(value) + F.lag(value).over(w)) / 2)
    active = F.col(value) >= F.greatest(F.lit(0.5), 0.1 * F.col("peak"))
    return df.groupBy(key).agg(
        F.max("peak").alias("peak"), F.min(F.when(F.col("i") == F.col("peak_i"), F.col(order))).alias("peak_at"), F.count("*").alias("n"),
        F.min(F.when(active, F.col("i"))).alias("first_i"), F.max(F.when(active, F.col("i"))).alias("last_i"), F.coalesce(F.sum("trap"), F.lit(0.0)).alias("area"),
        F.coalesce(F.max((F.col("i") > F.col("fell")) & (F.col(value) > 0.3 * F.col("peak"))), F.lit(False)).alias("resurgence"),
    )


def stage_intervals(att: DataFrame, key: str, order: str, value: str = "value") -> DataFrame:
    """(key, pos, stage, lo, hi): five stages around the peak over a key's own rows; rows are counted, not months.

    Active means at least a tenth of the peak and 2; keys with fewer than three active rows have no stages.
    Stages may overlap; ``pos`` says which comes first.
    """
    part = Window.partitionBy(key)
    df = att.withColumn("i", (F.row_number().over(part.orderBy(order)) - 1).cast("int")).withColumn("peak", F.max(value).over(part))
    df = df.withColumn("ip", F.min(F.when(F.col(value) == F.col("peak"), F.col("i"))).over(part))
    late = (F.col("i") >= F.col("ip") + 3) & (F.col("i") <= F.col("ip") + 5) & (F.col(value) < 0.3 * F.col("peak"))
    k = df.groupBy(key).agg(
        F.max("ip").alias("ip"), (F.count("*") - 1).cast("int").alias("last"), F.min(F.when(late, F.col("i"))).alias("dip"),
        F.count_if(F.col(value) >= F.greatest(0.1 * F.col("peak"), F.lit(2.0))).alias("active"),
    ).filter("active >= 3")
    k = k.withColumn("span", F.least(F.lit(4), F.col("ip"))).withColumn("c", F.coalesce("dip", F.col("ip") + 5))
    rows = F.array(
        *(
            F.struct(F.lit(p).alias("pos"), F.lit(name).alias("stage"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
            for p, (name, lo, hi) in enumerate(
                (
                    ("origin", F.lit(0), F.greatest(F.lit(0), F.col("ip") - F.col("span") - 1)),
                    ("emergence", F.col("ip") - F.col("span"), F.col("ip") - 1),
                    ("peak", F.col("ip") - 2, F.col("ip") + 2),
                    ("controversy", F.col("ip") + 3, F.col("c")),
                    ("fixation", F.col("c") + 1, F.col("last")),
                )
            )
        )
    )
    clipped = k.select(key, "last", F.inline(rows)).select(key, "pos", "stage", F.greatest("lo", F.lit(0)).alias("lo"), F.least("hi", "last").alias("hi"))
    return clipped.filter("lo <= hi")


def stage_of(att: DataFrame, stages: DataFrame, key: str, order: str) -> DataFrame:
    """Interval join: the first stage (by pos) that holds each row. Intervals are laid out row by row and joined by equality."""
    rows = att.withColumn("i", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("int"))
    laid = stages.select(key, "pos", "stage", F.explode(F.sequence("lo", "hi")).alias("i")).groupBy(key, "i").agg(F.min(F.struct("pos", "stage")).alias("s"))
    return rows.join(laid, [key, "i"], "left").withColumn("stage", F.col("s.stage")).drop("s")


def anomalies(att: DataFrame, key: str, order: str, value: str = "value", recent: int = 3, least: int = 12, z: float = 2.0) -> DataFrame:
    """(key, recent, mean, sd, z) of keys whose last rows lie more than z population sd above the earlier ones."""
    w = Window.partitionBy(key)
    df = att.withColumn("k", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("n", F.count("*").over(w)).filter(F.col("n") >= least)
    old = F.when(F.col("k") > recent, F.col(value))
    got = df.groupBy(key).agg(F.avg(F.when(F.col("k") <= recent, F.col(value))).alias("recent"), F.avg(old).alias("mean"), F.stddev_pop(old).alias("sd"))
    return got.filter("sd > 0").withColumn("z", (F.col("recent") - F.col("mean")) / F.col("sd")).filter(F.col("z") > z)


def curve_shape(att: DataFrame, key: str, order: str, value: str = "value") -> DataFrame:
    """(key, shape): persistent, pulse, rebound, fading or long tail, by ordered rules."""
    w = Window.partitionBy(key)
    df = att.withColumn("i", F.row_number().over(w.orderBy(order))).withColumn("n", F.count("*").over(w)).withColumn("peak", F.max(value).over(w))
    df = df.withColumn("ip", F.min(F.when(F.col(value) == F.col("peak"), F.col("i"))).over(w))
    got = df.groupBy(key).agg(
        F.max("peak").alias("peak"), F.max("n").alias("n"), F.avg(F.when(F.col("i") > F.col("n") - 12, F.col(value))).alias("recent12"),
        F.count_if(F.col(value) > 0.15 * F.col("peak")).alias("active"), F.coalesce(F.max(F.when(F.col("i") > F.col("ip"), F.col(value))), F.lit(0.0)).alias("after"),
    )
    shape = (
        F.when((F.col("recent12") > 0.4 * F.col("peak")) & (F.col("n") > 24), "persistent")
        .when((F.col("peak") > 50) & (F.col("active") < 6), "pulse")
        .when(F.col("after") > 0.3 * F.col("peak"), "rebound")
        .when(F.col("recent12") < 0.15 * F.col("peak"), "fading")
        .otherwise("long tail")
    )
    return got.select(key, "peak", "recent12", "active", shape.alias("shape"))


def stitched(parts: DataFrame, window: str, day: str, value: str, least: int = 5) -> DataFrame:
    """Overlapping windows put on one scale: (day, value).

    Each window is scaled by the ratio of overlap means with the one before (1 where fewer than ``least``
    common days or no level); factors multiply along the windows, and the earliest window gives a day's value.
    """
    prev = parts.select((F.col(window) + 1).alias(window), day, F.col(value).alias("_before"))
    overlap = parts.join(prev, [window, day]).groupBy(window).agg(F.count("*").alias("c"), F.avg("_before").alias("a"), F.avg(value).alias("b"))
    ratio = F.when((F.col("c") >= least) & (F.col("b") > 1e-9) & (F.col("a") > 0), F.col("a") / F.col("b")).otherwise(F.lit(1.0))
    chain = parts.select(window).distinct().join(overlap.select(window, ratio.alias("r")), window, "left").na.fill(1.0, ["r"])
    w = Window.partitionBy(F.lit(0)).orderBy(window).rowsBetween(Window.unboundedPreceding, 0)  # windows are few
    factors = chain.select(window, F.exp(F.sum(F.ln("r")).over(w)).alias("f"))
    scaled = parts.join(factors, window).select(day, window, (F.col(value) * F.col("f")).alias(value))
    return scaled.groupBy(day).agg(F.min_by(value, window).alias(value))


def topic_report(att: DataFrame, key: str, order: str, category: str, value: str = "value") -> DataFrame:
    """(key, category, peak_month, recent, before, direction, n_peers): a topic rises if it has more than six rows and the last three sum to more than the three
    before, else it falls; recent and before are those sums. n_peers: other keys of the category."""
    w = Window.partitionBy(key)
    df = att.withColumn("_k", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("_top", F.first(order).over(w.orderBy(F.desc(value), order)))
    total = lambda lo, hi: F.sum(F.when(F.col("_k").between(lo, hi), F.col(value)))
    t = df.groupBy(key).agg(F.max(category).alias(category), F.max("_top").alias("peak_month"), F.count("*").alias("_n"), total(1, 3).alias("recent"), total(4, 6).alias("before"))
    t = t.withColumn("direction", F.when((F.col("_n") > 6) & (F.col("recent") > F.col("before")), "rising").otherwise("falling")).drop("_n")
    return t.join(t.groupBy(category).agg((F.count("*") - 1).alias("n_peers")), category)


def side_by_side(reports: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Two topics' reports in one row."""
    a, b = (reports.filter(F.col(key) == name).select(*(F.col(c).alias(f"{side}_{c}") for c in reports.columns)) for name, side in ((first, "a"), (second, "b")))
    return a.join(b).select(
        F.col(f"a_{key}").alias("first"), F.col(f"b_{key}").alias("second"), F.col("a_peak_month").alias("first_peak"), F.col("b_peak_month").alias("second_peak"),
        (F.col("a_recent") / F.col("b_recent")).alias("ratio"), (F.col("a_category") == F.col("b_category")).alias("peers"),
    )
