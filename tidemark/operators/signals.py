"""Signals and headlines: deduplication, bursts, platform flow, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.columns import clip
from tidemark.operators.windows import following, placed


def best_rank(df: DataFrame, by: list[str], rank: str = "rank", tie: str = "event_id") -> DataFrame:
    """One row for each key: the best rank, the earliest id on a tie."""
    w = Window.partitionBy(*by).orderBy(rank, tie)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def summary(df: DataFrame, by: str) -> DataFrame:
    """Count, best rank and counts by platform (as a map) of each key."""
    per = df.groupBy(by, "platform").agg(F.count("*").alias("n"), F.min("rank").alias("best"))
    return per.groupBy(by).agg(F.sum("n").alias("n"), F.min("best").alias("best"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", "n")))).alias("platforms"))


def platform_sequences(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds the next platform in each key's events, in time order; no task holds a key's whole history."""
    return following(df, by, order, "platform")


def platform_transitions(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(src, dst, n, p): platform moves, each row's share rounded to three digits."""
    n = platform_sequences(df, by, order).filter("next is not null").groupBy(F.col("platform").alias("src"), F.col("next").alias("dst")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 3))


def flow_patterns(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Per key with two events or more: entry platform, distinct platforms of either half, those new in the second, expanding or not."""
    seq = placed(df, by, order).filter("n >= 2")
    first = F.col("i") < F.floor(F.col("n") / 2)
    halves = seq.groupBy(by).agg(
        F.min_by("platform", "i").alias("entry"), F.sort_array(F.collect_set(F.when(first, F.col("platform")))).alias("early"),
        F.sort_array(F.collect_set(F.when(~first, F.col("platform")))).alias("late"),
    )
    return halves.select(by, "entry", "early", "late", F.sort_array(F.array_except("late", "early")).alias("new"), (F.size("late") > F.size("early")).alias("expanding"))


def daily_metrics(df: DataFrame, topic: str) -> DataFrame:
    """(day, topics, turnover, entropy, novelty, signals, score) of each day with events.

    Turnover is one minus the shared share of the last and this day's topic sets; novelty the share of topics not
    seen the day before; entropy that of the scores by topic over ln(k + 1), .5 where there is none.
    """
    per = df.groupBy("day", topic).agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    total = F.sum("s").over(Window.partitionBy("day"))
    p = F.col("s") / total
    day = per.withColumn("e", F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).groupBy("day").agg(
        F.collect_set(topic).alias("topics"), F.sum("e").alias("h"), F.count("*").alias("k"), F.sum("n").alias("signals")
    )
    prev = day.select(F.date_add("day", 1).alias("day"), F.col("topics").alias("before"))
    j = day.join(prev, "day", "left")
    shared = F.size(F.array_intersect("topics", "before"))
    turnover = F.when(F.col("before").isNull(), 1.0).otherwise(1 - shared / F.greatest(F.size(F.array_union("topics", "before")), F.lit(1)))
    novelty = F.when(F.col("before").isNull(), 1.0).otherwise(1 - shared / F.size("topics"))
    entropy = F.when(F.col("k") > 0, F.col("h") / F.ln(F.col("k") + 1)).otherwise(0.5)
    m = j.select("day", F.col("k").alias("topics"), turnover.alias("turnover"), entropy.alias("entropy"), novelty.alias("novelty"), "signals")
    score = 0.3 * F.col("turnover") + 0.25 * (1 - F.col("entropy")) + 0.25 * F.col("novelty") + 0.2 * F.least(F.col("signals") / 10, F.lit(1.0))
    return m.withColumn("score", clip(score, 0.0, 1.0))


def micro_correction(metrics: DataFrame) -> DataFrame:
    """(mean3, rising, factor) from the last three days' scores."""
    last = metrics.orderBy(F.desc("day")).limit(3)
    m = last.agg(F.avg("score").alias("mean3"), (F.max_by("score", "day") > F.min_by("score", "day")).alias("rising"))
    factor = (
        F.when((F.col("mean3") > 0.5) & F.col("rising"), 1 + 0.3 * F.col("mean3"))
        .when(F.col("mean3") > 0.4, 1 + 0.15 * F.col("mean3"))
        .when(F.col("mean3") < 0.2, 0.85)
        .otherwise(1.0)
    )
    return m.withColumn("factor", factor)


def candidates(titles: DataFrame, known: list[str], noise: list[str], least: int = 2, most: int = 30) -> DataFrame:
    """(title, n, platforms, score): repeated titles that may be new memes.

    titles: (scrape, platform, title, score). Of a scrape's equal titles one counts. Out go titles that hold a
    known name or a noise word, those of under 4 or over 30 characters, and those with digits under 10.
    """
    distinct = titles.groupBy("scrape", "title").agg(F.max("score").alias("score"), F.collect_set("platform").alias("p"))
    bad = F.lit(False)
    for word in [*known, *noise]:
        bad = bad | F.contains("title", F.lit(word))
    n = F.length("title")
    ok = distinct.filter(~bad & n.between(4, 30) & ~(F.col("title").rlike("[0-9]") & (n < 10)))
    top = ok.groupBy("title").agg(F.count("*").alias("n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("p")))).alias("platforms"), F.avg("score").alias("score"))
    return top.orderBy(F.desc("n"), "title").limit(most).filter(F.col("n") >= least)


def discovered(items: DataFrame, known: DataFrame, title: str, patterns: list[str]) -> DataFrame:
    """New names: 2 to 12 characters, no digits, not plain Latin, not known, at least one pattern."""
    hits = sum((F.col(title).rlike(p).cast("int") for p in patterns[1:]), F.col(title).rlike(patterns[0]).cast("int"))
    ok = F.length(title).between(2, 12) & ~F.col(title).rlike("[0-9]") & ~F.col(title).rlike(r"^[A-Za-z\s]+$") & (hits >= 1)
    return items.filter(ok).join(known, title, "left_anti")


def sessions(df: DataFrame, by: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """(by, start, end, n): runs of events closer than the gap."""
    w = F.session_window(time, gap)
    return df.groupBy(by, w).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def binned(df: DataFrame, by: str, at: str, value: str, width: float, bins: int) -> DataFrame:
    """(by, bin, level, smooth): fixed-width bins, zero where empty, and the centred mean of three."""
    grid = df.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = df.groupBy(by, F.floor(F.col(at) / width).cast("int").alias("bin")).agg(F.sum(value).alias("level"))
    w = Window.partitionBy(by).orderBy("bin").rowsBetween(-1, 1)
    g = grid.join(filled, [by, "bin"], "left").na.fill(0, ["level"])
    return g.withColumn("smooth", F.avg("level").over(w))


def emphasised(df: DataFrame, by: str, before: float = 0.0, weight: float = 0.3) -> DataFrame:
    """One exponential step of each key's live level: weight of 4 / best rank."""
    return df.groupBy(by).agg(F.min("rank").alias("best"), F.countDistinct("platform").alias("platforms")).withColumn(
        "level", (1 - weight) * F.lit(before) + weight * 4 / F.greatest(F.col("best"), F.lit(1))
    )
