"""Catalogue operators: regions, boundaries and basins of points, look-ups, series alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def regions(points: DataFrame, by: str, axes: list[str], key: str) -> DataFrame:
    """(by, n, centre of each axis, radius of each, members): centroid and 1.5 population sd."""
    parts = [f for a in axes for f in (F.avg(a).alias(f"{a}_centre"), (1.5 * F.stddev_pop(a)).alias(f"{a}_radius"))]
    return points.groupBy(by).agg(F.count("*").alias("n"), *parts, F.sort_array(F.collect_list(key)).alias("members"))


def boundaries(points: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """(axis, cut, below, above): counts on either side of each threshold, in one pass."""
    counts = [c for a, v in cuts.items() for c in (F.count_if(F.col(a) < v).alias(f"{a}_b"), F.count_if(F.col(a) >= v).alias(f"{a}_a"))]
    rows = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(float(v)).alias("cut"), F.col(f"{a}_b").alias("below"), F.col(f"{a}_a").alias("above")) for a, v in cuts.items()))
    return points.agg(*counts).select(F.inline(rows))


def basins(points: DataFrame, value: str, edges: list[float], names: list[str]) -> DataFrame:
    """(basin, n, low, high) over half-open intervals, so each point is in exactly one."""
    basin = F.lit(names[-1])
    for e, n in reversed(list(zip(edges, names, strict=False))):
        basin = F.when(F.col(value) < e, n).otherwise(basin)
    return points.groupBy(basin.alias("basin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def steady_runs(df: DataFrame, value: str, order: str, most: float = 0.05) -> DataFrame:
    """(run, n, mean, first, last): stretches over which neighbours differ by less than ``most``."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    r = df.withColumn("_new", F.when(step < most, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return r.groupBy("run").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(order).alias("first"), F.max(order).alias("last"))


def regime_members(df: DataFrame, label: str, order: str, axes: list[str]) -> DataFrame:
    """(label, n, top axis, closest, farthest): mean vector's largest axis, members nearest to and farthest from the centroid."""
    m = df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m_{a}") for a in axes))
    top = F.greatest(*(F.struct(F.col(f"m_{a}").alias("v"), F.lit(-i).alias("k"), F.lit(a).alias("name")) for i, a in enumerate(axes)))["name"]
    d = F.sqrt(sum(((F.col(a) - F.col(f"m_{a}")) * (F.col(a) - F.col(f"m_{a}")) for a in axes[1:]), (F.col(axes[0]) - F.col(f"m_{axes[0]}")) ** 2))
    j = df.join(m.withColumn("top", top), label).withColumn("d", d)
    return j.groupBy(label).agg(F.max("n").alias("n"), F.max("top").alias("top"), F.min(F.struct("d", order))[order].alias("closest"), F.max(F.struct("d", order))[order].alias("farthest"))


def look_up(name: str, *tables: DataFrame) -> DataFrame:
    """The first of several tables (name, aliases array, record) that knows the name or has it as an alias."""
    out = None
    for k, t in enumerate(tables):
        hit = t.filter((F.col("name") == name) | F.array_contains("aliases", name)).select(F.lit(k).alias("source"), "name", "record")
        out = hit if out is None else out.unionByName(hit)
    return out.orderBy("source", "name").limit(1)


def peers(catalogue: DataFrame, name: str, most: int = 5) -> DataFrame:
    """Entries of the same category, in the catalogue's order."""
    own = catalogue.filter(F.col("name") == name).select("category").limit(1)
    return catalogue.join(own, "category", "left_semi").filter(F.col("name") != name).orderBy("pos").limit(most)


def overlapping_windows(start: Column, end: Column, width: int = 250, step: int = 150) -> Column:
    """Array of (from, to) date windows, each ``width`` days, begun every ``step``; the last ends at the end."""
    begins = F.sequence(start, end, F.make_interval(days=F.lit(step)))
    return F.transform(begins, lambda d: F.struct(d.alias("from"), F.least(F.date_add(d, width), end).alias("to")))


def anchored(daily: DataFrame, monthly: DataFrame, key: str, day: str, value: str, anchor: str) -> DataFrame:
    """Each month's days scaled so that their mean is the month's anchor; unscaled where the month has no level."""
    d = daily.withColumn("month", F.date_format(day, "yyyy-MM"))
    m = d.groupBy(key, "month").agg(F.avg(value).alias("_m"))
    f = m.join(monthly.select(key, "month", anchor), [key, "month"], "left").select(key, "month", F.when(F.col("_m") > 0, F.col(anchor) / F.col("_m")).alias("_f"))
    return d.join(f, [key, "month"]).withColumn(value, F.col(value) * F.coalesce("_f", F.lit(1.0))).drop("_f")


def reliability(daily: DataFrame, monthly: DataFrame, key: str, day: str, value: str, anchor: str, least: int = 6, good: float = 0.8) -> DataFrame:
    """(key, n, r, reliable): correlation of monthly means with the anchor over ``least`` common months or more."""
    m = daily.groupBy(key, F.date_format(day, "yyyy-MM").alias("month")).agg(F.avg(value).alias("_m"))
    j = m.join(monthly.select(key, "month", anchor), [key, "month"]).groupBy(key).agg(F.count("*").alias("n"), F.corr("_m", anchor).alias("r"))
    return j.filter(F.col("n") >= least).withColumn("reliable", F.col("r") >= good)


def lookback(df: DataFrame, columns: list[str], order: str, n: int = 6, by: list[str] | None = None) -> DataFrame:
    """Rows with the n rows before them as columns c_1 .. c_n; only rows that have all of them."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    out = df.select("*", *(F.lag(c, k).over(w).alias(f"{c}_{k}") for c in columns for k in range(1, n + 1)))
    return out.filter(F.col(f"{columns[0]}_{n}").isNotNull())


def tag_distribution(tags: DataFrame, tag: str) -> DataFrame:
    """(class, n, share, entropy) of part-of-speech tags put into coarse classes."""
    from tidemark.functions.columns import entropy_term
    from tidemark.functions.rules import coarse_tag

    n = tags.groupBy(coarse_tag(F.col(tag)).alias("class")).agg(F.count("*").alias("n"))
    share = n.join(n.agg(F.sum("n").alias("t"))).withColumn("share", F.col("n") / F.col("t"))
    return share.join(share.agg(F.sum(entropy_term(F.col("share"))).alias("entropy"))).select("class", "n", "share", "entropy")


def interest(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, month, value): monthly means; keys that are all zero are left out."""
    m = df.groupBy(key, F.date_format(time, "yyyy-MM").alias("month")).agg(F.avg(value).alias(value))
    return m.join(m.groupBy(key).agg(F.max(value).alias("_top")).filter("_top > 0").select(key), key, "left_semi")


def ranked_by(trajectories: DataFrame, metric: str) -> DataFrame:
    """Entries by a metric of their second node (the first where there is one alone), largest first, then by name."""
    node = F.coalesce(F.get("nodes", F.lit(1)), F.get("nodes", F.lit(0)))
    return trajectories.withColumn("metric", node[metric]).orderBy(F.desc("metric"), "name")


def trajectory_nodes(narratives: DataFrame, phases: dict[str, str]) -> DataFrame:
    """(name, nodes): one node for each phase under its mapped name; fixation closes every trajectory.

    narratives: (name, spread_phases array of struct(phase, intensity)). A phase without a mapping counts as
    emergence; an entry without phases gets origin and fixation.
    """
    table = F.create_map(*(F.lit(x) for kv in phases.items() for x in kv))
    node = lambda phase, intensity: F.struct(phase.alias("phase"), intensity.cast("double").alias("intensity"))
    made = F.transform("spread_phases", lambda p: node(F.coalesce(F.try_element_at(table, p["phase"]), F.lit("emergence")), p["intensity"]))
    made = F.when(F.size("spread_phases") > 0, made).otherwise(F.array(node(F.lit("origin"), F.lit(0.1))))
    ends = F.element_at(made, -1)["phase"] == "fixation"
    return narratives.select("name", F.when(ends, made).otherwise(F.concat(made, F.array(node(F.lit("fixation"), F.lit(0.1))))).alias("nodes"))


def mutation_months(narratives: DataFrame, markers: list[str], after: int = 6) -> DataFrame:
    """(name, month): months of mutation events and the ``after`` following, and of phases whose name has a marker.

    narratives: (name, mutations array of struct(month), phases array of struct(phase, month)), months as yyyy-MM.
    """
    from tidemark.functions.columns import has_any

    events = narratives.select("name", F.explode("mutations.month").alias("m")).select("name", F.explode(F.sequence(F.lit(0), F.lit(after))).alias("k"), "m")
    spread = events.select("name", F.date_format(F.add_months(F.to_date("m", "yyyy-MM"), F.col("k")), "yyyy-MM").alias("month"))
    marked = narratives.select("name", F.inline("phases")).filter(has_any(F.col("phase"), markers)).select("name", "month")
    return spread.unionByName(marked).filter("month is not null").distinct()


def lifecycle_shares(curves: DataFrame, key: str, time: str, value: str, threshold: float = 0.1) -> DataFrame:
    """(key, emergence, growth, decay, equilibrium): hundredths of a curve's time, one digit.

    Emergence lasts until the curve first has ``threshold`` of its peak (0 where it has so at no time before the peak), growth from there to the
    peak (the first of equal ones), decay until it is back at that share or less (the end where it never is). time counts from 0; a curve that ends at 0
    has null shares.
    """
    c = curves.select(key, F.col(time).alias("_t"), F.col(value).alias("_v"))
    top = c.groupBy(key).agg(F.max("_v").alias("_top"), F.min_by("_t", F.struct(-F.col("_v"), F.col("_t"))).alias("_peak"), F.max("_t").alias("_end"))
    before, after = (F.col("_t") < F.col("_peak")) & (F.col("_v") >= threshold * F.col("_top")), (F.col("_t") >= F.col("_peak")) & (F.col("_v") <= threshold * F.col("_top"))
    ends = c.join(top, key).groupBy(key, "_peak", "_end").agg(F.min(F.when(before, F.col("_t"))).alias("_lit"), F.min(F.when(after, F.col("_t"))).alias("_back"))
    lit, back, peak, end = F.coalesce(F.col("_lit"), F.lit(0)), F.coalesce(F.col("_back"), F.col("_end")), F.col("_peak"), F.col("_end")
    share = lambda x, name: F.round(x / F.nullif(end, F.lit(0)) * 100, 1).alias(name)
    return ends.select(key, share(lit, "emergence"), share(peak - lit, "growth"), share(back - peak, "decay"), share(end - back, "equilibrium"))


def name_of_folder(folder: Column) -> Column:
    """A meme's name out of a folder's: what stands between ``1.`` and ``(Av``, else the title without what is in its brackets, 30 characters."""
    numbered = F.regexp_extract(folder, r"1\.(.+?)\(Av", 1)
    title = F.substring(F.trim(F.regexp_replace(F.split(folder, " - ")[0], "【.*?】", "")), 1, 30)
    return F.when(numbered != "", F.trim(numbered)).otherwise(title)


def rank_weighted(signals: DataFrame, by: str, score: Column) -> DataFrame:
    """(by, n, level): mean score with weights 1 / max(rank, 1): the current state where no month is complete."""
    w = 1 / F.greatest(F.col("rank"), F.lit(1))
    return signals.groupBy(by).agg(F.count("*").alias("n"), (F.sum(score * w) / F.sum(w)).alias("level"))


def priority(stored: Column, soft: Column, default: Column, least_sd: float = 0.03) -> Column:
    """A constraint by precedence: stored scores, soft scores that vary enough, the category's default (arrays of numbers)."""
    n = F.size(soft)
    mean = F.aggregate(soft, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(soft, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.coalesce(stored, F.when((n > 0) & (F.sqrt(var) > least_sd), soft), default)


def duration_months(stored: Column) -> Column:
    """A curated duration: three months where there is none, eighteen for an endless one (999 or more)."""
    return F.when(stored >= 999, 18.0).otherwise(F.coalesce(stored, F.lit(3.0)))


def described(df: DataFrame, label: str, human: str, axes: list[str]) -> DataFrame:
    """(label, n, mean of each axis, dominant): clusters with the outside label that most of their members have, the first on a tie."""
    c = df.groupBy(label, human).agg(F.count("*").alias("_c"))
    top = c.groupBy(label).agg(F.min_by(human, F.struct(-F.col("_c"), F.col(human))).alias("dominant"))
    return df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in axes)).join(top, label)
