"""Scalar rules and closed forms of the domain, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.columns import clip, entropy_term, has_any, let, sigmoid


def total_infected(circles: Column, peak: Column, months: Column) -> Column:
    """Share ever reached, from circles, peak intensity and duration in months: into [.03, .92]."""
    c, d = clip((circles - 1) / 6, 0.0, 1.0), clip(months / 48, 0.0, 1.0)
    return 0.03 + 0.89 / (1 + F.exp(-6 * (0.5 * c + 0.3 * clip(peak, 0.0, 1.0) + 0.2 * d - 0.5)))


def gamma_of(days: Column) -> Column:
    return 2 / F.greatest(days, F.lit(1.0))


def r0_of(x: Column, s0: float = 0.999) -> Column:
    """Basic reproduction number from the final size x, guarded at both ends."""
    return F.when(x >= 0.99, 10.0).when(x <= 0.001, 0.1).otherwise(-s0 * F.ln(F.greatest(F.lit(1e-12), 1 - x / s0)) / x)


def sir_entropy(s: Column, i: Column, r: Column) -> Column:
    return entropy_term(s) + entropy_term(i) + entropy_term(r)


def meme_type(r0: Column, days: Column, peak: Column) -> tuple[Column, Column]:
    """(type, confidence) by ordered rules."""
    kind = (
        F.when(r0 < 0.8, "abortive").when((days < 30) & (peak > 0.3), "pulse").when(days > 90, "long-tail").when(r0 > 1, "outbreak").otherwise("abortive")
    )
    sure = (
        F.when(r0 < 0.8, 0.9).when((days < 30) & (peak > 0.3), F.least(F.lit(0.9), (r0 - 1) / 3 + 0.5)).when(days > 90, 0.7)
        .when(r0 > 1, F.least(F.lit(0.9), (r0 - 1) / 2 + 0.5)).otherwise(0.6)
    )
    return kind, sure


def sentiment_entropy(values: Column, bins: int = 5) -> Column:
    """Entropy over equal bins of [0, 1], the right edge closed, over ln(bins)."""
    n = F.size(values)
    slot = lambda x: F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")
    placed = F.transform(values, slot)
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(placed, lambda s: s == b)) / n)
    import math

    return F.when(n > 0, F.aggregate(F.transform(shares, entropy_term), F.lit(0.0), lambda a, x: a + x) / math.log(bins)).otherwise(F.lit(0.0))


def sentiment_arc(values: Column) -> Column:
    """Shape of an intensity array: halves' means, the middle value and the steps' signs decide, in this order."""
    n = F.size(values)
    some = lambda lo, m: F.slice(values, lo, m)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    half = F.floor(n / 2).cast("int")
    # nine digits: sums of tenths differ in the last bits, and the bounds are sharp
    nine = lambda x: F.round(x, 9)
    first, second = mean(some(F.lit(1), half)), mean(some(half + 1, n - half))
    middle = F.when(n >= 3, F.try_element_at(values, half + 1)).otherwise(F.try_element_at(values, F.lit(1)))
    steps = F.zip_with(some(F.lit(2), F.greatest(n - 1, F.lit(0))), some(F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: nine(a - b))
    m = F.greatest(n - 2, F.lit(0))

    def named(first: Column, second: Column, steps: Column) -> Column:
        signs = F.transform(steps, lambda d: F.signum(d))
        turns = F.aggregate(F.zip_with(F.slice(signs, F.lit(2), m), F.slice(signs, F.lit(1), m), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2
        rise, bulge = nine(second - first), nine(middle - (first + second) / 2)
        return (
            F.when(turns >= 2, "oscillating").when((F.abs(rise) < 0.03) & (F.abs(bulge) < 0.03), "stable")
            .when(F.forall(steps, lambda d: d >= -0.01), "monotonic_up").when(F.forall(steps, lambda d: d <= 0.01), "monotonic_down")
            .when(bulge > 0.05, F.when(rise < 0, "inverted_U").otherwise("rise_fall")).when(bulge < -0.05, F.when(rise > 0, "U_shape").otherwise("fall_rise"))
            .when(rise < 0, "rise_fall").otherwise("fall_rise")
        )

    return F.when(n < 2, "stable").otherwise(let(first, lambda a: let(second, lambda b: let(steps, lambda d: named(a, b, d)))))


#: Base deltas of the five constraint axes (identity, humour, conflict, novelty, access) for phase moves.
PHASE_DELTA = {
    ("origin", "emergence"): (0.1, 0.0, 0.05, 0.15, 0.1),
    ("emergence", "peak"): (0.2, 0.1, 0.1, -0.05, 0.2),
    ("peak", "controversy"): (-0.15, -0.1, 0.3, -0.1, -0.2),
    ("controversy", "fixation"): (0.05, 0.1, -0.2, -0.1, 0.05),
    ("peak", "fixation"): (0.1, 0.05, -0.1, -0.1, 0.1),
    ("emergence", "fixation"): (0.05, 0.0, -0.05, -0.1, 0.0),
}
#: Economic stress, polarisation and censorship: where they are neutral, where they stand by default, and what they add to each axis.
SOCIAL = {"economic": (0.5, 0.5, (0.1, 0.0, 0.15, 0.0, -0.1)), "polarization": (0.5, 0.5, (0.05, 0.0, 0.2, 0.0, 0.0)), "censorship": (0.3, 0.2, (0.0, 0.0, -0.15, 0.0, 0.1))}
#: Beyond these ends a move further out counts .3; no delta passes .4.
ENDS, DAMPED, LARGEST_DELTA = (0.2, 0.8), 0.3, 0.4


def phase_delta(constraint: Column, src: Column, dst: Column, **social: Column) -> Column:
    """What a phase move adds to the constraint axes: the move's base (unknown moves have none) and the social terms, damped near the ends, bounded.

    social: economic, polarization, censorship; those not given stand at their default.
    """
    table = F.create_map(*(x for (a, b), d in PHASE_DELTA.items() for x in (F.lit(f"{a}>{b}"), F.array(*map(F.lit, d)))))
    base = F.coalesce(F.try_element_at(table, F.concat_ws(">", src, dst)), F.array(*(F.lit(0.0) for _ in range(5))))
    terms = [sum((w[i] * (social.get(k, F.lit(default)) - neutral) for k, (neutral, default, w) in SOCIAL.items()), F.lit(0.0)) for i in range(5)]
    outward = lambda c, d: ((c > ENDS[1]) & (d > 0)) | ((c < ENDS[0]) & (d < 0))
    # nine digits: a base that its social terms cancel is no move
    whole = F.transform(F.zip_with(base, F.array(*terms), lambda a, b: a + b), lambda d: F.round(d, 9))
    return F.zip_with(constraint, whole, lambda c, d: clip(F.when(outward(c, d), d * DAMPED).otherwise(d), -LARGEST_DELTA, LARGEST_DELTA))


def moved(constraint: Column, src: Column, dst: Column, **social: Column) -> Column:
    """Constraint after a phase move, in [0, 1]."""
    return F.zip_with(constraint, phase_delta(constraint, src, dst, **social), lambda c, d: clip(c + d, 0.0, 1.0))


#: What concepts weigh on each constraint axis.
CONSTRAINT_WEIGHTS = {
    "identity": {
        "identity_belonging": 0.4, "youth_dominant": 0.15, "white_collar": 0.1, "student": 0.1, "official_release": -0.2, "grassroots": 0.2, "hope": 0.15,
        "mainstream_media": 0.1, "KOL_amplification": 0.15,
    },
    "humor": {"humor_laugh": 0.5, "irony": 0.3, "parody": 0.25, "remix": 0.15, "anger": -0.2, "nihilism": -0.1, "semantic_drift": 0.1, "cross_platform": 0.1},
    "conflict": {
        "class_conflict": 0.35, "gender_conflict": 0.3, "political_conflict": 0.3, "generation_conflict": 0.25, "value_conflict": 0.25, "anger": 0.2, "backlash": 0.2,
        "algorithm_push": -0.1, "identity_belonging": -0.15,
    },
    "novelty": {
        "parody": 0.3, "remix": 0.3, "semantic_drift": 0.25, "irony": 0.2, "accident_trigger": 0.2, "grassroots": 0.2, "official_release": -0.15, "cross_platform": 0.15,
        "KOL_amplification": 0.1,
    },
    "access": {
        "humor_laugh": 0.3, "remix": 0.25, "youth_dominant": 0.2, "algorithm_push": 0.25, "cross_platform": 0.2, "brand_hijack": 0.15, "political_conflict": -0.3,
        "class_conflict": -0.1, "elite": -0.15,
    },
}


def constraint_of(scores: Column, weights: dict[str, dict[str, float]]) -> Column:
    """Axis values from concept scores (a map): clip(.5 + .4 * sum(w s) / sum(|w|), .1, .9)."""
    axes = []
    for w in weights.values():
        total = sum(abs(x) for x in w.values())
        s = sum((F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) * v for k, v in w.items()), F.lit(0.0))
        axes.append(clip(0.5 + 0.4 * s / total, 0.1, 0.9))
    return F.array(*axes)


def squashed(scores: Column, weights: dict[str, dict[str, float]] = CONSTRAINT_WEIGHTS) -> Column:
    """The other mapping: .5 and the weighted sum, cut to [0, 1], through a logistic curve of slope 6 about .5, into [.05, .95]."""
    axes = []
    for w in weights.values():
        s = sum((F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) * v for k, v in w.items()), F.lit(0.0))
        axes.append(0.05 + 0.9 * sigmoid(6.0 * (clip(s + 0.5, 0.0, 1.0) - 0.5)))
    return F.array(*axes)


def group_means(scores: Column, groups: dict[str, list[str]]) -> Column:
    """Mean concept score of each group, three digits."""
    return F.array(*(F.round(sum((F.coalesce(F.try_element_at(scores, F.lit(n)), F.lit(0.0)) for n in names), F.lit(0.0)) / len(names), 3) for names in groups.values()))


def active_concepts(scores: Column, above: float = 0.3) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda _, v: v > above)))


def parsed_scores(text: Column, least: int = 20) -> Column:
    """A map of scores from a reply: fenced or plain JSON, else name-number pairs if there are ``least`` of them."""
    body = F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*(.*?)```.*$", "$1")
    plain = F.from_json(body, "map<string,double>")
    names = F.regexp_extract_all(text, F.lit(r"\"?([A-Za-z_]+)\"?\s*[:=]\s*([0-9]*\.?[0-9]+)"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"\"?([A-Za-z_]+)\"?\s*[:=]\s*([0-9]*\.?[0-9]+)"), F.lit(2))
    pairs = F.when(F.size(F.array_distinct(names)) >= least, F.map_from_entries(F.array_distinct(F.arrays_zip(F.array_distinct(names), F.slice(F.transform(values, lambda v: v.cast("double")), F.lit(1), F.size(F.array_distinct(names)))))))
    return F.when(F.size(plain) > 0, plain).otherwise(pairs)


def diagnosis(inertia: Column, resilience: Column, sensitivity: Column) -> Column:
    return F.when((inertia > 0.6) & (resilience < 0.3) & (sensitivity > 0.4), "metastable").when((inertia > 0.5) & (resilience < 0.5), "rigid").otherwise("balanced")


def risks(inertia: Column, sensitivity: Column, regime: Column | None = None, dwell: Column | None = None) -> Column:
    """Warnings: inertia over .65, sensitivity over .60, and more than 24 months in a row in regime 2; ``none`` without any."""
    long = F.when((regime == 2) & (dwell > 24), F.concat(F.lit("dwell of "), dwell.cast("string"), F.lit(" months"))) if regime is not None and dwell is not None else F.lit(None).cast("string")
    notes = F.array_compact(F.array(F.when(inertia > 0.65, "high inertia"), F.when(sensitivity > 0.60, "high sensitivity"), long))
    return F.when(F.size(notes) > 0, F.array_join(notes, "; ")).otherwise("none")


def out_of_domain(inertia: Column, resilience: Column, sensitivity: Column) -> Column:
    """Two of three extremes."""
    return (inertia > 0.85).cast("int") + (resilience < 0.15).cast("int") + (sensitivity > 0.70).cast("int") >= 2


#: Collective states by R0 (above) and the chaos axis (from, to; none: open), in order of precedence, and the moves between them.
STATES = (
    ("constructive_irony", 1.5, -0.4, 0.1),
    ("aggressive_venting", 1.5, None, -0.4),
    ("nihilistic_retreat", 1.0, None, -0.5),
    ("identity_construction", 1.0, 0.2, None),
    ("neutral_entertainment", None, -0.2, 0.2),
)
MOVES = (
    ("constructive_irony", "aggressive_venting"),
    ("aggressive_venting", "nihilistic_retreat"),
    ("nihilistic_retreat", "constructive_irony"),
    ("identity_construction", "constructive_irony"),
)


def collective_state(r0: Column, chaos: Column) -> Column:
    """The first state whose conditions hold: closed where the range has two ends, open where it has one; none else."""
    tests = []
    for name, above, lo, hi in STATES:
        closed = lo is not None and hi is not None
        ok = r0 > above if above is not None else F.lit(True)
        if lo is not None:
            ok = ok & (chaos >= lo if closed else chaos > lo)
        if hi is not None:
            ok = ok & (chaos <= hi if closed else chaos < hi)
        tests.append(F.when(ok, name))
    return F.coalesce(*tests)


def state_moves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MOVES), "src string, dst string")


def inertia(origin: Column, emergence: Column, fixation: Column, corr: Column) -> Column:
    stage = clip(fixation / (F.greatest(origin + emergence, F.lit(0.01)) + fixation + 0.05), 0.0, 1.0)
    return 0.4 * stage + 0.3 * F.greatest(F.lit(0.0), corr) + 0.3 * fixation


def three_way(x: Column, high: float, mid: float, names: tuple[str, str, str] = ("high", "medium", "low")) -> Column:
    return F.when(x > high, names[0]).when(x > mid, names[1]).otherwise(names[2])


#: The mark of a mutation phase, and the words that tell institutions' use.
MUTATION_MARKERS = ["变异"]
INSTITUTION_WORDS = [
    "人民日报", "新华社", "央视", "CCTV", "光明日报", "中国青年报",
    "环球时报", "官方", "国务院", "教育部", "广电", "网信办",
    "政府", "两会", "人大代表", "政协委员", "政法委", "最高法",
    "新闻联播", "焦点访谈", "中央", "国家", "部委", "党委",
    "中国新闻周刊", "澎湃新闻", "新京报", "南方周末",
]


def institutional(*texts: Column) -> Column:
    """Whether one of the texts (triggers, backlash, political sensitivity, summary, hint) names an institution; no text names none."""
    return F.coalesce(has_any(F.concat_ws(" ", *texts), INSTITUTION_WORDS), F.lit(False))


def institutional_month(*texts: Column) -> Column:
    """January of the first year (four digits and 年) that stands from 50 characters before to 100 after an institution's first mention, by the words' order."""
    whole = F.concat_ws(" ", *texts)

    def near(word: str) -> Column:
        at = F.locate(word, whole)
        window = F.substring(whole, F.greatest(at - 50, F.lit(1)), F.least(at - 1, F.lit(50)) + 100)
        return F.when(at > 0, F.nullif(F.regexp_extract(window, r"([0-9]{4})\s*年", 1), F.lit("")))

    return F.concat(F.coalesce(*map(near, INSTITUTION_WORDS)), F.lit("-01"))


def year_months(text: Column) -> Column:
    """Date text to months (yyyy-MM), the most specific form first.

    Forms: A-B ranges (with 至, to or ~), half years, year-month, year and month in words, a bare year.
    """
    ym = r"((?:19|20)[0-9]{2})[-/.年]([0-9]{1,2})"
    a, am, b, bm = (F.regexp_extract(text, rf"{ym}月?\s*(?:至|到|to|~)\s*{ym}", i) for i in (1, 2, 3, 4))
    y, half = F.regexp_extract(text, r"((?:19|20)[0-9]{2})年?\s*(上半年|下半年|H1|H2)", 1), F.regexp_extract(text, r"((?:19|20)[0-9]{2})年?\s*(上半年|下半年|H1|H2)", 2)
    sy, sm = F.regexp_extract(text, ym, 1), F.regexp_extract(text, ym, 2)
    bare = F.regexp_extract(text, r"((?:19|20)[0-9]{2})", 1)

    def span(year_a: Column, month_a: Column, year_b: Column, month_b: Column) -> Column:
        lo = F.make_date(year_a.try_cast("int"), month_a.try_cast("int"), F.lit(1))
        hi = F.make_date(year_b.try_cast("int"), month_b.try_cast("int"), F.lit(1))
        days = F.when(lo <= hi, F.sequence(lo, hi, F.expr("interval 1 month"))).otherwise(F.array(lo))
        return F.transform(days, lambda d: F.date_format(d, "yyyy-MM"))

    first = half.isin("上半年", "H1")
    return (
        F.when(a != "", span(a, am, b, bm))
        .when(y != "", F.when(first, span(y, F.lit("1"), y, F.lit("6"))).otherwise(span(y, F.lit("7"), y, F.lit("12"))))
        .when(sy != "", span(sy, sm, sy, sm))
        .when(bare != "", span(bare, F.lit("1"), bare, F.lit("12")))
        .otherwise(F.array().cast("array<string>"))
    )


def months_between(a: Column, b: Column) -> Column:
    """Inclusive months of two yyyy-MM texts."""
    days = F.sequence(F.to_date(a, "yyyy-MM"), F.to_date(b, "yyyy-MM"), F.expr("interval 1 month"))
    return F.transform(days, lambda d: F.date_format(d, "yyyy-MM"))


#: Words of what sets a narrative off, by the level that they tell; the first level that has one counts, else the default.
SOCIAL_WORDS = {
    "economic": ((0.8, ["失业", "就业", "房价", "经济", "收入", "生存"]), (0.6, ["消费", "压力", "焦虑", "内卷"])),
    "polarization": ((0.8, ["争议", "批判", "对立", "骂战", "反弹"]), (0.6, ["阶层", "差异", "不同群体"])),
    "censorship": ((0.5, ["审查", "敏感", "官方", "政策", "收编"]),),
}


def social_context(text: Column) -> Column:
    """(economic, polarization, censorship) levels by words; the defaults where the text has none of them or is null."""
    level = lambda k: F.coalesce(*(F.when(has_any(text, words), F.lit(x)) for x, words in SOCIAL_WORDS[k]), F.lit(SOCIAL[k][1])).alias(k)
    return F.struct(*map(level, SOCIAL_WORDS))


#: Tags of particles; the classes that a tag's first letter tells.
PARTICLES = ("p", "uj", "ul", "uv", "ud", "ug", "uz")
TAG_CLASSES = {"n": "nominal", "v": "verbal", "a": "adjectival", "d": "adverbial"}


def coarse_tag(tag: Column) -> Column:
    """Part-of-speech tag to a coarse class."""
    by_letter = [F.when(tag.startswith(k), v) for k, v in TAG_CLASSES.items()]
    return F.coalesce(*by_letter, F.when(tag == "c", "connective"), F.when(tag.isin(*PARTICLES), "particle"), F.when(tag.startswith("m"), "numeral"), F.lit("other"))


def overall_verdict(split: Column, modulated: Column, drift: Column) -> tuple[Column, Column]:
    """(number of significant tests, verdict): two or more proceed, one is a weak signal."""
    n = split.cast("int") + modulated.cast("int") + drift.cast("int")
    return n, F.when(n >= 2, "PROCEED_TO_PHASE_2").when(n == 1, "WEAK_SIGNAL").otherwise("NO_EVIDENCE")
