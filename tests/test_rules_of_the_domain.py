"""Rules whose results are fixed from outside: expected values are worked out by hand from the rules' statement, not from this library's SQL."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calibration as B, rules as R
from tidemark.operators import attention as A, curation as K, validation as V

PHASES = ("origin", "emergence", "peak", "controversy", "fixation")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def delta(spark, c, src, dst, **social):
    return value(spark, R.phase_delta(array(*c), F.lit(src), F.lit(dst), **{k: F.lit(v) for k, v in social.items()}))


def test_phase_moves(spark):
    tense = {"economic": 0.7, "polarization": 0.6, "censorship": 0.3}
    c = (0.5, 0.5, 0.3, 0.5, 0.5)
    up = delta(spark, c, "peak", "controversy", **tense)
    assert up == pytest.approx([-0.125, -0.1, 0.35, -0.1, -0.22]) and up[2] > 0  # conflict rises
    assert delta(spark, c, "controversy", "fixation", **tense)[2] < 0  # and falls
    assert delta(spark, (0.9, 0.5, 0.1, 0.5, 0.85), "origin", "emergence") == pytest.approx([0.03, 0, 0.065, 0.15, 0.027])
    assert delta(spark, c, "fixation", "peak") == pytest.approx([0, 0, 0.015, 0, -0.01])  # no base, the social terms alone
    assert delta(spark, c, "peak", "controversy", economic=1.0, polarization=1.0, censorship=0.0)[2] == pytest.approx(0.4)  # bounded
    assert delta(spark, (0.1, 0.5, 0.5, 0.5, 0.1), "peak", "controversy")[0] == pytest.approx(-0.045)
    assert value(spark, R.moved(array(0.95, 0.05, 0.5, 0.5, 0.5), F.lit("emergence"), F.lit("peak")))[:2] == pytest.approx([1.0, 0.15])
    assert set(R.PHASE_DELTA) == {
        ("origin", "emergence"), ("emergence", "peak"), ("peak", "controversy"), ("controversy", "fixation"), ("peak", "fixation"), ("emergence", "fixation"),
    }


def test_institutions(spark):
    say = lambda *t: (value(spark, R.institutional(*map(F.lit, t))), value(spark, R.institutional_month(*map(F.lit, t))))
    assert len(R.INSTITUTION_WORDS) == 28
    assert say("CCTV 转发") == (True, None)
    assert say("official government brand 品牌 政策") == (False, None)
    assert say("2021 年 5 月", "人民日报评论") == (True, "2021-01")
    assert say("起" * 60 + "央视" + "长" * 98 + "2019年") == (True, None)  # the window ends 100 characters after the word's start
    assert say("起" * 60 + "央视" + "长" * 90 + "2019年") == (True, "2019-01")
    assert say("2018年" + "长" * 44 + "央视") == (True, None) or say("2018年" + "长" * 44 + "央视")[1] == "2018-01"
    assert say("2018年" + "长" * 60 + "央视")[1] is None
    # the first word in the list's order that has a year near it, not the first in the text
    assert say("官方 2015年 " + "长" * 200 + " 新华社 2020年")[1] == "2020-01"
    assert say("新华社" + "长" * 200 + "官方 2015年")[1] == "2015-01"
    assert value(spark, R.institutional(F.lit(None).cast("string"))) is False


def test_mutation_months(spark):
    n = spark.createDataFrame(
        [("a", [("2020-11",)], [("变异期", "2019-01"), ("二创 remix mutation", "2018-01")])], "name string, mutations array<struct<month:string>>, phases array<struct<phase:string,month:string>>"
    )
    got = sorted(r["month"] for r in K.mutation_months(n, R.MUTATION_MARKERS).collect())
    assert got == ["2019-01", "2020-11", "2020-12", "2021-01", "2021-02", "2021-03", "2021-04", "2021-05"]


def test_constraints_by_the_logistic_curve(spark):
    scores = lambda **k: F.create_map(*(x for n, v in k.items() for x in (F.lit(n), F.lit(v))))
    curve = lambda total: 0.05 + 0.9 / (1 + math.exp(-6 * (min(max(total + 0.5, 0), 1) - 0.5)))
    assert value(spark, R.squashed(scores(none=1.0))) == pytest.approx([0.5] * 5)
    got = value(spark, R.squashed(scores(humor_laugh=1.0, anger=0.5)))
    assert got == pytest.approx([0.5, curve(0.4), curve(0.1), 0.5, curve(0.3)])
    assert value(spark, R.squashed(scores(class_conflict=1.0, gender_conflict=1.0, political_conflict=1.0)))[2] == pytest.approx(0.05 + 0.9 / (1 + math.exp(-3)))


@pytest.mark.parametrize(
    "values, arc",
    [
        ([], "stable"), ([0.7], "stable"), ([0.1, 0.2, 0.3], "monotonic_up"), ([0.3, 0.2, 0.1], "monotonic_down"), ([0.1, 0.9, 0.1, 0.9], "oscillating"), ([0.5, 0.51, 0.5], "stable"),
        ([0.9, 0.95, 0.3], "inverted_U"), ([0.1, 0.9, 0.2], "rise_fall"), ([0.3, 0.1, 0.9], "U_shape"), ([0.9, 0.2, 0.3], "fall_rise"), ([0.5, 0.5], "stable"), ([0.2, 0.6], "monotonic_up"),
    ],
)
def test_sentiment_arcs(spark, values, arc):
    assert value(spark, R.sentiment_arc(array(*values) if values else F.array().cast("array<double>"))) == arc


def test_lifecycle_shares(spark):
    curves = {"a": [0, 0.05, 0.2, 1, 0.6, 0.3, 0.09, 0.02, 0, 0, 0], "b": [1.0, 0.5, 0.2, 0.2, 0.2], "c": [0.0, 0.0, 0.05, 1.0], "d": [3.0]}
    rows = [(k, float(t), float(v)) for k, c in curves.items() for t, v in enumerate(c)]
    got = {r[0]: tuple(r)[1:] for r in K.lifecycle_shares(spark.createDataFrame(rows, "k string, t double, v double"), "k", "t", "v").collect()}
    assert got == {"a": (20.0, 10.0, 30.0, 40.0), "b": (0.0, 0.0, 100.0, 0.0), "c": (0.0, 100.0, 0.0, 0.0), "d": (None,) * 4}


def test_social_context(spark):
    say = lambda t: tuple(value(spark, R.social_context(F.lit(t).cast("string"))))
    assert say("失业潮 内卷") == (0.8, 0.5, 0.2) and say("消费 焦虑") == (0.6, 0.5, 0.2) and say("对立 阶层") == (0.5, 0.8, 0.2)
    assert say("不同群体 官方") == (0.5, 0.6, 0.5) and say("") == say(None) == (0.5, 0.5, 0.2)


def test_names_of_folders(spark):
    folders = {
        "【梗指南】打工人，打工魂，打工都是人上人！ - 1.打工人(Av123,P1)": "打工人", "【梗指南】打工人，打工魂": "打工人，打工魂", "a【x】b【y】 - 2.z": "ab", "t" * 40: "t" * 30, "【】": "", "x 1. y (Av": "y",
    }
    df = spark.createDataFrame([(f,) for f in folders], "f string")
    assert [r["n"] for r in df.select(K.name_of_folder(F.col("f")).alias("n")).collect()] == list(folders.values())


def test_risks(spark):
    say = lambda i, s, regime, dwell: value(spark, R.risks(F.lit(i), F.lit(s), F.lit(regime), F.lit(dwell)))
    assert say(0.7, 0.1, 0, 99) == "high inertia" and say(0.65, 0.60, 2, 24) == "none" and say(0.66, 0.61, 2, 25) == "high inertia; high sensitivity; dwell of 25 months"


def test_coarse_tags(spark):
    want = {"n": "nominal", "nr": "nominal", "v": "verbal", "a": "adjectival", "d": "adverbial", "c": "connective", "cc": "other", "p": "particle", "uj": "particle", "u": "other", "m": "numeral", "mq": "numeral", "r": "other", "x": "other"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", R.coarse_tag(F.col("t")).alias("c")).collect()} == want


def test_topics_rise_or_fall(spark):
    series = {"up": [1, 1, 1, 1, 2, 2, 2], "short": [1, 1, 1, 2, 2, 2], "level": [1] * 8, "down": [9, 9, 9, 9, 1, 1, 1]}
    rows = [(k, f"2020-{t + 1:02d}", 0, float(v)) for k, s in series.items() for t, v in enumerate(s)]
    got = {r["k"]: (r["direction"], r["recent"], r["before"]) for r in A.topic_report(spark.createDataFrame(rows, "k string, m string, c int, value double"), "k", "m", "c").collect()}
    assert got == {"up": ("rising", 6.0, 3.0), "short": ("falling", 6.0, 3.0), "level": ("falling", 3.0, 3.0), "down": ("falling", 3.0, 27.0)}


def problems(df, *columns):
    return sorted((r["k"], r["t"], r["problem"]) for r in df.collect())


def test_validators(spark):
    steps = [("jump", [0.5] * 5), ("jump", [0.9, 0.5, 0.5, 0.5, 0.5]), ("small", [0.5] * 5), ("small", [0.6, 0.5, 0.5, 0.5, 0.5]), ("pair", [0.1] * 5), ("pair", [0.3, 0.1, 0.3, 0.1, 0.1]), ("other", [0.1] * 5), ("other", [0.3, 0.3, 0.1, 0.1, 0.3]),
             ("all", [0.1] * 5), ("all", [0.4, 0.4, 0.1, 0.4, 0.1])]
    df = spark.createDataFrame([(k, i, c) for i, (k, c) in enumerate(steps)], "k string, t int, c array<double>")
    assert problems(V.step_violations(df, "k", "t", "c")) == [("all", 9, "norm"), ("jump", 1, "dimension"), ("pair", 5, "co-rise")]
    orders = {"back": ["fixation", "peak", "origin"], "good": ["origin", "emergence", "peak", "fixation"], "again": ["peak", "emergence"], "far": ["origin", "fixation"], "odd": ["origin", "boom", "peak"], "still": ["peak", "peak"]}
    df = spark.createDataFrame([(k, i, p) for k, ps in orders.items() for i, p in enumerate(ps)], "k string, t int, phase string")
    assert problems(V.phase_violations(df, "k", "t", "phase", PHASES)) == [
        ("again", 1, "warning"), ("back", 1, "violation"), ("back", 2, "violation"), ("far", 1, "warning"), ("odd", 1, "violation"), ("odd", 2, "violation"),
    ]
    nodes = {
        "low": [("origin", 0.1, 0.0), ("peak", 0.5, 0.0)], "good": [("origin", 0.1, 0.0), ("peak", 1.5, -0.3), ("fixation", 0.0, -0.5)], "leap": [("origin", 0.1, 0), ("peak", 3.0, 0), ("controversy", 1.2, 0.0)],
        "death": [("peak", 4.0, 0), ("fixation", 0.05, 0)], "alive": [("peak", 2.0, 0), ("fixation", 2.0, 0.05)], "basin": [("fixation", 1.9, 0.05)],
    }
    df = spark.createDataFrame([(k, i, p, float(r), float(c)) for k, ns in nodes.items() for i, (p, r, c) in enumerate(ns)], "k string, t int, phase string, r double, c double")
    assert problems(V.dynamics_violations(df, "k", "t", "r", "phase", "c")) == [("alive", 1, "still active"), ("leap", 2, "jump"), ("leap", 2, "no drift"), ("low", 1, "peak")]
    whole = df.withColumn("v", array(0.5, 0.5, 0.5, 0.5, 0.5))
    assert {r["k"] for r in V.trajectories_valid(whole, "k", "t", "v", "phase", "r", "c", PHASES).filter("valid").collect()} == {"good", "death", "alive", "basin"}


def test_scenarios(spark):
    x = value(spark, B.scenario(F.lit("order_builder")))
    votes = [(0.5, 3.0), (0.92, 1.5), (0.54, 1.0), (-0.15, 1.0), (0.4, 1.0)]
    raw = [sum(w * math.exp(-((v - c) ** 2) / (2 * 0.15**2)) for v, w in votes) for c in (-0.8, -0.4, 0.0, 0.4, 0.8)]
    p = [r / sum(raw) for r in raw]
    mean = sum(a * b for a, b in zip(p, (-0.8, -0.4, 0.0, 0.4, 0.8)))
    assert x["position"] == round(mean, 3) and x["role"] == "builder" and x["roles"] == [0.429, 0.571, 0.0, 0.0] and x["resilience"] == 0.83 and x["pattern"] == "early_adopter"
    assert x["posterior"] == [round(v, 4) if v > 0.01 else None for v in p] and x["susceptibility"] == round(0.5 + 0.3 * mean, 3)
    roles = {s: value(spark, B.scenario(F.lit(s)))["role"] for s in B.SCENARIOS}
    assert roles == {"order_builder": "builder", "chaos_injector": "injector", "normal_follower": "normal", "lurker": "lurker"}
    assert value(spark, B.scenario(F.lit("nobody"))) is None


def test_an_individual_of_whom_nothing_is_seen(spark):
    none = F.lit(None).cast("double")
    x = value(spark, B.profile(none, none, none, none, none, F.lit(None).cast("array<string>"), none, none, F.lit(False)))
    assert (x["position"], x["role"], x["resilience"], x["influence"], x["pattern"], x["stability"], x["confidence"]) == (0.0, "normal", 0.5, 0.1, "follower", "drifting", 0.1)
