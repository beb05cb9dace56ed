"""Operators on small frames: ties, gaps, overlaps, empty groups, sources, streams, UDFs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, udfs
from tidemark.functions.columns import bigrams, ngrams, soft_score
from tidemark.operators import attention as A, curation as C, indicators as I, matching as M, semantic as S, signals as G, validation as V, windows as W
from tidemark.sources import tables as T
from tidemark.streaming import jobs, store


def value(spark, col, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(col.alias("v")).first()["v"]


def test_structure_of_one_and_none(spark):
    a = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 0.0), ("b", "x", 0.0), ("c", "x", 1.0), ("c", "y", 1.0)], "m string, k string, value double")
    got = {r["m"]: (r["active"], r["hhi"], r["entropy"]) for r in A.structure(a, "m").collect()}
    assert got["a"] == (1, 1.0, 0.0) and got["b"] == (0, 0.0, 0.0) and got["c"][1] == 0.5 and got["c"][2] == pytest.approx(0.693147, abs=1e-6)


def test_stages_overlap_and_the_first_wins(spark):
    v = [3, 4, 5, 6, 7, 8, 20, 15, 14, 13, 2, 3, 3]
    a = spark.createDataFrame([("k", f"2020-{i + 1:02d}", float(x)) for i, x in enumerate(v)], "keyword string, month string, value double")
    st = A.stage_intervals(a, "keyword", "month")
    assert [(r["stage"], r["lo"], r["hi"]) for r in st.orderBy("pos").collect()] == [("origin", 0, 1), ("emergence", 2, 5), ("peak", 4, 8), ("controversy", 9, 10), ("fixation", 11, 12)]
    assert [r["stage"] for r in A.stage_of(a, st, "keyword", "month").orderBy("i").collect()][4:7] == ["emergence", "emergence", "peak"]
    two = spark.createDataFrame([("z", "2020-01", 9.0), ("z", "2020-02", 9.0)], a.schema)
    assert A.stage_intervals(two, "keyword", "month").count() == 0


def test_islands_and_transitions(spark):
    d = spark.createDataFrame(list(enumerate([0, 0, 1, 1, 1, 0, None, None])), "t int, label int")
    assert [(r["label"], r["length"]) for r in W.episodes(d, "label", "t").orderBy("start").collect()] == [(0, 2), (1, 3), (0, 1), (None, 2)]
    p = {(r["src"], r["dst"]): r["p"] for r in W.transitions(d.filter("label is not null"), "label", "t").collect()}
    assert p == {(0, 0): 0.5, (0, 1): 0.5, (1, 1): pytest.approx(2 / 3), (1, 0): pytest.approx(1 / 3)}


def test_refractory_locf_asof_takens(spark):
    d = spark.createDataFrame([(i, float(i)) for i in (0, 3, 7, 8, 20)], "t int, x double")
    assert sorted(r["t"] for r in W.refractory(d, F.lit(True), "t").collect()) == [0, 7, 20]
    n = spark.createDataFrame([(0, None), (1, 2.0), (2, None)], "t int, x double")
    assert [r["x"] for r in W.carried_forward(n, "x", "t").orderBy("t").collect()] == [None, 2.0, 2.0]
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, ts int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, ts int, v string")
    assert sorted(tuple(r) for r in W.asof_previous(left, right, "k", "ts", "v").filter("v is not null").collect()) == [(1, 5, "b")]
    assert W.takens(d, "x", "t", 2, 2).count() == 3


def test_matching(spark):
    texts = spark.createDataFrame([(1, "abc def"), (2, "zz")], "id int, text string")
    few = spark.createDataFrame([("g", "def", 1), ("g", "abc", 0), ("h", "z", 0)], "group string, word string, pos int")
    want = [(1, "g", "abc"), (2, "h", "z")]
    got = M.first_hit(M.substring_hits(texts, "text", few, ["id"]), ["id", "group"])
    assert sorted((r["id"], r["group"], r["word"]) for r in got.collect()) == want
    many = few.unionByName(spark.range(2500).select(F.lit("n").alias("group"), F.format_string("none%d", "id").alias("word"), F.lit(9).alias("pos")))
    got = M.first_hit(M.substring_hits(texts, "text", many, ["id"]), ["id", "group"])
    assert sorted((r["id"], r["group"], r["word"]) for r in got.collect()) == want
    got = M.first_hit(M.substring_hits(texts, "text", few, ["id"], small=0), ["id", "group"])  # short words too by equality of n-grams
    assert sorted((r["id"], r["group"], r["word"]) for r in got.collect()) == want
    assert M.substring_hits(texts, "text", few.filter("false"), ["id"]).count() == 0
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    assert sorted(map(tuple, M.upsert_if_absent(old, spark.createDataFrame([("a", 2), ("b", 3)], old.schema), "k").collect())) == [("a", 1), ("b", 3)]
    assert value(spark, M.normalised_match(F.col("a"), F.col("b")), a="New York", b="new_york") and value(spark, M.either_contains(F.col("a"), F.col("b")), a="Cat", b="a cat here")


def test_text_functions(spark):
    assert value(spark, ngrams(F.col("t"), 2), t="añ\U0001f600b") == ["añ", "ñ\U0001f600", "\U0001f600b"] and value(spark, bigrams(F.col("t")), t="aaa") == ["aa"] and value(spark, ngrams(F.col("t"), 3), t="ab") == []
    assert value(spark, soft_score(F.col("t"), F.array(F.lit("a"), F.lit("b"), F.lit("z"))), t="ab") == pytest.approx(2 / 3 + 0.05)


@pytest.mark.parametrize(
    "text, first, n", [("2021-06", "2021-06", 1), ("2021年3月", "2021-03", 1), ("2020-11 至 2021-02", "2020-11", 4), ("2019年下半年", "2019-07", 6), ("2018", "2018-01", 12), ("unknown", None, 0)]
)
def test_dates_most_specific_first(spark, text, first, n):
    got = value(spark, rules.year_months(F.col("t")), t=text)
    assert len(got) == n and (got[0] if got else None) == first


def test_rules(spark):
    assert value(spark, rules.sentiment_entropy(F.array(F.lit(0.1), F.lit(1.0)))) == pytest.approx(0.693147 / 1.609438, abs=1e-5)
    assert value(spark, rules.diagnosis(F.lit(0.7), F.lit(0.2), F.lit(0.5))) == "metastable"
    w = {"a": {"x": 1.0, "y": -1.0}}
    m = F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(0.2))
    assert value(spark, rules.constraint_of(m, w)) == pytest.approx([0.66]) and value(spark, rules.active_concepts(m)) == ["x"]
    assert value(spark, rules.parsed_scores(F.col("t")), t='text ```json\n{"a": 0.5}\n``` end') == {"a": 0.5}


def test_validators(spark):
    d = spark.createDataFrame([("m", 0, [0.1] * 3, "origin", 3.0), ("m", 1, [0.5, 0.3, 0.1], "peak", 0.5), ("m", 2, [0.5, 0.3, 0.1], "emergence", 2.5)], "k string, t int, c array<double>, phase string, r double")
    assert sorted((r["t"], r["problem"]) for r in V.step_violations(d, "k", "t", "c").collect()) == [(1, "dimension")]
    phases = ("origin", "emergence", "peak", "controversy", "fixation")
    assert [(r["t"], r["problem"]) for r in V.phase_violations(d, "k", "t", "phase", phases).collect()] == [(2, "warning")]
    assert [(r["t"], r["problem"]) for r in V.dynamics_violations(d.withColumn("z", F.lit(-0.5)), "k", "t", "r", "phase", "z").collect()] == [(1, "peak"), (2, "jump")]


def test_concentration_in_one_pass(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    d = spark.createDataFrame([("g", x) for x in v], "g string, e array<double>")
    pairs = [sum(a * b for a, b in zip(v[i], v[j])) for i in range(3) for j in range(3) if i != j]
    assert S.concentration(d, ["g"]).first()["concentration"] == pytest.approx(sum(pairs) / 6)


def test_signals_and_discovery(spark):
    t = spark.createDataFrame([(s, p, x, 1.0) for s in (1, 2) for p in (0, 1) for x in ("good title", "abc1", "known thing")] + [(1, 0, "once", 1.0)], "scrape int, platform int, title string, score double")
    assert [(r["title"], r["n"], r["platforms"]) for r in G.candidates(t, ["known"], []).collect()] == [("good title", 2, [0, 1])]
    items = spark.createDataFrame([("梗王来了",), ("plain",), ("梗1",), ("旧梗",)], "title string")
    assert [r["title"] for r in G.discovered(items, spark.createDataFrame([("旧梗",)], "title string"), "title", ["梗", "王"]).collect()] == ["梗王来了"]


def test_curation(spark):
    d = spark.createDataFrame([("a", 0, 1.0, 0.0), ("a", 1, 3.0, 0.0), ("b", 2, 0.0, 5.0)], "label string, t int, x double, y double")
    r = {x["label"]: x for x in C.regime_members(d, "label", "t", ["x", "y"]).collect()}
    assert r["a"]["top"] == "x" and r["b"]["top"] == "y" and r["a"]["n"] == 2
    tab = spark.createDataFrame([("cat", ["kitty"], "r1")], "name string, aliases array<string>, record string")
    assert C.look_up("kitty", tab.filter("false"), tab).first()["record"] == "r1"


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": {"realtime": [{"word": "one", "num": 7, "url": "u"}, {"word": "two", "url": "v"}]}}))
    assert [tuple(r)[:3] for r in T.ranked_list(spark, f"{tmp_path}/a.json").orderBy("rank").collect()] == [(1, "one", 7), (2, "two", 0)]
    (tmp_path / "p.html").write_text("<b>x</b><i>5</i><a>u1</a><b>y</b><i>k</i><a>u2</a>")
    got = T.html_list(spark, f"{tmp_path}/p.html", "<b>(.)</b>", "<i>(.)</i>", "<a>(..)</a>").orderBy("rank").collect()
    assert [(r["title"], r["hot_score"], r["url"]) for r in got] == [("x", 5, "u1"), ("y", None, "u2")]
    (tmp_path / "m.json").write_text(json.dumps({"memes": {"k": {"2020-01": 3.5, "2020-03": 1}}}))
    assert sorted(map(tuple, T.attention_json(spark, f"{tmp_path}/m.json").collect())) == [("k", "2020-01", 3.5), ("k", "2020-03", 1.0)]
    d = spark.createDataFrame([(1, "2024-01-01 05:00:00"), (2, "2024-01-03 05:00:00")], "v int, ts string").withColumn("ts", F.to_timestamp("ts"))
    T.append_by_day(d, f"{tmp_path}/days")
    T.append_by_day(d, f"{tmp_path}/days")
    assert T.recent(spark, f"{tmp_path}/days", "2024-01-02").count() == 2
    assert T.expired(spark, f"{tmp_path}/days", "2024-01-04", 2).count() == 1 and T.expired(spark, f"{tmp_path}/days", "2024-01-04", 0).count() == 0
    v1 = spark.createDataFrame([("t", ["a ", ""], ["b"], None)], "ts string, weibo_top10 array<string>, zhihu_top10 array<string>, baidu_top10 array<string>")
    assert sorted((r["platform"], r["rank"], r["title"]) for r in T.migrated(v1).collect()) == [("weibo", 1, "a"), ("zhihu", 1, "b")]
    assert [r["v"] for r in T.last_wins(d.withColumn("k", F.lit(1)), ["k"], "ts").collect()] == [2]


def test_udfs(spark):
    udfs.register(spark)
    e = spark.sql("select embed_text('hello') e").first()["e"]
    assert len(e) == udfs.DIM and sum(x * x for x in e) == pytest.approx(1, abs=1e-5) and e == udfs.hashed_vector("hello")
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0)], "k string, v double, w double")
    assert d.groupBy("k").agg(udfs.weighted_score("v", "w").alias("s")).first()["s"] == 2.5

    def scorer(t):
        if t == "bad":
            raise ValueError
        return {"n": float(len(t))}

    got = udfs.scored(spark.createDataFrame([("abc",), ("bad",)], "t string"), "t", scorer).collect()
    assert [r["scores"] for r in got] == [{"n": 3.0}, None]


def test_streams_agree_with_batches_and_drop_late_rows(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", i % 3, "m" if i % 2 else "n", 1.0, '{"k": %d}' % (i + 1)) for i in range(16)]
    d = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("t")).drop("t")
    schema = "event_id bigint, user_id bigint, event_type string, value double, props string, ts timestamp"
    src = f"{tmp_path}/in"
    d.select("event_id", "user_id", "event_type", "value", "props", "ts").coalesce(1).write.parquet(src)
    s = jobs.events(jobs.source(spark, src, schema))
    seen = []
    jobs.run_available(jobs.tumbling(s), lambda b, _: seen.extend(b.collect()), f"{tmp_path}/c1")
    assert sorted({str(r["start"])[:10] for r in seen}) == ["2024-01-01", "2024-01-02"] and sum(r["n"] for r in seen) == 8
    levels = []
    jobs.run_available(jobs.live_levels(s), lambda b, _: levels.extend(b.collect()), f"{tmp_path}/c2", "update")
    assert {r["meme"]: r["best"] for r in levels} == {"n": 1, "m": 2}
    jobs.capture(s, f"{tmp_path}/out", f"{tmp_path}/c3")
    assert store.rows(spark, f"{tmp_path}/out", "event_id bigint, ts timestamp, user_id bigint, meme string, platform int, rank int, score double").count() == 16
    late = d.limit(1).withColumn("ts", F.to_timestamp(F.lit("2023-06-01 00:00:00"))).select("event_id", "user_id", "event_type", "value", "props", "ts")
    late.write.mode("append").parquet(src)
    before = len(seen)
    jobs.run_available(jobs.tumbling(s), lambda b, _: seen.extend(b.collect()), f"{tmp_path}/c1")
    assert not any(str(r["start"]).startswith("2023") for r in seen[before:])
    for job in (jobs.sliding, jobs.sessions):
        jobs.run_available(job(s), lambda b, _: b.count(), f"{tmp_path}/{job.__name__}")


def test_engine(spark):
    rows = [(t, f"{2000 + t // 12}-{t % 12 + 1:02d}", [0.1 * (t % 5), 0.05 * t], [float(t % 3)], 0.2, 0.3, 0.4, 0.1, 0.2) for t in range(30)]
    st = spark.createDataFrame(rows, "t int, month string, x array<double>, u array<double>, origin double, emergence double, fixation double, mutation double, drift double")
    regimes = spark.createDataFrame([(r[1], r[0] % 2) for r in rows], "month string, label int")
    nodes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "node int, v array<double>")
    e = I.Engine(I.history(st), regimes, nodes)
    m = e.query("macro").first()
    assert m["month"] == "2002-06" and 0 <= m["inertia"] <= 1 and m["regime"] == 1
    v = spark.createDataFrame([(1, [1.0, 0.05]), (2, [1.0, 1.0]), (3, [-1.0, -1.0])], "id int, e array<double>")
    assert [(r["best"], r["status"]) for r in e.query("persona", vectors=v).orderBy("id").collect()] == [(0, "projected"), (0, "ambiguous"), (0, "noise")]
    assert e.query("full", "2001-01", v).count() == 3
    with pytest.raises(ValueError):
        e.query("other")


def test_stated_sets_meet_in_blocks(spark, monkeypatch):
    points = spark.createDataFrame([(i, float(i % 17)) for i in range(60)], "k int, x double")
    centres = spark.createDataFrame([(f"c{i:02d}", float(i)) for i in range(17)], "c string, y double")
    near = lambda: sorted(map(tuple, M.nearest(points, centres, F.abs(F.col("x") - F.col("y")), "k", "c").collect()))
    want = [(i, f"c{i % 17:02d}", 0.0) for i in range(60)]
    assert near() == want
    monkeypatch.setattr(M, "MOST_AT_ONCE", 5)
    monkeypatch.setattr(M, "BLOCK", 4)
    assert near() == want


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(size=500).round(1)] + [("b", 7.0)] * 40 + [("c", 1.0), ("c", 2.0)] + [("d", float(v)) for v in rng.exponential(size=301)] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"q0": 0.0, "q1": 0.25, "q5": 0.5, "q9": 0.9, "q10": 1.0}
    for bins in (1, 7, 4096):
        got = {r["g"]: [r[n] for n in shares] for r in S.exact_quantiles(df, ["g"], "v", shares, bins).collect()}
        for g in "abcd":
            v = [x for k, x in rows if k == g and x is not None]
            assert got[g] == pytest.approx(np.quantile(v, list(shares.values())).tolist(), abs=1e-12)


def test_a_ledger_from_a_table(spark):
    from tidemark.operators import ledger as L

    t = spark.createDataFrame([("a", "E3", ["A1"]), ("b", "odd", None), ("c", "E0", ["A1", "A2"])], "id string, grade string, depends array<string>")
    led = L.checked(t)
    assert {r["id"]: (r["grade"], r["outcome"]) for r in L.cascade(led, "A1").collect()} == {"a": ("E3", "invalidated"), "b": ("E4", "clean"), "c": ("E0", "survives, flagged")}
    assert {r["grade"]: (r["n"], r["free"]) for r in L.by_grade(led).collect()} == {"E3": (1, 0), "E4": (1, 1), "E0": (1, 0)}
    with pytest.raises(ValueError):
        L.checked(t.drop("depends"))


def test_collective_states(spark):
    of = lambda r0, c: value(spark, rules.collective_state(F.col("r"), F.col("c")), r=r0, c=c)
    assert [of(2.0, -0.4), of(2.0, -0.41), of(1.2, -0.6), of(1.2, 0.3), of(0.5, 0.2), of(0.5, 0.9), of(1.5, 0.1)] == [
        "constructive_irony", "aggressive_venting", "nihilistic_retreat", "identity_construction", "neutral_entertainment", None, "neutral_entertainment"
    ]


def test_configurations_solved_together_are_those_solved_alone():
    import numpy as np

    from tidemark.functions import dynamics as D

    beta, gamma, sigma = np.array([0.15, 0.35, 0.55]), np.array([0.1, 0.2, 0.1]), np.array([0.01, 0.0, 0.03])
    s = D.Spread(beta, gamma, sigma)
    rates = D.divergence(s.solve(i0=0.001)[1], s.solve(i0=0.0011)[1], 200.0)
    across = np.array([0.02, 0.1, 0.3])
    both = D.two_populations(D.Spread(beta, gamma), D.Spread(0.15, gamma), across)[1]
    paths = D.individual(np.array([beta, gamma, np.full(3, 0.05), sigma]), np.array([0.3, -0.4, 0.9]))
    for i in range(3):
        one = D.Spread(beta[i], gamma[i], sigma[i])
        assert rates[i] == D.divergence(one.solve(i0=0.001)[1], one.solve(i0=0.0011)[1], 200.0)
        assert (both[:, :, i] == D.two_populations(D.Spread(beta[i], gamma[i]), D.Spread(0.15, gamma[i]), across[i])[1]).all()
        assert (paths[:, i] == D.individual(np.array([beta[i], gamma[i], 0.05, sigma[i]]), np.array([0.3, -0.4, 0.9]))).all()


def test_configurations_of_one_file_go_to_all_cores(spark):
    from tidemark.operators import simulation as S

    one = spark.range(50).coalesce(1).selectExpr("id", "0.3D as beta", "0.1D as gamma", "0.01D as sigma")
    made = S.divergences(S.dealt(one), 0.001, 0.0011)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and made.count() == 50
