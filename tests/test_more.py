"""Later kernels, sources and catalogue operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numerics as N
from tidemark.operators import curation as C
from tidemark.sources import tables as T


def test_order_in_time():
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.normal(0.3, 1, (150, 2)), axis=0)
    w, n = N.time_reversal(walk, 60), N.time_reversal(rng.normal(size=(150, 2)), 60)
    assert w["p"] == 0.0 and w["significant_dims"] >= 1 and n["p"] > 0.05 and n["significant_dims"] == 0
    d = N.drift_within(np.column_stack([np.arange(60.0), rng.normal(size=60)]), np.arange(60))
    assert d[0]["r"] == pytest.approx(1) and d[0]["p"] < 1e-6 < d[1]["p"]


def test_manifold_shift_sees_the_changed_part_only():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(80, 3))
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    same = N.manifold_shift(base, base @ q, 40, np.arange(80) % 2)
    moved = base.copy()
    moved[40:] += rng.normal(0, 2, (40, 3))
    other = N.manifold_shift(base, moved, 40, np.arange(80) // 40)
    assert same["after"] < 1e-8 and not same["significant"] and other["ratio"] > 2


def test_predictor():
    t = np.arange(120)
    x = np.column_stack([np.sin(t / 5), np.cos(t / 5)])
    p = N.StatePredictor(3, 1e-3)
    b = p.backtest(x)
    assert b["r2"] > 0.99 and b["mae"] < b["mae_last"]
    assert p.fit(x).forecast(x, 5)[:, 0] == pytest.approx(np.sin(np.arange(120, 125) / 5), abs=0.05)
    form, sure = N.nearest_form(x, np.array([[1.0, 0], [-1, 0]]))
    assert form[8] == 0 and 0 <= sure.min() <= sure.max() <= 1
    assert N.persistence(np.array([0, 0, 0, 1, 0]), 2) == pytest.approx(2 / 3)
    assert N.importance_noise(x, (x[:, 0] > 0).astype(int), 1e-6, 3) == 1.0


def test_sources(spark, tmp_path):
    c = spark.createDataFrame([("k", 0, "d1", 1.0), ("k", 1, "d1", 9.0), ("k", 1, "d2", 0.0), ("k", 1, "d3", 2.0)], "keyword string, chunk int, day string, value double")
    assert sorted(tuple(r) for r in T.joined_chunks(c).collect()) == [("k", "d1", 1.0), ("k", "d3", 2.0)]
    assert T.publish_months(spark.createDataFrame([("k", 1704067200), ("k", 1704067201)], "keyword string, pubdate long")).first()["n"] == 2
    assert tuple(T.interest_snapshot(c).first())[1:] == (3.0, 9.0)
    (tmp_path / "x.json").write_text(json.dumps([{"name": "a", "duration_months": 999}, {"name": "b", "year": 2020}]))
    got = {r["name"]: r for r in T.curated(spark, f"{tmp_path}/x.json", ("zzz",)).collect()}
    assert got["a"]["duration_months"] == 18.0 and got["b"]["duration_months"] == 3.0 and got["b"]["aliases"] == []
    assert T.by_stem(spark, [f"{tmp_path}/x.json"], "name string").first()["stem"] == "x"
    d = spark.createDataFrame([("", "/a/scrape_20240102_030405.json"), ("20240203_000000zz", "")], "f string, p string")
    assert [str(r["t"]) for r in d.select(T.captured_at("f", "p").alias("t")).collect()] == ["2024-01-02 03:04:05", "2024-02-03 00:00:00"]
    T.versioned_json(d, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first()["schema_version"] == "2.1"


def test_catalogue(spark):
    n = spark.createDataFrame([("a", [("burst", 0.9)]), ("b", None)], "name string, spread_phases array<struct<phase:string,intensity:double>>")
    t = {r["name"]: [x["phase"] for x in r["nodes"]] for r in C.trajectory_nodes(n, {"burst": "peak", "decay": "fixation"}).collect()}
    assert t == {"a": ["peak", "fixation"], "b": ["origin", "fixation"]}
    m = spark.createDataFrame([("a", [("2020-11",)], [("remix era", "2019-01"), ("calm", "2018-01")])], "name string, mutations array<struct<month:string>>, phases array<struct<phase:string,month:string>>")
    assert sorted(r["month"] for r in C.mutation_months(m, ["remix"], 2).collect()) == ["2019-01", "2020-11", "2020-12", "2021-01"]
    s = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 0.0)], "k string, rank int, x double")
    assert C.rank_weighted(s, "k", F.col("x")).first()["level"] == pytest.approx(0.75)
    p = spark.range(1).select(C.priority(F.lit(None).cast("array<double>"), F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.4))).alias("p")).first()["p"]
    assert p == [0.4]
    r = spark.createDataFrame([("a", [(1.0,), (5.0,)]), ("b", [(9.0,)])], "name string, nodes array<struct<r0:double>>")
    assert [x["name"] for x in C.ranked_by(r, "r0").collect()] == ["b", "a"]


def test_windows_over_few_keys_are_cut_into_ranges(spark):
    import random

    from tidemark.operators import signals, windows

    draw = random.Random(5)
    rows = [("hot" if draw.random() < 0.9 else f"k{draw.randint(0, 3)}", draw.randint(0, 400), i, draw.choice([0, 1, 2, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts int, event_id int, platform int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or the few rows would be one part
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    got = {r["event_id"]: r["next"] for r in signals.platform_sequences(df, "k", ["ts", "event_id"]).collect()}
    assert got == {a[2]: (b[3] if b else None) for own in by.values() for a, b in zip(own, [*own[1:], None])}
    got = {r["event_id"]: (r["i"], r["n"]) for r in windows.placed(df, "k", ["ts", "event_id"]).collect()}
    assert got == {r[2]: (i, len(own)) for own in by.values() for i, r in enumerate(own)}
    parts = windows.ranged(df, "k", ["ts", "event_id"]).groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.7 * len(rows)  # the hot key is in several parts
    assert signals.platform_sequences(df.limit(0), "k", ["ts", "event_id"]).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_first_rows_of_each_key_and_projections_beside_nodes(spark):
    import random

    from tidemark.operators import semantic, windows

    draw = random.Random(9)
    rows = [("hot" if i % 4 else f"k{i % 8}", draw.random(), i) for i in range(2000)]
    got = {(r["k"], r["rank"]): r["i"] for r in windows.first_of_each(spark.createDataFrame(rows, "k string, x double, i int"), ["k"], ["x", "i"], 7, 8).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r[2])
    assert got == {(k, n + 1): i for k, own in by.items() for n, i in enumerate(own[:7])}
    q = spark.createDataFrame([(i, [draw.gauss(0, 1) for _ in range(4)], i % 5) for i in range(60)], "id int, e array<double>, label int")
    nodes = spark.createDataFrame([(j, [draw.gauss(0, 1) for _ in range(4)]) for j in range(5)] + [(7, [0.0] * 4)], "node int, v array<double>")
    near = lambda rs: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in sorted(rs)]
    assert near(semantic.project(q, nodes).collect()) == near(semantic.project(q, nodes, most=0).collect())
    assert tuple(semantic.retrieval(q, nodes, "label").first()) == tuple(semantic.retrieval(q, nodes, "label", most=0).first())
    assert semantic.project(q, nodes.limit(0)).count() == 0
    assert "Exchange hash" not in semantic.project(q, nodes)._jdf.queryExecution().executedPlan().toString()


def test_md5_of_many_at_once():
    import hashlib

    from tidemark.functions.numerics import md5_head

    words = [b"", b"0:1:a", b"199:7200000:b", b"x" * 55] + [f"{i}:{i * i}:a".encode() for i in range(9000)]
    assert md5_head(np.array(words)).tolist() == [int(hashlib.md5(w).hexdigest()[:8], 16) for w in words]


def test_ranks_after_noise_by_sorting_all(spark, monkeypatch):
    """Rows are not multiplied by the draws, and ranges sorted apart give the ranks that sorting all gives."""
    import hashlib
    import math

    from tidemark.operators import permutations as P

    r0 = lambda x: -0.999 * math.log(max(1e-12, 1 - x / 0.999)) / x
    rows = [(i, r0(x), x) for i, x in ((i, 0.02 + 0.93 * ((i * 37) % 101) / 101) for i in range(1, 400))]
    u = lambda k, i, s: (int(hashlib.md5(f"{k}:{i}:{s}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
    want = {}
    for k in range(3):
        after = [(i, a, r0(min(0.92, max(0.03, x + 0.05 * math.sqrt(-2 * math.log(u(k, i, "a"))) * math.cos(2 * math.pi * u(k, i, "b")))))) for i, a, x in rows]
        places = [{i: n for n, i in enumerate(i for i, *_ in sorted(after, key=lambda t: (t[c], t[0])))} for c in (1, 2)]
        want[k] = np.corrcoef(*([p[i] for i, *_ in rows] for p in places))[0, 1], sum((a > 1) == (b > 1) for _, a, b in after) / len(after)
    df = spark.createDataFrame(rows, "p_partkey bigint, r0 double, x double")
    for size in (1 << 20, 40):
        monkeypatch.setattr(P, "RANGE", size)
        out = P.rank_robustness(df.repartition(3), 3, 0.05)
        assert "explode" not in out._jdf.queryExecution().toString()
        for r in out.collect():
            assert (r["r"], r["same"]) == pytest.approx(want[r["k"]], abs=1e-9)
    assert P.rank_robustness(df.limit(0), 3, 0.05).count() == 0
