"""Ward's hierarchy, cuts, silhouettes and components against plain versions."""

import numpy as np
import pytest

from tidemark.operators import components as C, hierarchy as H


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in r], "z") for i, r in enumerate(x)] + list(extra), "id bigint, v array<double>, n string")


def ward_plainly(x):
    live = {i: (1, np.array(r, float), {i}) for i, r in enumerate(x)}
    merges = []
    while len(live) > 1:
        ids = sorted(live)
        best = min((live[a][0] * live[b][0] / (live[a][0] + live[b][0]) * float(((live[a][1] - live[b][1]) ** 2).sum()), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
        h, a, b = best
        (n, c, s), (m, d, t) = live.pop(a), live.pop(b)
        live[1000 + len(merges)] = (n + m, (n * c + m * d) / (n + m), s | t)
        merges.append((h, s | t))
    return merges


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(3)
    return np.concatenate([r.normal(c, 0.4, (14, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 0))])


def members(merges):
    """Each node's rows."""
    kids = {m["node"]: (m["a"], m["b"]) for m in merges}

    def rows(i):
        return {i} if i >= 0 else rows(kids[i][0]) | rows(kids[i][1])

    return {frozenset(rows(n)): m["height"] for n, m in ((m["node"], m) for m in merges)}


@pytest.mark.parametrize("block", [1024, 7])
def test_ward_is_that_of_the_nearest_pair_each_time(spark, points, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    got = members(H.ward(frame(spark, points, [(None, [0.0] * 3, ""), (99, None, "")]), "id", "v").collect())
    want = {frozenset(s): h for h, s in ward_plainly(points)}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)


def test_equal_points_and_few_rows(spark):
    same = H.ward(frame(spark, [[1.0, 2.0]] * 5 + [[9.0, 9.0]]), "id", "v").collect()
    assert len(same) == 5 and sorted(r["height"] for r in same)[:4] == [0.0] * 4
    assert H.ward(frame(spark, [[1.0]]), "id", "v").count() == 0 and H.ward(frame(spark, []), "id", "v").count() == 0


def test_cuts_and_silhouettes(spark, points):
    df = frame(spark, points)
    merges = H._kept(H.ward(df, "id", "v"), H.working_dir(spark), "test-merges")
    plain = ward_plainly(points)
    for k in (1, 3, 5, len(points)):
        groups = [{i} for i in range(len(points))]
        for _, s in plain[: len(points) - k]:
            groups = [g for g in groups if not g <= s] + [s]
        want = {i: min(g) for g in groups for i in g}
        got = {r["id"]: r["cluster"] for r in H.cut(merges, df, "id", k).collect()}
        assert got == want
        labelled = df.join(H.cut(merges, df, "id", k), "id")
        sil = {r["id"]: r["silhouette"] for r in H.silhouettes(labelled, "cluster", "v").collect()}
        d = ((points[:, None] - points[None]) ** 2).sum(-1)
        for i in range(0, len(points), 5):
            own = [j for j in want if want[j] == want[i] and j != i]
            rest = [np.mean([d[i, j] for j in want if want[j] == c]) for c in set(want.values()) - {want[i]}]
            if not rest:
                assert sil[i] is None
            elif not own:
                assert sil[i] == 0
            else:
                a, b = np.mean([d[i, j] for j in own]), min(rest)
                assert sil[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_sweep_finds_the_groups(spark, points):
    got = {r["k"]: r for r in H.sweep(frame(spark, points), "id", "v", range(2, 5)).collect()}
    assert max(got, key=lambda k: got[k]["silhouette"]) == 3
    groups = [points[:14], points[14:28], points[28:]]
    assert got[3]["inertia"] == pytest.approx(sum(((g - g.mean(0)) ** 2).sum() for g in groups), rel=1e-9)


def test_components_are_those_of_the_singular_values(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (300, 6)) @ r.normal(0, 1, (6, 6)) + 5
    x[:, 4] = 2.0  # constant
    df = frame(spark, x).repartition(7)
    b = C.bases(df, "v")[0]
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert b.n == 300 and b.shares[:5] == pytest.approx((s**2 / (s**2).sum())[:5], abs=1e-9)
    assert np.abs((b.components[:4] * v[:4]).sum(axis=1)) == pytest.approx(np.ones(4), abs=1e-7)
    got = {r["id"]: r["s"] for r in df.select("id", C.scores("v", b, 2).alias("s")).collect()}
    assert np.array([got[i] for i in range(300)]) == pytest.approx(z @ b.components[:2].T, abs=1e-7)
    halves = C.bases(df.withColumn("h", (df["id"] >= 150).cast("int")), "v", "h", scaled=False)
    own = x[150:] - x[150:].mean(0)
    a = halves[0].components[:2]
    assert halves[1].explained(a) == pytest.approx(((own @ a.T) ** 2).sum() / (own**2).sum(), abs=1e-9)
    assert C.angles(a, a) == pytest.approx([0, 0], abs=1e-4) and C.angles(np.eye(3)[:1], np.eye(3)[1:2]) == pytest.approx([90])
    assert C.bases(df.limit(0), "v") == {}


def test_embeddings_components(spark):
    from tidemark import catalog

    rows = catalog.queries()["embedding_components"](spark, "/root/testdata/sf0.001").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()], float)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    z = np.array([[r["z1"], r["z2"], r["z3"]] for r in rows])
    assert np.abs(z) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-6)


def test_least_heights_are_those_of_differences():
    import numpy as np

    from tidemark.operators import hierarchy as H

    r = np.random.default_rng(3)
    c = np.concatenate([r.normal(0, 1, (60, 20)), np.repeat(r.normal(0, 1, (2, 20)), 4, axis=0), 1e4 + 1e-5 * r.normal(0, 1, (6, 20))])
    n, i = r.integers(1, 9, len(c)).astype(float), np.arange(len(c))
    whole = sum(((c[:, None, lo : lo + 8] - c[None, :, lo : lo + 8]) ** 2).sum(-1) for lo in range(0, 20, 8)) * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(whole, np.inf)
    got = H.least_heights(i, n, c, i, n, c)
    low = whole.min(axis=1)
    assert (got.min(axis=1) == low).all() and ((got == low[:, None]) == (whole == low[:, None])).all()


def test_nearest_rows_by_nested_loops(spark):
    """Copies, a vector without length, near ties, and blocks smaller than the table."""
    import numpy as np

    from tidemark.operators import semantic as S

    r = np.random.default_rng(5)
    v = [list(map(float, x)) for x in r.integers(-2, 3, (90, 3))] + [[0.0, 0.0, 0.0]] * 2 + [[1.0, 1.0, 0.5]] * 12
    base = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id bigint, e array<double>")

    def cos(a, b):
        s = lambda x, y: sum((p * q for p, q in zip(x, y)), 0.0)
        n = s(a, a) ** 0.5 * s(b, b) ** 0.5
        return s(a, b) / n if n > 0 else 0.0

    want = {(i, k + 1, j) for i in range(0, len(v), 7) for k, (_, j) in enumerate(sorted((-round(cos(v[i], x), 9), j) for j, x in enumerate(v) if j != i)[:5])}
    got = S.nearest_rows(base.filter("vec_id % 7 = 0").selectExpr("vec_id as id", "e"), base, 5, 4, 16).collect()
    assert {(x["id"], x["rank"], x["vec_id"]) for x in got} == want and len(got) == len(want)


def test_later_rounds_compare_what_is_new(spark, points, monkeypatch):
    """A cluster whose nearest one is still there meets the new clusters alone."""
    monkeypatch.setattr(H, "BLOCK", 2)
    monkeypatch.setattr(H, "ONE_TASK", 12)
    met, counts, plain = [], [], H.nearest

    def seen(some, few, clusters, count):
        assert some.count() == few and clusters.count() == count
        met.append(few * count)
        counts.append(max(few, count))
        return plain(some, few, clusters, count)

    monkeypatch.setattr(H, "nearest", seen)
    x = np.concatenate([points, points[:9] + 0.25])
    got = members(H.ward(frame(spark, x), "id", "v").collect())
    want = {frozenset(s): h for h, s in ward_plainly(x)}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)
    whole = counts[0] ** 2 + sum(c**2 for c in counts[1::2])
    assert len(met) > 3 and sum(met) < whole


@pytest.mark.parametrize("scale", [1e-25, 1e-9, 1.0, 1e7, 1e25])
def test_least_distances_in_any_unit(scale):
    r = np.random.default_rng(9)
    c = np.concatenate([r.normal(0, 1, (40, 12)), np.zeros((3, 12)), 1e3 + 1e-6 * r.normal(0, 1, (5, 12))]) * scale
    n, i = r.integers(1, 99, len(c)).astype(float), np.arange(len(c))
    whole = sum(((c[:, None, lo : lo + 8] - c[None, :, lo : lo + 8]) ** 2).sum(-1) for lo in range(0, 12, 8)) * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(whole, np.inf)
    got = H.least_heights(i, n, c, i, n, c)
    low = whole.min(axis=1)
    assert (got.min(axis=1) == low).all() and ((got == low[:, None]) == (whole == low[:, None])).all()
