"""Indicators month by month, stages' positions, cells and basins against plain loops."""

import numpy as np
import pytest

from tidemark.operators import hierarchy as H, indicators as I


@pytest.fixture(scope="module")
def months():
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (30, 3)).cumsum(axis=0) * 0.1
    shares = r.dirichlet(np.ones(5), 30)
    shares[4] = [0.3, 0.3, 0.2, 0.1, 0.1]
    shares[5] = 0
    return x, r.normal(0, 1, (30, 2)), shares, r.random(30), r.random(30)


@pytest.fixture(scope="module")
def states(spark, months):
    x, u, shares, m, d = months
    rows = [(i, f"{2000 + i // 12}-{i % 12 + 1:02d}", [float(v) for v in x[i]], [float(v) for v in u[i]], *(float(v) for v in shares[i]), float(m[i]), float(d[i])) for i in range(30)]
    return spark.createDataFrame(rows, "t int, month string, x array<double>, u array<double>, origin double, emergence double, peak double, controversy double, fixation double, mutation double, drift double").repartition(5)


def test_each_month_by_those_before_it(spark, states, months):
    """No month sees a later one, and the spectral radius is that of the least-squares map."""
    whole = {r["t"]: r for r in I.history(states).collect()}
    assert len(whole) == 30 and {r["month"] for r in whole.values()} >= {"2000-01", "2002-06"}
    x, _, shares, m, d = months
    for t in (3, 10, 29):
        past = x[max(0, t - 11) : t + 1]
        if len(past) > 4:
            a, b = past[:-1] - past.mean(0), past[1:] - past.mean(0)
            w = np.linalg.solve(a.T @ a, a.T @ b)
            assert whole[t]["radius"] == pytest.approx(np.abs(np.linalg.eigvals(w)).max(), rel=1e-6)
        else:
            assert whole[t]["radius"] == 0
        heat = 0.5 * m[t] / m.max() + 0.5 * d[t] / d.max()
        assert whole[t]["temperature"] == pytest.approx(min(max(heat, 0), 1))
        s = shares[t]
        stage = min(max(s[4] / (max(s[0] + s[1], 0.01) + s[4] + 0.05), 0), 1)
        flat, nxt = past[:-1].ravel(), past[1:].ravel()
        corr = np.corrcoef(flat, nxt)[0, 1] if len(past) > 3 else 0
        assert whole[t]["inertia"] == pytest.approx(0.4 * stage + 0.3 * max(0, corr) + 0.3 * s[4])
    early = {r["t"]: (r["inertia"], r["recovery"], r["fragility"], r["shocks"], r["radius"]) for r in I.history(states.filter("t < 15")).collect()}
    assert all(early[t] == pytest.approx(tuple(whole[t][c] for c in ("inertia", "recovery", "fragility", "shocks", "radius"))) for t in early)


def test_positions(states, months):
    shares = months[2]
    first = [int(np.argmax(s)) for s in shares]
    second = [min((i for i in range(5) if i != f), key=lambda i: (-s[i], i)) for s, f in zip(shares, first)]
    for r in I.positions(states).collect():
        t = r["t"]
        moves = sum(first[i] != first[i - 1] for i in range(max(1, t - 12), t + 1))
        assert (r["dominant"], r["second"], r["moves"]) == (I.STAGES[first[t]], I.STAGES[second[t]], moves)


def test_cells_and_basins(spark, states, months):
    x = months[0]
    got = {r["t"]: r["cluster"] for r in H.kmeans(states, "t", "x", 3).collect()}
    label = np.array([got[t] for t in range(30)])
    centre = np.stack([x[label == c].mean(0) for c in range(3)])
    assert (((x[:, None] - centre[None]) ** 2).sum(-1).argmin(1) == label).all()  # a fixed point of the rounds
    cells = spark.createDataFrame([(t, int(c)) for t, c in got.items()], "t int, cell int")
    away = np.linalg.norm(x - centre[label], axis=1)
    for r in I.basins(states, cells).collect():
        own = label == label[r["t"]]
        assert r["share"] == round(100 * own.sum() / 30, 1) and r["away"] == pytest.approx(away[r["t"]]) and r["typical"] == (away[r["t"]] < 1.5 * away[own].mean())
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "t int, x array<double>")
    assert {r["cluster"] for r in H.kmeans(same, "t", "x", 3).collect()} == {0} and H.kmeans(same.limit(0), "t", "x", 3).count() == 0
