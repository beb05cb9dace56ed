"""Kernels against known answers and plain versions."""

import math

import numpy as np
import pytest

from tidemark.functions import dynamics as D, numerics as N
from tidemark.operators import replicates as R, validation as V


def test_distributions():
    assert N.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and N.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert N.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and N.t_sf2(0.0, 5) == pytest.approx(1.0)
    assert V.ks_p_value(0.05, 1000, 1000) == pytest.approx(0.159, abs=0.01)


def test_pca_and_dimensions():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2)) @ np.array([[3.0, 0, 1, 0], [0, 1.0, 0, 2]]) + 5
    scores, comp, ratio = N.pca(x)
    assert N.dimensions(ratio)[2] == 2 and np.allclose(scores @ comp, x - x.mean(0)) and np.allclose(scores.mean(0), 0)
    assert all(c[np.abs(c).argmax()] > 0 for c in comp[:2])


def test_principal_angles_and_rotation():
    a = np.eye(4)[:2]
    assert np.allclose(N.principal_angles(a, a), 0, atol=1e-5) and np.allclose(N.principal_angles(a, np.eye(4)[2:]), 90)
    r = np.random.default_rng(1)
    x = r.normal(size=(30, 3))
    q = np.linalg.qr(r.normal(size=(3, 3)))[0]
    assert np.allclose(N.rotated(x, x @ q), x)


def test_diffusion_map_separates_clusters():
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(0, 0.3, (40, 2)), r.normal(4, 0.3, (40, 2))])
    z = N.diffusion_map(x)[:, 0]
    assert len({bool(v) for v in z[:40] > z.mean()}) == 1 and (z[:40] > z.mean())[0] != (z[40:] > z.mean())[0]


def test_clusters_mixture_gap_and_stability():
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(m, 0.4, (50, 2)) for m in ((0, 0), (5, 0), (0, 5))])
    truth = np.repeat([0, 1, 2], 50)
    for label in (N.kmeans(x, 3)[0], N.ward(x, 3), N.mixture_by_bic(x, range(1, 6))[1]):
        assert len({(a, b) for a, b in zip(label, truth)}) == 3
    assert N.gap_statistic(x, 5, 10)[0] == 3 and N.gap_statistic(r.uniform(size=(120, 2)), 4, 10)[0] == 1
    assert min(N.jaccard_stability(x, 3, 5)) > 0.9 and N.silhouette(x, truth) > 0.8
    assert N.mixture_by_bic(r.normal(size=(200, 2)), range(1, 4))[0] == 1


def test_silverman_controls():
    r = np.random.default_rng(4)
    assert N.silverman(r.normal(size=120), 40) > 0.1 and N.silverman(np.r_[r.normal(-4, 0.5, 60), r.normal(4, 0.5, 60)], 40) < 0.1


def ar(b, n, rng):
    y = [0.0, 0.0]
    for _ in range(n):
        y.append(sum(c * y[-k - 1] for k, c in enumerate(b)) + rng.normal())
    return np.array(y[2:])


def test_autoregression():
    rng = np.random.default_rng(5)
    y = ar([0.6, 0.25], 1500, rng)
    b, e = N.ar_fit(y, 2)
    assert b[1:] == pytest.approx([0.6, 0.25], abs=0.08) and N.ar_order(y) == 2 and N.ljung_box(e)[1] > 0.01
    assert len(N.ar_surrogate(y, 2, rng)) == len(y)
    shifted = np.r_[ar([0.1], 300, rng), ar([0.9], 300, rng)]
    assert N.nyblom(shifted, 1) > N.nyblom(ar([0.5], 600, rng), 1)
    d = N.drifting_ar(shifted, 1, (0.0, 1e-4, 1e-3, 1e-2))
    assert d["q"] > 0 and d["root_second"] > d["root_first"]


def test_kalman_without_drift_is_least_squares():
    rng = np.random.default_rng(6)
    z, y = N.ar_design(ar([0.5], 200, rng), 1)
    assert N.kalman(z, y, 0.0)[1][-1] == pytest.approx(np.linalg.lstsq(z, y, rcond=None)[0], abs=1e-3)


def test_ridge_and_forecast():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3))
    w, b = N.ridge(x, x @ [1.0, -2, 0.5] + 3, 1e-9)
    assert w == pytest.approx([1, -2, 0.5]) and b == pytest.approx(3)
    t = np.arange(60.0)[:, None]
    assert N.forecast(t, 3, 5, 1e-6)[:, 0] == pytest.approx(np.arange(60, 65), abs=0.05)
    v = N.varx(np.cumsum(rng.normal(size=(120, 2)), axis=0))
    assert v["alpha"] in N.ALPHAS and v["r2_last"] > 0


def lorenz(n=1200):
    f = lambda y: np.array([10 * (y[1] - y[0]), y[0] * (28 - y[2]) - y[1], y[0] * y[1] - 8 / 3 * y[2]])
    return D.rk4(f, np.array([1.0, 1, 1]), np.linspace(0, n * 0.02, n))[300:, 0]


def test_known_systems():
    sine = np.sin(0.11 * np.arange(700))  # a step that no period is a multiple of
    assert N.embedding_dimension(np.ones(100)) == 1 and N.embedding_dimension(sine, 14) == 2
    assert 2 <= N.embedding_dimension(lorenz(), 8) <= 4 and N.lyapunov(lorenz(), 3, 8) > 0.01
    assert N.recurrence(sine, 2, 14)[1] > 0.8


class TestSpread:
    def test_mass_is_kept(self):
        for s in (D.Spread(), D.Spread(sigma=0.05), D.Spread(mu=0.3, sigma=0.02)):
            assert s.solve()[1].sum(1) == pytest.approx(1.0)

    def test_threshold(self):
        assert D.summarised(*D.Spread(0.3, 0.1).solve())["total"] > 0.5 and D.summarised(*D.Spread(0.05, 0.1).solve())["total"] < 0.01

    def test_final_size_rises_with_r0_and_meets_its_equation(self):
        sizes = [D.summarised(*D.Spread(b, 0.1).solve(2000, 4000))["total"] for b in (0.15, 0.2, 0.3, 0.5)]
        assert sizes == sorted(sizes)
        for b, z in zip((0.15, 0.2, 0.3, 0.5), sizes):
            assert z == pytest.approx(1 - 0.999 * math.exp(-b / 0.1 * z), abs=1e-3)

    def test_waning_keeps_it_alive(self):
        assert D.life_cycle(*D.Spread(0.4, 0.1, 0.05).solve())["status"] == "endemic" and D.life_cycle(*D.Spread(0.4, 0.1).solve())["status"] == "died"

    def test_core_comes_first(self):
        t, y = D.two_populations(D.Spread(0.6, 0.1), D.Spread(0.3, 0.1), 0.05)
        assert t[y[:, 1].argmax()] < t[y[:, 4].argmax()]

    def test_fit_finds_itself(self):
        t = np.linspace(0, 100, 101)
        y = D.rk4(D.Spread(0.4, 0.12).field, np.array([0.99, 0.01, 0]), t)[:, 1]
        s = D.fitted(t, y, 0.01)
        assert s.beta == pytest.approx(0.4, rel=0.1) and s.gamma == pytest.approx(0.12, rel=0.1)
        assert D.robustly_fitted([0.5 * y], np.array([0.5]))[0]["scale"] > 0

    def test_crowd_and_networks(self):
        e = D.scale_free_network(100, 3, 1)
        assert len(e) == 3 * 97 and np.bincount(e.ravel()).max() > 10
        assert len(D.random_network(200, 6, 0)) == pytest.approx(600, rel=0.2)
        base = D.Crowd(contagion=0.0)
        low, high = D.simulated(base), D.simulated(D.swept(base, "contagion", [0.4])[0])
        assert low["reached"] < 0.05 < high["reached"] and base.contagion == 0.0 and D.simulated(base) == low

    def test_calibration(self):
        e = np.sin(np.arange(40) / 4)
        p, loss = D.evolved(D.individual(np.array([0.4, 0.6, 0.0, 0.7]), e), e, 24, 40)
        assert loss < 0.01 and len(p) == 4


def test_replicates_repeat(spark):
    labels = np.array([0, 0, 1, 1, 1, 2, 0, 0, 2, 2] * 5)
    a = R.transition_bootstrap(spark, labels, 3, 200).orderBy("src", "dst").collect()
    b = R.transition_bootstrap(spark, labels, 3, 200).orderBy("src", "dst").collect()
    assert a == b and all(r["lo"] <= r["mean"] <= r["hi"] for r in a)
    t = R.transition_table(labels, 3)
    assert [r["mean"] for r in a] == pytest.approx(t.ravel().tolist(), abs=0.05)
    stay = R.transition_bootstrap(spark, labels, 3, 200, as_is=True).filter("src = dst").agg({"mean": "avg"}).first()[0]
    assert stay > np.diag(t).mean()
    p = R.permutation_p(spark, 3.0, lambda g: g.normal(), 400).first()
    assert p["p"] < 0.05


def test_likelihoods_of_many_series_are_those_of_one_by_one():
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (3, 40)).cumsum(axis=1)
    both = [N.ar_design(v, 2) for v in x]
    q = np.array([0.0, 1e-3, 0.5])
    got = N.kalman_likelihoods(np.stack([b[0] for b in both]), np.stack([b[1] for b in both]), q)
    want = [[N.kalman(z, y, v)[0] for v in q] for z, y in both]
    assert np.allclose(got, want, rtol=1e-7, atol=1e-7)


def test_surrogates_are_constant_and_the_same_however_they_are_dealt(spark):
    from tidemark.operators import replicates

    rng = np.random.default_rng(4)
    y = np.zeros(70)
    for t in range(1, 70):
        y[t] = 0.5 * y[t - 1] + rng.normal()
    q, lr = N.drifting_surrogates(y, 1, np.arange(40), N.Q_GRID)
    one = [N.drifting_surrogates(y, 1, np.array([s]), N.Q_GRID) for s in range(40)]
    assert np.allclose(lr, [o[1][0] for o in one]) and (lr >= -1e-9).all() and (q == 0).mean() > 0.3
    r = replicates.drifting_test(spark, y, 40, 7).first()
    order = N.ar_order(y)
    want = N.drifting_surrogates(y, order, np.arange(40), N.Q_GRID)[1]
    assert r["order"] == order and r["p"] == pytest.approx((np.round(want, 9) >= round(r["lr"], 9)).mean())


def test_robust_fits_of_known_series(spark):
    """Series made by the model come back: the curve is matched, and what the data say of the parameters is found; batches don't matter."""
    from tidemark.operators import simulation

    made, known = [], [(0.9, 0.2, 0.05, 0.02), (1.4, 0.35, 0.1, 0.0), (0.6, 0.15, 0.02, 0.05)]
    for b, s, g, m in known:
        i0 = 0.02
        t = np.arange(40 * 10 + 1) / 10
        i = D.rk4(lambda y: D.mutating_field(y, b, s, g, m, 0.7), np.array([0.7 - i0, i0, 0.3]), t)[::10, 1]
        made.append(2.0 * i / 1.0)
    got = D.robustly_fitted([*made, np.zeros(9), np.ones(3)], np.array([k[0] for k in known] + [0.5, 0.5]))
    assert got[3] is None and got[4] is None
    for f, (b, s, g, m), seen in zip(got, known, made):
        assert f["loss"] < 0.02 * float((seen**2).sum()) and abs(f["beta"] - b) < 0.35 * b and 0.01 <= f["sigma"] <= 1.5 and f["active"] == 41 and f["r0"] == f["beta"] / f["sigma"]
    one = D.robustly_fitted([made[1]], np.array([known[1][0]]))[0]
    assert one == pytest.approx(got[1], rel=1e-6)
    rows = [(f"k{k}", i, float(v), "攻击发泄" if k == 0 else None) for k, s in enumerate([*made, np.zeros(9)]) for i, v in enumerate(s)]
    fits = {r["k"]: r for r in simulation.robust_fits(spark.createDataFrame(rows, "k string, t int, v double, c string"), "k", "t", "v", "c").collect()}
    assert fits["k3"]["beta"] is None and fits["k3"]["points"] == 9 and fits["k1"]["points"] == 41
    want = D.robustly_fitted([made[0]], np.array([0.8]))[0]
    assert fits["k0"]["beta"] == pytest.approx(want["beta"], rel=1e-6)


def test_the_mutating_field_keeps_the_whole():
    y = np.array([0.5, 0.2, 0.3])
    d = D.mutating_field(y, 0.8, 0.2, 0.1, 0.05)
    assert d.sum() == pytest.approx(0) and d == pytest.approx([0.1 * 0.3 - 0.08, 0.08 - 0.04 + 0.015, 0.04 - 0.03 - 0.015])
