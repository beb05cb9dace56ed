"""Epidemic-style and agent models of spread, by fixed-step Runge-Kutta and seeded draws; numpy only."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np


def rk4(field, y0: np.ndarray, t: np.ndarray) -> np.ndarray:
    """States over time (times x variables, or x runs as well when y0 has a column for each run)."""
    out = np.empty((len(t), *np.shape(y0)))
    out[0] = y = np.asarray(y0, float)
    for i, h in enumerate(np.diff(t)):
        a = field(y)
        b = field(y + h / 2 * a)
        c = field(y + h / 2 * b)
        d = field(y + h * c)
        out[i + 1] = y = y + h / 6 * (a + 2 * b + 2 * c + d)
    return out


@dataclass(frozen=True)
class Spread:
    """beta: contact, gamma: recovery, sigma: loss of immunity, mu: mutation feedback."""

    beta: float = 0.3
    gamma: float = 0.1
    sigma: float = 0.0
    mu: float = 0.0

    @property
    def r0(self) -> float:
        return self.beta / self.gamma if self.gamma else math.inf

    def field(self, y: np.ndarray) -> np.ndarray:
        s, i, r = y
        new, out, back = self.beta * s * i, self.gamma * i, (self.sigma + self.mu * i) * r
        return np.array([back - new, new - out, out - back])

    def solve(self, days: float = 200.0, points: int = 1000, i0: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
        t = np.linspace(0, days, points)
        one = np.ones(np.broadcast(self.beta, self.gamma, self.sigma, self.mu).shape)  # parameters may be arrays: a run for each
        return t, rk4(self.field, np.array([(1 - i0) * one, i0 * one, 0.0 * one]), t)


def summarised(t: np.ndarray, y: np.ndarray) -> dict:
    """Peak, its day, final size, days above a hundredth of the peak, highest three-state entropy."""
    i = y[:, 1]
    up = t[i > 0.01 * i.max()]
    with np.errstate(divide="ignore", invalid="ignore"):
        e = -np.where(y > 0, y * np.log(y), 0).sum(1)
    return {"peak": float(i.max()), "peak_day": float(t[i.argmax()]), "total": float(1 - y[:, 0].min()), "duration": float(up[-1] - up[0]) if len(up) else 0.0, "entropy": float(e.max())}


def life_cycle(t: np.ndarray, y: np.ndarray, threshold: float = 0.01) -> dict:
    i = y[:, 1]
    on = np.flatnonzero(i >= threshold)
    status = "never" if not len(on) else "endemic" if i[-1] >= threshold else "died"
    return {"birth": float(t[on[0]]) if len(on) else None, "end": float(t[on[-1]]) if len(on) and status == "died" else None, "status": status}


def two_populations(core: Spread, mass: Spread, cross: float, days: float = 200.0, points: int = 1000, i_core: float = 0.01, i_mass: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Six states: a core that spreads early, and the mass it spills over to."""

    def field(y: np.ndarray) -> np.ndarray:
        sc, ic, _, sm, im, _ = y
        nc, nm = core.beta * sc * ic, mass.beta * sm * im + cross * sm * ic
        return np.array([-nc, nc - core.gamma * ic, core.gamma * ic, -nm, nm - mass.gamma * im, mass.gamma * im])

    t = np.linspace(0, days, points)
    one = np.ones(np.broadcast(core.beta, core.gamma, mass.beta, mass.gamma, cross).shape)
    return t, rk4(field, np.array([v * one for v in (1 - i_core, i_core, 0, 1 - i_mass, i_mass, 0)]), t)


def minimised(loss, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Bounded pattern search with shrinking steps: no derivatives, repeatable."""
    x, step = np.clip(start, lo, hi), (hi - lo) / 4
    best = loss(x)
    for _ in range(rounds):
        moved = False
        for k in range(len(x)):
            for sign in (1, -1):
                z = x.copy()
                z[k] = np.clip(z[k] + sign * step[k], lo[k], hi[k])
                v = loss(z)
                if v < best:
                    x, best, moved = z, v, True
                    break
        if not moved:
            step = step / 2
            if (step < 1e-7 * (hi - lo)).all():
                break
    return x


def fitted(t: np.ndarray, seen: np.ndarray, i0: float | None = None) -> Spread:
    """beta and gamma by least squares within bounds."""
    start = float(i0 if i0 is not None else max(seen[0], 1e-4))

    def loss(p: np.ndarray) -> float:
        return float(((rk4(Spread(*p).field, np.array([1 - start, start, 0.0]), t)[:, 1] - seen) ** 2).sum())

    lo, hi = np.array([0.01, 0.005]), np.array([3.0, 1.0])
    seeds = [np.array([b, g]) for b in (0.2, 0.6, 1.5) for g in (0.05, 0.2)]
    return Spread(*minimised(loss, min(seeds, key=loss), lo, hi))


#: Fixed values of the robust fit: bounds of contact, recovery, loss of immunity and mutation; where the search starts (contact at its prior); weights of the
#: priors; contact's prior by category, and without one; bounds of the scale; the share of the peak above which a point counts.
ROBUST_BOUNDS = ((0.01, 5.0), (0.01, 1.5), (0.0, 0.5), (0.0, 0.5))
ROBUST_START, PRIOR_WEIGHTS, SCALE, ACTIVE = (0.3, 0.1, 0.05), (0.1, 0.2), (0.1, 10.0), 0.02
CONTACT_PRIOR = {"攻击发泄": 0.8, "虚无退却": 0.5, "解构自嘲": 0.35, "身份认同": 0.4, "纯粹娱乐": 0.6}
NO_PRIOR = 0.5


def mutating_field(y: np.ndarray, beta, sigma, gamma, mu, n: float = 1.0) -> np.ndarray:
    """Spread in which some of those who are over it take it up again in another form: sigma recovers, gamma loses immunity, mu leads straight back."""
    s, i, r = y
    new = beta * s * i / n
    return np.array([gamma * r - new, new - sigma * i + mu * r, sigma * i - gamma * r - mu * r])


def robustly_fitted(series: list[np.ndarray], priors: np.ndarray, s0: float = 0.7, rounds: int = 60, inside: int = 4) -> list[dict | None]:
    """Fits of mutating_field() to many series of counts at whole times, moved together: squared error of the scaled infected share on active points, plus
    the priors' terms. The scale has a closed form. Each series has its own bounded pattern search; one solution of the model tries a step of all.

    A series of under five points, or of zeros, has no fit. With under five active points all points count; a series begins at its first point that counts.
    """
    usable = [k for k, v in enumerate(series) if len(v) >= 5 and v.max() >= 1e-6]
    out: list[dict | None] = [None] * len(series)
    if not usable:
        return out
    cut, masks = [], []
    for k in usable:
        v = np.asarray(series[k], float)
        on = v > ACTIVE * v.max()
        on = on if on.sum() >= 5 else np.ones(len(v), bool)
        first, last = int(on.argmax()), len(v) - int(on[::-1].argmax())
        cut.append(v[first:last])
        masks.append(on[first:last])
    n, most = len(cut), max(map(len, cut))
    seen, mask = np.zeros((most, n)), np.zeros((most, n), bool)
    for c, (v, m) in enumerate(zip(cut, masks, strict=True)):
        seen[: len(v), c], mask[: len(v), c] = v, m
    peak = np.array([np.asarray(series[k]).max() for k in usable])
    i0 = np.maximum(0.001, seen[0] / np.maximum(1.0, peak))
    start = np.array([s0 - i0, i0, np.full(n, 1 - s0)])
    t = np.arange((most - 1) * inside + 1) / inside
    prior = np.asarray(priors, float)[usable]

    def tried(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            i = rk4(lambda y: mutating_field(y, *p, s0), start, t)[::inside, 1]
            i = np.where(np.isfinite(i), i, 1e6)
            own = np.where(mask, i, 0)
            square = (own * own).sum(0)
            scale = np.where(square < 1e-12, 1.0, np.clip((own * seen).sum(0) / np.maximum(square, 1e-300), *SCALE))
            error = (np.where(mask, scale * i - seen, 0) ** 2).sum(0)
        return error + PRIOR_WEIGHTS[0] * (p[0] - prior) ** 2 + PRIOR_WEIGHTS[1] * p[3] ** 2, scale

    lo, hi = (np.array([b[e] for b in ROBUST_BOUNDS])[:, None] for e in (0, 1))
    p = np.clip(np.vstack([prior, *(np.full(n, v) for v in ROBUST_START)]), lo, hi)
    step = np.repeat((hi - lo) / 4, n, axis=1)
    best, scale = tried(p)
    for _ in range(rounds):
        alive = (step >= 1e-6 * (hi - lo)).any(axis=0)  # each series stops by itself, whatever it is tried with
        if not alive.any():
            break
        moved = ~alive
        for k in range(4):
            taken = np.zeros(n, bool)
            for sign in (1, -1):
                z = p.copy()
                z[k] = np.where(taken, p[k], np.clip(p[k] + sign * step[k], lo[k], hi[k]))
                loss, a = tried(z)
                better = (loss < best) & ~taken & alive
                p[k], best, scale = np.where(better, z[k], p[k]), np.where(better, loss, best), np.where(better, a, scale)
                taken |= better
            moved |= taken
        step = np.where(moved, step, step / 2)
    for c, k in enumerate(usable):
        beta, sigma, gamma, mu = (float(v) for v in p[:, c])
        out[k] = {"beta": beta, "sigma": sigma, "gamma": gamma, "mu": mu, "r0": beta / sigma, "scale": float(scale[c]), "loss": float(best[c]), "active": int(mask[:, c].sum())}
    return out


def divergence(a: np.ndarray, b: np.ndarray, days: float) -> float | np.ndarray:
    """Mean log growth of the distance of two runs over the time; of many pairs of runs (times x variables x runs) together."""
    d = np.linalg.norm(a - b, axis=1)
    each = d.reshape(len(d), -1)
    on, place = each > 1e-15, np.arange(each.shape[1])
    first, last = each[on.argmax(0), place], each[len(d) - 1 - on[::-1].argmax(0), place]
    ok = on.sum(0) > 1
    rate = np.where(ok, np.log(np.where(ok, last, 1.0) / np.where(ok, first, 1.0)) / days, 0.0)
    return rate.reshape(d.shape[1:]) if d.ndim > 1 else float(rate[0])


# agents


def random_network(n: int, degree: float, seed: int) -> np.ndarray:
    """Edges (i, j), i < j, each with the same chance."""
    rng = np.random.default_rng(seed)
    i, j = np.triu_indices(n, 1)
    pick = rng.random(len(i)) < degree / max(n - 1, 1)
    return np.column_stack([i[pick], j[pick]])


def scale_free_network(n: int, m: int, seed: int) -> np.ndarray:
    """Preferential attachment: each new node links to m earlier ones, by degree."""
    rng = np.random.default_rng(seed)
    ends, edges = list(range(m)), []
    for v in range(m, n):
        chosen: set[int] = set()
        while len(chosen) < min(m, v):
            chosen.add(int(ends[rng.integers(len(ends))]))
        edges += [(u, v) for u in sorted(chosen)]
        ends += [*chosen, *[v] * len(chosen)]
    return np.array(edges).reshape(-1, 2)


@dataclass(frozen=True)
class Crowd:
    agents: int = 200
    degree: float = 6.0
    scale_free: bool = False
    contagion: float = 0.2
    recovery: float = 0.1
    chaos: float = 0.0
    seeds: int = 3
    steps: int = 100
    seed: int = 0


def simulated(c: Crowd) -> dict:
    """One run: synchronous infection over a network, mood drawn to neighbours, optional disturbance half way."""
    rng = np.random.default_rng(c.seed)
    edges = scale_free_network(c.agents, max(1, int(c.degree / 2)), c.seed) if c.scale_free else random_network(c.agents, c.degree, c.seed)
    a = np.concatenate([edges, edges[:, ::-1]]) if len(edges) else np.empty((0, 2), int)
    state = np.zeros(c.agents, int)
    state[rng.choice(c.agents, min(c.seeds, c.agents), replace=False)] = 1
    mood = rng.normal(0, 0.3, c.agents)
    degree = np.maximum(np.bincount(a[:, 0], minlength=c.agents), 1)
    share, spread = [], []
    for step in range(c.steps):
        ill = np.bincount(a[:, 0], (state[a[:, 1]] == 1).astype(float), c.agents)
        catch = (state == 0) & (rng.random(c.agents) < 1 - (1 - c.contagion) ** ill)
        heal = (state == 1) & (rng.random(c.agents) < c.recovery)
        state[catch], state[heal] = 1, 2
        near = np.bincount(a[:, 0], mood[a[:, 1]], c.agents) / degree
        mood = 0.9 * mood + 0.1 * near + rng.normal(0, 0.02, c.agents)
        if c.chaos and step == c.steps // 2:
            mood = mood + rng.normal(0, c.chaos, c.agents)
        share.append(float((state == 1).mean()))
        spread.append(float(mood.std()))
    return {"peak": max(share), "reached": float((state > 0).mean()), "final": share[-1], "mood_sd": spread[-1]}


def swept(base: Crowd, field: str, values: list[float]) -> list[Crowd]:
    """Copies of a configuration with one field varied; the base stays as it is."""
    return [replace(base, **{field: v}) for v in values]


# one agent


def individual(params: np.ndarray, events: np.ndarray, seed: int = 42) -> np.ndarray:
    """A path of leaning under events: memory keeps it, openness takes the event in, noise is seeded. params may hold many agents (4 x agents): events x agents."""
    lean, openness, noise, memory = params
    e = np.multiply.outer(np.random.default_rng(seed).normal(0, 1, len(events)), noise)
    out, x = np.empty((len(events), *np.shape(lean))), lean
    for i, v in enumerate(events):
        x = np.clip(memory * x + (1 - memory) * lean + openness * (v - x) * 0.2 + e[i], -1, 1)
        out[i] = x
    return out


def evolved(target: np.ndarray, events: np.ndarray, population: int = 40, rounds: int = 100, seed: int = 0) -> tuple[np.ndarray, float]:
    """Genetic search for the parameters whose path is nearest the target."""
    rng = np.random.default_rng(seed)
    lo, hi = np.array([-1, 0, 0, 0.0]), np.array([1, 1, 0.3, 1.0])
    pool = rng.uniform(lo, hi, (population, 4))
    loss = lambda p: float(((individual(p, events) - target) ** 2).mean())
    score = np.array([loss(p) for p in pool])
    for k in range(rounds):
        best = pool[score.argsort()[: population // 4]]
        a, b = best[rng.integers(len(best), size=population)], best[rng.integers(len(best), size=population)]
        child = np.clip(np.where(rng.random(a.shape) < 0.5, a, b) + rng.normal(0, 0.2 * 0.97**k, a.shape) * (hi - lo), lo, hi)
        child[: len(best)] = best
        pool, score = child, np.array([loss(p) for p in child])
    return pool[score.argmin()], float(score.min())
