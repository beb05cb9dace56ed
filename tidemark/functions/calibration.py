"""Direct calibration of an individual's leaning from what can be seen of them, as column expressions.

Signals vote for a leaning in [-1, 1], each with a weight. The weighted mean tells how the individual takes part, the votes' spread
how steady they are; a Gaussian kernel over five bins makes a posterior of them, whose mean is the estimate. Roles are scored by
rules and normalised. A signal that is null is absent; without any signal the leaning is 0 and the posterior empty.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.columns import clip, let

#: Centres of the posterior's bins, the kernel's width, the share below which a bin isn't listed.
BINS, KERNEL, NEGLIGIBLE = (-0.8, -0.4, 0.0, 0.4, 0.8), 0.15, 0.01
#: Roles, in the order that decides ties.
ROLES = ("normal", "builder", "injector", "lurker")
#: How somebody takes part.
EARLY, LATE, NEVER, RESISTER = ("early", "early_maj"), ("late_maj", "laggard"), "never", "resister"
#: Scenarios by self-report, orderly expression, consistency, trolling, contradiction and ways of taking part.
SCENARIOS = {
    "order_builder": (0.5, 0.85, 0.80, 0.02, 0.10, ("early", "early", "early_maj")),
    "chaos_injector": (-0.5, 0.20, 0.25, 0.60, 0.70, ("laggard", "early", "early_maj")),
    "normal_follower": (0.0, 0.50, 0.55, 0.05, 0.30, ("late_maj", "late_maj", "laggard")),
    "lurker": (0.1, 0.60, 0.70, 0.01, 0.10, ("never", "never", "laggard")),
}


def share(joined: Column, *ways: str) -> Column:
    """Share of the ways of taking part that are among these; null where there are none."""
    return F.when(F.size(joined) > 0, F.size(F.filter(joined, lambda w: w.isin(*ways))) / F.size(joined))


def votes(own: Column, order: Column, consistency: Column, troll: Column, contradiction: Column, joined: Column) -> Column:
    """Array of struct(v, w): the votes that apply."""
    vote = lambda v, w: F.struct(v.cast("double").alias("v"), F.lit(w).alias("w"))
    unit = lambda x: F.when(x.isNotNull(), clip(x, -1.0, 1.0))
    every = F.array(
        vote(own, 3.0), vote(unit(order * 1.2 - 0.1), 1.5), vote(unit(consistency * 0.8 - 0.1), 1.0), vote(F.when(troll > 0.15, troll * -2), 1.5), vote(unit(contradiction * -1.5), 1.0),
        vote(F.when(share(joined, *EARLY) > 0.5, F.lit(0.4)), 1.0), vote(F.when(share(joined, RESISTER) > 0.3, F.lit(-0.3)), 1.0),
    )
    return F.filter(every, lambda x: x["v"].isNotNull())


def total(some: Column, f) -> Column:
    return F.aggregate(some, F.lit(0.0), lambda a, x: a + f(x))


def leaning(cast: Column) -> Column:
    """Weighted mean of the votes, in [-1, 1]; 0 without votes."""
    return F.when(F.size(cast) > 0, clip(total(cast, lambda x: x["v"] * x["w"]) / total(cast, lambda x: x["w"]), -1.0, 1.0)).otherwise(F.lit(0.0))


def spread(cast: Column) -> Column:
    """Standard deviation of the votes, without weights; .5 without votes."""
    mean = total(cast, lambda x: x["v"]) / F.size(cast)
    return F.when(F.size(cast) > 0, let(mean, lambda m: F.sqrt(total(cast, lambda x: (x["v"] - m) * (x["v"] - m)) / F.size(cast)))).otherwise(F.lit(0.5))


def posterior(cast: Column) -> Column:
    """Five shares, by a Gaussian kernel about each vote."""
    raw = F.array(*(total(cast, lambda x, c=c: x["w"] * F.exp(-((x["v"] - c) * (x["v"] - c)) / (2 * KERNEL**2))) for c in BINS))
    return let(raw, lambda r: F.transform(r, lambda p: p / (F.aggregate(r, F.lit(0.0), lambda a, x: a + x) + 1e-10)))


def role_shares(order: Column, consistency: Column, troll: Column, contradiction: Column, joined: Column) -> Column:
    """Shares of ROLES, three digits."""
    none = lambda x, d: F.coalesce(x, F.lit(d))
    add = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(F.lit(0.0))
    scores = F.array(
        F.lit(0.3),
        add((order > 0.6) & (consistency > 0.6) & (none(troll, 1.0) < 0.15), F.lit(0.4)),
        add(troll > 0.15, troll * 1.5) + add(contradiction > 0.4, F.lit(0.3)) + add(share(joined, RESISTER) > 0.3, F.lit(0.3)),
        add((none(order, 0.5) < 0.3) & (none(troll, 0.0) < 0.1), F.lit(0.5)) + add(share(joined, NEVER) > 0.6, F.lit(0.4)),
    )
    return let(scores, lambda s: F.transform(s, lambda x: F.round(x / (F.aggregate(s, F.lit(0.0), lambda a, y: a + y) + 1e-10), 3)))


def profile(own: Column, order: Column, consistency: Column, troll: Column, contradiction: Column, joined: Column, resilience: Column, influence: Column, sentiment: Column) -> Column:
    """The calibrated profile as one struct. sentiment: whether there is a series of it."""
    none = lambda x, d: F.coalesce(x, F.lit(d))
    signals = F.coalesce(order, consistency, troll, contradiction).isNotNull()
    resilient = F.coalesce(resilience, F.when(signals, clip(none(consistency, 0.5) * 0.7 + (1 - none(contradiction, 0.3)) * 0.3, 0.1, 0.95)), F.lit(0.5))
    influent = F.coalesce(influence, F.when(signals, clip(none(order, 0.5) * 0.15 + none(troll, 0.05) * 0.2, 0.02, 0.5)), F.lit(0.1))
    known = (none(own, 0.0) != 0).cast("int") + signals.cast("int") + (F.size(none(joined, F.array().cast("array<string>"))) > 0).cast("int") + F.coalesce(sentiment, F.lit(False)).cast("int")
    centres = F.array(*map(F.lit, BINS))

    def made(cast: Column, shares: Column, roles: Column) -> Column:
        mean = F.aggregate(F.zip_with(shares, centres, lambda p, c: p * c), F.lit(0.0), lambda a, x: a + x)
        var = lambda m: F.aggregate(F.zip_with(shares, centres, lambda p, c: p * (c - m) * (c - m)), F.lit(0.0), lambda a, x: a + x)
        role = F.element_at(F.array(*map(F.lit, ROLES)), F.array_position(roles, F.array_max(roles)).cast("int"))
        lean, off = leaning(cast), spread(cast)
        sure = 0.4 * F.least(F.lit(1.0), known / 4) + 0.4 * (1 - F.least(F.lit(1.0), off / 0.5)) + 0.2 * F.when(role != "normal", 1.0).otherwise(0.5)
        return F.struct(
            F.transform(shares, lambda p: F.when(p > NEGLIGIBLE, F.round(p, 4))).alias("posterior"), F.round(mean, 3).alias("position"),
            let(mean, lambda m: F.round(F.sqrt(var(m)), 3)).alias("position_sd"), F.round(resilient, 3).alias("resilience"), F.round(influent, 3).alias("influence"),
            roles.alias("roles"), role.alias("role"), F.when(lean > 0.25, "early_adopter").when(lean > -0.25, "follower").otherwise("resister").alias("pattern"),
            F.round(0.5 + 0.3 * mean, 3).alias("susceptibility"), F.when(off < 0.15, "stable").when(off < 0.35, "oscillating").otherwise("drifting").alias("stability"),
            F.round(clip(sure, 0.1, 0.95), 3).alias("confidence"),
        )

    return let(
        votes(own, order, consistency, troll, contradiction, joined),
        lambda cast: let(posterior(cast), lambda shares: let(role_shares(order, consistency, troll, contradiction, joined), lambda roles: made(cast, shares, roles))),
    )


def scenario(name: Column) -> Column:
    """The profile that a described scenario makes; null for an unknown one."""
    parts = lambda i: F.coalesce(*(F.when(name == s, F.lit(v[i])) for s, v in SCENARIOS.items()))
    joined = F.coalesce(*(F.when(name == s, F.array(*map(F.lit, v[5]))) for s, v in SCENARIOS.items()))
    none = F.lit(None).cast("double")
    return F.when(name.isin(*SCENARIOS), profile(*(parts(i) for i in range(5)), joined, none, none, F.lit(False)))
