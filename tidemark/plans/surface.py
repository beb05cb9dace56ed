"""Queries of the Python surface, of agents' paths, and of a few kernels with a plain closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions import columns as C, numerics as N, udfs as U
from tidemark.functions.columns import r6
from tidemark.operators import attention as A, curation as K, hearing as H, replicates as P, signals as G, simulation as S
from tidemark.plans.attention import _STAGES
from tidemark.plans.bindings import ATT, AXIS, attention, axis, regime_sequence, table, vectors
from tidemark.plans.series import _STATES, frame, states

_COS = "list_cosine_similarity"


@query(f"SELECT a.vec_id, round(1 - {_COS}(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS drift FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def meaning_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One minus the cosine of an original and a current meaning: each vector and the next one."""
    v = vectors(spark, sf_dir)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(nxt, "vec_id").select("vec_id", r6(1 - C.cosine(F.col("e"), F.col("f"))).alias("drift"))


@query(f"""WITH {ATT}, m AS (SELECT keyword, value, month[1:4]::INT * 12 + month[6:7]::INT AS k FROM att), c AS (SELECT keyword, value, (k - min(k) OVER (PARTITION BY keyword))::DOUBLE AS t FROM m),
p AS (SELECT keyword, max(value) AS top, max(t) AS fin FROM c GROUP BY keyword), q AS (SELECT p.keyword, top, fin, min(t) AS peak FROM p JOIN c ON c.keyword = p.keyword AND value = top GROUP BY 1, 2, 3),
e AS (SELECT q.keyword, peak, nullif(fin, 0) AS fin, coalesce(min(t) FILTER (t < peak AND value >= 0.1 * top), 0) AS lit, coalesce(min(t) FILTER (t >= peak AND value <= 0.1 * top), fin) AS back FROM q JOIN c ON c.keyword = q.keyword GROUP BY 1, peak, fin)
SELECT keyword, round(lit / fin * 100, 1) AS emergence, round((peak - lit) / fin * 100, 1) AS growth, round((back - peak) / fin * 100, 1) AS decay, round((fin - back) / fin * 100, 1) AS equilibrium FROM e""")
def phase_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundredths of each curve's time before it takes off, up to its peak, back down, and after."""
    a = attention(spark, sf_dir).withColumn("k", F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int"))
    first = a.groupBy("keyword").agg(F.min("k").alias("lo"))
    return K.lifecycle_shares(a.join(first, "keyword").withColumn("t", (F.col("k") - F.col("lo")).cast("double")), "keyword", "t", "value")


@query(r"SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_name), '[^\p{L}\p{N}]+', '', 'g') AS plain FROM part")
def plain_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as the matcher hears them: letters and digits in lower case."""
    plain = F.regexp_replace(F.lower(F.concat_ws(" ", "p_brand", "p_name")), r"[^\p{L}\p{N}]+", "")
    return table(spark, sf_dir, "part").select("p_partkey", plain.alias("plain"))


_HEARD = ("the and", "thonthe", "ationing", "einachich", "pour les", "mentelle", "queeau", "la ç", "LA CH", "thatat of the", "nich", "the")


def _less(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda a: substr({text}, 1, (a - 1)::INT) || substr({text}, (a + 1)::INT))"


def _pairs(text: str) -> str:
    return f"list_transform(range(1, length({text})), lambda a: substr({text}, a::INT, 2))"


#: Windows against keywords, each with each. A likeness over .85 leaves few ways: none missing, one missing and one added (7 characters or more), or
#: an end of the window without one character (4 or more) or two (8).
_HEARS = f"""k(keyword) AS (VALUES {', '.join(f"('{w}')" for w in _HEARD)}), c AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations WHERE length(text) >= 2),
w AS (SELECT conv_id, turn, keyword, i, substr(text, i + 1, length(keyword)) AS m FROM (SELECT *, unnest(range(0, n - length(keyword) + 1))::INT AS i FROM c JOIN k ON length(keyword) <= n)),
near AS (SELECT * FROM (SELECT conv_id, turn, keyword, len(list_filter(range(1, length(keyword) + 1), lambda j: substr(lower(m), j::INT, 1) <> substr(lower(keyword), j::INT, 1))) AS d, i, m FROM w) WHERE d <= 1),
v AS (SELECT conv_id, turn, n, i, substr(text, i + 1, 8) AS m FROM (SELECT *, unnest(range(0, greatest(1, n - 7)))::INT AS i FROM c)),
p AS (SELECT conv_id, turn, keyword, i, m, CASE WHEN length(keyword) <= length(m) THEN keyword ELSE m END AS s, CASE WHEN length(keyword) <= length(m) THEN m ELSE keyword END AS t
  FROM v JOIN k ON length(keyword) <= n AND list_has_any({_pairs('m')}, {_pairs('keyword')})),
q AS (SELECT *, length(s) AS z, {_less('s')} AS less FROM p),
r AS (SELECT conv_id, turn, keyword, i, m, greatest(CASE WHEN contains(t, s) THEN 1 ELSE 0 END,
    CASE WHEN z >= 7 AND len(list_filter(range(1, length(t) - z + 2), lambda j: list_has_any(less, {_less('substr(t, j::INT, z::INT)')}))) > 0 THEN (z - 1) / z ELSE 0 END,
    CASE WHEN z >= 4 AND (list_contains(less, t[1 : z - 1]) OR list_contains(less, t[length(t) - z + 2 :])) THEN 2 * (z - 1) / (2 * z - 1) ELSE 0 END,
    CASE WHEN z >= 8 AND list_has_any(list_distinct(flatten(list_transform(less, lambda y: {_less('y')}))), [t[1 : z - 2], t[length(t) - z + 3 :]]) THEN 2 * (z - 2) / (2 * z - 2) ELSE 0 END)::DOUBLE AS r FROM q),
h AS (SELECT conv_id, turn, keyword, CASE WHEN d = 0 THEN 1 ELSE 2 END AS layer, i AS place, m AS matched, CASE WHEN d = 0 THEN 1.0 ELSE 0.4 END::DOUBLE AS confidence FROM near
  UNION ALL SELECT conv_id, turn, keyword, 3, i, substr(m, 1, length(keyword)), r * 0.6 FROM r WHERE r > 0.85),
heard AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY conv_id, turn, keyword ORDER BY layer, place) = 1)"""


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in _HEARD], "keyword string")
    turns, cores = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), spark.sparkContext.defaultParallelism
    if turns.rdd.getNumPartitions() < cores:  # a few files: a turn costs far more than it takes to move it
        turns = turns.repartition(2 * cores)
    return H.heard(turns, ["conv_id", "turn"], "text", words)


@query(f"WITH {_HEARS} SELECT conv_id, turn, keyword, layer, place, matched, round(confidence, 4) AS confidence FROM heard")
def heard_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that the turns of all conversations hold: exactly, but for one slip, or mostly."""
    h = _heard(spark, sf_dir)
    return h.select("conv_id", "turn", "keyword", "layer", "place", "matched", F.round("confidence", 4).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'bolt') THEN NULL ELSE length(p_name) / 100.0 END::DOUBLE AS length, CASE WHEN contains(p_name, 'bolt') THEN NULL ELSE len(string_split(p_name, ' ')) END::DOUBLE AS words FROM part")
def injected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a service that is passed in (here a stub that fails on some texts, every time)."""

    def scorer(text: str) -> dict[str, float]:
        if "bolt" in text:
            raise ValueError("the service has no answer")
        return {"length": len(text) / 100, "words": float(len(text.split(" ")))}

    s = U.scored(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", scorer)
    return s.select("p_partkey", F.try_element_at("scores", F.lit("length")).alias("length"), F.try_element_at("scores", F.lit("words")).alias("words"))


_AGENTS = "ag AS (SELECT s_suppkey AS id, -0.6 + s_suppkey % 13 * 0.1::DOUBLE AS lean, 0.1 + s_suppkey % 5 * 0.2::DOUBLE AS openness, 0.4 + s_suppkey % 4 * 0.15::DOUBLE AS memory FROM supplier)"
_EVENTS = "ev AS (SELECT range + 1 AS k, ((range * 37) % 21 - 10) / 10.0::DOUBLE AS v FROM range(40))"
_PATHS = f"""{_AGENTS}, {_EVENTS}, pa AS (SELECT id, 0 AS k, lean AS x, lean, openness, memory FROM ag UNION ALL
  SELECT id, pa.k + 1, least(greatest(memory * x + (1 - memory) * lean + openness * (v - x) * 0.2, -1), 1), lean, openness, memory FROM pa JOIN ev ON ev.k = pa.k + 1)"""


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as agents: their keys say what they are like."""
    k = F.col("id")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id")).select("id", (-0.6 + k % 13 * 0.1).alias("lean"), (0.1 + k % 5 * 0.2).alias("openness"), (0.4 + k % 4 * 0.15).alias("memory"))


EVENTS = [((i * 37) % 21 - 10) / 10.0 for i in range(40)]


@query(f"WITH RECURSIVE {_PATHS} SELECT id, k::INT AS step, round(x, 6) + 0.0 AS x FROM pa WHERE k > 0")
def agent_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents' leanings under a row of events, without noise."""
    return S.agent_paths(S.dealt(agents(spark, sf_dir)), EVENTS).select("id", "step", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query(f"WITH RECURSIVE {_PATHS} SELECT a.id, round(avg((a.x - b.x) ** 2), 6) AS loss FROM pa a JOIN pa b ON b.id = 6 AND a.k = b.k WHERE a.k > 0 GROUP BY a.id")
def agent_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared distance of each agent's path to an observed one."""
    a = agents(spark, sf_dir)
    seen = S.agent_paths(a.filter("id = 6"), EVENTS).select("step", F.col("x").alias("y"))  # one agent's path
    return S.agent_paths(S.dealt(a), EVENTS).join(F.broadcast(seen), "step").groupBy("id").agg(r6(F.avg((F.col("x") - F.col("y")) ** 2)).alias("loss"))


@query(f"""WITH {AXIS}, b AS (SELECT min(x) - 0.5 * (max(x) - min(x)) AS lo, 2 * (max(x) - min(x)) AS span, stddev_samp(x) AS sd FROM axis), w(h) AS (VALUES (0.1::DOUBLE), (0.2), (0.4), (0.8)),
g AS (SELECT h, i, lo + span * i / 511 AS place, sd * h AS s FROM b, w, range(512) AS r(i)), f AS (SELECT h, i, sum(exp(-0.5 * ((place - x) / s) ** 2)) AS f FROM g, axis GROUP BY h, i),
n AS (SELECT h, f, lag(f) OVER (PARTITION BY h ORDER BY i) AS a, lead(f) OVER (PARTITION BY h ORDER BY i) AS b FROM f) SELECT h AS width, count(*) FILTER (f > a AND f >= b)::INT AS modes FROM n GROUP BY h""")
def density_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima of the axis' kernel density at several widths."""
    x = P.matrix(axis(spark, sf_dir), "t", ["x"])[:, 0]
    return frame(spark, [(h, N.modes(x, h * x.std(ddof=1))) for h in (0.1, 0.2, 0.4, 0.8)], "width double, modes int")


@query(f"""WITH {AXIS}, {_STATES}, d AS (SELECT a.t, a.label, b.label AS other, sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) AS d FROM j a JOIN j b ON a.t <> b.t), m AS (SELECT t, label, other, avg(d) AS m FROM d GROUP BY ALL),
s AS (SELECT t, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM m GROUP BY t) SELECT count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""")
def regime_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the regimes are apart on the state: mean silhouette."""
    m = P.matrix(states(spark, sf_dir), "t", ["x", "z", "label"])
    return frame(spark, [(len(m), round(float(N.silhouette(m[:, :2], m[:, 2].astype(int))), 6))], "n bigint, silhouette double")


@query(f"""WITH {AXIS}, v AS (SELECT t, x FROM axis), p AS (SELECT t, x, lead(x, 1) OVER (ORDER BY t) AS y FROM v) SELECT t, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE y IS NOT NULL""")
def delay_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay vectors of the axis in two dimensions."""
    e = N.embedded(P.matrix(axis(spark, sf_dir), "t", ["x"])[:, 0], 2, 1)
    return frame(spark, [(t, *(round(float(v), 6) for v in r)) for t, r in enumerate(np.asarray(e))], "t int, x double, y double")


@query(f"WITH {AXIS}, {_STATES}, m AS (SELECT t, label, lead(label) OVER (ORDER BY t) AS p, x FROM j) SELECT count(*) AS switches, round(avg(x), 6) AS mean_at_switches, round((SELECT avg(x) FROM j), 6) AS mean FROM m WHERE p <> label")
def axis_at_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed side of the permutation test: the axis where regimes switch, beside its mean."""
    from pyspark.sql import Window

    j = axis(spark, sf_dir).join(regime_sequence(spark, sf_dir).select("month", "label"), "month")
    w = j.withColumn("p", F.lead("label").over(Window.partitionBy(F.lit(0)).orderBy("t")))
    at = w.filter("p <> label").agg(F.count("*").alias("switches"), r6(F.avg("x")).alias("mean_at_switches"))
    return at.join(j.agg(r6(F.avg("x")).alias("mean")))


_KEPT = _STAGES.replace("att AS (", "att0 AS (", 1).replace("GROUP BY 1, 2, 3)", "GROUP BY 1, 2, 3),\natt AS (SELECT * FROM att0 WHERE category <> 2)", 1)


@query(f"""WITH {_KEPT}, o AS (SELECT month, stage, row_number() OVER (PARTITION BY i.keyword, i.i ORDER BY pos) AS k FROM i JOIN st ON i.keyword = st.keyword AND i.i BETWEEN lo AND hi)
SELECT month, stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY month), 6) AS share FROM o WHERE k = 1 GROUP BY month, stage""")
def kept_stage_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of stages where one axis of the curation is left out (the jackknife's inner step)."""
    a = attention(spark, sf_dir).filter("category <> 2")
    n = A.stage_of(a, A.stage_intervals(a, "keyword", "month"), "keyword", "month").filter("stage is not null").groupBy("month", "stage").agg(F.count("*").alias("n"))
    total = n.groupBy("month").agg(F.sum("n").alias("t"))
    return n.join(total, "month").select("month", "stage", "n", r6(F.col("n") / F.col("t")).alias("share"))


@query(f"""WITH {_HEARS}, l AS (SELECT keyword, least(turn // 2, 9) AS bin, count(*) AS level FROM heard GROUP BY 1, 2), g AS (SELECT keyword, b AS bin FROM (SELECT DISTINCT keyword FROM heard), range(10) AS r(b)), f AS (SELECT keyword, bin, coalesce(level, 0) AS level FROM g LEFT JOIN l USING (keyword, bin))
SELECT keyword, bin::INT AS bin, level::BIGINT AS level, round(avg(level) OVER (PARTITION BY keyword ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM f""")
def keyword_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heard keywords over the course of the conversations, in bins of two turns, and the centred mean of three."""
    h = _heard(spark, sf_dir).select("keyword", F.least(F.col("turn"), F.lit(19)).alias("at"), F.lit(1).alias("one"))
    t = G.binned(h, "keyword", "at", "one", 2, 10)
    return t.select("keyword", "bin", F.col("level").cast("bigint").alias("level"), r6(F.col("smooth")).alias("smooth"))


@query()
def keyword_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords heard in the conversations, their timelines, and the robust fit of each: match, timeline and fit in one query."""
    h = _heard(spark, sf_dir).select("keyword", F.least(F.col("turn"), F.lit(19)).alias("at"), F.col("confidence").alias("one"))
    return S.robust_fits(G.binned(h, "keyword", "at", "one", 1, 20), "keyword", "bin", "smooth")
