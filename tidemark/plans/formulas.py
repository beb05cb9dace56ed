"""Queries of the scalar rules over catalogue entries: dates, texts, concept scores, constraints, sentiment, indicators' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions import calibration as B, columns as C, rules as R
from tidemark.functions.columns import r6
from tidemark.operators import curation as K
from tidemark.plans.bindings import STAGES, table

#: Notes by p_partkey % 7: the words the text rules look for, in several places.
NOTES = ("央视 2019年 official report", "品牌 消费 焦虑", "remix of old news 就业 争议", "压力 媒体 官方 政策", "起于 1999 年 的旧闻，人民日报 审查", "阶层 差异 新京报 " + "长" * 120 + " 2020年", "")
NOTE_SQL = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(NOTES)) + " END"
TEXT_SQL = f"(p_name || ' ' || lower(p_type) || ' ' || {NOTE_SQL})"


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    note = F.get(F.array(*map(F.lit, NOTES)), (F.col("p_partkey") % 7).cast("int"))
    return p.withColumn("text", F.concat_ws(" ", "p_name", F.lower("p_type"), note))


def any_of(words: list[str], text: str = TEXT_SQL) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# dates


_FORMS = """f AS (SELECT o_orderkey, o_orderkey % 7 AS form, date_trunc('month', o_orderdate)::DATE AS d FROM orders),
r AS (SELECT o_orderkey, CASE WHEN form IN (0, 1, 2, 6) THEN d WHEN form = 4 THEN make_date(year(d), 7, 1) ELSE make_date(year(d), 1, 1) END AS lo,
  CASE form WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN (d + INTERVAL 3 MONTH)::DATE WHEN 3 THEN make_date(year(d), 6, 1) WHEN 4 THEN make_date(year(d), 12, 1) WHEN 5 THEN make_date(year(d), 12, 1) END AS hi FROM f)"""


@query(f"""WITH {_FORMS} SELECT o_orderkey, coalesce(array_to_string(list_transform(range(lo, (hi + INTERVAL 1 MONTH)::DATE, INTERVAL 1 MONTH), lambda x: strftime(x, '%Y-%m')), ','), '') AS months FROM r""")
def date_text_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date texts in seven forms (month, month in words, range, half years, bare year, no date) to months."""
    d = F.trunc("o_orderdate", "month")
    y, m = F.year(d).cast("string"), F.month(d).cast("string")
    texts = (F.date_format(d, "yyyy-MM"), F.concat(y, F.lit("年"), m, F.lit("月")), F.concat(F.date_format(d, "yyyy-MM"), F.lit("至"), F.date_format(F.add_months(d, 3), "yyyy-MM")),
             F.concat(y, F.lit("年上半年")), F.concat(y, F.lit("年下半年")), y, F.lit("unknown"))
    text = F.get(F.array(*texts), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(R.year_months(text), ",").alias("months"))


@query("""SELECT o_orderkey, len(range(date_trunc('month', o_orderdate)::DATE, (date_trunc('month', o_orderdate) + INTERVAL (o_orderkey % 9 + 1) MONTH)::DATE, INTERVAL 1 MONTH))::INT AS n,
  strftime(date_trunc('month', o_orderdate) + INTERVAL (o_orderkey % 9) MONTH, '%Y-%m') AS last FROM orders""")
def months_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.trunc("o_orderdate", "month")
    span = R.months_between(F.date_format(d, "yyyy-MM"), F.date_format(F.add_months(d, (F.col("o_orderkey") % 9).cast("int")), "yyyy-MM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", span.alias("m")).select("o_orderkey", F.size("m").alias("n"), F.element_at("m", -1).alias("last"))


@query("""WITH e AS (SELECT event_id, ts, event_id % 3 AS kind FROM events)
SELECT event_id, CASE WHEN kind = 2 THEN NULL ELSE date_trunc('second', ts) END AS captured FROM e""")
def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a field, else from the file's name, else none."""
    from tidemark.sources.tables import captured_at

    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    kind = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("event_id", F.when(kind == 0, F.concat(stamp, F.lit("_tail"))).otherwise(F.lit("")).alias("field"), F.when(kind == 1, F.concat(F.lit("/in/cap_"), stamp, F.lit(".json"))).otherwise(F.lit("/in/none.json")).alias("path"))
    return e.select("event_id", captured_at("field", F.col("path")).cast("timestamp_ntz").alias("captured"))


_MUTATED = """n AS (SELECT p_name AS name, min(p_partkey) AS k, strftime(DATE '2015-01-01' + INTERVAL (min(p_partkey) % 60) MONTH, '%Y-%m') AS month FROM part GROUP BY 1)"""


@query(f"""WITH {_MUTATED}, e AS (SELECT name, strftime((month || '-01')::DATE + INTERVAL (unnest(range(0, 7))) MONTH, '%Y-%m') AS month FROM n),
m AS (SELECT name, month FROM n WHERE k % 2 = 0) SELECT DISTINCT name, month FROM (SELECT * FROM e UNION ALL SELECT * FROM m)""")
def mutation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of mutation events, the six that follow, and marked phases."""
    k = F.min("p_partkey")
    month = F.date_format(F.add_months(F.lit("2015-01-01").cast("date"), (F.col("k") % 60).cast("int")), "yyyy-MM")
    n = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(k.alias("k"))
    n = n.select("name", F.array(F.struct(month.alias("month"))).alias("mutations"), F.array(F.struct(F.when(F.col("k") % 2 == 0, "late remix").otherwise("plain").alias("phase"), month.alias("month"))).alias("phases"))
    return K.mutation_months(n, R.MUTATION_MARKERS)


# texts


def _named(word: str) -> str:
    window = f"substr(text, greatest(instr(text, '{word}') - 50, 1)::INT, (least(instr(text, '{word}') - 1, 50) + 100)::INT)"
    return f"CASE WHEN instr(text, '{word}') > 0 THEN nullif(regexp_extract({window}, '([0-9]{{4}})\\s*年', 1), '') END"


@query(f"""WITH t AS (SELECT p_partkey, {TEXT_SQL} AS text FROM part)
SELECT p_partkey, {any_of(R.INSTITUTION_WORDS, 'text')} AS institutional, coalesce(coalesce({', '.join(map(_named, R.INSTITUTION_WORDS))}) || '-01', '') AS month FROM t""")
def institutional_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text names an institution, and since when."""
    t, text = noted(spark, sf_dir), F.col("text")
    return t.select("p_partkey", R.institutional(text).alias("institutional"), F.coalesce(R.institutional_month(text), F.lit("")).alias("month"))


_ANCHORS = ("cold", "widget", "promo", "official", "report")


@query(f"""WITH h AS (SELECT p_partkey, [{', '.join(f"contains({TEXT_SQL}, '{a}')::INT" for a in _ANCHORS)}] AS h FROM part)
SELECT p_partkey, round(least(list_sum(h) / {len(_ANCHORS)} + least((h[1] * h[2] + h[2] * h[3] + h[3] * h[4] + h[4] * h[5]) * 0.05, 0.2), 1.0), 6)::DOUBLE AS score FROM h""")
def concept_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soft score of one concept's anchors in an entry's joined texts."""
    return noted(spark, sf_dir).select("p_partkey", r6(C.soft_score(F.col("text"), F.array(*map(F.lit, _ANCHORS)))).alias("score"))


@query("SELECT DISTINCT p_name, array_to_string(list_sort(list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2)))), '|') AS grams FROM part")
def name_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.array_join(F.sort_array(C.bigrams(F.col("p_name"))), "|").alias("grams"))


def _level(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(words)} THEN {x}" for x, words in R.SOCIAL_WORDS[name]) + f" ELSE {R.SOCIAL[name][1]} END::DOUBLE AS {name}"


@query(f"SELECT p_partkey, {', '.join(map(_level, R.SOCIAL_WORDS))} FROM part")
def social_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Economic stress, polarisation and censorship by the words of what set a narrative off."""
    return noted(spark, sf_dir).select("p_partkey", R.social_context(F.col("text")).alias("s")).select("p_partkey", "s.*")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name || ' ' || p_name || ' ' || p_name, 1, 30) ELSE 'plain ' || p_name END AS name FROM part""")
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of folders' names: between a number and an identifier, else the title without its brackets."""
    n = F.col("p_name")
    forms = (F.concat(F.lit("【guide】title - 1. "), n, F.lit(" (Av12)")), F.concat(F.lit("【a】"), n, F.lit(" "), n, F.lit(" "), n, F.lit("【b】 - 2."), n), F.concat(F.lit("plain "), n))
    folder = F.get(F.array(*forms), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", K.name_of_folder(folder).alias("name"))


_TAGS = ("n", "nr", "v", "vd", "a", "ad", "d", "r", "m", "x", "c", "cc", "p", "uj", "uz", "u", "mq")
_CLASS = (
    "CASE " + " ".join(f"WHEN tag[1] = '{k}' THEN '{v}'" for k, v in R.TAG_CLASSES.items())
    + f" WHEN tag = 'c' THEN 'connective' WHEN tag IN ({', '.join(repr(t) for t in R.PARTICLES)}) THEN 'particle' WHEN tag[1] = 'm' THEN 'numeral' ELSE 'other' END"
)


@query(f"""WITH t AS (SELECT [{', '.join(f"'{t}'" for t in _TAGS)}][l_partkey % {len(_TAGS)} + 1] AS tag FROM lineitem), c AS (SELECT {_CLASS} AS class, count(*) AS n FROM t GROUP BY 1), s AS (SELECT class, n, n / sum(n) OVER () AS share FROM c)
SELECT class, n, round(share, 6) AS share, round((SELECT sum(-share * ln(share)) FROM s), 6) AS entropy FROM s""")
def tag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse word classes of tags: counts, shares and the distribution's entropy."""
    tags = table(spark, sf_dir, "lineitem").select(F.get(F.array(*map(F.lit, _TAGS)), (F.col("l_partkey") % len(_TAGS)).cast("int")).alias("tag"))
    return K.tag_distribution(tags, "tag").select("class", "n", r6(F.col("share")).alias("share"), r6(F.col("entropy")).alias("entropy"))


# concept scores and constraints


CONCEPTS = tuple(f"c{k}" for k in range(6))
WEIGHTS = {"economic": {"c0": 1.0, "c1": -0.5}, "control": {"c2": 0.8, "c3": 0.4}, "media": {"c4": -1.0, "c0": 0.3}, "split": {"c5": 0.6, "c2": -0.2}, "tech": {"c1": 0.5, "c3": 0.5, "c5": 0.5}}
GROUPS = {"a": ["c0", "c1"], "b": ["c2", "c3", "c4"], "c": ["c5"]}
_SCORE = {c: f"((p_partkey * {k + 3}) % 11 / 10.0::DOUBLE)" for k, c in enumerate(CONCEPTS)}


def concept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.withColumn("scores", F.create_map(*(x for k, c in enumerate(CONCEPTS) for x in (F.lit(c), F.col("p_partkey") * (k + 3) % 11 / F.lit(10.0)))))


def _weighted(w: dict[str, float]) -> str:
    return " + ".join(f"({v}::DOUBLE * {_SCORE[k]})" for k, v in w.items())


_LINEAR = {a: f"round(least(greatest(0.5 + 0.4 * ({_weighted(w)}) / {sum(map(abs, w.values()))}, 0.1), 0.9)::DOUBLE, 6)" for a, w in WEIGHTS.items()}
_NAMED = sorted({c for w in R.CONSTRAINT_WEIGHTS.values() for c in w})
_NAMED_SCORE = {c: f"((p_partkey * {k + 3}) % 11 / 20.0::DOUBLE)" for k, c in enumerate(_NAMED)}


def _curved(w: dict[str, float]) -> str:
    total = " + ".join(f"({v}::DOUBLE * {_NAMED_SCORE[k]})" for k, v in w.items())
    return f"round((0.05 + 0.9 / (1 + exp(-6 * (least(greatest({total} + 0.5, 0.0), 1.0) - 0.5))))::DOUBLE, 6)"


@query("SELECT p_partkey, " + ", ".join(f"{x} AS {a}" for a, x in _LINEAR.items()) + " FROM part")
def constraint_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = concept_scores(spark, sf_dir).select("p_partkey", R.constraint_of(F.col("scores"), WEIGHTS).alias("x"))
    return s.select("p_partkey", *(r6(F.col("x")[i]).alias(a) for i, a in enumerate(WEIGHTS)))


@query("SELECT p_partkey, " + ", ".join(f"{_curved(w)} AS {a}" for a, w in R.CONSTRAINT_WEIGHTS.items()) + " FROM part")
def constraint_squashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint axes from the scores of the concepts that weigh on them."""
    scores = F.create_map(*(x for k, c in enumerate(_NAMED) for x in (F.lit(c), F.col("p_partkey") * (k + 3) % 11 / F.lit(20.0))))
    s = table(spark, sf_dir, "part").select("p_partkey", R.squashed(scores).alias("x"))
    return s.select("p_partkey", *(r6(F.col("x")[i]).alias(a) for i, a in enumerate(R.CONSTRAINT_WEIGHTS)))


@query("SELECT p_partkey, " + ", ".join(f"round(({' + '.join(_SCORE[c] for c in names)}) / {len(names)}, 3) AS {g}" for g, names in GROUPS.items()) + " FROM part")
def concept_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = concept_scores(spark, sf_dir).select("p_partkey", R.group_means(F.col("scores"), GROUPS).alias("x"))
    return s.select("p_partkey", *(F.col("x")[i].alias(g) for i, g in enumerate(GROUPS)))


@query("SELECT p_partkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {x} > 0.3 THEN '{c}' END" for c, x in _SCORE.items()) + "], lambda x: x IS NOT NULL), ',') AS active FROM part")
def active_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept_scores(spark, sf_dir).select("p_partkey", F.array_join(R.active_concepts(F.col("scores")), ",").alias("active"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0 WHEN p_partkey % 4 = 2 THEN 22 ELSE 3 END::INT AS n, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE round((p_partkey % 10) / 10.0, 6)::DOUBLE END AS first FROM part""")
def reply_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from replies: plain JSON, fenced JSON, at least twenty name-number pairs, or nothing usable."""
    v = F.format_string("%.1f", F.col("p_partkey") % 10 / F.lit(10.0))
    plain = F.concat(F.lit('{"aa": '), v, F.lit(', "bb": 0.5, "cc": 0.25}'))
    fenced = F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n```\nDone."))
    names = ["aa", *(f"k{chr(97 + i)}" for i in range(21))]
    pairs = F.concat(F.lit("scores - "), *(x for i, n in enumerate(names) for x in (F.lit(f"{n}: "), v if i == 0 else F.lit(f"0.{i % 10}"), F.lit("; "))))
    text = F.get(F.array(plain, fenced, pairs, F.lit("no numbers here")), (F.col("p_partkey") % 4).cast("int"))
    s = table(spark, sf_dir, "part").select("p_partkey", R.parsed_scores(text).alias("s"))
    return s.select("p_partkey", F.when(F.col("s").isNotNull(), F.size("s")).otherwise(0).alias("n"), r6(F.try_element_at("s", F.lit("aa"))).alias("first"))


_CON = [f"((p_partkey * {k + 1}) % 10 / 10.0::DOUBLE)" for k in range(5)]
_DELTAS = "m(src, dst, d) AS (VALUES " + ", ".join(f"('{a}', '{b}', [{', '.join(f'{x}::DOUBLE' for x in d)}])" for (a, b), d in R.PHASE_DELTA.items()) + ")"
_STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
_LEVELS = {"economic": "(p_size % 11 / 10.0::DOUBLE)", "polarization": "(p_partkey % 11 / 10.0::DOUBLE)", "censorship": "((p_partkey + p_size) % 11 / 10.0::DOUBLE)"}


def _delta(i: int) -> str:
    return f"round(coalesce(d[{i}], 0) + " + " + ".join(f"({w[i - 1]}::DOUBLE * ({k} - {neutral}))" for k, (neutral, _, w) in R.SOCIAL.items()) + ", 9)"


_DAMPED = ", ".join(f"{_delta(i)} * CASE WHEN (c[{i}] > 0.8 AND {_delta(i)} > 0) OR (c[{i}] < 0.2 AND {_delta(i)} < 0) THEN 0.3 ELSE 1 END" for i in range(1, 6))
_MOVED = ", ".join(f"round(least(greatest(c[{i}] + least(greatest(e[{i}], -0.4), 0.4), 0.0), 1.0)::DOUBLE, 6) AS x{i}" for i in range(1, 6))


@query(f"""WITH {_DELTAS}, p AS (SELECT p_partkey, [{', '.join(_CON)}] AS c, {_STAGE_LIST}[p_size % 5 + 1] AS src, {_STAGE_LIST}[(p_size + 1 + p_partkey % 3) % 5 + 1] AS dst, {', '.join(f'{x} AS {k}' for k, x in _LEVELS.items())} FROM part),
q AS (SELECT p_partkey, src, dst, c, [{_DAMPED}] AS e FROM p LEFT JOIN m USING (src, dst)) SELECT p_partkey, src, dst, {_MOVED} FROM q""")
def phase_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints after a phase move under a social context, damped near the ends."""
    k, s = F.col("p_partkey"), F.col("p_size")
    stage = lambda i: F.get(F.array(*map(F.lit, STAGES)), i.cast("int"))
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.array(*(k * (i + 1) % 10 / F.lit(10.0) for i in range(5))).alias("c"), stage(s % 5).alias("src"), stage((s + 1 + k % 3) % 5).alias("dst"),
        (s % 11 / F.lit(10.0)).alias("economic"), (k % 11 / F.lit(10.0)).alias("polarization"), ((k + s) % 11 / F.lit(10.0)).alias("censorship"),
    )
    x = R.moved(F.col("c"), F.col("src"), F.col("dst"), economic=F.col("economic"), polarization=F.col("polarization"), censorship=F.col("censorship"))
    return p.withColumn("x", x).select("p_partkey", "src", "dst", *(r6(F.col("x")[i]).alias(f"x{i + 1}") for i in range(5)))


@query(f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [{', '.join(_CON)}] END AS stored, CASE WHEN p_partkey % 5 = 0 THEN [0.4, 0.4, 0.41]::DOUBLE[] ELSE [{', '.join(_CON[1:4])}] END AS soft FROM part),
v AS (SELECT *, sqrt(list_sum(list_transform(soft, lambda x: (x - list_avg(soft)) * (x - list_avg(soft)))) / len(soft)) > 0.03 AS varied FROM p)
SELECT p_partkey, CASE WHEN stored IS NOT NULL THEN 'stored' WHEN varied THEN 'soft' ELSE 'default' END AS origin, round(list_sum(coalesce(stored, CASE WHEN varied THEN soft END, [0.5, 0.5, 0.5]::DOUBLE[])), 6) AS total FROM v""")
def constraint_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scores first, then soft scores that vary enough, then the category's default."""
    con = [F.col("p_partkey") * (k + 1) % 10 / F.lit(10.0) for k in range(5)]
    default = F.array(*(F.lit(0.5) for _ in range(3)))
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.array(*con)).alias("stored"), F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit(0.4), F.lit(0.4), F.lit(0.41))).otherwise(F.array(*con[1:4])).alias("soft"))
    p = p.withColumn("x", K.priority(F.col("stored"), F.col("soft"), default))
    origin = F.when(F.col("stored").isNotNull(), "stored").when(F.col("x") == F.col("soft"), "soft").otherwise("default")
    return p.select("p_partkey", origin.alias("origin"), r6(C.vsum(F.col("x"))).alias("total"))


# sentiment


_ARC = """v AS (SELECT p_partkey, p_brand, p_size, list_transform(range(0, (1 + p_size % 6)::BIGINT), lambda j: (p_partkey * (j + 2) * 7 + p_size * j) % 10 / 10.0::DOUBLE) AS v FROM part),
s AS (SELECT *, len(v) AS n, list_avg(v[1 : len(v) // 2]) AS f, list_avg(v[len(v) // 2 + 1 :]) AS g, CASE WHEN len(v) >= 3 THEN v[len(v) // 2 + 1] ELSE v[1] END AS m, list_transform(range(2, len(v) + 1), lambda i: round(v[i] - v[i - 1], 9)) AS d FROM v),
t AS (SELECT *, round(g - f, 9) AS rise, round(m - (f + g) / 2, 9) AS bulge, coalesce(list_sum(list_transform(range(2, len(d) + 1), lambda i: abs(sign(d[i]) - sign(d[i - 1])))), 0) / 2 AS turns FROM s),
arc AS (SELECT p_partkey, p_brand, v, CASE WHEN n < 2 THEN 'stable' WHEN turns >= 2 THEN 'oscillating' WHEN abs(rise) < 0.03 AND abs(bulge) < 0.03 THEN 'stable' WHEN list_min(d) >= -0.01 THEN 'monotonic_up' WHEN list_max(d) <= 0.01 THEN 'monotonic_down'
  WHEN bulge > 0.05 THEN CASE WHEN rise < 0 THEN 'inverted_U' ELSE 'rise_fall' END WHEN bulge < -0.05 THEN CASE WHEN rise > 0 THEN 'U_shape' ELSE 'fall_rise' END WHEN rise < 0 THEN 'rise_fall' ELSE 'fall_rise' END AS arc,
  coalesce(list_sum(list_transform(range(0, 5), lambda k: CASE WHEN list_sum(list_transform(v, lambda x: (least(floor(x * 5), 4) = k)::INT)) > 0
    THEN -(list_sum(list_transform(v, lambda x: (least(floor(x * 5), 4) = k)::INT)) / n) * ln(list_sum(list_transform(v, lambda x: (least(floor(x * 5), 4) = k)::INT)) / n) ELSE 0 END)), 0) / ln(5) AS e FROM t)"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, p_brand, v, arc, e): intensities of an entry's phases, their shape and entropy."""
    n = F.col("p_size") % 6
    v = F.transform(F.sequence(F.lit(0), n), lambda j: (F.col("p_partkey") * (j + 2) * 7 + F.col("p_size") * j) % 10 / F.lit(10.0))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", v.alias("v"))
    return p.withColumn("arc", R.sentiment_arc(F.col("v"))).withColumn("e", R.sentiment_entropy(F.col("v")))


@query(f"WITH {_ARC} SELECT p_partkey, arc, round(e, 6) AS entropy FROM arc")
def sentiment_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcs(spark, sf_dir).select("p_partkey", "arc", r6(F.col("e")).alias("entropy"))


@query(f"WITH {_ARC}, n AS (SELECT arc, count(*) AS n, avg(e) AS e FROM arc GROUP BY arc) SELECT arc, n, round(n / sum(n) OVER (), 6) AS share, round(e, 6) AS entropy FROM n")
def arc_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arcs(spark, sf_dir).groupBy("arc").agg(F.count("*").alias("n"), F.avg("e").alias("e"))
    return a.join(a.agg(F.sum("n").alias("t"))).select("arc", "n", r6(F.col("n") / F.col("t")).alias("share"), r6(F.col("e")).alias("entropy"))


@query(f"WITH {_ARC} SELECT p_brand, count(*) AS n, round(avg(e), 6) AS entropy, round(stddev_pop(e), 6) AS sd FROM arc GROUP BY p_brand")
def entropy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcs(spark, sf_dir).groupBy("p_brand").agg(F.count("*").alias("n"), r6(F.avg("e")).alias("entropy"), r6(F.stddev_pop("e")).alias("sd"))


# spread and indicators' labels


@query("""WITH c AS (SELECT p_partkey, p_size % 10 / 10.0::DOUBLE AS a, p_partkey % 7 / 7.0::DOUBLE AS b FROM part), s AS (SELECT p_partkey, a * (1 - b) AS s, a * b AS i, 1 - a AS r FROM c)
SELECT p_partkey, round(CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END + CASE WHEN i > 0 THEN -i * ln(i) ELSE 0 END + CASE WHEN r > 0 THEN -r * ln(r) ELSE 0 END, 6) AS entropy FROM s""")
def state_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of susceptible, infected and recovered shares."""
    a, b = F.col("p_size") % 10 / F.lit(10.0), F.col("p_partkey") % 7 / F.lit(7.0)
    c = table(spark, sf_dir, "part").select("p_partkey", (a * (1 - b)).alias("s"), (a * b).alias("i"), (1 - a).alias("r"))
    return c.select("p_partkey", r6(R.sir_entropy(F.col("s"), F.col("i"), F.col("r"))).alias("entropy"))


_IND = "i AS (SELECT p_partkey, p_partkey % 21 / 20.0::DOUBLE AS inertia, p_size % 11 / 10.0::DOUBLE AS resilience, (p_partkey + p_size) % 11 / 10.0::DOUBLE AS sensitivity, p_size % 4 / 10.0::DOUBLE AS origin, p_partkey % 3 / 10.0::DOUBLE AS emergence, p_partkey % 6 / 10.0::DOUBLE AS fixation, p_size % 4 AS regime, p_partkey % 40 AS dwell FROM part)"


def indicator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", (k % 21 / F.lit(20.0)).alias("inertia"), (s % 11 / F.lit(10.0)).alias("resilience"), ((k + s) % 11 / F.lit(10.0)).alias("sensitivity"),
                                               (s % 4 / F.lit(10.0)).alias("origin"), (k % 3 / F.lit(10.0)).alias("emergence"), (k % 6 / F.lit(10.0)).alias("fixation"), (s % 4).alias("regime"), (k % 40).alias("dwell"))


@query(f"""WITH {_IND} SELECT p_partkey, CASE WHEN inertia > 0.6 AND resilience < 0.3 AND sensitivity > 0.4 THEN 'metastable' WHEN inertia > 0.5 AND resilience < 0.5 THEN 'rigid' ELSE 'balanced' END AS diagnosis,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN inertia > 0.65 THEN 'high inertia' END, CASE WHEN sensitivity > 0.60 THEN 'high sensitivity' END,
    CASE WHEN regime = 2 AND dwell > 24 THEN 'dwell of ' || dwell || ' months' END], lambda x: x IS NOT NULL), '; '), ''), 'none') AS risks,
  (inertia > 0.85)::INT + (resilience < 0.15)::INT + (sensitivity > 0.70)::INT >= 2 AS out_of_domain FROM i""")
def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, r, s = F.col("inertia"), F.col("resilience"), F.col("sensitivity")
    return indicator_rows(spark, sf_dir).select("p_partkey", R.diagnosis(i, r, s).alias("diagnosis"), R.risks(i, s, F.col("regime"), F.col("dwell")).alias("risks"), R.out_of_domain(i, r, s).alias("out_of_domain"))


@query(f"""WITH {_IND}, x AS (SELECT p_partkey, 0.4 * least(greatest(fixation / (greatest(origin + emergence, 0.01) + fixation + 0.05), 0), 1) + 0.3 * greatest(0, sensitivity - 0.5) + 0.3 * fixation AS x FROM i)
SELECT p_partkey, round(x::DOUBLE, 6) AS inertia, CASE WHEN x > 0.65 THEN 'high' WHEN x > 0.40 THEN 'medium' ELSE 'low' END AS label FROM x""")
def inertia_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.inertia(F.col("origin"), F.col("emergence"), F.col("fixation"), F.col("sensitivity") - 0.5)
    return indicator_rows(spark, sf_dir).select("p_partkey", x.alias("x")).select("p_partkey", r6(F.col("x")).alias("inertia"), R.three_way(F.col("x"), 0.65, 0.40).alias("label"))


_SEEN = {"own": "(p_partkey % 21 - 10) / 10.0", "ord": "p_size % 11 / 10.0", "con": "p_partkey % 11 / 10.0", "tro": "p_size % 7 / 20.0", "cdc": "p_partkey % 5 / 10.0", "rsl": "p_size % 10 / 10.0", "inf": "p_partkey % 6 / 10.0"}
_GONE = {"own": 4, "ord": 5, "con": 6, "tro": 7, "cdc": 8, "rsl": 2, "inf": 3}  # each signal is absent where p_partkey % this is 1
_WAYS = ("early", "early_maj", "late_maj", "laggard", "never", "resister")
_OBSERVED = (
    "o AS (SELECT p_partkey AS id, " + ", ".join(f"CASE WHEN p_partkey % {_GONE[n]} <> 1 THEN ({x})::DOUBLE END AS {n}" for n, x in _SEEN.items())
    + f", list_transform(range(0, (p_size % 5)::BIGINT), lambda j: [{', '.join(repr(w) for w in _WAYS)}][((p_partkey * (1 + j) + p_size) % 6 + 1)::BIGINT]) AS ways, p_partkey % 3 = 0 AS sen FROM part)"
)


def _profile(observed: str) -> str:
    """The calibration in SQL: observed is (id, own, ord, con, tro, cdc, rsl, inf, ways, sen)."""
    of = lambda *w: f"len(list_filter(ways, lambda x: x IN ({', '.join(repr(x) for x in w)})))::DOUBLE / nullif(len(ways), 0)"
    kernel = ", ".join(f"coalesce(list_sum(list_transform(vs, lambda x: x.w * exp(-((x.v - ({c})) ** 2) / (2 * {B.KERNEL} ** 2)))), 0)" for c in B.BINS)
    centres = f"[{', '.join(map(str, B.BINS))}]"
    return f"""{observed},
a AS (SELECT *, {of(*B.EARLY)} AS early, {of(B.RESISTER)} AS resist, {of(B.NEVER)} AS never FROM o),
b AS (SELECT *, list_filter([{{'v': own, 'w': 3.0::DOUBLE}}, {{'v': CASE WHEN ord IS NOT NULL THEN least(greatest(ord * 1.2 - 0.1, -1), 1) END::DOUBLE, 'w': 1.5}}, {{'v': CASE WHEN con IS NOT NULL THEN least(greatest(con * 0.8 - 0.1, -1), 1) END::DOUBLE, 'w': 1.0}},
  {{'v': CASE WHEN tro > 0.15 THEN tro * -2 END::DOUBLE, 'w': 1.5}}, {{'v': CASE WHEN cdc IS NOT NULL THEN least(greatest(cdc * -1.5, -1), 1) END::DOUBLE, 'w': 1.0}}, {{'v': CASE WHEN early > 0.5 THEN 0.4 END::DOUBLE, 'w': 1.0}}, {{'v': CASE WHEN resist > 0.3 THEN -0.3 END::DOUBLE, 'w': 1.0}}], lambda x: x.v IS NOT NULL) AS vs,
  [0.3::DOUBLE, CASE WHEN ord > 0.6 AND con > 0.6 AND coalesce(tro, 1) < 0.15 THEN 0.4 ELSE 0 END, CASE WHEN tro > 0.15 THEN tro * 1.5 ELSE 0 END + CASE WHEN cdc > 0.4 THEN 0.3 ELSE 0 END + CASE WHEN resist > 0.3 THEN 0.3 ELSE 0 END,
   CASE WHEN coalesce(ord, 0.5) < 0.3 AND coalesce(tro, 0) < 0.1 THEN 0.5 ELSE 0 END + CASE WHEN never > 0.6 THEN 0.4 ELSE 0 END] AS scores, coalesce(ord, con, tro, cdc) IS NOT NULL AS signals FROM a),
c AS (SELECT *, [{kernel}] AS raw, list_transform(scores, lambda x: round(x / (list_sum(scores) + 1e-10), 3)) AS roles,
  CASE WHEN len(vs) > 0 THEN least(greatest(list_sum(list_transform(vs, lambda x: x.v * x.w)) / list_sum(list_transform(vs, lambda x: x.w)), -1), 1) ELSE 0 END AS lean,
  CASE WHEN len(vs) > 0 THEN sqrt(list_sum(list_transform(vs, lambda x: (x.v - list_avg(list_transform(vs, lambda y: y.v))) ** 2)) / len(vs)) ELSE 0.5 END AS off FROM b),
d AS (SELECT *, list_transform(raw, lambda x: x / (list_sum(raw) + 1e-10)) AS p, [{', '.join(repr(r) for r in B.ROLES)}][list_position(roles, list_max(roles))] AS role FROM c),
e AS (SELECT *, list_sum(list_transform(range(1, 6), lambda i: p[i] * {centres}[i])) AS mean FROM d)
SELECT id, round(mean, 3) + 0.0 AS position, round(sqrt(list_sum(list_transform(range(1, 6), lambda i: p[i] * ({centres}[i] - mean) ** 2))), 3) AS position_sd,
  {', '.join(f"CASE WHEN p[{i}] > {B.NEGLIGIBLE} THEN round(p[{i}], 4) ELSE 0 END AS p{i}" for i in range(1, 6))}, {', '.join(f"roles[{i + 1}] AS {r}" for i, r in enumerate(B.ROLES))}, role,
  round(coalesce(rsl, CASE WHEN signals THEN least(greatest(coalesce(con, 0.5) * 0.7 + (1 - coalesce(cdc, 0.3)) * 0.3, 0.1), 0.95) END, 0.5)::DOUBLE, 3) AS resilience,
  round(coalesce(inf, CASE WHEN signals THEN least(greatest(coalesce(ord, 0.5) * 0.15 + coalesce(tro, 0.05) * 0.2, 0.02), 0.5) END, 0.1)::DOUBLE, 3) AS influence,
  CASE WHEN lean > 0.25 THEN 'early_adopter' WHEN lean > -0.25 THEN 'follower' ELSE 'resister' END AS pattern, round((0.5 + 0.3 * mean)::DOUBLE, 3) AS susceptibility,
  CASE WHEN off < 0.15 THEN 'stable' WHEN off < 0.35 THEN 'oscillating' ELSE 'drifting' END AS stability,
  round(least(greatest(0.4 * least(1.0, ((coalesce(own, 0) <> 0)::INT + signals::INT + (len(ways) > 0)::INT + sen::INT) / 4) + 0.4 * (1 - least(1.0, off / 0.5)) + 0.2 * CASE WHEN role <> 'normal' THEN 1.0 ELSE 0.5 END, 0.1), 0.95)::DOUBLE, 3) AS confidence FROM e"""


def _flat(profile, *more):
    x = lambda c: F.col(f"x.{c}")
    return profile.select(
        *more, (x("position") + F.lit(0.0)).alias("position"), "x.position_sd", *(F.coalesce(x("posterior")[i], F.lit(0.0)).alias(f"p{i + 1}") for i in range(5)),
        *(x("roles")[i].alias(r) for i, r in enumerate(B.ROLES)), "x.role", "x.resilience", "x.influence", "x.pattern", "x.susceptibility", "x.stability", "x.confidence",
    )


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as individuals: what can be seen of them, each signal absent for some."""
    k, s = F.col("p_partkey"), F.col("p_size")
    value = {"own": (k % 21 - 10) / F.lit(10.0), "ord": s % 11 / F.lit(10.0), "con": k % 11 / F.lit(10.0), "tro": s % 7 / F.lit(20.0), "cdc": k % 5 / F.lit(10.0), "rsl": s % 10 / F.lit(10.0), "inf": k % 6 / F.lit(10.0)}
    way = lambda j: F.get(F.array(*map(F.lit, _WAYS)), ((k * (1 + j) + s) % 6).cast("int"))
    ways = F.when(s % 5 > 0, F.transform(F.sequence(F.lit(0), F.greatest(s % 5 - 1, F.lit(0))), way)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(k.alias("id"), *(F.when(k % _GONE[n] != 1, x).alias(n) for n, x in value.items()), ways.alias("ways"), (k % 3 == 0).alias("sen"))


@query(f"WITH {_profile(_OBSERVED)}")
def calibrated_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct calibration whole: posterior, leaning, roles, and what follows from them."""
    c = F.col
    made = B.profile(c("own"), c("ord"), c("con"), c("tro"), c("cdc"), c("ways"), c("rsl"), c("inf"), c("sen"))
    return _flat(observed(spark, sf_dir).select("id", made.alias("x")), "id")


@query(f"SELECT id AS p_partkey, round(CASE WHEN len(vs) > 0 THEN lean ELSE 0 END, 6) + 0.0 AS axis FROM (WITH {_profile(_OBSERVED).rsplit('SELECT id', 1)[0]} SELECT * FROM e)")
def calibrated_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct calibration's weighted votes."""
    c = F.col
    lean = B.leaning(B.votes(c("own"), c("ord"), c("con"), c("tro"), c("cdc"), c("ways")))
    return observed(spark, sf_dir).select(c("id").alias("p_partkey"), (r6(lean) + F.lit(0.0)).alias("axis"))


_SCENES = "o AS (SELECT p_partkey AS id, s.*, NULL::DOUBLE AS rsl, NULL::DOUBLE AS inf, false AS sen FROM part JOIN (VALUES " + ", ".join(
    f"({i}, {', '.join(f'{x}::DOUBLE' for x in v[:5])}, [{', '.join(repr(w) for w in v[5])}])" for i, v in enumerate(B.SCENARIOS.values())
) + ") AS s(kind, own, ord, con, tro, cdc, ways) ON kind = p_partkey % 4)"


@query(f"WITH {_profile(_SCENES)}")
def agent_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of individuals of whom only a scenario is known."""
    name = F.get(F.array(*map(F.lit, B.SCENARIOS)), (F.col("p_partkey") % 4).cast("int"))
    # a scenario's profile is the same for all of whom it is known: made once for each, then looked up
    known = spark.createDataFrame([(s,) for s in B.SCENARIOS], "name string").select("name", B.scenario(F.col("name")).alias("x"))
    people = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return _flat(people.join(F.broadcast(known), "name", "left"), "id")


@query("SELECT vec_id, unnest(range(1, len(embedding) + 1))::INT AS i, round(unnest(embedding)::DOUBLE, 4) AS x FROM embeddings")
def rounded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a JSON sink stores them: rounded."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(C.rounded(F.col("embedding"), 4)).alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("i"), "x")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_size > 45 THEN 18.0 WHEN p_size % 10 = 0 THEN 3.0 ELSE p_size % 24 + 1.0 END::DOUBLE AS months, (p_size % 7 + 1)::DOUBLE AS circles, (p_retailprice % 100) / 100 AS peak FROM part),
x AS (SELECT *, 0.03 + 0.89 / (1 + exp(-6 * (0.5 * least(greatest((circles - 1) / 6, 0), 1) + 0.3 * least(greatest(peak, 0), 1) + 0.2 * least(greatest(months / 48, 0), 1) - 0.5))) AS x FROM p)
SELECT p_partkey, round(months * 30, 6) AS days, round(2 / greatest(months * 30, 1), 6) AS gamma, round(CASE WHEN x >= 0.99 THEN 10 WHEN x <= 0.001 THEN 0.1 ELSE -0.999 * ln(greatest(1e-12, 1 - x / 0.999)) / x END, 6) AS r0 FROM x""")
def curated_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread estimates of curated entries: no duration counts as three months, an endless one (999 or more) as eighteen."""
    s = F.col("p_size")
    stored = F.when(s > 45, 999.0 + s).when(s % 10 == 0, None).otherwise(s % 24 + 1.0)
    p = table(spark, sf_dir, "part").select("p_partkey", K.duration_months(stored).alias("months"), (s % 7 + 1).cast("double").alias("circles"), (F.col("p_retailprice") % 100 / 100).alias("peak"))
    x = R.total_infected(F.col("circles"), F.col("peak"), F.col("months"))
    return p.select("p_partkey", r6(F.col("months") * 30).alias("days"), r6(R.gamma_of(F.col("months") * 30)).alias("gamma"), r6(R.r0_of(x)).alias("r0"))


_STATE = """s AS (SELECT p_partkey, CASE WHEN r0 > 1.5 AND c BETWEEN -0.4 AND 0.1 THEN 'constructive_irony' WHEN r0 > 1.5 AND c < -0.4 THEN 'aggressive_venting' WHEN r0 > 1.0 AND c < -0.5 THEN 'nihilistic_retreat'
  WHEN r0 > 1.0 AND c > 0.2 THEN 'identity_construction' WHEN c BETWEEN -0.2 AND 0.2 THEN 'neutral_entertainment' END AS state
  FROM (SELECT p_partkey, (p_size % 9) / 4.0::DOUBLE AS r0, (p_partkey % 23 - 11) / 12.0::DOUBLE AS c FROM part))"""


@query(f"""WITH {_STATE}, n AS (SELECT state, count(*) AS n FROM s GROUP BY 1), m(src, dst) AS (VALUES ('constructive_irony', 'aggressive_venting'), ('aggressive_venting', 'nihilistic_retreat'), ('nihilistic_retreat', 'constructive_irony'), ('identity_construction', 'constructive_irony'))
SELECT src, dst, coalesce(a.n, 0)::BIGINT AS here, coalesce(b.n, 0)::BIGINT AS there FROM m LEFT JOIN n a ON src = a.state LEFT JOIN n b ON dst = b.state""")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moves between collective states, with how many entries are in either one."""
    state = R.collective_state(F.col("p_size") % 9 / F.lit(4.0), (F.col("p_partkey") % 23 - 11) / F.lit(12.0))
    n = table(spark, sf_dir, "part").groupBy(state.alias("state")).agg(F.count("*").alias("n")).filter("state is not null")
    m = R.state_moves(spark).join(n.select(F.col("state").alias("src"), F.col("n").alias("here")), "src", "left")
    return m.join(n.select(F.col("state").alias("dst"), F.col("n").alias("there")), "dst", "left").na.fill(0).select("src", "dst", "here", "there")


@query(f"WITH {_STATE} SELECT coalesce(state, 'none') AS state, count(*) AS n FROM s GROUP BY 1")
def collective_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = R.collective_state(F.col("p_size") % 9 / F.lit(4.0), (F.col("p_partkey") % 23 - 11) / F.lit(12.0))
    return table(spark, sf_dir, "part").groupBy(F.coalesce(state, F.lit("none")).alias("state")).agg(F.count("*").alias("n"))
