"""Queries of look-ups, filters, matching, ordered limits and the ledger over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import r6
from tidemark.operators import attention as A, curation as K, ledger as L, matching as M, semantic as S, signals as G, validation as V, windows as W
from tidemark.plans.bindings import ATT, AXIS, SIG, VEC, attention, axis, regime_sequence, signals, table, vectors
from tidemark.plans.rules import _X, curated
from tidemark.streaming import jobs

# look-ups


_KNOWN = ("red widget", "BLUE BOLT", "shiny thing")


def sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two catalogues (name, aliases, record): names with their upper-case forms as aliases, and types."""
    p = table(spark, sf_dir, "part")
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k")).select("name", F.array(F.upper("name")).alias("aliases"), F.col("k").cast("string").alias("record"))
    kinds = p.groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n")).select("name", F.array(F.lit("shiny thing")).alias("aliases"), F.col("n").cast("string").alias("record"))
    return [names, kinds]


@query("""WITH n AS (SELECT p_name AS name, min(p_partkey)::VARCHAR AS record FROM part GROUP BY 1), k AS (SELECT p_type AS name, count(*)::VARCHAR AS record FROM part GROUP BY 1),
h AS (SELECT a AS asked, 0 AS source, name, record FROM n, (VALUES ('red widget'), ('BLUE BOLT'), ('shiny thing')) AS v(a) WHERE name = a OR upper(name) = a UNION ALL SELECT 'shiny thing', 1, name, record FROM k)
SELECT asked, source, name, record FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY source, name) AS r FROM h) WHERE r = 1""")
def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name, an alias, and a name that only the second catalogue knows: the first record of each."""
    both = sources(spark, sf_dir)
    out = None
    for name in _KNOWN:
        hit = K.look_up(name, *both).withColumn("asked", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
    return out.select("asked", "source", "name", "record")


@query("""WITH n AS (SELECT p_name AS name, min(p_partkey) AS pos FROM part GROUP BY 1), c AS (SELECT name, pos, string_split(name, ' ')[2] AS category FROM n)
SELECT name, pos FROM c WHERE category = 'widget' AND name <> 'red widget' ORDER BY pos LIMIT 5""")
def topic_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    return K.peers(p.withColumn("category", F.split("name", " ")[1]), "red widget").select("name", "pos")


_REPORT = f"""{ATT}, r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY month DESC) AS k, first_value(month) OVER (PARTITION BY keyword ORDER BY value DESC, month) AS top FROM att),
t AS (SELECT keyword, max(category) AS category, any_value(top) AS peak_month, count(*) AS n, sum(value) FILTER (k <= 3) AS recent, sum(value) FILTER (k BETWEEN 4 AND 6) AS before FROM r GROUP BY keyword),
rep AS (SELECT keyword, category, peak_month, round(recent, 4) AS recent, round(before, 4) AS before, CASE WHEN n > 6 AND recent > before THEN 'rising' ELSE 'falling' END AS direction, count(*) OVER (PARTITION BY category) - 1 AS n_peers FROM t)"""


@query(f"WITH {_REPORT} SELECT keyword, peak_month, recent, before, direction, n_peers FROM rep")
def topic_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each topic: its peak, its last three rows against the three before, and how many peers it has."""
    r = A.topic_report(attention(spark, sf_dir), "keyword", "month", "category")
    return r.select("keyword", "peak_month", F.round("recent", 4).alias("recent"), F.round("before", 4).alias("before"), "direction", "n_peers")


@query(f"WITH {_REPORT} SELECT a.keyword AS first, b.keyword AS second, a.peak_month AS first_peak, b.peak_month AS second_peak, round(a.recent / b.recent, 4) AS ratio, a.category = b.category AS peers FROM rep a, rep b WHERE a.keyword = 'NATION_1' AND b.keyword = 'NATION_7'")
def compared_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.topic_report(attention(spark, sf_dir), "keyword", "month", "category").withColumn("recent", F.round("recent", 4))
    return A.side_by_side(r, "keyword", "NATION_1", "NATION_7").select("first", "second", "first_peak", "second_peak", F.round("ratio", 4).alias("ratio"), "peers")


_TITLES = "CASE c_custkey % 6 WHEN 0 THEN '新词' || ['甲','乙','丙','丁','戊'][c_custkey % 5 + 1] WHEN 1 THEN 'abc def' WHEN 2 THEN '新词9' WHEN 3 THEN '很长很长很长很长很长很长的词' WHEN 4 THEN '老梗' || ['甲','乙','丙','丁','戊'][c_custkey % 5 + 1] ELSE '别的' END"


@query(f"WITH t AS (SELECT c_custkey, {_TITLES} AS title FROM customer) SELECT c_custkey, title FROM t WHERE c_custkey % 6 IN (0, 4) AND title NOT IN (SELECT title FROM t WHERE c_custkey % 60 = 4)")
def discovered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names without digits or plain Latin that fit a pattern and are not known yet."""
    k = F.col("c_custkey")
    letter = F.get(F.array(*map(F.lit, "甲乙丙丁戊")), (k % 5).cast("int"))
    title = F.when(k % 6 == 0, F.concat(F.lit("新词"), letter)).when(k % 6 == 1, F.lit("abc def")).when(k % 6 == 2, F.lit("新词9")).when(k % 6 == 3, F.lit("很长很长很长很长很长很长的词")).when(k % 6 == 4, F.concat(F.lit("老梗"), letter)).otherwise(F.lit("别的"))
    t = table(spark, sf_dir, "customer").select("c_custkey", title.alias("title"))
    return G.discovered(t, t.filter("c_custkey % 60 = 4").select("title").distinct(), "title", ["新词", "老梗"])


@query("""WITH g(term) AS (VALUES ('Red'), ('old rusty bolt'), ('cog')) SELECT DISTINCT p_name, term FROM part, g WHERE contains(lower(p_name), lower(term)) OR contains(lower(term), lower(p_name))""")
def contained_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.createDataFrame([("Red",), ("old rusty bolt",), ("cog",)], "term string")  # a fixed list
    return table(spark, sf_dir, "part").select("p_name").distinct().join(F.broadcast(g), M.either_contains(F.col("p_name"), F.col("term"))).select("p_name", "term")


@query(f"WITH {AXIS} SELECT t, round(x, 6) AS x FROM axis WHERE t IN (0, 5, 12, 40, 79)")
def index_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an aligned series by their places."""
    return W.at_places(axis(spark, sf_dir), "t", [0, 5, 12, 40, 79]).select("t", r6(F.col("x")).alias("x"))


_FORM = "CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '_')) WHEN 1 THEN replace(p_name, ' ', ' / ') WHEN 2 THEN 'the ' || string_split(p_name, ' ')[2] || ' so ' || string_split(p_name, ' ')[1] ELSE 'other thing' END"
_BARE = "regexp_replace(lower({}), '[\\s/_]+', '', 'g')"


@query(f"""WITH p AS (SELECT p_partkey, p_name AS a, {_FORM} AS b FROM part)
SELECT p_partkey, {_BARE.format('a')} = {_BARE.format('b')} OR len(list_filter(string_split(lower(a), ' '), lambda t: length(t) > 1 AND NOT contains(lower(b), t))) = 0 AS matches FROM p""")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names equal but for spaces, slashes and case, or with all their words in the other."""
    k, n = F.col("p_partkey"), F.col("p_name")
    w = F.split(n, " ")
    b = F.when(k % 4 == 0, F.upper(F.regexp_replace(n, " ", "_"))).when(k % 4 == 1, F.regexp_replace(n, " ", " / ")).when(k % 4 == 2, F.concat(F.lit("the "), w[1], F.lit(" so "), w[0])).otherwise(F.lit("other thing"))
    return table(spark, sf_dir, "part").select("p_partkey", M.normalised_match(n, b).alias("matches"))


@query(f"WITH {SIG} SELECT event_id, platform, coalesce(lead(platform) OVER (PARTITION BY meme ORDER BY ts, event_id), -1) AS next FROM sig")
def platform_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.platform_sequences(signals(spark, sf_dir), "meme", ["ts", "event_id"]).na.fill(-1, ["next"]).select("event_id", "platform", "next")


@query(f"""WITH {_X}, j AS (SELECT r0 AS a, r0 + (p_partkey % 7 - 3) / 10.0 AS b FROM r WHERE p_partkey % 3 <> 0) SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(avg(abs(a - b)), 6) AS mae FROM j""")
def estimate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated against observed reproduction numbers of the entries that have both."""
    c = curated(spark, sf_dir).select("p_partkey", "r0")
    seen = c.filter("p_partkey % 3 <> 0").select("p_partkey", (F.col("r0") + (F.col("p_partkey") % 7 - 3) / F.lit(10.0)).alias("r0"))
    return M.agreement(c, seen, "p_partkey", "r0").select("n", r6(F.col("r")).alias("r"), r6(F.col("mae")).alias("mae"))


@query("""WITH n AS (SELECT p_name AS name, min(p_partkey) AS pos FROM part GROUP BY 1), c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'red widget' WHEN 1 THEN 'RED WIDGET' ELSE 'unknown ' || c_custkey END AS asked FROM customer)
SELECT c_custkey, name AS match, CASE WHEN name IS NULL THEN -1 WHEN asked = name THEN 0 ELSE 1 END AS rank FROM c LEFT JOIN n ON asked = name OR asked = upper(name)""")
def merged_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records meet curated entries by name, else by alias."""
    n = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("match")).agg(F.min("p_partkey").alias("pos"))
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, F.lit("red widget")).when(k % 3 == 1, F.lit("RED WIDGET")).otherwise(F.concat(F.lit("unknown "), k)).alias("asked"))
    exact, alias = c.join(n, c["asked"] == n["match"]), c.join(n, c["asked"] == F.upper(n["match"]))
    return M.first_match(c, "c_custkey", [x.select("c_custkey", "match", "pos") for x in (exact, alias)]).na.fill(-1, ["rank"]).select("c_custkey", "match", "rank")


# aggregations


@query(f"""WITH {ATT}, m AS (SELECT *, (dense_rank() OVER (ORDER BY month) + length(keyword) + category) % 7 < 2 AS active FROM att)
SELECT month, round(sum(CASE WHEN active THEN value ELSE 0 END) / sum(value), 6) AS mutation FROM m GROUP BY month""")
def mutation_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a month's attention that goes to keywords in an active month."""
    a = attention(spark, sf_dir)
    at = a.select("month").distinct().withColumn("i", F.row_number().over(W.over("month")))
    flag = ((F.col("i") + F.length("keyword") + F.col("category")) % 7 < 2).cast("double")
    return a.join(at, "month").groupBy("month").agg(r6(A.weighted_mean(flag, F.col("value"))).alias("mutation"))


_COS = "list_cosine_similarity"


@query(f"""WITH {VEC}, mu AS (SELECT label, i, avg(x) AS m FROM dim GROUP BY 1, 2), cen AS (SELECT label, list(m ORDER BY i) AS mean FROM mu GROUP BY label), s AS (SELECT day, c.label AS node, {_COS}(v.e, c.mean) AS cos FROM vec v CROSS JOIN cen c)
SELECT day, node, round(avg(cos), 6) AS mean_sim, round(max(cos), 6) AS max_sim, count(*) FILTER (cos > 0.5) AS n_hits FROM s GROUP BY day, node""")
def daily_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each day's vectors to each node."""
    v = vectors(spark, sf_dir)
    nodes = S.means(v, ["label"]).select(F.col("label").alias("node"), F.col("mean").alias("v"))
    s = S.similarities(v.select(F.col("vec_id").alias("id"), "day", "e"), nodes, ["day"])
    return s.select("day", "node", r6(F.col("mean_sim")).alias("mean_sim"), r6(F.col("max_sim")).alias("max_sim"), "n_hits")


@query(f"""WITH {AXIS}, cat AS (SELECT month, category, sum(value::DECIMAL(18,2)) AS v FROM att GROUP BY 1, 2),
best AS (SELECT month, category AS label FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC, category) AS k FROM cat) WHERE k = 1),
j AS (SELECT t, label, x, total / 1e7 AS z FROM axis JOIN best USING (month)), m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(z) AS mz FROM j GROUP BY label),
d AS (SELECT label, t, n, mx, mz, sqrt((x - mx) ** 2 + (z - mz) ** 2) AS d FROM j JOIN m USING (label))
SELECT label, max(n) AS n, CASE WHEN max(mz) > max(mx) THEN 'z' ELSE 'x' END AS top, arg_min(t, d) AS closest, arg_max(t, d) AS farthest FROM d GROUP BY label""")
def regime_portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each regime: its largest axis, the month nearest to its centre and the farthest one."""
    j = axis(spark, sf_dir).join(regime_sequence(spark, sf_dir).select("month", "label"), "month").withColumn("z", F.col("total") / 1e7)
    return K.regime_members(j, "label", "t", ["x", "z"])


@query(f"WITH {SIG} SELECT meme, count(*) AS n, round(sum(score / greatest(rank, 1)) / sum(1.0::DOUBLE / greatest(rank, 1)), 6) AS level FROM sig GROUP BY meme")
def rank_weighted_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state where no month is complete: scores weighted by one over their rank."""
    return K.rank_weighted(signals(spark, sf_dir), "meme", F.col("score")).select("meme", "n", r6(F.col("level")).alias("level"))


@query(f"WITH {ATT} SELECT keyword, max(value) AS peak, arg_min(month, (-value, month)) AS peak_at FROM att GROUP BY keyword")
def peak_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.life_cycle(attention(spark, sf_dir), "keyword", "month").select("keyword", "peak", "peak_at")


@query(f"""WITH {AXIS}, cat AS (SELECT month, category, sum(value::DECIMAL(18,2)) AS v FROM att GROUP BY 1, 2), best AS (SELECT month, category AS label FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC, category) AS k FROM cat) WHERE k = 1)
SELECT month, round(x, 6) AS x, label FROM axis JOIN best USING (month) ORDER BY month DESC LIMIT 6""")
def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six months' axis with their regimes."""
    j = axis(spark, sf_dir).join(regime_sequence(spark, sf_dir).select("month", "label"), "month")
    return j.orderBy(F.desc("month")).limit(6).select("month", r6(F.col("x")).alias("x"), "label")


@query(f"WITH {_X}, s AS (SELECT p_partkey, r0 - (sum(r0) OVER (PARTITION BY p_brand) - r0) / nullif(count(*) OVER (PARTITION BY p_brand) - 1, 0) AS e FROM r) SELECT p_partkey, round(e, 5) AS error FROM s WHERE e IS NOT NULL ORDER BY round(abs(e), 5) DESC, p_partkey LIMIT 10")
def largest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten entries that their groups predict worst."""
    e = V.leave_one_out(curated(spark, sf_dir), "p_brand", "r0").filter("error is not null")
    return e.orderBy(F.desc(F.round(F.abs("error"), 5)), "p_partkey").limit(10).select("p_partkey", F.round("error", 5).alias("error"))


@query(f"""WITH {SIG}, m AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM sig), d AS (SELECT date_trunc('day', ts) - INTERVAL (b) DAY AS s, meme, count(*) AS n FROM sig, range(3) AS r(b) GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d') AS day, meme, n FROM d, m WHERE s + INTERVAL 3 DAY <= w""")
def stream_sliding_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete three-day windows begun every day, as the watermark closes them."""
    from tidemark.plans.streams import _finished, _stream

    return _finished(spark, jobs.sliding(_stream(spark, sf_dir)), "append").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "meme", "n")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of the capture job into its daily store, and what stands there then."""
    import uuid

    from tidemark.plans.streams import _CAPTURED, _stream
    from tidemark.sources.tables import working_dir
    from tidemark.streaming import store

    at = f"{working_dir(spark)}/capture-{uuid.uuid4().hex}"
    jobs.capture(_stream(spark, sf_dir), f"{at}/out", f"{at}/checkpoint")
    return store.rows(spark, f"{at}/out", _CAPTURED).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


# ledger


_LEDGER = "led AS (SELECT p_partkey::VARCHAR AS id, 'E' || (p_size % 5) AS grade, list_filter(['A1', 'A2', 'A3', 'A4'], lambda a: (p_partkey * ascii(a[2]) + p_size) % 3 = 0) AS depends FROM part)"


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as claims: a grade, and the assumptions they rest on."""
    rests = F.filter(F.array(*map(F.lit, ("A1", "A2", "A3", "A4"))), lambda a: (F.col("p_partkey") * F.ascii(F.substring(a, 2, 1)) + F.col("p_size")) % 3 == 0)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("E"), F.col("p_size") % 5).alias("grade"), rests.alias("depends"), F.col("p_name").alias("value"))
    return L.checked(p)


@query(f"WITH {_LEDGER} SELECT id, CASE WHEN NOT list_contains(depends, 'A3') THEN 'clean' WHEN grade IN ('E3', 'E4') THEN 'invalidated' ELSE 'survives, flagged' END AS outcome FROM led")
def ledger_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each claim of a loaded ledger if one assumption falls."""
    return L.cascade(ledger_rows(spark, sf_dir), "A3").select("id", "outcome")


@query(f"WITH {_LEDGER}, x AS (SELECT grade, unnest(depends) AS assumption FROM led) SELECT assumption, count(*) AS dependents, count(*) FILTER (grade IN ('E3', 'E4')) AS fragile FROM x GROUP BY 1")
def ledger_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dependents(ledger_rows(spark, sf_dir))


@query(f"WITH {_LEDGER} SELECT grade, count(*) AS n, count(*) FILTER (len(depends) = 0) AS free, round(avg(len(depends)), 6) AS mean FROM led GROUP BY grade")
def ledger_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first part: claims of each grade."""
    return L.by_grade(ledger_rows(spark, sf_dir)).select("grade", "n", "free", r6(F.col("mean")).alias("mean"))


@query("""SELECT source, frame, scale, n FROM (VALUES ('attention', 'monthly volume', 'relative'), ('headlines', 'hourly ranks', 'absolute'), ('narratives', 'extracted text', 'interpretive')) AS t(source, frame, scale)
JOIN (SELECT 'attention' AS source, count(*) AS n FROM orders UNION ALL SELECT 'headlines', count(*) FROM events UNION ALL SELECT 'narratives', count(*) FROM documents) USING (source)""")
def operator_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources with what they can say, and how many rows of each there are."""
    rows = [table(spark, sf_dir, t).agg(F.lit(s).alias("source"), F.count("*").alias("n")) for s, t in (("attention", "orders"), ("headlines", "events"), ("narratives", "documents"))]
    return L.operator_registry(spark).join(rows[0].unionByName(rows[1]).unionByName(rows[2]), "source").select("source", "frame", "scale", "n")
