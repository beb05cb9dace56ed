"""Text and record matching queries, and the evidence ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.catalog import query
from tidemark.functions.columns import bigrams, jaccard, ngrams, r6, soft_score
from tidemark.operators import ledger as L, matching as M
from tidemark.plans.bindings import attention, table

#: The dictionary the text queries look up (group, word, place).
WORDS = [("article", "the ", 0), ("article", "der ", 1), ("article", "une ", 2), ("joint", "tion", 3), ("joint", "heit", 4), ("joint", "ment", 5), ("pair", "qu", 6), ("pair", "sh", 7)]
_WORDS = "words AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{w}', {p})" for g, w, p in WORDS) + ") AS t(grp, word, pos))"


def _dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORDS, "group string, word string, pos int")


@query(f"""WITH {_WORDS}, h AS (SELECT doc_id, grp, word, pos, row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos) AS k FROM documents JOIN words ON contains(text, word))
SELECT doc_id, grp AS "group", word, pos FROM h WHERE k = 1""")
def signal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first word of each group: a substring join by n-gram prefilter."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.first_hit(M.substring_hits(d, "text", _dictionary(spark), ["doc_id"]), ["doc_id", "group"])


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), d AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM n WHERE length(name) % 2 = 0),
a AS (SELECT name AS alias, (SELECT min(name) FROM d) AS target FROM n WHERE length(name) % 3 = 0),
m AS (SELECT n.name AS k, d.name AS match, d.pos, 0 AS rank FROM n JOIN d ON n.name = d.name UNION ALL SELECT n.name, d.name, d.pos, 1 FROM n JOIN a ON n.name = a.alias JOIN d ON d.name = a.target
  UNION ALL SELECT n.name, d.name, d.pos, 2 FROM n JOIN d ON substr(n.name, 1, 4) = substr(d.name, 1, 4)),
b AS (SELECT k, match, rank, row_number() OVER (PARTITION BY k ORDER BY rank, pos, match) AS i FROM m)
SELECT n.name, match, rank FROM n LEFT JOIN b ON n.name = b.k AND i = 1""")
def entity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved in a dictionary: exact, by alias, by the first four characters."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("key")).distinct()
    d = n.filter(F.length("key") % 2 == 0).select(F.col("key").alias("name"))
    d = d.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")))
    target = d.agg(F.min("name").alias("target"))
    a = n.filter(F.length("key") % 3 == 0).select(F.col("key").alias("alias")).join(target)
    return M.cascade(n, "key", d, a).select(F.col("key").alias("name"), "match", "rank")


@query("""WITH g AS (SELECT substr(text, i, 3) AS g FROM (SELECT text, unnest(range(1, length(text) - 1)) AS i FROM conversations)) SELECT g AS gram, count(*) AS n FROM g GROUP BY g HAVING count(*) >= 3 ORDER BY n DESC, g LIMIT 20""")
def ngram_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").select(F.explode(ngrams(F.col("text"), 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "gram").limit(20)


@query("""WITH b AS (SELECT item_id, list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS g FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS j FROM b a JOIN b ON b.item_id = a.item_id + 1""")
def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", bigrams(F.col("text")).alias("g"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return b.join(nxt, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), r6(jaccard(F.col("g"), F.col("h"))).alias("j"))


_ANCHORS = ["the", "tion", "and", "qu"]


@query(f"""WITH h AS (SELECT doc_id, list_transform({_ANCHORS}, lambda a: contains(text, a)::INT) AS h FROM documents)
SELECT doc_id, round(least(list_sum(h) / 4 + least((h[1] * h[2] + h[2] * h[3] + h[3] * h[4]) * 0.05, 0.2), 1.0), 6) AS score FROM h""")
def soft_concept_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", r6(soft_score(F.col("text"), F.array(*map(F.lit, _ANCHORS)))).alias("score"))


@query("SELECT source, lang, count(*) AS n, count(DISTINCT md5(text)) AS texts, max(n_chars) AS longest FROM documents GROUP BY source, lang")
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct(F.md5("text")).alias("texts"), F.max("n_chars").alias("longest"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("""WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, n_name AS keyword, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
b AS (SELECT keyword, avg(value) AS m FROM a WHERE month <= '1997-12' GROUP BY keyword)
SELECT month, a.keyword, round(CASE WHEN ends_with(a.keyword, '3') AND month >= '1999-01' THEN m ELSE value END, 2) AS value FROM a LEFT JOIN b USING (keyword)""")
def counterfactual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attention(spark, sf_dir).select("month", "keyword", "value")
    return M.overwritten(a, "keyword", "month", "value", F.col("keyword").endswith("3"), "1997-12", "1999-01").select("month", "keyword", F.round("value", 2).alias("value"))


_LEDGER = "ledger AS (SELECT * FROM (VALUES " + ", ".join(f"('{e.id}', '{e.grade}', {list(e.depends)})" for e in L.ENTRIES) + ") AS t(id, grade, depends))"


@query(f"""WITH {_LEDGER} SELECT id, grade, CASE WHEN NOT list_contains(depends, 'A1') THEN 'clean' WHEN grade IN ('E3', 'E4') THEN 'invalidated' ELSE 'survives, flagged' END AS outcome FROM ledger""")
def ledger_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cascade(L.entries(spark), "A1").select("id", "grade", "outcome")


@query(f"""WITH {_LEDGER}, x AS (SELECT id, grade, unnest(depends) AS assumption FROM ledger) SELECT assumption, count(*) AS dependents, count(*) FILTER (grade IN ('E3', 'E4')) AS fragile FROM x GROUP BY assumption""")
def ledger_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dependents(L.entries(spark))
