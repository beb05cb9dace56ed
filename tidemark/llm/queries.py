"""The queries of this subpackage, opN_<name>, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, collocations, decontaminate, exact_dedup, license_rules, license_scan, packing, pii, secret_scan, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from .shared import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.reported(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))[0]


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digested(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digested(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.judged(decontaminate.contamination(documents(spark, sf_dir), benchmark))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.reported(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_sharding, op3_substring_dedup, op4_toxicity, op5_pii, op6_suffix_dedup, op7_exact_dedup, op8_decontamination, op9_simhash, op10_packing,
        op11_collocations, op12_alignment, op13_license_scan,
    )
}

def _secrets_sql() -> str:
    """The rules in SQL: a match's place is what splitting leaves before it plus the matches before it."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)  # noqa: E731  RE2 folds case beyond ASCII
    words = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
    parts, counts = [], []
    for order, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", words).replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {order} AS o, {str(r.base).lower()} AS base, regexp_split_to_array(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m, "
            f"regexp_extract_all(t, '{pattern}', {r.group}) AS v, {r.least} AS least FROM d"
        )
        if r.base:
            counts.append(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT doc_id, kind, o, base, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a, length(m[i]) AS n
      FROM i WHERE length(v[i]) >= least),
n AS (SELECT *, kind || ':' || a || ':' || (a + n) AS name FROM s),
x AS (SELECT doc_id, {", ".join(counts)}, string_agg(name, ',' ORDER BY a, o) FILTER (base) AS b, string_agg(name, ',' ORDER BY a, o) AS spans FROM n GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secret_scan.RULES if r.base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (doc_id)"""


def _pii_sql() -> str:
    """Patterns and checks in SQL; places as in the secrets' SQL; the score from the words within 40 characters."""
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    at = f"({digits})[length({digits}) + 1 - i]::INT"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END)) % 10 = 0"
    moved = "replace(x, ' ', '')[5:] || replace(x, ' ', '')[1:4]"
    mod97 = (
        f"list_reduce(list_transform(regexp_extract_all({moved}, '.'), lambda c: CASE WHEN c <= '9' THEN c::INT ELSE ord(c) - 55 END), "
        "lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1"
    )
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
               "list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))"),
        "card": (r"[0-9]([ -]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}\b", mod97),
    }
    found = " UNION ALL ".join(
        f"SELECT doc_id, t, '{k}' AS kind, {o} AS o, a, x FROM (SELECT doc_id, t, list_sum(list_transform(g[1:i], lambda y: length(y)))::BIGINT "
        f"+ coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)::BIGINT AS a, m[i] AS x "
        f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m FROM d))) WHERE {check}"
        for o, (k, (p, check)) in enumerate(kinds.items())
    )
    case = lambda f: "CASE kind " + " ".join(f"WHEN '{k}' THEN {f(k)}" for k in kinds) + " END"
    near = lambda words: f"regexp_matches(near, {case(lambda k: repr(pii.whole_word(words[k])))})::INT"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)
    n = pii.CONTEXT_CHARS
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
w AS (SELECT *, translate(substr(t, greatest(a - {n}, 0) + 1, least(a, {n})) || ' ' || substr(t, a + length(x) + 1, {n}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near FROM f),
s AS (SELECT doc_id, kind, o, a, kind || ':' || a || ':' || (a + length(x)) AS name,
      least(1.0, greatest(0.0, {case(lambda k: pii.PRIOR[k])} + {pii.CONTEXT_WEIGHT} * ({near(pii.CONTEXT)} - {near(pii.COUNTER)})))::DECIMAL(4, 2)::VARCHAR AS score FROM w),
x AS (SELECT doc_id, {counts}, string_agg(name, ',' ORDER BY a, o) FILTER (kind <> 'iban') AS b, string_agg(name, ',' ORDER BY a, o) AS spans, string_agg(score, ',' ORDER BY a, o) AS scores FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN x USING (doc_id)"""


def _licenses_sql() -> str:
    """Signatures over words laid out with a space of their own on either side; places are counted in words."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({i}, {quoted(r.label)}, {r.priority}, {r.weight}, {quoted(r.keyword)}, {quoted(r.pattern)}, {str(r.base).lower()})" for i, r in enumerate(license_rules.RULES))
    n = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    return f"""WITH r(rule, label, priority, weight, keyword, pattern, base) AS (VALUES {rules}),
d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT id, rule, label, priority, weight, base, pattern, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d JOIN r ON list_contains(w, keyword)),
m AS (SELECT * EXCLUDE (t, pattern), regexp_extract_all(t, pattern, 0) AS m, regexp_split_to_array(t, pattern) AS g FROM p),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
f AS (SELECT id, rule, label, priority, weight, base, a, a + {n("m[i]")} AS b
      FROM (SELECT *, list_sum(list_transform(g[1:i], lambda x: {n("x")}))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {n("x")})), 0)::BIGINT AS a FROM i)),
s AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f AS o WHERE o.id = f.id AND o.a <= f.a AND o.b >= f.b AND o.priority <= f.priority
      AND (o.a < f.a OR o.b > f.b OR o.priority < f.priority OR o.rule < f.rule))),
x AS (SELECT id, count(*) FILTER (base) AS n, min(a) FILTER (base) AS lo, max(a) FILTER (base) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS names FROM f GROUP BY id),
y AS (SELECT id, max(weight) AS score FROM s GROUP BY id),
z AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM (SELECT id, label FROM s UNION ALL SELECT id, label FROM f WHERE base) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo AS first_word, hi AS last_word, coalesce(x.names, '') AS base_labels, coalesce(z.names, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN x USING (id) LEFT JOIN y USING (id) LEFT JOIN z USING (id)"""


def _collocations_sql() -> str:
    """Windows of each piece counted; a candidate's cuts and the longer candidates it stands in by joins on its parts."""
    t = collocations
    windows = " UNION ALL ".join(
        f"SELECT lang, {n} AS n, array_to_string(w[i : i + {n - 1}], ' ') AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM w WHERE len(w) >= {n})" for n in range(1, t.LONGEST + 1)
    )
    inner = " UNION ALL ".join(
        f"SELECT lang, a, array_to_string(w[{i} : {i + k - 1}], ' ') AS p FROM c WHERE n = {n}" for n in range(3, t.LONGEST + 1) for k in range(2, n) for i in range(1, n - k + 2)
    )
    return f"""WITH d AS (SELECT coalesce(lang, '{t.NO_LANGUAGE}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS w FROM d),
f AS (SELECT lang, n, p, count(*) AS a FROM ({windows}) GROUP BY lang, n, p HAVING count(*) >= {t.LEAST}),
c AS (SELECT *, string_split(p, ' ') AS w FROM f WHERE n > 1),
k AS (SELECT lang, p, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:n], ' ') AS y FROM (SELECT *, unnest(range(1, n)) AS k FROM c)),
s AS (SELECT k.lang, k.p, k.a, k.k, x.a AS l, y.a AS r, (k.a::HUGEINT * {t.UNIT} // (x.a::HUGEINT + y.a))::BIGINT AS score
      FROM k JOIN f AS x ON x.lang = k.lang AND x.p = k.x JOIN f AS y ON y.lang = k.lang AND y.p = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
o AS (SELECT lang, p, max(a) AS most FROM ({inner}) GROUP BY lang, p),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.p) AS rank FROM b LEFT JOIN o USING (lang, p) WHERE most IS NULL OR 100 * most::HUGEINT < {t.COVER} * b.a::HUGEINT)
SELECT r.lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n::BIGINT AS n, score FROM r JOIN (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang) AS t ON t.lang = r.lang WHERE rank <= {t.TOP}"""


ORACLE_SQL = {
    "op11_collocations": _collocations_sql(),
    "op13_license_scan": _licenses_sql(),
    "op1_secret_scan": _secrets_sql(),
    "op5_pii": _pii_sql(),
    "op6_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM b WHERE length(h) >= 400)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
e AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM e),
s AS (SELECT doc_id, run, min(p) AS lo, max(p) + 200 AS hi FROM k GROUP BY doc_id, run),
c AS (SELECT s.doc_id, lo, hi, substr(h, 2 * coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0) + 1, 2 * (lo - coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0))) AS piece FROM s JOIN b ON s.doc_id = b.doc_id),
a AS (SELECT doc_id, sum(hi - lo) AS cut, count(*) AS spans, max(hi) AS tail, string_agg(piece, '' ORDER BY lo) AS rest FROM c GROUP BY doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(cut, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(rest, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN a ON a.doc_id = b.doc_id""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM r),
o AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT o.doc_id, count(*) FILTER (c.q IS NOT NULL) AS cut, string_agg(o.x, ' ' ORDER BY o.q) FILTER (c.q IS NULL) AS rest
      FROM o LEFT JOIN c ON o.doc_id = c.doc_id AND o.q = c.q GROUP BY o.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cut, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op7_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256
FROM t""",
    "op8_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
