"""Secret scan over a trigram inverted index (DataFrame functions only).

From each rule's regular expression comes a Boolean query over mandatory trigrams. The index holds
the postings (trigram, document) of those trigrams; a clause's postings are intersected by counting
distinct trigrams per document, with partial aggregation, so no posting list is ever gathered. The
documents that satisfy a rule's query are its candidates; they are verified with the regular
expression over the whole text. A rule without mandatory trigrams (the bare hex run) scans every text. The
candidates' keys go to the texts; only where they are too many to broadcast does a shuffle bring the two together.

Positions are code points. Spark gives matches but no offsets, so a match's place is the length of
what split() leaves before it plus the matches before it, summed in two levels.

Edge cases: null text is empty and has no spans; a text of any length is scanned whole; spans of several kinds
may overlap and are listed by start, then kind; rows repeated whole get the same row each; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import trigrams
from .shared import KEY, document_key, few, kept


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1
    base: bool = False

    @property
    def clauses(self):
        return trigrams.query(self.pattern)


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # runs are maximal, so asking for 24 in the pattern drops the same matches as measuring them afterwards
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
_STEP = 256


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index of the wanted trigrams: (trigram, _key)."""
    has = [F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in wanted]
    low = docs.select(document_key().alias(KEY), F.lower("text").alias("_low"))
    return low.select(KEY, F.explode(F.array_compact(F.array(*has))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_key, rules): the documents that satisfy the trigram query of some rule."""
    clauses = [(r.kind, i, c) for r in rules if r.clauses for i, c in enumerate(sorted(r.clauses, key=sorted))]
    wanted = sorted({t for *_, c in clauses for t in c})
    uses = {t: [(k, i, len(c)) for k, i, c in clauses if t in c] for t in wanted}
    asked = F.create_map(
        *(
            x
            for t in wanted
            for x in (
                F.lit(t),
                F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("clause"), F.lit(n).alias("size")) for k, i, n in uses[t])),
            )
        )
    )
    return (
        postings(docs, wanted)
        .select(KEY, "trigram", F.inline(asked[F.col("trigram")]))
        .groupBy(KEY, "kind", "clause", "size")
        .agg(F.countDistinct("trigram").alias("n"))
        .filter("n = size")
        .groupBy(KEY)
        .agg(F.collect_set("kind").alias("rules"))
    )


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression inside a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(lengths: Column) -> Column:
    """Sums of all values before each; linear but for one term of n * n / STEP**2. lengths: a bound variable."""
    add = lambda a, x: a + x
    zero = F.lit(0)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * _STEP + 1, F.lit(_STEP)), zero, add),
    )
    before = lambda bs: F.transform(bs, lambda _, i: F.aggregate(F.slice(bs, F.lit(1), i), zero, add))
    inside = lambda bf: F.transform(
        lengths,
        lambda _, i: F.element_at(bf, F.floor(i / _STEP).cast("int") + 1)
        + F.aggregate(F.slice(lengths, i - i % _STEP + 1, i % _STEP), zero, add),
    )
    return let(blocks, lambda bs: let(before(bs), inside))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of a rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, lambda p: F.length(p))
    part = F.struct(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("value"),
    )

    def placed(p: Column) -> Column:
        gap = F.slice(p["gap"], F.lit(1), F.size(p["size"]))
        begin = lambda sums: F.zip_with(
            F.arrays_zip(sums.alias("before"), gap.alias("gap")),
            F.arrays_zip(p["size"].alias("size"), p["value"].alias("value")),
            lambda a, b: F.struct(
                (a["before"] + a["gap"]).alias("start"), F.lit(order).alias("order"), (a["before"] + a["gap"] + b["size"]).alias("end"),
                F.lit(rule.kind).alias("kind"), b["value"].alias("value"),
            ),
        )
        return let(F.zip_with(gap, p["size"], lambda g, m: g + m), lambda moves: begin(prefix_sums(moves)))

    found = F.filter(let(part, placed), lambda s: s["value"] >= rule.least)
    return F.transform(found, lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"]))


_SPAN = "array<struct<start:int,order:int,end:int,kind:string>>"


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the sorted spans of the base rules and of all rules, a row for each input row."""
    found = kept(candidates(docs, rules), "secret-candidates")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(document_key().alias(KEY), "doc_id", text.alias("text")).join(few(found, 200, "shuffle_hash"), KEY, "left")
    nothing = F.expr(f"cast(array() as {_SPAN})")
    each = []
    for order, r in enumerate(rules):
        there = F.col("text").rlike(r.pattern)
        if r.clauses:
            there = F.coalesce(F.array_contains("rules", r.kind), F.lit(False)) & there
        each.append(F.when(there, spans(F.col("text"), r, order).cast(_SPAN)).otherwise(nothing).alias(r.kind))
    base = [r.kind for r in rules if r.base]
    listed = rows.select("doc_id", *each)
    return listed.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*(r.kind for r in rules))).alias("all"),
    )


def named(spans_: str) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def reported(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    got = secrets(docs)
    return got.select("doc_id", *(c for c in got.columns if c.startswith("n_")), F.sha2(named("base"), 256).alias("base_sha256"), named("all").alias("spans"))


