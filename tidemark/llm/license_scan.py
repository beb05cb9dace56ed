"""Licence scan by ordered signature rules (DataFrame functions only).

A text's words, lower-cased, are laid out with a space of their own on either side; license_rules' signatures, some
hundreds of regular expressions, are scanned over that. A keyword prefilter gates them: the text's words are
intersected with the rules' keywords once, and only rules whose keyword is there run. Detections are word intervals. One
that lies inside another one of the same or a higher priority is suppressed; of detections of the same words the
higher priority stays, then the earlier rule. Containment is settled in one pass over the detections by start: whoever contains an interval
starts no later, so the largest end so far of each priority tells.

Everything about a text happens in its row: no shuffle, no join, no key that could be hot.

Score: the largest weight of the detections that stay, 0 without any.

Edge cases: null text is empty; a text without words has no places, null first_word and last_word, empty labels and score 0; a text
of any length is scanned whole; rows repeated whole get the same row each; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, functions as F

from .license_rules import RULES, Signature
from .secret_scan import let, prefix_sums

#: What separates words: everything but digits, letters and characters that are not ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_STEP = 256
_RULE = "array<struct<rule:int,label:string,priority:int,weight:double,keyword:string,pattern:string,base:boolean>>"
_FOUND = "array<struct<start:int,back:int,priority:int,rule:int,end:int,label:string,weight:double,base:boolean>>"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def laid_out(words_: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words_, "  "), F.lit(" "))


def counted(laid: Column) -> Column:
    """Words of a stretch of laid-out text."""
    return ((F.length(laid) - F.length(F.replace(laid, F.lit(" "), F.lit("")))) / 2).cast("int")


def places(laid: Column, rule: Column) -> Column:
    """The detections of one rule: what split() leaves before a match, and the matches before it, give its place."""

    def placed(matches: Column) -> Column:
        size = F.transform(matches, counted)
        gap = F.slice(F.transform(F.split(laid, rule["pattern"], -1), counted), F.lit(1), F.size(matches))
        return let(
            F.arrays_zip(gap.alias("gap"), size.alias("size")),
            lambda both: let(
                F.transform(both, lambda b: b["gap"] + b["size"]),
                lambda moves: F.zip_with(prefix_sums(moves), both, lambda before, b: struct(before + b["gap"], b["size"])),
            ),
        )

    def struct(start: Column, size: Column) -> Column:
        return F.struct(
            start.cast("int").alias("start"), (-(start + size)).cast("int").alias("back"), rule["priority"].alias("priority"), rule["rule"].alias("rule"),
            (start + size).cast("int").alias("end"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"),
        )

    matches = F.regexp_extract_all(laid, rule["pattern"], F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) > 0, placed(m).cast(_FOUND)).otherwise(F.expr(f"cast(array() as {_FOUND})")))


def largest_before(ends: Column) -> Column:
    """The largest of all values before each, -1 for the first; in two levels, so nearly linear. ends: a bound variable that isn't empty."""
    most = lambda some: F.aggregate(some, F.lit(-1), lambda a, x: F.greatest(a, x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / _STEP).cast("int")), lambda b: most(F.slice(ends, b * _STEP + 1, F.lit(_STEP))))
    before = lambda bs: F.transform(bs, lambda _, i: most(F.slice(bs, F.lit(1), i)))
    inside = lambda bf: F.transform(
        ends, lambda _, i: F.greatest(F.element_at(bf, F.floor(i / _STEP).cast("int") + 1), most(F.slice(ends, i - i % _STEP + 1, i % _STEP)))
    )
    return let(blocks, lambda bs: let(before(bs), inside))


def unsuppressed(found: Column, levels: int) -> Column:
    """Those that lie inside no other one of the same or a higher priority. found: sorted by start, falling end, priority and rule."""
    upto = lambda s: F.transform(
        F.sequence(F.lit(1), F.lit(levels)),
        lambda level: let(F.transform(s, lambda x: F.when(x["priority"] <= level, x["end"]).otherwise(-1)), largest_before),
    )
    return let(
        found,
        lambda s: let(upto(s), lambda most: F.filter(s, lambda x, i: F.element_at(F.element_at(most, x["priority"]), i + 1) < x["end"])),
    )


def detections(docs: DataFrame, rules: tuple[Signature, ...] = RULES) -> DataFrame:
    """doc_id, n_words, all detections and those that stay, a row for each input row; places are in words from 0."""
    table = [{"rule": i} | {k: v for k, v in r.__dict__.items()} for i, r in enumerate(rules)]
    known = F.from_json(F.lit(json.dumps(table)), _RULE)
    keywords = F.array(*(F.lit(k) for k in sorted({r.keyword for r in rules})))
    nothing = F.expr(f"cast(array() as {_FOUND})")
    read = docs.select("doc_id", words(F.col("text")).alias("w"))
    gated = read.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.array_intersect("w", keywords).alias("there"), F.col("w")
    ).select("doc_id", "n_words", "there", F.when(F.size("there") > 0, laid_out(F.col("w"))).alias("laid"))
    run = F.transform(F.filter(known, lambda r: F.array_contains("there", r["keyword"])), lambda r: places(F.col("laid"), r))
    found = gated.select("doc_id", "n_words", F.when(F.size("there") > 0, F.array_sort(F.flatten(run))).otherwise(nothing).alias("found"))
    stay = F.when(F.size("found") > 0, unsuppressed(F.col("found"), max(r.priority for r in rules))).otherwise(nothing)
    return found.select("doc_id", "n_words", "found", stay.alias("stay"))


def reported(docs: DataFrame, rules: tuple[Signature, ...] = RULES) -> DataFrame:
    """The contract's columns: the base phrases' places, labels, and the scan's labels and score."""
    got = detections(docs, rules).select("doc_id", "n_words", F.filter("found", lambda x: x["base"]).alias("base"), "stay")
    labels = lambda found: F.transform(found, lambda x: x["label"])
    listed = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    starts = F.transform("base", lambda x: x["start"])
    return got.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        listed(labels(F.col("base"))).alias("base_labels"), listed(F.concat(labels(F.col("base")), labels(F.col("stay")))).alias("labels"),
        F.coalesce(F.array_max(F.transform("stay", lambda x: x["weight"])), F.lit(0.0)).alias("score"),
    )
