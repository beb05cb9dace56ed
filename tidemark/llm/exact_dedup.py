"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

1. Every normalised text is cut where its content says so: after a white-space character that
   follows one of the letters CUT_AFTER, never before MIN_CHUNK and always before MAX_CHUNK characters.
   Equal texts are cut alike. Only hashes, lengths and digests of the chunks leave the scan.
2. The chunk dictionary has a row for each distinct (hash, length) with the sorted SHA-256 digests
   seen under it. A verified identifier is (hash, length, place of the digest in that list): two chunks
   get the same one only if their digests are the same. Partial aggregation makes a chunk that
   stands in a third of all documents one row for each task.
3. A document's recipe is the ordered list of its chunks' identifiers; documents are equal when
   their recipes are. Long texts are read once and never shuffled.

Edge cases: null text is the empty text, whose recipe is the empty list. Of equal texts the largest
doc_id stays; a null doc_id is smaller than any other. Rows repeated whole count as rows of the
group and all of them carry ``kept`` where their doc_id is the one that stays; ties (equal texts with
one doc_id) stay or go together. A text of any length is read whole. An empty table gives an empty result.
Input columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import KEY, copies, document_key, few_dropped, kept, scratch

MIN_CHUNK, MAX_CHUNK = 512, 8192
#: A cut may follow white space after one of these characters; about one word in ten ends so.
CUT_AFTER = "ot"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() is the quick way where the text is ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of a text; together they are the text."""
    pattern = rf"(?s).{{{least},{most}}}?(?<=[{CUT_AFTER}]\s)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK, hashed=F.xxhash64) -> DataFrame:
    """_key, doc_id, digest of the normalised text, and its chunks as (hash, length, digest), not verified yet."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    part = F.transform(
        chunks(F.col("_norm"), least, most),
        lambda c: F.struct(hashed(c).alias("h"), F.length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("d")),
    )
    return docs.select(document_key().alias(KEY), "doc_id", text.alias("_norm")).select(
        KEY, "doc_id", F.unhex(F.sha2("_norm", 256)).alias("digest"), part.alias("parts")
    )


def ambiguous_chunks(made: DataFrame) -> DataFrame:
    """(h, n, digests) of each hash and length under which more than one digest was seen."""
    distinct = made.select(F.inline("parts")).groupBy("h", "n", "d").agg(F.count("*").alias("uses"))
    return distinct.groupBy("h", "n").agg(F.sort_array(F.collect_list("d")).alias("digests")).filter(F.size("digests") > 1)


def verified_recipes(made: DataFrame) -> DataFrame:
    """doc_id, digest, recipe and n_rows (rows repeated whole): recipes of verified identifiers."""
    one = made.groupBy(KEY, "doc_id").agg(F.first("digest").alias("digest"), F.first("parts").alias("parts"), F.count("*").alias("n_rows"))
    ambiguous = kept(ambiguous_chunks(made), "ambiguous-chunks")
    if ambiguous.isEmpty():  # then (hash, length) tells all chunks apart
        plain = F.transform("parts", lambda p: F.struct(p["h"], p["n"], F.lit(0).alias("k")))
        return one.select("doc_id", "digest", "n_rows", plain.alias("recipe"))
    part = one.select(KEY, "doc_id", F.posexplode("parts").alias("pos", "p")).select(KEY, "doc_id", "pos", "p.h", "p.n", "p.d")
    place = F.coalesce(F.array_position("digests", F.col("d")), F.lit(0)).cast("int")
    listed = (
        part.join(ambiguous, ["h", "n"], "left")
        .groupBy(KEY, "doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "h", "n", place.alias("k")))).alias("ids"))
    )
    recipe = F.coalesce(F.transform("ids", lambda x: F.struct(x["h"], x["n"], x["k"])), F.expr("array()"))
    return (
        one.alias("o")
        .join(listed.alias("l"), (F.col(f"o.{KEY}") == F.col(f"l.{KEY}")) & F.col("o.doc_id").eqNullSafe(F.col("l.doc_id")), "left")
        .select("o.doc_id", "o.digest", "o.n_rows", recipe.alias("recipe"))
    )


def exact_classes(docs: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK, hashed=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each input row."""
    with scratch():
        each = kept(verified_recipes(kept(recipes(docs, least, most, hashed), "recipes")), "verified-recipes", stay=True)
    # a table of its own: so both sides of the join below are plain exchanges, and a hot recipe's rows can be split
    best = kept(each.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size")), "classes")
    return (
        each.join(best, "recipe")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                F.lower(F.hex("digest")).alias("text_sha256"), "n_rows")
        .transform(lambda df: copies(df, "n_rows"))
        .drop("n_rows", "_copy")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_classes() drops (of rows repeated whole all stay or go). What travels are the
    rejected rows' keys; texts do only where those are too many to broadcast."""
    with scratch():
        gone = exact_classes(docs).filter("not kept").select(F.col("doc_id").alias("_gone_id"), F.unhex("text_sha256").alias("_gone_text")).distinct()
        gone = few_dropped(kept(gone, "rejected", stay=True))
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (digest == gone["_gone_text"]), "left_anti")
