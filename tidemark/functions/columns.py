"""Column expressions shared by the operators: vectors, shares, clips, similarities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression inside a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(vsum(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))))


def entropy_term(p: Column) -> Column:
    """-p ln p, 0 at 0."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def ngrams(text: Column, n: int) -> Column:
    """All character n-grams in order, repeats included, the last one too."""
    def made(chars: Column) -> Column:
        count = F.size(chars) - (n - 1)
        grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))
        return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), made)  # linear in the text


def bigrams(text: Column) -> Column:
    return F.array_distinct(ngrams(text, 2))


def soft_score(text: Column, anchors: Column) -> Column:
    """Share of anchor terms that the text holds, plus .05 for each adjacent pair of hits (.2 at most), 1 at most."""
    hit = F.transform(anchors, lambda a: F.when(F.contains(text, a), 1).otherwise(0))
    n = F.size(anchors)
    pairs = F.aggregate(F.zip_with(F.slice(hit, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(hit, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a * b), F.lit(0), lambda s, x: s + x)
    share = F.aggregate(hit, F.lit(0), lambda s, x: s + x) / n
    return F.when(n > 0, F.least(share + F.least(pairs * 0.05, F.lit(0.2)), F.lit(1.0))).otherwise(F.lit(0.0))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def rounded(e: Column, digits: int = 6) -> Column:
    """A vector as a JSON sink stores it."""
    return F.transform(e, lambda x: F.round(x.cast("double"), digits))
