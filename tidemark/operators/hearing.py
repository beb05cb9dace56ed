"""Keywords that a transcript's segments hold: as they sound, with one slip, or mostly. Built-in functions and joins only.

A segment's windows are looked up in an index of the keywords, never tried one by one:

1. and 2. One edit leaves either the first or the second half of a keyword as it is, at the beginning or the end of the window: an equality
   join by halves finds all pairs that can match (windows with neither half of any keyword go before it); their edit distance decides.
3. A window of fixed width and a keyword that agree in most of their characters share pairs of neighbouring characters: each missing
   or added character undoes two of them. Windows meet keywords by such pairs, those with too few in common go, and the rest is
   scored by the longest common subsequence.

Where the keywords are few, windows that can match nothing are not made at all: a regular expression tells the places where a half of a keyword stands, or
one of the few forms that a likeness leaves it. Long texts are cut into overlapping stretches before.

How a text sounds is a column expression (lower case by default; put a transliteration in its place where one is at hand).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import let
from tidemark.operators.matching import SMALL_DICTIONARY

#: Width of a window, what each layer's confidence is, and bounds of the second and third layers.
WINDOW, SLIP, ALMOST = 8, (0.7, 0.3), 0.6
SHORTEST_SHARE, MOSTLY = 0.7, 0.85
#: Keywords and width of a window up to which places are told by a regular expression, and places of a stretch of text.
FEW, NARROW, STRETCH = 100, 8, 256


def shortened(text: Column) -> Column:
    """The text, and the text with each one of its characters left out."""
    one_less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), one_less))


def pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    n = F.length(text) - 1
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n > 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def window_pairs(text: Column, width: int) -> Column:
    """pairs() of a window of ``width`` characters, place by place; of a shorter one (a whole short text) by the general form."""
    if not 1 < width <= 64:
        return pairs(text)
    return F.when(F.length(text) == width, F.array_distinct(F.array(*(F.substring(text, i, 2) for i in range(1, width))))).otherwise(pairs(text))


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of characters, the first of 60 at most: a row of the usual table is a row of bits."""
    one = F.lit(1).cast("bigint")
    shifted = lambda j: F.call_function("shiftleft", one, j)

    def rows(chars: Column) -> Column:
        full = shifted(F.size(chars)) - 1
        seats = F.sequence(F.lit(0), F.size(chars) - 1)

        def step(v: Column, c: Column) -> Column:
            here = F.aggregate(seats, F.lit(0).cast("bigint"), lambda m, j: F.when(F.get(chars, j) == c, m.bitwiseOR(shifted(j))).otherwise(m))
            return let(v.bitwiseAND(here), lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(full))

        return F.size(chars) - F.bit_count(F.aggregate(b, full, step))

    return F.when((F.size(a) > 0) & (F.size(b) > 0), let(a, rows)).otherwise(0)


def partial_ratios(a: Column, b: Column, over: float = MOSTLY) -> Column:
    """The likenesses over ``over``, 2 * common / (both lengths), of the shorter text with stretches of the longer one: of its length, or shorter ones
    at either end. Stretches that so many edits can't reach are told by the edit distance, which is never over the number of characters missing or added."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)

    def found(s: Column, t: Column) -> Column:
        n, m = F.length(s), F.length(t)
        least = F.greatest(F.floor(F.round(over / (2 - over) * n, 9)).cast("int") + 1, F.lit(1))  # shorter stretches are too short
        inner = F.transform(F.sequence(F.lit(1), m - n + 1), lambda i: F.substring(t, i, n))
        sizes = F.sequence(least, n - 1)
        edge = F.when(least < n, F.concat(F.transform(sizes, lambda k: F.substring(t, F.lit(1), k)), F.transform(sizes, lambda k: F.substring(t, m - k + 1, k)))).otherwise(
            F.array().cast("array<string>")
        )
        spare = lambda x: F.floor(F.round((1 - over) * (n + F.length(x)), 9))
        near = F.filter(F.array_distinct(F.concat(inner, edge)), lambda x: F.levenshtein(s, x) <= spare(x))
        return F.filter(F.transform(near, lambda x: F.when(x == s, 1.0).otherwise(2 * common(letters(s), letters(x)) / (n + F.length(x)))), lambda r: r > over)

    return let(short, lambda s: let(long, lambda t: found(s, t)))


def undone(n: Column) -> Column:
    """How many pairs of the shorter text, of n characters, a likeness of over MOSTLY can undo at most: two for each character missing or added."""
    return 2 * (F.ceil(F.round(2 * (1 - MOSTLY) * n, 9)) - 1)


def begins(text: Column, pattern: str) -> Column:
    """The places (from 0) where the pattern begins, and place 0."""
    pieces = F.split(text, f"(?s)(?={pattern})", -1)
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x))))


def one_of(texts: Iterable[str]) -> str:
    return "|".join(map(re.escape, sorted(set(texts))))


def forms(text: str, less: int, more: int) -> set[tuple[str, ...]]:
    """The text without ``less`` of its characters and with ``more`` other ones ("" stands for any) among the rest."""
    kept = {tuple(text[i] for i in range(len(text)) if i not in gone) for gone in combinations(range(len(text)), less)}
    out = set()
    for k in kept:
        for at in combinations(range(len(k) + more), more):
            rest = iter(k)
            out.add(tuple("" if i in at else next(rest) for i in range(len(k) + more)))
    return out


def pattern_of(some: Iterable[tuple[str, ...]]) -> str:
    """A pattern for forms of one length, their beginnings put together."""
    heads: dict[str, set[tuple[str, ...]]] = {}
    for f in some:
        heads.setdefault(f[0], set()).add(f[1:])
    each = [(re.escape(c) if c else ".") + (pattern_of(rest) if any(rest) or () not in rest else "") for c, rest in sorted(heads.items())]
    return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"


def windows_of(words: Iterable[str], window: int, over: float = MOSTLY) -> dict[tuple[int, tuple[int, ...]], set[tuple[str, ...]]]:
    """All forms that a window of ``window`` characters with a likeness of over ``over`` with one of the words can hold, by their length and the places in the window
    where they can begin: what partial_ratios() finds, told beforehand."""
    out: dict[tuple[int, tuple[int, ...]], set[tuple[str, ...]]] = {}

    def add(at: Iterable[int], some: set[tuple[str, ...]]) -> None:
        for f in some:
            out.setdefault((len(f), tuple(sorted(set(at)))), set()).add(f)

    for w in words:
        n = min(len(w), window)
        for size in range(1, n + 1):  # of the stretch
            for missing in range(n):  # characters of the shorter one that the stretch has not
                added = size - (n - missing)
                if added < 0 or round(2 * (n - missing) / (n + size), 9) < over:
                    continue
                if len(w) <= window:
                    add(range(window - n + 1) if size == n else (0, window - size), forms(w, missing, added))
                else:
                    for x in {w[i : i + n] for i in range(len(w) - n + 1)} if size == n else {w[:size], w[len(w) - size :]}:
                        add((0,), forms(x, added, missing))
    return out


def index_of(keywords: DataFrame, keyword: str, sound: Callable[[Column], Column] = F.lower) -> DataFrame:
    """(keyword, sound, n): the distinct keywords; n counts their characters."""
    k = keywords.select(F.col(keyword).alias("keyword")).filter("length(keyword) > 0").distinct()
    return k.withColumn("sound", sound(F.col("keyword"))).withColumn("n", F.length("keyword"))


def heard(segments: DataFrame, ids: list[str], text: str, keywords: DataFrame, keyword: str = "keyword", sound: Callable[[Column], Column] = F.lower, window: int = WINDOW) -> DataFrame:
    """(ids..., keyword, layer, place, matched, confidence): of each segment the keywords that it holds, by the first layer that finds them and
    there the first place (in characters, from 0). ids tell segments apart. Layer 1: a stretch of the keyword's length sounds the same (1);
    layer 2: it sounds the same but for one edit (.4); layer 3: in a window of ``window`` characters a likeness of over .85 (.6 of it).

    A segment that is null or has under two characters, and a keyword that is longer than the segment, match nothing; a segment may have any length.
    """
    spark = segments.sparkSession
    known = index_of(keywords, keyword, sound)
    own = segments.select(*ids, F.col(text).alias("_text")).filter(F.length("_text") >= 2)
    halved = known.withColumn("head", F.floor(F.length("sound") / 2).cast("int")).withColumn("tail", F.length("sound") - F.col("head"))
    few = halved.limit(SMALL_DICTIONARY + 1).collect()
    if not few:
        return own.select(*ids, F.lit("").alias("keyword"), F.lit(1).alias("layer"), F.lit(0).alias("place"), F.col("_text").alias("matched"), F.lit(0.0).alias("confidence")).limit(0)
    small = len(few) <= SMALL_DICTIONARY
    along = F.broadcast if small else (lambda d: d)
    if small:
        halved = spark.createDataFrame(few, halved.schema).coalesce(1)
        kinds = sorted({(r["n"], r["head"], r["tail"]) for r in few})
    else:
        kinds = [tuple(r) for r in halved.select("n", "head", "tail").distinct().collect()]  # about as many as lengths
    known = halved.select("keyword", "sound", "n")
    halves_of, few = few, few if len(few) <= min(FEW, SMALL_DICTIONARY) else []
    reach = max(window, *(n for n, _, _ in kinds)) - 1
    cuts = own.withColumn("_all", F.length("_text")).withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_all") - 1, F.lit(STRETCH))))
    cuts = cuts.select(*ids, "_all", "_from", F.substring("_text", F.col("_from") + 1, F.lit(STRETCH + reach)).alias("_text"))
    none = F.array().cast("array<int>")
    lows = cuts.withColumn("_size", F.length("_text")).withColumn("_low", F.lower("_text"))

    def shifted(places: Column, by: int) -> Column:
        return F.transform(places, lambda q: q - by) if by else places

    def seated(n: int, head: int, tail: int) -> Column:
        """Places of windows of n characters in a stretch; where it can be told, of those alone that hold a half of a keyword."""
        last = F.least(F.lit(STRETCH - 1), F.col("_size") - n)
        every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none)
        if not few or sound is not F.lower or not head:
            return every
        sounds = [r["sound"] for r in few if (r["n"], r["head"], r["tail"]) == (n, head, tail)]
        places = F.concat(begins(F.col("_low"), one_of(x[:head] for x in sounds)), shifted(begins(F.col("_low"), one_of(x[head:] for x in sounds)), n - tail))
        # these two alone are not in lower case as they are anywhere else
        return F.when(F.col("_text").rlike("[\u03a3\u0130]"), every).otherwise(F.filter(F.array_distinct(places), lambda p: (p >= 0) & (p <= last)))

    def seats(n: int, head: int, tail: int) -> Column:
        return F.transform(seated(n, head, tail), lambda p: F.struct(p.alias("at"), F.lit(n).alias("n"), F.lit(head).alias("head"), F.lit(tail).alias("tail")))

    cut = lows.select(*ids, "_from", "_text", F.explode(F.concat(*(seats(*k) for k in kinds))).alias("_k"))
    cut = cut.select(*ids, "_k.n", "_k.head", "_k.tail", (F.col("_from") + F.col("_k.at")).alias("place"), F.substring("_text", F.col("_k.at") + 1, F.col("_k.n")).alias("matched"))
    said = cut.withColumn("said", sound(F.col("matched")))

    def halves(text: Column) -> tuple[Column, Column]:
        """Both halves with their kind: as long as those of the keyword."""
        at = lambda side: F.concat_ws(":", F.lit(side), F.col("n"), F.col("head"), F.col("tail"))
        return F.concat(at("<"), F.lit(":"), F.substring(text, F.lit(1), F.col("head"))), F.concat(at(">"), F.lit(":"), F.substring(text, F.greatest(F.length(text) - F.col("tail"), F.lit(0)) + 1, F.col("tail")))

    entries = halved.select("keyword", "sound", F.explode(F.array(*halves(F.col("sound")))).alias("entry"))
    first, second = halves(F.col("said"))
    said = said.withColumn("_first", first).withColumn("_second", second)
    if small:
        kind = lambda side, r: ":".join([side, *(str(r[c]) for c in ("n", "head", "tail"))])
        listed = sorted({f"{kind('<', r)}:{r['sound'][: r['head']]}" for r in halves_of} | {f"{kind('>', r)}:{r['sound'][r['head'] :]}" for r in halves_of})
        said = said.filter(F.col("_first").isin(listed) | F.col("_second").isin(listed))
    entry = F.explode(F.array("_first", "_second")).alias("entry")
    met = said.select(*ids, "place", "matched", "said", entry).join(along(entries), "entry")
    slips = F.levenshtein("said", "sound")
    near = met.withColumn("_d", slips).filter((F.col("_d") <= 1) & (F.length("said") >= SHORTEST_SHARE * F.length("sound")))
    close = near.select(*ids, "keyword", F.when(F.col("_d") == 0, 1).otherwise(2).alias("layer"), "place", "matched", F.when(F.col("_d") == 0, 1.0).otherwise(SLIP[0] - SLIP[1]).alias("confidence"))

    last = F.when(F.col("_from") == 0, F.greatest(F.col("_all") - window, F.lit(0))).otherwise(F.col("_all") - window - F.col("_from"))
    ends = cuts.withColumn("_last", F.least(F.lit(STRETCH - 1), last))
    there = F.when(F.col("_last") >= 0, F.sequence(F.lit(0), F.col("_last"))).otherwise(none)
    if few and window <= NARROW:
        every = []
        for (_, at), some in sorted(windows_of((r["keyword"] for r in few), window).items()):
            places = begins(F.col("_text"), pattern_of(some))
            every += [shifted(places, d) for d in at]
        # a short text is one window; a form that begins with any character could begin within one of two code units
        there = F.when((F.col("_all") < window) | F.col("_text").rlike(r"[\x{10000}-\x{10FFFF}]"), there).otherwise(F.filter(F.array_distinct(F.concat(none, *every)), lambda p: (p >= 0) & (p <= F.col("_last"))))
    wide = ends.select(*ids, "_all", "_from", "_text", F.explode(there).alias("_at"))
    wide = wide.select(*ids, (F.col("_from") + F.col("_at")).alias("place"), "_all", F.substring("_text", F.col("_at") + 1, F.lit(window)).alias("_w"))
    by_pair = known.select("keyword", "n", F.size(pairs(F.col("keyword"))).alias("_own"), F.explode(pairs(F.col("keyword"))).alias("pair"))
    unlike = wide.select("_w").distinct().withColumn("_pairs", window_pairs(F.col("_w"), window))
    shared = unlike.select("_w", F.size("_pairs").alias("_there"), F.explode("_pairs").alias("pair")).join(along(by_pair), "pair")
    counted = shared.groupBy("_w", "_there", "keyword", "n", "_own").agg(F.count("*").alias("_both"))
    short, of = F.least(F.col("n"), F.length("_w")), F.when(F.col("n") <= F.length("_w"), F.col("_own")).otherwise(F.col("_there"))
    likely = counted.filter(F.col("_both") >= F.greatest(F.lit(1), of - undone(short)))
    # outer: an inner explode would have the likenesses computed once more, to filter empty ones before
    each = likely.select("_w", "keyword", "n", F.explode_outer(partial_ratios(F.col("keyword"), F.col("_w"))).alias("_r"))
    alike = each.filter("_r is not null").groupBy("_w", "keyword", "n").agg(F.max("_r").alias("_r"))
    mostly = wide.join(alike, "_w").filter("n <= _all").select(*ids, "keyword", F.lit(3).alias("layer"), "place", F.substring("_w", F.lit(1), F.col("n")).alias("matched"), (F.col("_r") * ALMOST).alias("confidence"))
    first = F.min(F.struct("layer", "place", (-F.col("confidence")).alias("_less"), "matched")).alias("_m")  # of a window's likenesses the best
    best = close.unionByName(mostly).groupBy(*ids, "keyword").agg(first)
    return best.select(*ids, "keyword", "_m.layer", "_m.place", "_m.matched", (-F.col("_m._less")).alias("confidence"))
