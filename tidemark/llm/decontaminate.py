"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest hash of a K-gram in each window of GUARANTEE words (GUARANTEE - K + 1
consecutive K-grams; the rightmost of equal ones). A span of GUARANTEE words that a document and an item share
has the same K-grams in both, hence the same fingerprint, so no such span is missed.

1. Items: a row (n, h, gram, item) for each window, h being its fingerprint. An item of fewer than GUARANTEE
   words is one window of its own length n, and its only fingerprint is the hash of that.
2. Documents are winnowed as well. Consecutive windows with one fingerprint are a run; a run carries its words
   (GUARANTEE + 5 at most) to be verified. A bitmap of the items' fingerprints, of FILTER_WORDS 64-bit words at
   most whatever the benchmark's size, keeps most runs that meet no item at home; it never drops one that does.
3. The two fingerprint sets are joined by (n, h); Spark broadcasts the items' side if it is small and shuffles
   otherwise.
4. Runs that meet a fingerprint are extended to their windows, and these are compared with the items' windows
   word by word (the join is on the words themselves, not on a hash).
5. Items of a window are never listed: windows whose sets of items are equal belong to one class (count and
   128-bit exclusive or of the items' hashes), and a document meets each item of a class once, however many of
   its windows say so. Equal texts are one text throughout (by MD5), so a passage in a text that stands in a third of
   all rows is judged once.

Edge cases: null and word-less texts have no words and are never contaminated; null or word-less
items match nothing; a null item_id takes part and is listed as an empty string; rows of the benchmark that
share an item_id are one item; rows repeated whole are judged one by one, with the same result; very long texts are
read whole, in pieces that overlap by GUARANTEE - 1 words; extra columns are ignored, whatever their names; empty
tables give an empty result, or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import blocks as B
from .shared import few_dropped, kept, mapped, scratch

GUARANTEE, K = 13, 8
#: 64-bit words of the bitmap at most (16 MB).
FILTER_WORDS = 1 << 21
_PIECE = 4 << 20


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive hashes the place of the smallest, the rightmost of equal ones."""
    m = B.sliding_min(grams, w)
    place = np.zeros(len(m), np.int64)
    for shift in range(w):
        here = grams[shift : shift + len(m)] == m
        place[here] = np.flatnonzero(here) + shift
    return place


def identity(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of windows of n words: those of different lengths are told apart."""
    return B.mix(h + B.U64(n))


class Words:
    """The words of some texts in a row: their bytes, hashes, and the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.buf, at = B.joined([t.lower() for t in texts])
        self.starts, self.ends = B.word_spans(self.buf, "alnum")
        self.hashes = B.word_hashes(self.buf, self.starts, self.ends)
        self.edge = np.searchsorted(self.starts, at)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.edge))

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each place on are of one text."""
        return self.text[: max(0, len(self.text) - n + 1)] == self.text[n - 1 :]

    def joined(self, lo: int, hi: int) -> str:
        return b" ".join([self.buf[a:b].tobytes() for a, b in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)]).decode()

    def long_runs(self, guarantee: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, past the last, fingerprint) of the stretches of windows that keep one K-gram."""
        valid = np.flatnonzero(self.inside(guarantee))
        if not len(valid):
            return valid, valid, np.zeros(0, B.U64)
        grams = B.window_hashes(self.hashes, k)
        place = window_minima(grams, guarantee - k + 1)[valid]
        edge = np.flatnonzero((np.diff(place) != 0) | (np.diff(valid) != 1)) + 1
        lo = np.concatenate(([0], edge))
        hi = np.append(edge, len(valid))
        return valid[lo], valid[hi - 1] + 1, identity(grams[place[lo]], guarantee)

    def short_runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, fingerprint) of all windows of n words."""
        at = np.flatnonzero(self.inside(n))
        return at, identity(B.window_hashes(self.hashes, n)[at], n) if len(at) else np.zeros(0, B.U64)


_ITEM = "n int, h bigint, gram string, item string"


def item_windows(benchmark: DataFrame, guarantee: int = GUARANTEE, k: int = K) -> DataFrame:
    """(n, h, gram, item): each window of each item with its fingerprint."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in B.text_blocks(batches):
            out: list[list] = [[], [], [], []]

            def add(n: int, h: int, lo: int, words: Words, keys=keys, out=out) -> None:
                for c, v in zip(out, (n, h, words.joined(lo, lo + n), keys[words.text[lo]][0]), strict=True):
                    c.append(v)

            words = Words(texts)
            for lo, hi, h in zip(*(x.tolist() for x in words.long_runs(guarantee, k)), strict=True):
                for p in range(lo, hi):
                    add(guarantee, h, p, words)
            size = np.diff(words.edge)
            for n in np.unique(size[(size > 0) & (size < guarantee)]).tolist():
                at, h = words.short_runs(n)
                own = size[words.text[at]] == n
                for p, x in zip(at[own].tolist(), h[own].tolist(), strict=True):
                    add(n, x, p, words)
            hashes = pa.array(np.array(out[1], B.U64).view(np.int64))
            yield pa.record_batch([pa.array(out[0], pa.int32()), hashes, pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["n", "h", "gram", "item"])

    return mapped(rows, task, _ITEM)


def bitmap(prints: DataFrame, most: int = FILTER_WORDS) -> np.ndarray:
    """Bits of the fingerprints (n, h), as 64-bit words: about 32 bits for each, ``most`` words at most."""
    words = 1 << 10
    n = prints.count()
    while words < most and 2 * words <= n:
        words *= 2
    at = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(words - 1)).alias("at")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    got = prints.select(at, bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # ``most`` rows at most
    out = np.zeros(words, B.U64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(B.U64)
    return out


def may_meet(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (h >> B.U64(6)) & B.U64(len(bits) - 1)
    return ((bits[at.astype(np.int64)] >> (h & B.U64(63))) & B.U64(1)) > 0


def word_pieces(text: bytes, overlap: int, size: int = _PIECE) -> Iterator[tuple[int, bytes]]:
    """(number of words before, piece): a text in pieces of about ``size`` bytes that share ``overlap`` words."""
    lo, first, most = 0, 0, size
    while True:
        hi = len(text)
        if hi - lo > most:
            gap = np.flatnonzero(B.SEPARATORS["alnum"][np.frombuffer(text[lo + most : lo + 2 * most].lower(), np.uint8)])
            hi = lo + most + int(gap[0]) if len(gap) else min(hi, lo + 2 * most)
            if not len(gap) and hi < len(text):  # one word of that size: a longer piece
                most *= 2
                continue
        if hi == len(text):
            yield first, text[lo:]
            return
        starts, _ = B.word_spans(np.frombuffer(text[lo:hi].lower(), np.uint8), "alnum")
        if len(starts) <= overlap:
            most *= 2
            continue
        yield first, text[lo:hi]
        first += len(starts) - overlap
        lo, most = lo + int(starts[len(starts) - overlap]), size


_RUN = pa.struct([("n", pa.int32()), ("h", pa.int64()), ("lo", pa.int64()), ("words", pa.string())])
_SCAN = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN))])


def scanned(batches: Iterator[pa.RecordBatch], bits: np.ndarray, short: list[int], guarantee: int, k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Each document's number of words and the runs that may meet an item."""

    def found(words: Words) -> tuple[list[int], list[int], list[int], list[int]]:
        """(n, fingerprint, first word, past the last word) of the runs that pass the bitmap."""
        lo, hi, h = words.long_runs(guarantee, k)
        own = may_meet(h, bits)
        parts = [(np.full(int(own.sum()), guarantee), h[own], lo[own], hi[own] + guarantee - 1)]
        for n in short:
            at, h = words.short_runs(n)
            own = may_meet(h, bits)
            parts.append((np.full(int(own.sum()), n), h[own], at[own], at[own] + n))
        n, h, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
        return n.tolist(), h.astype(B.U64).view(np.int64).tolist(), lo.tolist(), hi.tolist()

    for keys, texts in B.text_blocks(batches):
        runs: list[list] = [[] for _ in texts]
        n_words = np.zeros(len(texts), np.int64)
        usual = [i for i, t in enumerate(texts) if len(t) <= size]
        if usual:
            words = Words([texts[i] for i in usual])
            n_words[usual] = np.diff(words.edge)
            for n, h, lo, hi in zip(*found(words), strict=True):
                of = int(words.text[lo])
                runs[usual[of]].append({"n": n, "h": h, "lo": lo - int(words.edge[of]), "words": words.joined(lo, hi)})
        for i in set(range(len(texts))) - set(usual):
            for first, piece in word_pieces(texts[i], guarantee - 1, size):
                words = Words([piece])
                n_words[i] = first + len(words.starts)
                for n, h, lo, hi in zip(*found(words), strict=True):
                    runs[i].append({"n": n, "h": h, "lo": first + lo, "words": words.joined(lo, hi)})
        yield pa.record_batch(
            [pa.array([x[0] for x in keys], pa.int64()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array(n_words), pa.array(runs, pa.list_(_RUN))],
            schema=_SCAN,
        )


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def contamination(docs: DataFrame, benchmark: DataFrame, guarantee: int = GUARANTEE, k: int = K, most: int = FILTER_WORDS, size: int = _PIECE) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, spans (word positions, start and end in turn) and the items met, a row for each input row."""
    with scratch():
        each, found = contaminated_texts(docs, benchmark, guarantee, k, most, size)
    none = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    return each.select("doc_id", "text_key", "n_words").join(found, "text_key", "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")
    )


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, guarantee: int, k: int, most: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The scanned documents (doc_id, text_key, n_words, runs), and (text_key, n_hit, spans, items) of the texts that hold a window."""
    of_items = kept(item_windows(benchmark, guarantee, k), "item-windows")
    prints = kept(of_items.select("n", "h").distinct(), "item-fingerprints")
    short = sorted(r["n"] for r in prints.filter(F.col("n") < guarantee).select("n").distinct().collect())  # under ``guarantee`` numbers
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(prints, most))
    schema = "doc_id bigint, text_key binary, n_words bigint, runs array<struct<n:int,h:bigint,lo:bigint,words:string>>"
    each = kept(mapped(docs.select("doc_id", "text"), lambda it: scanned(it, shared.value, short, guarantee, k, size), schema), "document-fingerprints", stay=True)
    # both sides' fingerprints meet; then windows, word by word
    met = each.select("text_key", F.inline("runs")).join(prints, ["n", "h"], "left_semi")
    words = met.select("text_key", "n", "lo", F.split("words", " ").alias("w"))
    windows = words.select("text_key", "n", "w", "lo", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("i"))
    windows = windows.select("text_key", "n", (F.col("lo") + F.col("i")).alias("start"), F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("gram"))
    listed = of_items.select("n", "gram", "item").distinct()
    kind = ("n_in", "x", "y")
    grams = kept(
        listed.groupBy("n", "gram").agg(F.count("*").alias("n_in"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y")),
        "item-grams",
    )
    hits = kept(windows.join(grams, ["n", "gram"]).select("text_key", "start", "n", *kind).distinct(), "hits")
    own = Window.partitionBy("text_key").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0)
    runs = hits.select("text_key", "start", "n").distinct().select("text_key", "start", "n", new.alias("new")).withColumn("run", F.sum("new").over(own))
    runs = runs.groupBy("text_key", "run").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("n")).alias("b"))
    spans = runs.groupBy("text_key").agg(
        F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("a", "b"))), lambda s: F.array(s["a"], s["b"]))).alias("spans")
    )
    of_kind = listed.join(grams, ["n", "gram"]).select(*kind, "item").distinct()
    items = hits.select("text_key", *kind).distinct().join(of_kind, list(kind)).select("text_key", "item").distinct()
    items = items.groupBy("text_key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return each, kept(spans.join(items, "text_key"), "contaminated-texts", stay=True)


def judged(found: DataFrame) -> DataFrame:
    """The contract's columns from contamination()."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones. Whether a text is contaminated depends on its words alone, so the rejected texts' keys suffice."""
    with scratch():
        bad = contamination(docs, benchmark).filter(contaminated()).select(F.col("text_key").alias("_bad_text")).distinct()
        bad = few_dropped(kept(bad, "rejected", stay=True))
    return docs.join(bad, text_key(docs["text"]) == bad["_bad_text"], "left_anti")
