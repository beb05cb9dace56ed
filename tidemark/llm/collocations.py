"""Collocations: phrases of 2 to 4 words that stand together more often than their parts would.

1. Sketch. Each window of 1 to 4 words in a piece is hashed, by language, to one of many cells; a cell's count is at least that
   of any phrase hashed into it. There are about as many cells as the input has eighths of a byte, so the sketch is wide instead of
   deep, and it is never held whole: shards give the cells that they meet, packed by range of cells, and Spark brings each
   range's together. What is left is a bit for each cell with LEAST or more (cells share bits beyond FILTER_BITS).
2. Candidates. A window whose cell, and those of its shorter windows, reach LEAST may be frequent; no other one can. A shard's
   candidates (texts of one language, SHARD_BYTES or one text) are compiled into an automaton. A space on either side guards each
   phrase, so only whole words match, and pieces are parted by a line end, so no match crosses.
3. Scan. The automaton reads the shard and counts all its matches, overlapping ones as well; Spark sums the shards' counts. Every
   occurrence of a candidate is counted in the shard it stands in, so the sums are exact whatever the sketch let through.
4. Thresholds, the lowest-scoring cut, what longer phrases cover, and the first TOP of each language by rounds of windows over ever
   fewer buckets, so that no task gets all of a language's phrases.

The bits are the only thing that goes to all tasks, 32 MB at most. On inputs of hundreds of GB cells share bits and more windows pass:
the counts that travel grow towards those of all windows, the result stays the same.

Edge cases: null text is empty; a null language is ``und``; texts without words add nothing; ties in score go to the higher
count, then to the phrase's bytes; a very long text is cut at the ends of pieces; rows repeated whole count each time; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import blocks as B
from .shared import batches_of, kept, mapped, scratch

LEAST, LONGEST, TOP, NO_LANGUAGE = 30, 4, 2000, "und"
#: A longer phrase with so many hundredths of a candidate's count covers it; what a score is a multiple of.
COVER, UNIT = 80, 2_000_000
SHARD_BYTES, HELD_BYTES = 4 << 20, 16 << 20
#: Cells of a range, as a power of two; bits that go to all tasks, as a power of two.
RANGE_BITS, FILTER_BITS, MOST_BITS = 22, 28, 40
#: Buckets of the rounds that find the first TOP.
ROUNDS = (4096, 16, 1)
_CUT = re.compile(rb"[.,;:!?\n-\r]")


def parts(text: bytes) -> Iterator[bytes]:
    """A text cut after ends of pieces, so that each part but a piece that is longer itself has SHARD_BYTES at most."""
    while len(text) > SHARD_BYTES:
        ends = [m.end() for m in _CUT.finditer(text, SHARD_BYTES // 2, SHARD_BYTES)][-1:] or [m.end() for m in [_CUT.search(text, SHARD_BYTES)] if m]
        if not ends:
            break
        yield text[: ends[0]]
        text = text[ends[0] :]
    yield text


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, lower-cased, SHARD_BYTES together or one part of a text; HELD_BYTES are held at most."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for keys, texts in B.text_blocks(batches):
        for (lang,), text in zip(keys, texts, strict=True):
            for part in parts(text.lower()):
                held[lang].append(part)
                size[lang] += len(part)
                if size[lang] >= SHARD_BYTES or sum(size.values()) >= HELD_BYTES:
                    most = max(size, key=size.__getitem__)
                    size.pop(most)
                    yield most, held.pop(most)
    yield from held.items()


class Shard:
    """A shard's words, and the cells of its windows."""

    def __init__(self, lang: str, texts: list[bytes], bits: int):
        buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.buf, self.bits = buf, bits
        self.starts, self.ends = B.word_spans(buf, "phrase")
        self.piece = np.cumsum(B.PHRASE_END[buf], dtype=np.int64)[self.starts]
        self.hashes = B.word_hashes(buf, self.starts, self.ends)
        self.seed = B.U64(B.xxhash.xxh64_intdigest(lang.encode()))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of n words begin, and their cells."""
        if len(self.starts) < n:
            return np.zeros(0, np.int64), np.zeros(0, B.U64)
        inside = self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1]
        cells = B.mix(B.window_hashes(self.hashes, n) + self.seed + B.U64(n)) >> B.U64(64 - self.bits)
        return np.flatnonzero(inside), cells

    def words(self) -> list[str]:
        whole = self.buf.tobytes()
        return [whole[a:b].decode() for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising 32-bit numbers and counts up to 255."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(planes + np.minimum(counts, 255).astype(np.uint8).tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 5 * n, "zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.int64), raw[4 * n :].astype(np.uint16)


def sketch(docs: DataFrame, bits: int, longest: int = LONGEST) -> DataFrame:
    """(range, n, cells): the cells that a shard meets, with their counts, a row for each range of cells."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in shards(batches):
            own = Shard(lang, texts, bits)
            cells = np.sort(np.concatenate([own.windows(n)[1][own.windows(n)[0]] for n in range(1, longest + 1)]))
            first = np.flatnonzero(np.diff(cells, prepend=cells[:1] + B.U64(1)))
            counts = np.diff(first, append=len(cells))
            cells = cells[first]
            ranges = (cells >> B.U64(RANGE_BITS)).astype(np.int64)
            edge = [*np.flatnonzero(np.diff(ranges, prepend=-1)).tolist(), len(cells)]
            low = (cells & B.U64((1 << RANGE_BITS) - 1)).astype(np.uint32)
            rows = [(int(ranges[a]), b - a, packed(low[a:b], counts[a:b])) for a, b in zip(edge, edge[1:], strict=False)]
            for lo in range(0, len(rows), 64):
                r, n, c = zip(*rows[lo : lo + 64], strict=True)
                yield pa.record_batch([pa.array(r, pa.int64()), pa.array(n, pa.int32()), pa.array(c, pa.binary())], names=["range", "n", "cells"])

    return mapped(docs, task, "range bigint, n int, cells binary")


def reaching(sketched: DataFrame, bits: int, least: int) -> np.ndarray:
    """A bit for each cell, or each few cells, one of which has ``least`` or more: 2**FILTER_BITS at most."""
    fold = max(0, bits - FILTER_BITS)
    width = max(1, (1 << RANGE_BITS) >> fold)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(1 << RANGE_BITS, np.uint16), -1

        def done() -> pa.RecordBatch:
            there = (total >= least).reshape(width, -1).any(axis=1)
            return pa.record_batch([pa.array([at], pa.int64()), pa.array([pa.compress(np.packbits(there).tobytes(), "zstd", asbytes=True)], pa.binary())], names=["range", "bits"])

        for batch in batches:
            for r, n, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != at:
                    if at >= 0:
                        yield done()
                    total[:], at = 0, r
                where, counts = unpacked(cells, n)
                total[where] = np.minimum(total[where] + counts, 255)
        if at >= 0:
            yield done()

    per = mapped(sketched.repartition("range").sortWithinPartitions("range"), task, "range bigint, bits binary")
    out = np.zeros(1 << (min(bits, FILTER_BITS) - 3), np.uint8)
    step = width // 8
    for row in per.toLocalIterator():
        out[row["range"] * step : (row["range"] + 1) * step] = np.frombuffer(pa.decompress(bytes(row["bits"]), step, "zstd", asbytes=True), np.uint8)
    return out


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = 0) -> DataFrame:
    """(lang, words, phrase, a): how often each phrase of 1 to ``longest`` words stands in the language's texts, where that is ``least`` or
    more; and of no words, with an empty phrase, how many words there are. docs: (lang, text)."""
    if least > 255:
        raise ValueError("cells count to 255")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = bits or max(RANGE_BITS, min(MOST_BITS, math.ceil(math.log2(max(size, 1) / 8 + 1))))
    shared = docs.sparkSession.sparkContext.broadcast(reaching(sketch(docs, bits, longest), bits, least))  # 32 MB at most
    fold = max(0, bits - FILTER_BITS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for lang, texts in shards(batches):
            own = Shard(lang, texts, bits)
            words = own.words()
            if not words:
                continue
            phrases: list[tuple[int, str]] = []
            shorter = np.ones(len(words) + 1, bool)
            for n in range(1, longest + 1):
                begin, cells = own.windows(n)
                cells >>= B.U64(fold)
                there = np.zeros(len(words) + 1, bool)
                inside = cells[begin]
                there[begin] = (shared.value[(inside >> B.U64(3)).astype(np.int64)] >> (B.U64(7) - (inside & B.U64(7))).astype(np.uint8)) & 1
                there[:-1] &= shorter[:-1] & shorter[1:] if n > 1 else True
                at = np.flatnonzero(there).tolist()
                phrases += [(n, p) for p in {" ".join(words[i : i + n]) for i in at}]
                shorter = there
            automaton = ahocorasick.Automaton()
            for i, (_, p) in enumerate(phrases):
                automaton.add_word(f" {p} ", i)
            times = np.zeros(0, np.int64)
            if phrases:
                automaton.make_automaton()
                apart = (np.diff(own.piece, prepend=own.piece[0]) != 0).tolist()
                text = "".join([f"\n {w} " if new else f"{w} " for new, w in zip(apart, words, strict=True)])
                times = np.bincount(np.fromiter((i for _, i in automaton.iter(f" {text}")), np.int64), minlength=len(phrases))
            rows = [*((n, p, t) for (n, p), t in zip(phrases, times.tolist(), strict=True)), (0, "", len(words))]
            del automaton
            n, p, t = zip(*rows, strict=True)
            yield pa.record_batch([pa.array([lang] * len(rows)), pa.array(n, pa.int32()), pa.array(p, pa.string()), pa.array(t, pa.int64())], names=["lang", "words", "phrase", "a"])

    per = mapped(docs, task, "lang string, words int, phrase string, a bigint")
    return per.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).filter((F.col("words") == 0) | (F.col("a") >= least))


def part(first, n) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scored(found: DataFrame, cover: int = COVER) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers. found: a kept table of counted()."""
    every = found.filter("words > 0").select("lang", "phrase", "a")
    candidates = found.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")
    )
    named = lambda side, n: every.select("lang", F.col("phrase").alias(side), F.col("a").alias(n))
    # products of counts may pass 64 bits
    score = F.expr(f"cast(cast(a as decimal(20, 0)) * {UNIT} div (cast(l as decimal(20, 0)) + r) as bigint)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    both = cuts.join(named("left", "l"), ["lang", "left"]).join(named("right", "r"), ["lang", "right"])
    best = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")),
        )
    )
    covers = candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    covered = F.expr(f"cast(most as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {cover}")
    return best.join(covers, ["lang", "phrase"], "left").filter(F.col("most").isNull() | ~covered).drop("most")


def first_of_each(rows: DataFrame, most: int) -> DataFrame:
    """Each language's first rows by score, a and phrase, with their rank."""
    for buckets in ROUNDS:
        at = F.pmod(F.xxhash64("phrase"), F.lit(buckets))
        own = Window.partitionBy("lang", "_bucket").orderBy(F.desc("score"), F.desc("a"), "phrase")
        rows = rows.withColumn("_bucket", at).withColumn("rank", F.row_number().over(own).cast("bigint")).filter(F.col("rank") <= most)
    return rows.drop("_bucket")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, bits: int = 0) -> DataFrame:
    """The contract's columns."""
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    with batches_of(docs.sparkSession, 1000):
        found = kept(counted(texts, least, longest, bits), "phrases")
    with scratch():
        ranked = kept(first_of_each(scored(found, cover), top), "collocations", stay=True)
    words = found.filter("words = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
