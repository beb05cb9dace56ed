"""Suffix-array dedup: bytes covered by a 200-byte string that stands anywhere else are removed.

One suffix array of a whole corpus fits no machine, so strings that can be equal are brought
together first, without loss: a WINDOW-byte string's anchor is the smallest hash of its GRAM-byte
pieces, a function of its bytes alone.

1. Consecutive window starts with one anchor are a run; a run with the bytes its windows cover is
   a segment. Each scan emits (anchor, XXH3-128 of the segment, document, start, count), about one row in
   90 bytes; a run of more than MOST windows is cut (windows are never cut). Documents are told apart by 128 bits too.
2. Anchors that occur once cannot hold a repeat; counting drops them (partial aggregation, then a
   semi-join whose hot keys Spark can split).
3. Of equal segments one stands for all, with their number as its weight. One that is alone under its
   anchor shares no window with another; its weight settles it. The bytes of the others go to a part chosen by
   anchor; parts hold about PART_BYTES, and an anchor with more than that is split by the windows' offset
   from their anchor, and one with more than eight times that by a hash of each window, both of which equal windows
   share too.
4. In each part: suffix array, Burrows-Wheeler transform, and breadth-first backward extension, which
   yields common prefixes by increasing value and stops at WINDOW (suffix_array.py).
5. The repeated places go back to all occurrences of the segments, and from there to the documents. Rows repeated whole are one
   document with their number as weight until their texts are cut, so a row that is there a million times costs a row and a count.

Edge cases: null text is empty; texts shorter than a window lose nothing; rows repeated whole are
documents like any other, so each repeats the other; a very long text is read in slices that overlap by a
window; ties (equal strings) all lose their bytes; an empty table gives an empty result; other columns are
ignored, whatever their names. Bytes that are removed may split a character: what is left is bytes, not text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .shared import MOST_PARTITIONS, dropped, few, kept, mapped, scratch
from .suffix_array import repeated_places

WINDOW, GRAM, MOST, PART_BYTES = 200, 32, 4096, 1 << 20
_SLICE = 1 << 20  # of one text, worked on at a time; with the block below 2**24 places
#: A segment's name: its hash in two halves and its number of windows. A document's: two hashes of doc_id and text.
_SEG, _DOC = ["anchor", "seg", "seg2", "n"], ["key", "key2"]
_SEGMENT = ["anchor", "band", "seg", "seg2", "n", "off", "weight", "body"]
_RUNS = "anchor bigint, seg bigint, seg2 bigint, key bigint, key2 bigint, start bigint, n int, many boolean"


def document() -> tuple:
    return F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "doc_id", "text").alias("key2")




def block_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of the texts buf[starts:ends]: text, first start in buf, count, anchor, hash (two halves), and whether the anchor stands there more than once."""
    c = B.rolling_prefix(buf.astype(B.U64) + B.U64(1))
    at = np.arange(len(buf) - gram + 1)
    h = B.mix(B.span_hash(c, at, at + gram))
    packed = B.sliding_min((h & ~B.U64(0xFFFFFF)) | at.astype(B.U64), window - gram + 1)
    first = (packed & B.U64(0xFFFFFF)).astype(np.int64)
    anchor = h[first]
    step = np.zeros(len(packed) + 1, np.int32)
    long = ends - starts >= window
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - window + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    edge = np.ones(len(packed), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    edge[starts[long]] = True
    edge &= valid
    lo = np.flatnonzero(edge)
    off = np.flatnonzero(~valid)
    stop = np.append(lo[1:], len(packed))
    if len(off):
        gap = np.append(off, len(packed))
        stop = np.minimum(stop, gap[np.searchsorted(off, lo)])
    moved = np.zeros(len(packed) + 1, np.int32)
    moved[2:] = np.cumsum(first[1:] != first[:-1])
    many = moved[stop] > moved[lo + 1]
    if len(lo) and (stop - lo).max() > MOST:
        pieces = -(-(stop - lo) // MOST)
        pick = np.repeat(np.arange(len(lo)), pieces)
        lo2 = lo[pick] + MOST * (np.arange(len(pick)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        lo, stop, many = lo2, np.minimum(lo2 + MOST, stop[pick]), many[pick] | (pieces[pick] > 1)
    n = stop - lo
    whole, digest = memoryview(buf), xxhash.xxh3_128_digest
    seg = np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(lo.tolist(), (lo + n + window - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return np.searchsorted(starts, lo, "right") - 1, lo, n, anchor[lo], seg, many


def runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RUNS.split(", ")]
        for keys, texts in B.text_blocks(batches):
            # a long text in slices that share window - 1 bytes
            part = [(k, lo, t[lo : lo + _SLICE + window - 1]) for k, t in zip(keys, texts, strict=True) for lo in range(0, max(1, len(t) - window + 1), _SLICE)]
            group: list = []
            held = 0
            for p in [*part, None]:
                if group and (p is None or held + len(p[2]) > B.BLOCK_BYTES):
                    buf, at = B.joined([g[2] for g in group])
                    if len(buf) > window:
                        doc, lo, n, anchor, seg, many = block_runs(buf, at[:-1], at[1:] - 1, window, gram)
                        key = np.array([g[0] for g in group], np.int64)[doc]
                        halves = (np.ascontiguousarray(x) for x in (seg[:, 0], seg[:, 1], key[:, 0], key[:, 1]))
                        start = lo - at[doc] + np.array([g[1] for g in group], np.int64)[doc]
                        yield pa.record_batch(
                            [pa.array(anchor.view(np.int64)), *map(pa.array, halves), pa.array(start), pa.array(n.astype(np.int32)), pa.array(many)], names=names
                        )
                    group, held = [], 0
                if p is not None:
                    group.append(p)
                    held += len(p[2])

    return mapped(docs.select(*_DOC, "text"), task, _RUNS)


def repeated_rows(docs: DataFrame) -> DataFrame | None:
    """(key, key2, copies) of the rows that are there more than once, as a kept table; none where there are none."""
    again = kept(docs.select(*document()).groupBy(*_DOC).agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated-rows")
    return again if again.take(1) else None


def once(docs: DataFrame, again: DataFrame | None) -> DataFrame:
    """(key, key2, text): a row for each document, rows repeated whole being one. Only their texts are shuffled, one from each task."""
    rows = docs.select(*document(), "text")
    if again is None:
        return rows
    keys = few(again.select(*_DOC), 32)
    return rows.join(keys, _DOC, "left_anti").unionByName(rows.join(keys, _DOC, "left_semi").groupBy(*_DOC).agg(F.first("text").alias("text")))


def occurrences(rows: DataFrame, again: DataFrame | None, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The runs whose anchor stands in another place as well, with the number of rows that are their document."""
    every = kept(runs(rows, window, gram), "runs")
    if again is None:
        times = every.withColumn("copies", F.lit(1).cast("bigint"))
    else:
        times = every.join(few(again, 40), _DOC, "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))
    shared = kept(times.groupBy("anchor").agg(F.sum("copies").alias("c"), F.max("many").alias("m")).filter("c > 1 or m").select("anchor"), "anchors")
    out = kept(times.join(shared, "anchor", "left_semi"), "occurrences")
    dropped(every, shared)
    return out


def bands(body: bytes, width: int, window: int, gram: int) -> list[tuple[int, int, int]]:
    """A segment's windows by the offset of their anchor, ``width`` offsets together: (band, first start, past the last)."""
    buf = np.frombuffer(body, np.uint8)
    c = B.rolling_prefix(buf.astype(B.U64) + B.U64(1))
    at = np.arange(len(buf) - gram + 1)
    h = B.mix(B.span_hash(c, at, at + gram))
    packed = B.sliding_min((h & ~B.U64(0xFFFFFF)) | at.astype(B.U64), window - gram + 1)
    band = ((packed & B.U64(0xFFFFFF)).astype(np.int64) - np.arange(len(packed))) // width
    edge = np.flatnonzero(np.diff(band)) + 1
    lo, hi = np.concatenate(([0], edge)), np.append(edge, len(band))
    return list(zip(band[lo].tolist(), lo.tolist(), hi.tolist(), strict=True))


def segments(docs: DataFrame, occ: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = PART_BYTES) -> tuple[DataFrame, int, DataFrame]:
    """(anchor, band, seg, seg2, n, off, weight, bytes) of the distinct segments to sort, their number of bytes, and
    (anchor, seg, seg2, n, spans) of those that are settled: alone under their anchor and without a repeat of
    it inside, so that no other string shares a window with them and their windows repeat just as they do."""
    at = F.min(F.struct(*_DOC, "start")).alias("at")
    distinct = kept(occ.groupBy(*_SEG).agg(F.sum("copies").alias("weight"), F.max("many").alias("many"), at), "segments")
    bytes_ = F.col("n") + window - 1
    anchors = kept(distinct.groupBy("anchor").agg(F.sum(bytes_).alias("b"), F.count("*").alias("kinds")), "anchor-sizes")
    known = kept(distinct.join(anchors, "anchor"), "known-segments")
    alone = (F.col("kinds") == 1) & ~F.col("many")
    settled = known.filter(alone & (F.col("weight") > 1)).select(*_SEG, F.array(F.lit(0).cast("bigint"), bytes_.cast("bigint")).alias("spans"))
    rest = known.filter(~alone)
    total = rest.agg(F.coalesce(F.sum(bytes_), F.lit(0)).alias("b")).first()["b"]
    # 0: whole; 1: by window; else so many anchor offsets of its windows go to a part together
    width = F.when(F.col("b") <= most, 0).when(F.col("b") <= 8 * most, 16).otherwise(1)
    wanted = rest.groupBy("at.key", "at.key2").agg(
        F.collect_list(F.struct(*_SEG, "weight", F.col("at.start").alias("start"), width.alias("width"))).alias("cut")
    )
    rows = docs.join(kept(wanted, "wanted-segments").hint("shuffle_hash"), _DOC).select("text", "cut")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for t, cut in zip(batch.column(0).cast(pa.large_binary()), batch.column(1), strict=True):
                text = t.as_py() or b""
                for c in cut.as_py():
                    body = text[c["start"] : c["start"] + c["n"] + window - 1]
                    if c["width"] == 1:  # a very crowded anchor: window by window
                        digest = xxhash.xxh32_intdigest
                        parts = [((digest(body[lo : lo + window]) >> 1), lo, lo + 1) for lo in range(c["n"])]
                    else:
                        parts = [(-1, 0, c["n"])] if not c["width"] else bands(body, c["width"], window, gram)
                    for band, lo, hi in parts:
                        out.append((c["anchor"], band, c["seg"], c["seg2"], c["n"], lo, c["weight"], body[lo : hi + window - 1]))
                        if len(out) >= 8192:
                            yield table(out)
                            out = []
        yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 8
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_SEGMENT)

    return mapped(rows, task, "anchor bigint, band int, seg bigint, seg2 bigint, n int, off int, weight bigint, body binary"), total, settled


def covered(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows sorted by part -> (anchor, seg, seg2, n, spans): byte intervals of each segment that repeated windows cover."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        seen = {(a, s, s2, n, o): (w, b) for a, s, s2, n, o, w, b in rows}
        made = repeated_places([b for _, b in seen.values()], [w for w, _ in seen.values()], window)
        keys, spans = [], []
        for k, where in zip(seen, made, strict=True):
            if len(where):
                edge = np.flatnonzero(np.diff(where) > window) + 1
                lo = where[np.concatenate(([0], edge))]
                hi = where[np.append(edge, len(where)) - 1] + window
                keys.append(k[:4])
                spans.append((np.column_stack([lo, hi]).reshape(-1) + k[4]).tolist())
        cols = list(zip(*keys, strict=True)) or [(), (), (), ()]
        return pa.record_batch(
            [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int32()), pa.array(spans, pa.list_(pa.int64()))], names=[*_SEG, "spans"]
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for p, *row in zip(*cols, strict=True):
                if p != part and rows:
                    yield solve(rows)
                    rows = []
                part = p
                rows.append(row)
        if rows:
            yield solve(rows)

    return mapped(parts, task, "anchor bigint, seg bigint, seg2 bigint, n int, spans array<bigint>")


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = PART_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_bytes: a row for each input row."""
    with scratch():
        spans = kept(removed_spans(docs, window, gram, most), "spans", stay=True)
    rows = docs.select("doc_id", *document(), "text").join(spans.hint("shuffle_hash"), _DOC, "left").select("doc_id", "text", "spans")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t, s in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                text = t.as_py() or b""
                left, n = removed(text, s.values.to_numpy(zero_copy_only=False) if s.is_valid else None)
                for c, v in zip(out, (len(text), len(text) - len(left), n, left), strict=True):
                    c.append(v)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"],
            )

    return mapped(rows, task, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_bytes binary")


def removed_spans(docs: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    """(key, key2, spans): the byte intervals that each document loses, start and end in turn; they may overlap."""
    again = repeated_rows(docs)
    rows = once(docs, again)
    occ = occurrences(rows, again, window, gram)
    cut, total, settled = segments(rows, occ, window, gram, most)
    parts = max(1, -(-total // most))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, -(-total // (32 << 20))))
    part = F.pmod(F.xxhash64("anchor", "band"), F.lit(parts)).cast("int")
    laid = cut.select(part.alias("part"), *_SEG, "off", "weight", "body").repartition(tasks, "part").sortWithinPartitions("part")
    found = kept(covered(laid, window).unionByName(settled), "covered")
    return (
        occ.join(found, _SEG)
        .select(*_DOC, F.transform("spans", lambda x: x + F.col("start")).alias("spans"))
        .groupBy(*_DOC)
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def removed(text: bytes, spans: np.ndarray | None) -> tuple[bytes, int]:
    """(what is left without the intervals, the number of maximal runs that went)."""
    if spans is None or not len(spans):
        return text, 0
    step = np.zeros(len(text) + 1, np.int32)
    np.add.at(step, spans[0::2], 1)
    np.add.at(step, spans[1::2], -1)
    out = np.cumsum(step[:-1]) > 0
    n = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~out].tobytes(), n


def digested(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


