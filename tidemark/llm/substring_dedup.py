"""Substring dedup: Rabin-Karp hashes of every 20-word window, counted in Spark.

1. Each document's words are hashed, and of these every window of WINDOW words (vectorised rolling sums).
2. A window also has a minimiser, the smallest hash of its GRAM-word pieces. Consecutive windows
   mostly share it, so they travel as runs (minimiser, document, start, count, hashes) to a part
   chosen by the minimiser: equal windows meet in a part, at about ten bytes a window.
3. Before they travel, windows that occur earlier in the same block are settled there (the map-side
   combine): a window that is everywhere costs a row for each block, not for each occurrence.
4. In a part equal windows are counted by minimiser and hash together, 128 bits; all but the first (by
   doc_id, then start) are repeated. Repeated windows of a document merge into maximal intervals.
5. A part is sorted in memory, so it must be bounded. A pass before the others counts the windows of each part (a
   number for each part and task). Where a part has more than MOST windows and four times the mean (a frequent
   phrase is the minimiser of very many windows, alike or not), its windows do not travel as runs: each is a row,
   and Spark counts them by (minimiser, hash), with partial aggregation, and joins the repeated ones back.
6. Each document meets its intervals, loses the words in them, and the rest is put together.

Edge cases: null text has no words; texts shorter than a window lose nothing; rows repeated whole
are one document (none of them loses words to its own repeats) and each gets its row; rows that share a
doc_id but not the text are ordered by a hash of the text; null doc_id comes first. Texts are read whole,
however long. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from . import blocks as B
from .shared import KEY, document_key, kept, mapped, partitions_for, scratch

WINDOW, GRAM, PARTS = 20, 5, 1024
#: Parts at most: their counts are an array in each task of the first pass. Windows of a part that is sorted in memory.
MOST_PARTS, MOST = 1 << 22, 2_000_000
_NULL_ID = -(2**63)
_RUN = np.dtype([("min", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<u4"), ("n", "<u2")])
#: Rows on their way: part and a packed array of runs with their hashes, or (kind 1) one settled interval.
_ROW = "part int, doc bigint, key bigint, lo bigint, hi bigint, runs binary, hashes binary"
_FIELDS = [f.split()[0] for f in _ROW.split(", ")]


def _settled(part: int, doc: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    parts = (np.arange(n) % part).astype(np.int32) if part else np.zeros(n, np.int32)
    none = pa.nulls(n, pa.binary())
    return pa.record_batch([pa.array(x) for x in (parts, doc, key, lo.astype(np.int64), hi.astype(np.int64))] + [none, none], names=_FIELDS)


def runs_of(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (from, to) in ``starts`` of its stretches of consecutive values over which all of ``same`` is constant."""
    if not len(starts):
        return np.arange(0), np.arange(0)
    new = np.diff(starts) != 1
    for s in same:
        new |= s[1:] != s[:-1]
    edge = np.flatnonzero(new) + 1
    return np.concatenate(([0], edge)), np.concatenate((edge, [len(starts)]))


def first_of_equal(hashes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each place whether an equal window, by hash and minimiser, stands at an earlier one."""
    order = np.argsort(hashes)
    h, m = hashes[order], least[order]
    same = (h[1:] == h[:-1]) & (m[1:] == m[:-1])
    repeated = np.zeros(len(h), bool)
    if same.any():
        lo, hi = runs_of(np.arange(len(h)), h, m)
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        member = np.concatenate([order[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        least = np.repeat(np.minimum.reduceat(member, np.concatenate(([0], np.cumsum(hi - lo)[:-1]))), hi - lo)
        repeated[member[member != least]] = True
    return repeated


def part_of(least: np.ndarray, parts: int) -> np.ndarray:
    return (B.mix(least) % B.U64(parts)).astype(np.int64)


def loads(batches: Iterator[pa.RecordBatch], window: int, gram: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, n): the windows of each part, a row for each part that the task has met."""
    n = np.zeros(parts, np.int32)
    for _, texts in B.text_blocks(batches):
        buf, at = B.joined(texts)
        starts, ends = B.word_spans(buf)
        if len(starts) < window:
            continue
        edge = np.searchsorted(starts, at)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(edge))
        inside = doc[: len(doc) - window + 1] == doc[window - 1 :]
        least = B.sliding_min(B.window_hashes(B.word_hashes(buf, starts, ends), gram), window - gram + 1)[inside]
        which, count = np.unique(part_of(least, parts), return_counts=True)
        n[which] += count.astype(np.int32)
    met = np.flatnonzero(n)
    yield pa.record_batch([pa.array(met.astype(np.int32)), pa.array(n[met].astype(np.int64))], names=["part", "n"])


_WINDOW = "h bigint, m bigint, doc bigint, key bigint, start bigint"


def shipped(batches: Iterator[pa.RecordBatch], window: int, gram: int, parts: int, crowded: np.ndarray, apart: bool = False) -> Iterator[pa.RecordBatch]:
    """Runs of the windows of parts that are not crowded, and settled intervals. Apart: the other windows, each as a row."""
    for keys, texts in B.text_blocks(batches):
        ids = np.array([[k[0] if k[0] is not None else _NULL_ID, k[1]] for k in keys], np.int64).reshape(-1, 2)
        order = np.lexsort((ids[:, 1], ids[:, 0]))
        ids = ids[order]
        once = np.ones(len(ids), bool)
        once[1:] = (ids[1:] != ids[:-1]).any(axis=1)  # rows repeated whole are one document
        ids, texts = ids[once], [texts[i] for i in order[once].tolist()]
        buf, at = B.joined(texts)
        starts, ends = B.word_spans(buf)
        words = B.word_hashes(buf, starts, ends)
        if len(words) < window:
            continue
        edge = np.searchsorted(starts, at)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(edge))
        where = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
        if not len(where):
            continue
        hashes = B.window_hashes(words, window)[where]
        least = B.sliding_min(B.window_hashes(words, gram), window - gram + 1)[where]
        doc = doc[where]
        again = first_of_equal(hashes, least)
        if len(crowded):
            alone = np.isin(part_of(least, parts), crowded)
            if apart:
                own = alone & ~again
                d = doc[own]
                cols = hashes[own].view(np.int64), least[own].view(np.int64), ids[d, 0], ids[d, 1], where[own] - edge[d]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], names=[f.split()[0] for f in _WINDOW.split(", ")])
                continue
        else:
            alone = np.zeros(len(hashes), bool)
        if again.any():
            lo, hi = runs_of(where[again], doc[again])
            a, d = where[again], doc[again][lo]
            yield _settled(parts, ids[d, 0], ids[d, 1], a[lo] - edge[d], a[hi - 1] - edge[d] + window)
        new = ~again & ~alone
        where, hashes, least, doc = where[new], hashes[new], least[new], doc[new]
        lo, hi = runs_of(where, least, doc)
        run = np.zeros(len(lo), _RUN)
        d = doc[lo]
        run["min"], run["doc"], run["key"] = least[lo], ids[d, 0], ids[d, 1]
        run["start"], run["n"] = where[lo] - edge[d], 0
        part = part_of(run["min"], parts).astype(np.int32)
        # a run is cut where its count no longer fits (one word over and over)
        if len(lo) and (hi - lo).max() > 60000:
            cut = [(i, k) for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)) for k in range(x, y, 60000)]
            pick = np.array([i for i, _ in cut])
            first = np.array([k for _, k in cut])
            last = np.minimum(first + 60000, hi[pick])
            run, part = run[pick], part[pick]
            run["start"] += (first - lo[pick]).astype(np.uint32)
            lo, hi = first, last
        run["n"] = hi - lo
        by = np.argsort(part, kind="stable")
        counts = (hi - lo)[by]
        take = np.repeat(lo[by] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        hashes, run, part = hashes[take], run[by], part[by]
        a, b = runs_of(np.arange(len(part)), part)
        past = np.concatenate(([0], np.cumsum(counts)))
        n = len(a)
        columns = {f: np.ascontiguousarray(run[f]) for f in _RUN.names}
        blobs = [b"".join(columns[f][x:y].tobytes() for f in _RUN.names) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        tails = [hashes[past[x] : past[y]].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        none = pa.nulls(n, pa.int64())
        yield pa.record_batch([pa.array(part[a]), none, none, none, none, pa.array(blobs, pa.binary()), pa.array(tails, pa.binary())], names=_FIELDS)


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // _RUN.itemsize
    out, at = np.zeros(n, _RUN), 0
    for f in _RUN.names:
        size = _RUN[f].itemsize * n
        out[f] = np.frombuffer(blob, _RUN[f], n, at)
        at += size
    return out


def repeated_in(blobs: list[bytes], tails: list[bytes], window: int) -> pa.RecordBatch:
    """The intervals of one part's windows that are not the first of their kind."""
    run = np.concatenate([_unpacked(b) for b in blobs])
    hashes = np.frombuffer(b"".join(tails), "<u8")
    at = np.repeat(np.arange(len(run), dtype=np.int32), run["n"])
    both = hashes + run["min"][at] * B.U64(0x9E3779B97F4A7C15)
    order = np.argsort(both)
    h = both[order]
    shared = np.zeros(len(h), bool)
    shared[1:] = h[1:] == h[:-1]
    shared[:-1] |= shared[1:].copy()
    pick = order[shared]
    inside = pick - np.concatenate(([0], np.cumsum(run["n"].astype(np.int64))))[at[pick]]
    r = run[at[pick]]
    start = r["start"].astype(np.int64) + inside
    rank = np.lexsort((start, r["key"], r["doc"], r["min"], hashes[pick]))
    r, start, hp = r[rank], start[rank], hashes[pick][rank]
    later = np.zeros(len(r), bool)
    later[1:] = (hp[1:] == hp[:-1]) & (r["min"][1:] == r["min"][:-1])
    # a row repeated whole in another block is the same document: not later than itself
    head = np.maximum.accumulate(np.where(later, 0, np.arange(len(r))))
    later &= (r["doc"] != r["doc"][head]) | (r["key"] != r["key"][head]) | (start != start[head])
    r, start = r[later], start[later]
    rank = np.lexsort((start, r["key"], r["doc"]))
    r, start = r[rank], start[rank]
    lo, hi = runs_of(start, r["doc"], r["key"])
    return _settled(0, np.ascontiguousarray(r["doc"][lo]), np.ascontiguousarray(r["key"][lo]), start[lo], start[hi - 1] + window)


def counted(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, a part at a time."""
    part, blobs, tails = None, [], []
    for batch in batches:
        settled = batch.filter(batch.column(5).is_null())
        if settled.num_rows:
            yield settled.select(_FIELDS[1:5])
        rows = batch.filter(batch.column(5).is_valid())
        for p, b, t in zip(rows.column(0).to_pylist(), rows.column(5).to_pylist(), rows.column(6).to_pylist(), strict=True):
            if p != part and blobs:
                yield repeated_in(blobs, tails, window).select(_FIELDS[1:5])
                blobs, tails = [], []
            part = p
            blobs.append(b)
            tails.append(t)
    if blobs:
        yield repeated_in(blobs, tails, window).select(_FIELDS[1:5])


def crowded_parts(docs: DataFrame, window: int, gram: int, parts: int, most: int) -> np.ndarray:
    """The parts with more windows than are sorted in memory together: ``parts`` numbers at most, far fewer as a rule."""
    counts = mapped(docs.select("doc_id", "text"), lambda it: loads(it, window, gram, parts), "part int, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
    told = Observation()  # the total comes with the parts themselves: nothing is written for it
    over = counts.observe(told, F.coalesce(F.sum("n"), F.lit(0)).alias("n")).filter(F.col("n") > most).collect()
    limit = max(most, 4 * told.get["n"] // parts)
    return np.array(sorted(r["part"] for r in over if r["n"] > limit), np.int64)


def crowded_intervals(docs: DataFrame, window: int, gram: int, parts: int, crowded: np.ndarray) -> DataFrame:
    """The windows of crowded parts that are not the first of their kind, counted by Spark."""
    each = kept(mapped(docs, lambda it: shipped(it, window, gram, parts, crowded, True), _WINDOW), "crowded-windows")
    first = each.groupBy("h", "m").agg(F.count("*").alias("n"), F.min(F.struct("doc", "key", "start")).alias("first")).filter("n > 1")
    later = each.join(kept(first, "repeated-hashes"), ["h", "m"]).filter(F.struct("doc", "key", "start") != F.col("first"))
    return later.select("doc", "key", F.col("start").alias("lo"), (F.col("start") + window).alias("hi"))


def repeated_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, parts: int = PARTS, most: int = MOST) -> DataFrame:
    """(doc, key, lo, hi): word intervals to remove; those of a document may overlap."""
    tasks = partitions_for(docs, 2.7)
    parts = min(MOST_PARTS, max(parts, 8 * tasks))
    crowded = crowded_parts(docs, window, gram, parts, most)
    docs = docs.select("doc_id", document_key().alias(KEY), "text")
    rows = mapped(docs, lambda it: shipped(it, window, gram, parts, crowded), _ROW)
    dealt = rows.repartition(tasks, "part").sortWithinPartitions("part")
    out = mapped(dealt, lambda it: counted(it, window), "doc bigint, key bigint, lo bigint, hi bigint")
    return out.unionByName(crowded_intervals(docs, window, gram, parts, crowded)) if len(crowded) else out


def remaining(words: list[bytes], intervals: list[tuple[int, int]]) -> list[bytes]:
    if not intervals:
        return words
    out, at = [], 0
    for lo, hi in sorted(intervals):
        out += words[at:lo]
        at = max(at, hi)
    return out + words[at:]


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, parts: int = PARTS, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (what is left, one space between words): a row for each input row."""
    with scratch():
        # a table of its own: both sides of the join are plain exchanges then, so a document that is there many times can be split
        cuts = repeated_intervals(docs, window, gram, parts, most).groupBy("key", "doc").agg(F.collect_set(F.struct("lo", "hi")).alias("cut"))
        own = kept(cuts, "repeated-windows", stay=True)
    rows = docs.select("doc_id", document_key().alias("key"), F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), "text")
    rows = rows.join(own.hint("shuffle_hash"), ["key", "doc"], "left").select("doc_id", "text", "cut")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, left = [], [], []
            for t, cut in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True):
                words = (t.as_py() or b"").split()
                rest = remaining(words, [(c["lo"], c["hi"]) for c in cut or ()])
                texts.append(b" ".join(rest))
                n.append(len(words))
                left.append(len(words) - len(rest))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(left, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return mapped(rows, task, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def digested(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


