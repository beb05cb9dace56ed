"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits link at T = 3 or fewer differing bits. Two that link differ in at most one
bit of the upper or of the lower half. Anchors of a half are the words of a covering code of
length 32: a Hamming code on 31 bits and one free bit, covering radius R = 1. With a threshold of
1 in a half, each fingerprint is replicated to every anchor within R + 1 = 2 (17 of them; the code
is perfect, so they are the same number for all), and the one that is its nearest is its home. The
nearest anchor of x is within 2 of every y that differs from x in at most one bit of the half, so
each link is seen where one end is at home, and only homes are compared with visitors.

Tables here grow with the input, so their joins are hinted to merge and none passes through the driver as a broadcast;
the rejected documents' keys alone go to all tasks, while they are few.

Skew: copies share a fingerprint and are one row from the start. An anchor with more than TILE
homes or visitors is cut into a grid of tiles of homes x visitors, each compared in a task of its
own; nothing is capped. A tile returns a spanning forest of its links, not the links; components
of the forests are the components of all links.

Edge cases: null text counts as empty; a text without words has fingerprint zero and links like
any other; rows repeated whole get the same row each; a component's id is null only if all its members'
are. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .blocks import U64
from .shared import components, few_dropped, kept, mapped, scratch

SHINGLE, SEED, MAX_BITS, TILE = 3, 42, 3, 4096
_NO_ID = 2**63 - 1


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= size:
        return h64(b" ".join(words), seed)
    counts, total = np.zeros(64, np.int64), len(words) - size + 1
    for lo in range(0, total, 65536):  # long texts in pieces, so that the unpacked bits stay small
        part = words[lo : min(lo + 65536, total) + size - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate(([0], ends[:-1]))
        spans = zip(starts[: len(part) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
        h = np.array([h64(line[a:b], seed) for a, b in spans], U64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (MD5 of the text), fp (the 64 bits as a signed long), a row for each input row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in B.text_blocks(batches):
            fp = np.array([fingerprint(t) for t in texts], U64).view(np.int64)
            digest = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), digest, pa.array(fp)], names=["doc_id", "text_key", "fp"])

    return mapped(docs.select("doc_id", "text"), task, "doc_id bigint, text_key binary, fp bigint")


def syndrome(x: np.ndarray) -> np.ndarray:
    """Of the Hamming code on bits 1..31 of each 32-bit word: exclusive or of the places of the bits set."""
    out = np.zeros(len(x), np.uint32)
    for bit in range(1, 32):
        out ^= ((x >> np.uint32(bit)) & np.uint32(1)) * np.uint32(bit)
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, near) of 32-bit words: the nearest anchor, and all 17 within distance 2 (the home among them).

    Flipping bit s repairs syndrome s (s = 0: none to flip); flipping bits i and i ^ s does as well;
    bit 0 is free, so it may be flipped besides a single repair.
    """
    half = half.astype(np.uint32)
    s = syndrome(half)
    one = np.uint32(1)
    fix = np.where(s > 0, one << s, np.uint32(0)).astype(np.uint32)
    home = half ^ fix
    near = [home, home ^ one]
    rows = np.arange(len(half))
    pairs = np.empty((len(half), 15), np.uint32)
    table = np.zeros((32, 15), np.uint32)
    for v in range(1, 32):  # the 15 unordered pairs {i, i ^ v} of places in 1..31 that leave out v itself
        got = sorted({(min(i, i ^ v), max(i, i ^ v)) for i in range(1, 32) if i != v})
        table[v] = [(1 << i) | (1 << j) for i, j in got]
    pairs[rows] = half[:, None] ^ table[s]
    out = np.column_stack([*near, pairs])
    out[s == 0, 2:] = home[s == 0][:, None]  # a code word itself: no other within 2 (the code's distance is 3)
    return home, out


def replicated(fps: DataFrame) -> DataFrame:
    """(half, anchor, fp, home) of distinct fingerprints."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16384):
                fp = batch.column(0).slice(lo, 16384).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                for part in (0, 1):
                    half = (fp >> U64(32 * part)).astype(np.uint32)
                    home, near = anchors(half)
                    first = np.ones(near.shape, bool)
                    first[:, 2:] &= near[:, 2:] != home[:, None]
                    at, col = np.nonzero(first)
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(at), part, np.int8)), pa.array(near[at, col].astype(np.int64)),
                            pa.array(fp[at].view(np.int64)), pa.array(col == 0),
                        ],
                        names=["half", "anchor", "fp", "home"],
                    )

    return mapped(fps.select("fp"), task, "half tinyint, anchor bigint, fp bigint, home boolean")


def tile_forest(fp: np.ndarray, home: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links between homes and all members of a tile."""
    members = np.unique(fp)
    label = np.arange(len(members))
    out: list[tuple[int, int]] = []
    for h in np.unique(fp[home]).tolist():
        near = np.flatnonzero(np.bitwise_count(members ^ U64(h)) <= most)
        own = int(np.searchsorted(members, U64(h)))
        kinds = np.unique(label[near])
        if len(kinds) > 1:
            others = kinds[kinds != label[own]]
            # one link from this home to a member of each other tree joins the trees
            for k in others.tolist():
                out.append((h, int(members[near[label[near] == k][0]])))
            label[np.isin(label, others)] = label[own]
    return out


def forests(tiles: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of the rows (tile columns..., fp, home), which come sorted by tile."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_rows: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            if len(rows):
                edge = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1)) + 1
                lo, hi = np.concatenate(([0], edge)), np.concatenate((edge, [len(rows)]))
                for a, b in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist(), strict=True):
                    out += tile_forest(rows[a:b, 4].view(U64), rows[a:b, 5] > 0)
            pairs = np.array(out, U64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            kept_rows.append(rows)
            change = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1))
            if len(change):  # the last tile of a batch may go on in the next one; a tile is bounded by TILE
                cut = int(change[-1]) + 1
                kept_rows[-1] = rows[:cut]
                yield solve(np.concatenate(kept_rows))
                kept_rows = [rows[cut:]]
        if kept_rows:
            yield solve(np.concatenate(kept_rows))

    return mapped(tiles, task, "a bigint, b bigint")


def links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) among distinct fingerprints that have the same components as all links within MAX_BITS."""
    spread = replicated(fps)
    homes = spread.filter("home").groupBy("half", "anchor").agg(F.count("*").alias("n_homes"))
    # visitors of anchors where nobody is at home can meet nobody
    met = kept(spread.join(homes.hint("merge"), ["half", "anchor"]), "anchors")
    busy = met.groupBy("half", "anchor").agg(F.count("*").alias("n")).filter("n > 1")
    sized = met.join(busy.hint("merge"), ["half", "anchor"])
    nh = F.ceil(F.col("n_homes") / F.lit(tile)).cast("int")
    nv = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), nh).cast("int"), F.pmod(F.xxhash64("fp", F.lit(2)), nv).cast("int")
    # a home row visits one column of tiles; at home it also meets the visitors of all columns in its row
    as_visitor = sized.select("half", "anchor", F.explode(F.sequence(F.lit(0), nh - 1)).alias("row"), own[1].alias("col"), "fp", F.lit(False).alias("home"))
    as_home = sized.filter("home").select("half", "anchor", own[0].alias("row"), F.explode(F.sequence(F.lit(0), nv - 1)).alias("col"), "fp", F.lit(True).alias("home"))
    tiles = as_visitor.unionByName(as_home)
    return forests(tiles.repartition("half", "anchor", "row", "col").sortWithinPartitions("half", "anchor", "row", "col"))


def classes(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, text_key, fp, component_id: a row for each input row."""
    each = kept(fingerprinted(docs), "fingerprints")
    # the smallest doc_id of a fingerprint stands for it
    with scratch():
        fps = kept(each.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
        joined = components(links(fps, tile)).withColumnRenamed("node", "fp")
        whole = fps.join(joined.hint("merge"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
        least = kept(whole.groupBy("component").agg(F.min("least_id").alias("component_id")), "component-ids")
        ids = kept(whole.join(least.hint("merge"), "component").select("fp", "component", "component_id"), "fingerprint-components", stay=True)
    return each.join(ids.hint("merge"), "fp")


def near_classes(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: a row for each input row."""
    return classes(docs, tile).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: of those with its smallest doc_id the one whose text has the smallest MD5.

    A document is a doc_id with a text: rows repeated whole are one, and all of them stay or go. What travels are
    the rejected documents' keys; texts do only where those are too many to broadcast.
    """
    with scratch():
        gone = few_dropped(kept(rejected(docs), "rejected", stay=True))
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (key == gone["_gone_text"]), "left_anti")


def rejected(docs: DataFrame) -> DataFrame:
    """(_gone_id, _gone_text): the documents that one_of_each() leaves out."""
    each = kept(classes(docs).select("component", "component_id", "doc_id", "text_key").distinct(), "near-classes")
    own = each.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = own.groupBy("component").agg(F.min("text_key").alias("stay_key"))
    gone = each.join(stay.hint("merge"), "component").filter(~F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("text_key") != F.col("stay_key")))
    return gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_text")).distinct()
