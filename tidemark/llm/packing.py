"""Best-fit-decreasing packing of token sequences.

Longer documents are cut into pieces of CAPACITY tokens; only the last piece may be shorter. Best-fit
decreasing takes the pieces by falling length and puts each into the fullest open bin that still has room.
Which bin that is depends on lengths alone, so the plan is made from the histogram of lengths (CAPACITY
rows at most, whatever the input): equal bins are runs, equal pieces are placed a run at a time, and a
segment tree over the remaining capacities finds the tightest open bin in logarithmic time. The plan is
a table of rules (length, first rank, last rank, first bin, bins, pieces per bin, offset) whose size is
bounded by CAPACITY as well. Pieces get their rank among those of their length in two levels (counts for
each length and bucket, then a row number inside the bucket), so no length is gathered in one task. Buckets follow the
input, and pieces are dealt to them evenly, whatever they hold: equal rows and rows without a doc_id do not meet.

Edge cases: null text is empty; an empty text is one piece, the end id alone; rows repeated whole are
packed one by one; ties (equal lengths) go by bucket, which is dealt, and doc_id; an empty table gives an empty result;
null doc_ids are kept.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import blocks as B
from .shared import batches_of, kept, kept_between, mapped, partitions_for

CAPACITY, END_ID, TOKENIZER = 2048, 0, "word_bpe_49k.json"
BUCKETS = 512  # at least
#: Words whose ids a worker remembers, and parts of words; beyond that it forgets them and goes on.
REMEMBERED, PARTS = 500_000, 50_000
#: Bytes of texts whose words are looked up together.
TOGETHER = 1 << 20


#: Bytes of a text beyond which it is split into words a part at a time.
LONG = 4 << 20


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """text cut after about each size bytes, at ASCII white space only."""
    space, lo = re.compile(rb"[ \t-\r]"), 0
    while lo < len(text):
        m = space.search(text, min(lo + size, len(text)))
        hi = m.end() if m else len(text)
        yield text[lo:hi]
        lo = hi


#: Words whose characters the normaliser leaves alone but for case: printable ASCII and the Latin-1 letters.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The pre-tokeniser's pattern, for such words in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts from ids of their words.

    The tokenizer's normaliser and pre-tokeniser never look across ASCII white space, and drop it; so a
    text's ids are its words' ids in a row. A block's words are hashed together; ids of words seen before
    are gathered from one array. A new word's parts are looked up or go straight to the tokenizer's model
    when they are plain, any other new word goes through the whole tokenizer. Two words count as one if hash,
    length and first eight bytes agree.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.alphabet = byte_characters()
        self.parts: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, B.U64), np.zeros(0, np.int32)  # hashes in order, and their places in the three arrays
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.check = np.zeros(1 << 16, B.U64)
        self.flat = np.zeros(1 << 18, "<u4")
        self.used = 0

    def part(self, text: str) -> bytes:
        symbols = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        got = self.parts[text] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(symbols)])
        return got

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids."""
        parts, plain, split = self.parts, _PLAIN.fullmatch, _PARTS.findall
        if len(parts) > PARTS:
            parts.clear()
        out: list[bytes] = []
        other = []
        for w in words:
            text = w.decode()
            if plain(text) and "<|" not in text:
                out.append(b"".join([parts.get(p) or self.part(p) for p in split(text.lower())]))
            else:
                other.append(len(out))
                out.append(w)
        for lo in range(0, len(other), 4096):
            some = other[lo : lo + 4096]
            made = self.encoder.encode_batch_fast([out[i].decode() for i in some], add_special_tokens=False)
            for i, e in zip(some, made, strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def learn(self, hashes: np.ndarray, words: list[bytes], check: np.ndarray) -> None:
        """hashes: in order, none of them known."""
        made = self.encoded(words)
        first = len(self.keys)
        last = first + len(made)
        sizes = np.array([len(m) // 4 for m in made], np.int64)
        ids = np.frombuffer(b"".join(made), "<u4")
        while last > len(self.begin):
            self.begin, self.count, self.check = (np.concatenate((a, np.zeros_like(a))) for a in (self.begin, self.count, self.check))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.begin[first:last] = self.used + np.cumsum(sizes) - sizes
        self.count[first:last], self.check[first:last] = sizes, check
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.place = np.insert(self.place, at, np.arange(first, last, dtype=np.int32))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes are known."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)] == hashes

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        lo = 0
        while lo < len(texts):
            if len(texts[lo]) > LONG:  # a very long text a part at a time; a part that is still as long has no white space to cut at
                yield b"".join(b"".join(self.block([part])) for part in slices(texts[lo], LONG // 2))
                lo += 1
                continue
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= TOGETHER) and len(texts[hi]) <= LONG:
                held += len(texts[hi])
                hi += 1
            yield from self.block(texts[lo:hi])
            lo = hi

    def block(self, texts: list[bytes]) -> Iterator[bytes]:
        buf, at = B.joined([*texts, b"       "])  # so that eight bytes can be read from the start of any word
        starts, ends = B.word_spans(buf)
        if not len(starts):
            yield from (b"" for _ in texts)
            return
        h = B.word_hashes(buf, starts, ends)
        n = (ends - starts).astype(B.U64)
        eight = np.zeros(len(starts), B.U64)
        for k in range(8):
            eight |= np.where(n > k, buf[starts + k], 0).astype(B.U64) << B.U64(8 * k)
        check = eight ^ (n << B.U64(56))
        order = np.argsort(h)
        sorted_h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = sorted_h[1:] != sorted_h[:-1]
        pick = order[new]
        own = h[pick]
        miss = ~self.known(own)
        if miss.any():
            if len(self.keys) + int(miss.sum()) > REMEMBERED:
                self.forget()
                miss[:] = True
            where = pick[miss]
            text = buf.tobytes()
            words = [text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            self.learn(own[miss], words, check[where])
        slot = np.empty(len(h), np.int64)
        slot[order] = self.place[np.searchsorted(self.keys, own)][np.cumsum(new) - 1]
        odd = np.flatnonzero(self.check[slot] != check)
        if len(odd):  # a word that shares its hash with another one: the texts go word by word
            for t in texts:
                yield b"".join(self.encoded(t.split()))
            return
        sizes = self.count[slot].astype(np.int64)
        past = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.begin[slot] - past[:-1], sizes) + np.arange(past[-1])]
        edge = past[np.searchsorted(starts, at)].tolist()
        for a, b in zip(edge[: len(texts)], edge[1:], strict=False):
            yield ids[a:b].tobytes()


_tokenizers: dict[str, WordTokenizer] = {}
kept_between["packing"] = _tokenizers.clear


def tokenizer(name: str) -> WordTokenizer:
    if name not in _tokenizers:
        if "/" in name:
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _tokenizers[name] = WordTokenizer(path)
    return _tokenizers[name]


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, name: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's token pieces; the ids themselves are re-made from the text where they are wanted."""
    tail = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(name)
        for keys, texts in B.text_blocks(batches, TOGETHER):
            cols: list[list] = [[] for _ in range(5)]
            for (doc,), ids in zip(keys, own.ids(texts), strict=True):
                ids += tail
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    for c, v in zip(cols, (doc, k, lo // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in PIECE.split(", ")])

    return mapped(docs.select("doc_id", "text"), task, PIECE, "packing")


class OpenBins:
    """Runs of equal open bins by remaining capacity, under a segment tree that tells which capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # remaining -> (first bin, bins)

    def _add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += bins
            at >>= 1

    def put(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.runs[room].append((first, bins))
            self._add(room, bins)

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that some open bin has."""
        at = least + self.leaves
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        first, bins = self.runs[room].popleft()
        got = min(bins, most)
        if got < bins:
            self.runs[room].appendleft((first + got, bins - got))
        self._add(room, -got)
        return first, got


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, rank from, rank to, first bin, pieces per bin, offset of the first) of best-fit decreasing.

    A bin that takes a piece and still has room for its like is then the tightest one, so equal pieces
    fill a bin before the next one is opened, as one by one they would.
    """
    rules, bins = [], 0
    spare = OpenBins(capacity)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = spare.tightest(length)
            if room is None:
                room, first, got = capacity, bins, -(-left // (capacity // length))
                bins += got
            else:
                first, got = spare.take(room, -(-left // (room // length)))
            each = room // length
            full = min(got, left // each)
            if full:
                rules.append((length, rank, rank + full * each, first, each, capacity - room))
                spare.put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < got:  # the last of these bins gets what is left
                rules.append((length, rank, rank + left, first + full, left, capacity - room))
                spare.put(room - left * length, first + full, 1)
                rank, left = rank + left, 0
    return rules


def packed(docs: DataFrame, name: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, buckets: int = 0) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    buckets = buckets or max(BUCKETS, partitions_for(docs, 1))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(buckets)).cast("int")  # fixed once the table is written
    with batches_of(spark, 1000):
        each = kept(pieces(docs, name, capacity, end_id).withColumn("bucket", bucket), "pieces")
    counts = each.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rules = plan(histogram, capacity)

    def table(rows: list[tuple], schema: str) -> DataFrame:
        cols = [f.split() for f in schema.split(", ")]
        lit = json.dumps([list(r) for r in rows])
        return spark.range(1).select(F.explode(F.from_json(F.lit(lit), "array<array<bigint>>")).alias("r")).select(
            *(F.col("r")[i].cast(t).alias(c) for i, (c, t) in enumerate(cols))
        )

    sofar = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias("before"))
    steps = table(rules, "length bigint, lo bigint, hi bigint, first bigint, each bigint, used bigint")
    # a rule's ranks are looked up by the places where rules begin, kept sorted in an array for each length
    starts = steps.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "first", "each", "used"))).alias("rules"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        each.withColumn("row", F.row_number().over(own))
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("row") - 1)
    )
    rule = F.element_at(F.filter("rules", lambda r: r["lo"] <= F.col("rank")), -1)
    return (
        ranked.join(F.broadcast(starts), "length")
        .withColumn("r", rule)
        .withColumn("in", F.col("rank") - F.col("r.lo"))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("r.first") + F.floor(F.col("in") / F.col("r.each"))).cast("long").alias("sequence_id"),
            (F.col("r.used") + F.col("in") % F.col("r.each") * F.col("length")).cast("long").alias("offset"),
        )
    )
