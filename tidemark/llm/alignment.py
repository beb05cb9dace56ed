"""Alignment of two tokenizers' tokens of the same text, by a dangling-suffix transducer.

A and B cut the same bytes. Read side by side, at any moment one side leads, by bytes that the other one has not matched yet: the
residual, always a suffix of the leader's last token. The side that lags gives the next token, which overlaps the leader's last
one: that is one link. The state (who leads, residual) and the token give the next state; transitions are remembered by state and
token. An empty residual closes a group. So a group of a + b tokens has a + b - 1 links, in the order in which they are read.

Where white space follows a character that is none, or a mark of MARKS a letter (of ASCII or Latin-1), either tokenizer's tokens end: A's
pre-tokenizer cuts there, and no piece of B's goes across (checked against its pieces when the model is loaded; with a model that has such pieces
a whole text is one word). Groups end there as well, so a stretch between such places, a *word*, is tokenized and aligned once and remembered;
the new words of a block go through the transducer together.

1. Each task counts its words, and from them its linked id pairs; Spark sums the pairs' counts.
2. The pairs' counts, and which of them are their B id's highest, go to all tasks while they fit PAIR_BYTES, and each document is
   read from its words' sums. Beyond, each document's pairs are joined with the counts by a shuffle, to the same result.

Edge cases: a text that is null or empty, or that either side's tokens do not spell (some character became another one), has no tokens: zeros and an
empty string; a very long text is read whole; rows repeated whole get the same
row each and count each time; ties for a B id's highest count all count as highest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .packing import byte_characters
from .shared import KEY, batches_of, kept, kept_between, mapped

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of pairs (16 each) that go to all tasks at most.
PAIR_BYTES = 64 << 20
#: Words and bytes of words that a worker remembers; transitions that it remembers.
REMEMBERED, REMEMBERED_BYTES, TRANSITIONS = 600_000, 80 << 20, 1_000_000
#: What stands before a stretch of text that B reads; marks that may end a word.
LEAD, MARKS = "\n", ".,;:!?)\"%*#$&"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: With fewer texts left, the transducer reads them one by one.
FEW = 24
#: Bytes of texts whose words are looked up together.
TOGETHER = 2 << 20
#: Pairs that a task holds before it gives them to Spark.
HELD_PAIRS = 1 << 20
_SHIFT, _LOW = 32, (1 << 32) - 1


class Transducer:
    """Aligns tokens given as ids, by their bytes; many texts move together, a token each at a time."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]  # the side that gives the next token, what it has to match
        self.number = {(0, b""): 0}
        self.side = np.zeros(1, np.int8)
        self.keys, self.to = np.zeros(0, np.int64), np.zeros(0, np.int64)  # transitions: state and token, in order, and the next state

    def step(self, state: int, token: int) -> int:
        """The state after the lagging side gave a token; -1 where the two sides' bytes differ."""
        side, residual = self.states[state]
        new = self.bytes[side][token]
        if residual.startswith(new):
            to = (side, residual[len(new) :])
        elif new.startswith(residual):
            to = (1 - side, new[len(residual) :])
        else:
            return -1
        if not to[1]:
            to = (0, b"")
        if to not in self.number:
            self.number[to] = len(self.states)
            self.states.append(to)
        return self.number[to]

    def moved(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The next states: transitions seen before are looked up, new ones are made and remembered."""
        keys = states << _SHIFT | tokens
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.unique(keys[~known])
            made = [self.step(k >> _SHIFT, k & _LOW) for k in new.tolist()]
            where = np.searchsorted(self.keys, new)
            self.keys, self.to = np.insert(self.keys, where, new), np.insert(self.to, where, made)
            if len(self.side) < len(self.states):
                self.side = np.array([s for s, _ in self.states], np.int8)
            at = np.searchsorted(self.keys, keys)
        return self.to[at]

    def rest(self, one: int, flat: np.ndarray, at: list, end: list, last: list, state: int, group: int, own: np.ndarray, links: list, texts: list) -> tuple[bool, int]:
        """align() for what is left of one text."""
        made: list[int] = []
        some: list[tuple[int, int]] = []
        known = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)) if len(self.keys) < 4 * (end[0] + end[1] - at[0] - at[1]) else {}
        while state >= 0 and (at[0] < end[0] or at[1] < end[1]):
            side = self.states[state][0]
            here = at[side]
            if here >= end[side]:
                state = -1
                break
            last[side] = token = int(flat[here])
            some.append((here, group))
            at[side] += 1
            if state:
                made.append(last[0] << _SHIFT | last[1])
            key = state << _SHIFT | token
            if key not in known:
                known[key] = self.step(state, token)
            state = known[key]
            group += state == 0
        links.append(np.array(made, np.int64))
        texts.append(np.full(len(made), one))
        for here, g in some:
            own[here] = g
        return state >= 0, state

    def align(self, ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """For texts whose ids stand one after the other up to their ends: which are spelt alike, each token's group in its text (for A, for B),
        the links a << 32 | b in the order read, and the text of each link."""
        if len(self.keys) > TRANSITIONS:
            self.forget()
        n = len(ends[0])
        flat, width = np.concatenate(ids), len(ids[0])
        at = np.stack([np.concatenate(([0], e[:-1])) for e in ends]) + np.array([[0], [width]])
        end = np.stack(ends) + np.array([[0], [width]])
        group, state, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((2, n), np.int64)
        own, good = np.zeros(len(flat), np.int64), np.ones(n, bool)
        links, texts = [], []
        alive = np.flatnonzero((at < end).any(axis=0))
        while len(alive) > FEW:
            side = self.side[state[alive]]
            here = at[side, alive]
            short = here >= end[side, alive]
            if short.any():  # the side that lags has no more tokens
                good[alive[short]] = False
                alive, side, here = alive[~short], side[~short], here[~short]
            token, before = flat[here], state[alive]
            own[here], last[side, alive] = group[alive], token
            linked = alive[before > 0]
            links.append(last[0, linked] << _SHIFT | last[1, linked])
            texts.append(linked)
            to = self.moved(before, token)
            group[alive] += to == 0
            at[side, alive] += 1
            state[alive] = to
            good[alive[to < 0]] = False
            alive = alive[(to >= 0) & (at[:, alive] < end[:, alive]).any(axis=0)]
        for one in alive.tolist():
            good[one], state[one] = self.rest(one, flat, at[:, one].tolist(), end[:, one].tolist(), last[:, one].tolist(), int(state[one]), int(group[one]), own, links, texts)
        good &= state == 0
        link, text = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (links, texts))
        order = np.argsort(text, kind="stable")
        return good, [own[:width], own[width:]], link[order], text[order]


def group_texts(ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], groups: list[np.ndarray]) -> list[str]:
    """Each text's groups as a1,a2|b1;a3|b2."""
    text = [np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in ends]
    place = np.concatenate([(t << _SHIFT | g) << 1 | side for side, (t, g) in enumerate(zip(text, groups, strict=True))])
    order = np.argsort(place, kind="stable")
    place, names = place[order], np.concatenate(ids)[order].tolist()
    sep = np.full(len(place), 0)
    step = place[1:] != place[:-1]
    sep[1:] = np.where(~step, 0, np.where(place[1:] >> 1 == place[:-1] >> 1, 1, np.where(place[1:] >> (_SHIFT + 1) == place[:-1] >> (_SHIFT + 1), 2, 3)))
    marks = [",", "|", ";", "\n"]
    whole = "".join([f"{marks[s]}{t}" for s, t in zip(sep.tolist(), names, strict=True)])[1:].split("\n")
    out, some = [""] * len(ends[0]), np.unique(np.concatenate(text))
    for i, t in zip(some.tolist(), whole, strict=False):
        out[i] = t
    return out


class Grown:
    """An array that rows are added to."""

    def __init__(self, width: int = 0):
        self.rows, self.n = np.zeros((1024, width) if width else 1024, np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        while self.n + len(rows) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Words:
    """Ids, groups and links of words, remembered."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c: b for b, c in byte_characters().items()}
        names = (self.a.id_to_token(i) for i in range(self.a.get_vocab_size()))
        a_bytes = [bytes(back[c] for c in name) if all(c in back for c in name) else name.encode() for name in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer(a_bytes, b_bytes)
        # B's ids of a stretch inside a text are those after LEAD, if LEAD is spelt by bytes, which join nothing
        self.lead = list(self.b.encode(LEAD))
        alone = any(self.b.is_byte(i) for i in self.lead[-1:]) and not any(LEAD in p for p in pieces)
        crossed = {(p[i + 1], bool(re.match(_LETTER, p[i]))) for p in pieces for i in range(len(p) - 1) if p[i] != "▁"}
        self.spaces, self.marks = np.zeros(256, bool), np.zeros(256, bool)
        self.spaces[[ord(c) for c in " \t\n" if not crossed & {(c, True), (c, False)}]] = True
        self.marks[[ord(m) for m in MARKS if (m, True) not in crossed]] = True
        self.divides = alone and ("▁", False) not in crossed and ("▁", True) not in crossed
        self.score, self.rated = None, ""
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, B.U64), np.zeros(0, np.int64)  # words' hashes in order, and their numbers
        self.groups: list[str] = []
        self.sizes = Grown(4)  # tokens of A and of B, groups, 1 if its bytes are not spelt
        self.begin = Grown()  # where its links begin; they end where the next word's begin
        self.links = Grown()
        self.scores = Grown(2)  # by rate(): links that are highest, sum of counts
        self.held = 0

    def borders(self, buf: np.ndarray) -> np.ndarray:
        """Where a word begins that isn't a text's first: a space after a character that is printable ASCII or one of U+00C0 to U+00FF, or a mark after a letter of these."""
        before, here = buf[:-1], buf[1:]
        two = np.zeros(len(before), bool)
        two[1:] = buf[:-2] == 0xC3
        solid = ((before > 0x20) & (before < 0x7F)) | two
        letter = _ASCII_LETTER[before] | (two & (before != 0x97) & (before != 0xB7))  # not the signs of multiplication and division
        return 1 + np.flatnonzero((self.spaces[here] & solid) | (self.marks[here] & letter))

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, a space before each that isn't empty, in a row; where their words begin and end; the text of each word."""
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        at = np.cumsum(size) - size
        buf = np.frombuffer(b"".join([b" " + t for t in texts if t] + [bytes(8)]), np.uint8)  # so that eight bytes can be read from any word's start
        n = int(size.sum())
        first = np.zeros(n + 1, bool)
        first[at[size > 0]] = True
        if self.divides and n:
            first[self.borders(buf[:n])] = True
        starts = np.flatnonzero(first[:n])
        return buf, starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(at[size > 0], starts, "right") - 1

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words by number, and the text of each; an empty text has none, nor has one with a word that isn't spelt. Words are told
        apart by a 64-bit hash of their bytes, length and first eight bytes."""
        if len(self.groups) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        buf, starts, ends, text = self.cut(texts)
        if not len(starts):
            return starts, text
        text = np.flatnonzero([bool(t) for t in texts])[text]
        size = (ends - starts).astype(B.U64)
        eight = np.zeros(len(starts), B.U64)
        for k in range(8):
            eight |= np.where(size > k, buf[starts + k], 0).astype(B.U64) << B.U64(8 * k)
        h = B.mix(B.word_hashes(buf, starts, ends) ^ B.mix(eight + B.mix(size)))
        own, where, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        miss = np.ones(len(own), bool)
        inside = at < len(self.keys)
        miss[inside] = self.keys[at[inside]] != own[inside]
        if miss.any():
            whole, new = buf.tobytes(), where[miss]
            first = len(self.groups)
            self.learn([whole[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self.keys = np.insert(self.keys, at[miss], own[miss])
            self.place = np.insert(self.place, at[miss], np.arange(first, first + len(new)))
            at = np.searchsorted(self.keys, own)
        got = self.place[at][back]
        wrong = np.zeros(len(texts), bool)
        wrong[text[self.sizes.rows[got, 3] > 0]] = True
        return got[~wrong[text]], text[~wrong[text]]

    def rate(self, score, name: str) -> None:
        """From now on words have scores by ``score`` of links; those known get theirs at once. name: what tells one such function from another."""
        if name != self.rated:
            self.score, self.rated, self.scores = score, name, Grown(2)
            if score and self.groups:
                size = self.sizes.rows[: self.sizes.n]
                self.scores.add(self.rates(self.links.rows[: self.links.n], size[:, 0] + size[:, 1] - size[:, 2]))

    def rates(self, links: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        best, n = self.score(links)
        return np.stack([sums(best.astype(np.int64), sizes), sums(n, sizes)], axis=1)

    def learn(self, words: list[str]) -> None:
        encoded = []
        for lo in range(0, len(words), 4096):
            some = words[lo : lo + 4096]
            a = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            b = [i[len(self.lead) :] for i in self.b.encode([LEAD + w for w in some], num_threads=1)] if self.divides else self.b.encode([w[1:] for w in some], num_threads=1)
            encoded += zip(a, b, strict=True)
        ids = tuple(np.array([t for e in encoded for t in e[side]], np.int64) for side in (0, 1))
        ends = tuple(np.cumsum([len(e[side]) for e in encoded]) for side in (0, 1))
        good, groups, links, word = self.transducer.align(ids, ends)
        a_bytes = self.transducer.bytes[0]
        good &= np.fromiter((b"".join([a_bytes[t] for t in e[0]]) == w.encode() for e, w in zip(encoded, words, strict=True)), bool, len(words))
        first = len(self.groups)
        self.groups += group_texts(ids, ends, groups)
        a, b = (np.diff(e, prepend=0) for e in ends)
        n_links = np.bincount(word, minlength=len(words))
        self.sizes.add(np.stack([a, b, a + b - n_links, ~good], axis=1))
        self.begin.add(self.links.n + np.cumsum(n_links) - n_links)
        self.links.add(links)
        if self.score:
            self.scores.add(self.rates(links, n_links))
        self.held += sum(map(len, words)) + sum(map(len, self.groups[first:])) + 8 * len(links)

    def links_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of words, and how many each has."""
        begin = self.begin.rows[words]
        size = self.sizes.rows[words, 0] + self.sizes.rows[words, 1] - self.sizes.rows[words, 2]
        place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.links.rows[place], size


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole-number sums of runs of values."""
    past = np.concatenate(([0], np.cumsum(values)))
    end = np.cumsum(sizes)
    return past[end] - past[end - sizes]


_words: dict[tuple[str, str], Words] = {}
kept_between["alignment"] = _words.clear


def loaded(a_file: str, b_file: str) -> Words:
    if (a_file, b_file) not in _words:
        import public_tokenizers

        _words[a_file, b_file] = Words(*(f if "/" in f else public_tokenizers.path(f) for f in (a_file, b_file)))
    return _words[a_file, b_file]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    some, at = np.unique(k, return_inverse=True)
    total = np.zeros(len(some), np.int64)
    np.add.at(total, at, c)
    return some, total


def link_counts(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(pair, n): how many links corpus-wide hold each linked pair of ids, a << 32 | b."""

    def given(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["pair", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(a_file, b_file)
        own.rate(None, "")
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for _, texts in B.text_blocks(batches, TOGETHER):
            words, times = np.unique(own.numbers(texts)[0], return_counts=True)
            links, size = own.links_of(words)
            held = merged([held[0], links], [held[1], np.repeat(times, size)])
            if len(held[0]) > HELD_PAIRS:
                yield given(*held)
                held = (held[0][:0], held[1][:0])
        if len(held[0]):
            yield given(*held)

    pairs = mapped(docs.select("text"), task, "pair bigint, n bigint", "alignment")
    return pairs.groupBy("pair").agg(F.sum("n").alias("n"))


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def arrow(fields: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in fields.split(", ")])


def batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_COUNTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def rated(counts: DataFrame) -> DataFrame:
    """(pair, n, best): best if no pair of the B id has a higher count."""
    by_b = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(_LOW)))
    highest = by_b.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B
    return by_b.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def counted(own: Words, words: np.ndarray, text: np.ndarray, texts: int) -> list[list]:
    """The texts' counts and digests, by column."""
    size = np.bincount(text, minlength=texts)
    a, b, groups = (sums(own.sizes.rows[words, k], size) for k in range(3))
    names, out, lo = own.groups, [], 0
    listed = words.tolist()
    for n in size.tolist():
        out.append(hashlib.sha256(";".join([names[w] for w in listed[lo : lo + n]]).encode()).hexdigest() if n else "")
        lo += n
    return [a.tolist(), b.tolist(), groups.tolist(), (a + b - groups).tolist(), out]


def by_words(docs: DataFrame, pairs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """The documents' rows where the rated pairs go to all tasks."""
    table = pairs.orderBy("pair").toArrow()
    arrays = tuple(table.column(c).to_numpy() for c in ("pair", "n", "best"))
    shared = docs.sparkSession.sparkContext.broadcast(arrays)  # PAIR_BYTES at most
    name = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(a_file, b_file)
        keys, n, best = shared.value

        def score(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, links), max(0, len(keys) - 1))
            there = keys[at] == links if len(keys) else np.zeros(len(links), bool)  # not there: links of words in texts that aren't spelt
            return (best[at] & there, np.where(there, n[at], 0)) if len(keys) else (there, np.zeros(len(links), np.int64))

        own.rate(score, name)
        for ids, texts in B.text_blocks(batches, TOGETHER):
            words, text = own.numbers(texts)
            size = np.bincount(text, minlength=len(texts))
            scores = [sums(own.scores.rows[words, k], size).tolist() for k in (0, 1)]
            yield batch([[d for (d,) in ids], *counted(own, words, text, len(texts)), *scores], schema)

    fields = _COUNTS + ", n_best bigint, count_sum bigint"
    schema = arrow(fields)
    return mapped(docs.select("doc_id", "text"), task, fields, "alignment")


def by_pairs(docs: DataFrame, pairs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """The documents' rows where the pairs are too many: a document's pairs, counted, meet the table in a join."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(a_file, b_file)
        own.rate(None, "")
        for ids, texts in B.text_blocks(batches, TOGETHER):
            words, text = own.numbers(texts)
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            pairs = [np.unique(own.links_of(words[lo:hi])[0], return_counts=True) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            own_rows = [[d for d, _ in ids], *counted(own, words, text, len(texts)), [r for _, r in ids]]
            yield batch([*own_rows, [k.tolist() for k, _ in pairs], [t.tolist() for _, t in pairs]], schema)

    fields = _COUNTS + f", {KEY} bigint, pairs array<bigint>, times array<bigint>"
    schema = arrow(fields)
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias(KEY), "text")
    rows = kept(mapped(numbered, task, fields, "alignment"), "aligned")
    each = rows.select(KEY, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(KEY, F.col("p.pairs").alias("pair"), F.col("p.times").alias("t"))
    sums = each.join(pairs, "pair").groupBy(KEY).agg(F.sum(F.col("t") * F.col("best").cast("bigint")).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.join(sums, KEY, "left").select(*(f.split()[0] for f in _COUNTS.split(", ")), zero("n_best"), zero("count_sum"))


def aligned(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """The contract's columns."""
    with batches_of(docs.sparkSession, 1000):
        pairs = kept(rated(kept(link_counts(docs, a_file, b_file), "pairs")), "rated-pairs")
        how = by_words if pairs.count() * 16 <= pair_bytes else by_pairs
        got = kept(how(docs, pairs, a_file, b_file), "alignment")
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
