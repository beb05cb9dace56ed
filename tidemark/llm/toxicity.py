"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of rows of one hashed table: those of the word itself and of its first
4, 5 and 6 bytes, so that unseen forms of a known stem are near it. Filters of widths 1, 2 and 3 run over
the whole text, their maxima over the places of its own words feed a logistic layer. Max pooling sends
gradient to a few places of a text only, which keeps training cheap. After training the weights are rounded to
multiples of GRID, so that all sums of a score are exact in the arithmetic used and a text's score is the same, to
the bit, alone, in any batch and in any partition.

Training uses every labelled row whose crc32 of doc_id is not 1 modulo 3. They are dealt by a hash of doc_id to shares of
about SHARE_ROWS rows and SHARE_BYTES of text. In each of ROUNDS rounds every share is a task that goes on from
the common weights over its own rows, and the shares' weights are averaged, TOGETHER at a time (rows of the table over the shares that changed them). A
quarter of each share stays out of training; all these quarters' logits, counted in bins of 1 / BINS, calibrate the threshold for each language;
the score puts that threshold at 0.7. Languages are learnt from the labelled rows' texts alone, as
clusters of their pairs of bytes (k-means begun in one share, moved by all rows): labels, lang, source and doc_id are no inputs of a
score. Every text is scored whole. What the driver holds is one set of weights and the bins.

Edge cases: null text counts as empty; an empty text (no words) is never predicted toxic; labels without a doc_id or
a value are left out, several labels of a document count as their maximum; without labels of both
kinds every score is 0; a labelled doc_id that several texts share stands for one of them, fixed by length and
hash; rows repeated whole get the same row each, and so do equal texts; a text of any length is scored whole, in
pieces of bounded size; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B
from .shared import few, kept, mapped, only, released, scratch

SHARE_ROWS, SHARE_BYTES, TOGETHER, ROUNDS, BINS = 5000, 8 << 20, 16, 4, 256
TABLE, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
STEPS, BATCH, SEED, CUT = 700, 32, 7, 0.7
#: Weight of a text without words among each batch's clean ones, and how far every threshold stays above its logit.
NOTHING, ABOVE = 6.0, 0.25
_PREFIXES = (0, 4, 5, 6)  # 0: the whole word
_PAD = max(WIDTHS) - 1
#: Step of the rounded weights. Table rows and filters stay under WEIGHT: products of them need 2 * (16 + 4) + 2 bits, their sums 6 more.
GRID, WEIGHT = 2.0**-16, 16.0
#: Languages that are told apart at most, and numbers that a text's profile has.
LANGUAGES, PROFILE = 6, 512


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def profile(text: bytes) -> np.ndarray:
    """Square roots of the shares of a text's pairs of bytes in words, hashed to PROFILE places: a unit vector, or zeros."""
    buf = np.frombuffer(text.lower(), np.uint8)
    if len(buf) < 2:
        return np.zeros(PROFILE)
    inside = ~B.SEPARATORS["alnum"][buf]
    pair = (buf[:-1].astype(np.int64) << 8 | buf[1:])[inside[:-1] & inside[1:]]
    n = np.bincount(pair * 40503 >> 5 & (PROFILE - 1), minlength=PROFILE)
    return np.sqrt(n / n.sum()) if n.any() else np.zeros(PROFILE)


def centres(texts: list[bytes], k: int = LANGUAGES, rounds: int = 12) -> np.ndarray:
    """Profiles of the languages that texts are in, learnt without being told which: spherical k-means, begun with the texts farthest apart."""
    x = np.stack([profile(t) for t in texts])
    x = x[x.any(axis=1)]
    if not len(x):
        return np.zeros((1, PROFILE))
    at = [int((x @ x.mean(axis=0)).argmax())]
    for _ in range(min(k, len(x)) - 1):
        at.append(int((x @ x[at].T).max(axis=1).argmin()))
    c = x[at]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return np.rint(c / GRID) * GRID


def features(texts: list[bytes], table: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word (words x prefixes), documents apart by padding rows of zero; and where each document begins."""
    buf, at = B.joined([*(t.lower() for t in texts), b" " * max(_PREFIXES)])
    at = at[: len(texts) + 1]
    starts, ends = B.word_spans(buf, "alnum")
    out = np.empty((len(starts), len(_PREFIXES)), np.int32)
    for k, n in enumerate(_PREFIXES):
        if n:
            h = np.zeros(len(starts), B.U64)
            for j in range(n):
                h |= np.where(starts + j < ends, buf[starts + j], 0).astype(B.U64) << B.U64(8 * j)
            h = B.mix(h)
        else:
            h = B.word_hashes(buf, starts, ends)
        out[:, k] = 1 + (B.mix(h + B.U64(k)) % B.U64(table - 1)).astype(np.int32)
    edge = np.searchsorted(starts, at)
    n = np.diff(edge)
    begin = np.concatenate(([0], np.cumsum(n + _PAD)[:-1])) if len(n) else np.arange(0)
    rows = np.zeros((int(n.sum() + _PAD * len(n)) + _PAD, len(_PREFIXES)), np.int32)
    place = np.repeat(begin - edge[:-1], n) + np.arange(len(starts))
    rows[place] = out
    return rows, begin.astype(np.int64)


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    languages: np.ndarray = field(default_factory=lambda: np.zeros((1, PROFILE)))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: float = 1.0
    trained: bool = True
    square: np.ndarray = field(default_factory=lambda: np.full(TABLE, 1e-6, np.float32))  # of the table's rows: squares of the gradients so far

    @classmethod
    def fresh(cls, seed: int = SEED) -> Model:
        r = np.random.default_rng(seed)
        table = r.normal(0, 0.03, (TABLE, DIM)).astype(np.float32)
        table[0] = 0
        filters = {w: r.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        return cls(table, filters, bias, r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32))

    def copy(self) -> Model:
        return replace(self, table=self.table.copy(), square=self.square.copy(), filters=dict(self.filters), bias=dict(self.bias))

    def dense(self) -> list[np.ndarray]:
        return [*(self.filters[w] for w in WIDTHS), *(self.bias[w] for w in WIDTHS), self.out, np.array([self.out_bias])]

    def moved(self, begun: Model, n: int) -> np.ndarray:
        """n times what has changed since ``begun``, and n: sums of these make an average. The table's rows count where they changed."""
        met = self.square != begun.square
        parts = [np.array([n]), met * n, (self.table - begun.table) * n, (self.square - begun.square) * n]
        return np.concatenate([x.reshape(-1).astype(np.float32) for x in (*parts, *((a - b) * n for a, b in zip(self.dense(), begun.dense(), strict=True)))])

    def onward(self, sums: np.ndarray, languages: np.ndarray) -> Model:
        """This model with the average of what shares have changed."""
        sizes = [1, TABLE, TABLE * DIM, TABLE, *(x.size for x in self.dense())]
        n, met, table, square, *dense = np.split(sums, np.cumsum(sizes)[:-1])
        met = np.maximum(met, 1)
        new = [(a + (b / n[0]).reshape(a.shape)).astype(np.float32) for a, b in zip(self.dense(), dense, strict=True)]
        k, length = len(WIDTHS), np.linalg.norm(languages, axis=1, keepdims=True)
        old = self.languages if len(self.languages) == len(languages) else languages
        return replace(
            self, table=self.table + table.reshape(TABLE, DIM) / met[:, None], square=self.square + square / met, filters=dict(zip(WIDTHS, new[:k], strict=True)), bias=dict(zip(WIDTHS, new[k : 2 * k], strict=True)),
            out=new[-2], out_bias=float(new[-1][0]), languages=np.where(length > 0, languages / np.maximum(length, 1e-300), old),
        )

    def rounded(self) -> None:
        """Weights on the grid; filters as doubles, in which their products with sums of rows add up without error."""
        to_grid = lambda a: (np.rint(np.clip(a, -WEIGHT, WEIGHT) / GRID) * GRID)
        self.table = to_grid(self.table).astype(np.float32)
        self.filters = {w: to_grid(f).astype(np.float64) for w, f in self.filters.items()}
        self.bias = {w: to_grid(b).astype(np.float64) for w, b in self.bias.items()}

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x += self.table[rows[:, k]]
        return x

    def maps(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Filter values at each place (places x filters), before the rectifier; none where no word begins."""
        n = len(x) - _PAD
        every = x @ np.concatenate([f for w in WIDTHS for f in self.filters[w]], axis=1)  # places x (widths, offsets, filters)
        out, at = np.empty((n, FILTERS * len(WIDTHS)), every.dtype), 0
        for a, w in enumerate(WIDTHS):
            z = out[:, a * FILTERS : (a + 1) * FILTERS]
            z[:] = self.bias[w]
            for o in range(w):
                z += every[o : n + o, at : at + FILTERS]
                at += FILTERS
        out[rows[:n, 0] == 0] = -np.inf  # between documents: such a place may see the next one's words
        return out

    def logits(self, texts: list[bytes]) -> np.ndarray:
        rows, begin = features(texts)
        n, step = len(rows) - _PAD, 1 << 15
        best = np.zeros((len(texts), len(self.out)))
        for lo in range(0, n, step):  # places in pieces, so that memory doesn't follow the longest text
            hi = min(n, lo + step)
            own = rows[lo : hi + _PAD]
            z = self.maps(own, self.vectors(own).astype(np.float64))
            first = int(np.searchsorted(begin, lo, "right")) - 1
            last = int(np.searchsorted(begin, hi, "left"))
            cuts = np.maximum(begin[first:last] - lo, 0)
            best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(z, cuts, axis=0))
        return (best * self.out).sum(axis=1) + self.out_bias  # row by row: a product with a matrix may depend on its other rows

    def language(self, text: bytes) -> int:
        """Place of the language whose profile the text's is nearest to; the first for a text without words. Each text by itself, so batches don't matter."""
        return int((self.languages * profile(text)).sum(axis=1).argmax())

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        lang = np.array([self.language(t) for t in texts], int)
        z = self.scale * (self.logits(texts) - self.thresholds[lang]) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(model: Model, made: list[np.ndarray], y: np.ndarray) -> tuple[dict, dict, np.ndarray, float, np.ndarray, np.ndarray]:
    """Of a batch's mean log loss: gradients of filters, biases, output weights and output bias, and rows of the table with theirs (a row may come
    more than once). made: each document's features; all documents go through the filters in one product."""
    rows = np.concatenate([*made, np.zeros((_PAD, len(_PREFIXES)), np.int32)])  # a document's features end with a border
    begin = np.concatenate(([0], np.cumsum([len(m) for m in made])))
    x = model.vectors(rows)
    z = model.maps(rows, x)
    where = np.stack([lo + z[lo:hi].argmax(axis=0) if hi > lo else np.zeros(z.shape[1], np.int64) for lo, hi in zip(begin[:-1], begin[1:], strict=True)])
    top = np.maximum(z[where, np.arange(z.shape[1])], 0)
    top[np.diff(begin) == 0] = 0
    p = 1 / (1 + np.exp(-np.clip(top @ model.out + np.float32(model.out_bias), -30, 30)))
    d = ((p - y) / len(made)).astype(np.float32)
    dz = np.where(top > 0, d[:, None] * model.out, 0).astype(np.float32)
    g_f, g_b, ids, grads = {}, {}, [], []
    for a, w in enumerate(WIDTHS):
        own = slice(a * FILTERS, (a + 1) * FILTERS)
        g_b[w] = dz[:, own].sum(axis=0)
        g_f[w] = np.stack([np.einsum("dfk,df->kf", x[where[:, own] + o], dz[:, own]) for o in range(w)])
        doc, f = np.nonzero(dz[:, own])
        for o in range(w):
            at = rows[where[doc, a * FILTERS + f] + o]
            ids.append(at.reshape(-1))
            grads.append(np.repeat(dz[doc, a * FILTERS + f][:, None] * model.filters[w][o][:, f].T, at.shape[1], axis=0))
    return g_f, g_b, d @ top, float(d.sum()), np.concatenate(ids), np.concatenate(grads)


@dataclass
class Share:
    """Some labelled texts: which of them calibrate, and features of the others, which train."""

    texts: list[bytes]
    y: np.ndarray
    seed: int = SEED

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        order = np.concatenate([r.permutation(np.flatnonzero(self.y == v)) for v in (0, 1)])
        self.calibrate = np.zeros(len(self.y), bool)
        self.calibrate[order[::4]] = True
        for v in (0, 1):  # where there are few, all of them train
            if (self.y == v).sum() < 8:
                self.calibrate[self.y == v] = False
        self.fit = [r.permutation(np.flatnonzero(~self.calibrate & (self.y == v))) for v in (0, 1)]

    def kept_out(self) -> tuple[list[bytes], np.ndarray]:
        return [self.texts[i] for i in np.flatnonzero(self.calibrate)], self.y[self.calibrate]

    def descend(self, model: Model, first: int, steps: int) -> None:
        """Steps from number ``first`` on: each label's rows come in turn, so that all are learnt from."""
        made: list[np.ndarray] = []
        for lo in range(0, len(self.texts), 64):
            rows, begin = features(self.texts[lo : lo + 64])
            made += [rows[a:b].copy() for a, b in zip(begin, [*begin[1:], len(rows) - _PAD], strict=True)]
        rate, memory = 0.05, {}

        def adam(key, value, grad):
            m, v, t = memory.get(key, (0.0, 0.0, 0))
            m, v, t = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad, t + 1
            memory[key] = m, v, t
            return value - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

        toxic = BATCH // 3 if len(self.fit[0]) else BATCH  # a third of each batch is toxic
        takes = (BATCH - toxic, self.fit[0]), (toxic if len(self.fit[1]) else 0, self.fit[1])
        for step in range(first, first + steps):
            pick = np.concatenate([own[np.arange(step * k, (step + 1) * k) % len(own)] for k, own in takes if k and len(own)])
            g_f, g_b, g_out, g_bias, rows, grad = gradients(model, [made[i] for i in pick.tolist()], self.y[pick])
            # a text without words is clean: the bias alone must not say otherwise
            g_bias += NOTHING / BATCH / (1 + np.exp(-np.clip(model.out_bias, -30, 30)))
            if len(rows):
                ids, back = np.unique(rows, return_inverse=True)
                # sums of each id's gradients, by runs of equal ids
                order = np.argsort(back, kind="stable")
                total = np.add.reduceat(grad[order], np.flatnonzero(np.diff(back[order], prepend=-1)), axis=0)
                model.square[ids] += (total**2).mean(axis=1)
                total *= (rate / np.sqrt(model.square[ids]))[:, None]
                total[ids == 0] = 0
                model.table[ids] -= total
            for w in WIDTHS:
                model.filters[w] = adam(("f", w), model.filters[w], g_f[w]).astype(np.float32)
                model.bias[w] = adam(("b", w), model.bias[w], g_b[w]).astype(np.float32)
            model.out = adam("out", model.out, g_out + 1e-4 * model.out).astype(np.float32)
            model.out_bias = float(adam("bias", model.out_bias, g_bias))


def trained(texts: list[bytes], labels: list[int], seed: int = SEED, steps: int = STEPS) -> Model:
    """A model fitted to three quarters of the texts and calibrated on the rest: what learnt() does where one share holds all."""
    model = Model.fresh(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        model.trained = False
        return model
    share = Share(texts, y, seed)
    share.descend(model, 0, steps)
    model.rounded()
    model.languages = centres(texts)
    model.thresholds = np.zeros(len(model.languages))
    z, lang, y = judged(model, *share.kept_out())
    calibrated(model, z, lang, y, np.ones(len(y)))
    return model


def judged(model: Model, texts: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits on the bins, languages and labels of texts."""
    z = np.concatenate([model.logits(texts[i : i + 64]) for i in range(0, len(texts), 64)] or [np.zeros(0)])
    return np.rint(z * BINS) / BINS, np.array([model.language(t) for t in texts], np.int64), y


def best_threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The logit between two neighbours that gives the best F1; the widest such gap's middle. n: how many examples each logit stands for, y of them toxic."""
    order = np.argsort(-z)
    n = np.ones(len(z)) if n is None else n[order]
    z, y = z[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.cumsum(n) + y.sum())
    gap = z - np.append(z[1:], z[-1] - 1.0)
    k = max(range(len(z)), key=lambda i: (round(float(f1[i]), 4), float(gap[i])))
    return float(z[k] - gap[k] / 2)


def calibrated(model: Model, z: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """Sets the threshold of each language from rows of n examples, y of them toxic; a language with few examples shares that of all."""
    if not 0 < y.sum() < n.sum():
        model.thresholds[:] = max(0.0, model.out_bias + ABOVE)
        return

    def best(own: np.ndarray) -> float:
        at, back = np.unique(z[own], return_inverse=True)
        return best_threshold(at, np.bincount(back, y[own]), np.bincount(back, n[own]))

    model.thresholds[:] = best(n > 0)
    for k in range(len(model.languages)):
        own = lang == k
        if n[own].sum() >= 40 and y[own].sum() >= 10:
            model.thresholds[k] = best(own)
    model.thresholds[:] = np.maximum(model.thresholds, model.out_bias + ABOVE)


def examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """(doc_id, toxic, text) of all labelled rows to learn from, those of a share in one partition in the order of doc_id and perhaps more
    than once (a row repeated whole); the number of shares, 0 if none; and the number of different labels."""
    marked = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic in (0, 1)")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("n"), F.xxhash64(text).alias("h"))
    marked = few(kept(marked, "marked"), 24)
    # of a doc_id's texts the shortest, then by hash
    keys = own.select("doc_id", "n", "h").join(marked, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("n", "h")).alias("m"))
    keys = kept(keys.select("doc_id", "toxic", "m.n", "m.h"), "examples-keys")
    of = keys.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"), F.countDistinct("toxic").alias("kinds")).first()
    shares = max(-(-of["rows"] // SHARE_ROWS), -(-(of["bytes"] or 0) // SHARE_BYTES))
    share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(max(shares, 1))).cast("int")
    rows = own.join(few(keys, 40), ["doc_id", "n", "h"]).select(share.alias("share"), "doc_id", "toxic", "text")
    return rows.repartition(max(shares, 1), "share").sortWithinPartitions("share", "doc_id"), shares, of["kinds"]


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """All examples of a small table, in the order of doc_id."""
    with scratch():
        got = {r["doc_id"]: r for r in examples(docs, labels)[0].collect()}
    return [got[i]["text"].encode() for i in sorted(got)], [got[i]["toxic"] for i in sorted(got)]


def shares_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Share]]:
    """From rows (share, doc_id, toxic, text) in order, a share at a time."""
    now, last, texts, y = None, None, [], []
    for batch in batches:
        for share, doc, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.large_binary()), strict=True):
            if share != now and texts:
                yield now, Share(texts, np.array(y, np.float32), SEED + now)
                texts, y = [], []
            if (share, doc) != (now, last):
                texts.append(text.as_py())
                y.append(toxic)
            now, last = share, doc
    if texts:
        yield now, Share(texts, np.array(y, np.float32), SEED + now)


_SUM = "share int, weights binary, languages binary"


def added(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each ``together`` shares, which come in order."""
    now, sums = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([now], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)], names=["share", "weights", "languages"])

    for batch in batches:
        for i in range(batch.num_rows):
            share = batch.column(0)[i].as_py() // together
            own = np.frombuffer(batch.column(1)[i].as_buffer(), np.float32), np.frombuffer(batch.column(2)[i].as_buffer(), np.float64)
            if share == now:
                sums = [a + b for a, b in zip(sums, own, strict=True)]
            else:
                if sums:
                    yield row()
                now, sums = share, [x.copy() for x in own]
    if sums:
        yield row()


def one_round(rows: DataFrame, shares: int, model: Model, number: int, rounds: int) -> Model:
    """The model after a round: each share goes on from it, their weights are averaged."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few MB, of fixed size
    steps = STEPS // rounds

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, own in shares_of(batches):
            begun = shared.value
            after = begun.copy()
            own.descend(after, number * steps, steps)
            languages = np.zeros((LANGUAGES, PROFILE))
            if number:
                x = np.stack([profile(t) for t in own.texts])
                np.add.at(languages, (x @ begun.languages.T).argmax(axis=1), x)
            elif share == 0:  # clusters of one share to begin with
                found = centres(own.texts)
                languages[: len(found)] = found
            yield pa.record_batch(
                [pa.array([share], pa.int32()), pa.array([after.moved(begun, len(own.texts)).tobytes()], pa.binary()), pa.array([languages.tobytes()], pa.binary())],
                names=["share", "weights", "languages"],
            )

    sums, n = mapped(rows, task, _SUM), shares
    while True:
        n = -(-n // TOGETHER)
        sums = sums.repartition(n, F.floor(F.col("share") / TOGETHER)).sortWithinPartitions("share")
        sums = mapped(sums, lambda it: added(it, TOGETHER), _SUM)
        if n == 1:
            break
    got = sums.first()
    shared.destroy()
    return model.onward(np.frombuffer(got["weights"], np.float32), np.frombuffer(got["languages"], np.float64).reshape(LANGUAGES, PROFILE))


def bins(rows: DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """(logit, language, toxic, all): how many of the examples kept out of training lie in each bin."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in shares_of(batches):
            z, lang, y = judged(shared.value, *own.kept_out())
            yield pa.record_batch([pa.array(np.clip(z * BINS, -(1 << 14), 1 << 14).astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(y.astype(np.int64))], names=["bin", "lang", "y"])

    counts = mapped(rows, task, "bin int, lang int, y bigint").groupBy("bin", "lang").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    got = sorted(map(tuple, counts.collect()))  # LANGUAGES * 2**15 rows at most
    return tuple(np.array([r[k] for r in got], float) / (BINS if k == 0 else 1) for k in range(4))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, of fixed size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for keys, texts in B.text_blocks(batches):
            score = own.scores(texts)
            yield pa.record_batch(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return mapped(rows, task, "doc_id bigint, held_out boolean, score double, predicted int")


def learnt(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of all labelled rows outside the held-out third."""
    model = Model.fresh()
    with scratch():
        rows, shares, kinds = examples(docs, labels)
        if kinds < 2:
            model.trained = False
            return model
        rows = kept(rows, "examples")
        rounds = ROUNDS if shares > 1 else 1
        for number in range(rounds):
            model = one_round(rows, shares, model, number, rounds)
        model.rounded()
        model.languages = np.rint(model.languages / GRID) * GRID
        model.thresholds = np.zeros(len(model.languages))
        calibrated(model, *bins(rows, model))
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, learnt(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted to be toxic. Texts alone go to Python, a flag for each comes back."""
    model = learnt(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only()
        own = shared.value
        try:
            for text in batches:
                rows = pa.record_batch([pa.nulls(len(text), pa.int8()), text], names=["k", "text"])
                yield pa.array(np.concatenate([own.scores(t) < CUT for _, t in B.text_blocks(iter([rows]))] or [np.zeros(0, bool)]))
        finally:
            released()

    return docs.filter(clean("text"))
