"""Vectorised text helpers for the Arrow operators of this subpackage.

A *block* is the concatenation of some documents' UTF-8 bytes, a separator byte after each.
Words, rolling hashes and sliding minima are computed over a whole block with numpy; memory
is a small multiple of the block, whose size is bounded by ``BLOCK_BYTES`` plus one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_SLICE = 1 << 20
#: Powers that a worker keeps: enough for a slice or a block and one word or window more. Longer runs make their own.
_KEPT = (1 << 20) + (1 << 16)
#: Words of more bytes are hashed by XXH64: polynomials modulo 2**64 collide on some long texts of two letters.
LONG_WORD = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, _KEPT)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.ones(size, U64)
            p[1:] = U64(b & (2**64 - 1))
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size == _KEPT:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling_prefix(values: np.ndarray) -> np.ndarray:
    """Rabin-Karp prefix sums: out[i] = sum of values[j] * base**j for j < i."""
    n = len(values)
    p, _ = powers(n + 1)
    out = np.zeros(n + 1, U64)
    np.cumsum(values * p[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], independent of where the span lies."""
    _, inv = powers(len(prefix))
    return (prefix[end] - prefix[start]) * inv[start]


_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and whatever is not ASCII.
_ALNUM_GAP = np.ones(256, bool)
_ALNUM_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: What ends a phrase: marks and line ends.
PHRASE_END = np.zeros(256, bool)
PHRASE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PHRASE_GAP = PHRASE_END.copy()
_PHRASE_GAP[[0x20, 0x09]] = True
SEPARATORS = {"space": _WS, "alnum": _ALNUM_GAP, "phrase": _PHRASE_GAP}


def word_spans(buf: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    gap = SEPARATORS[kind][buf]
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(gap, out=inside[1:-1].view(bool))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; works through the block in slices so that temporaries stay small."""
    out = np.zeros(len(starts), U64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo <= _SLICE:  # else it is one long word
            c = rolling_prefix(buf[lo:hi].astype(U64) + U64(1))
            out[i:j] = span_hash(c, starts[i:j] - lo, ends[i:j] - lo)
        i = j
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return mix(out)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive word hashes (document borders are the caller's matter)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out, step = np.empty(n, U64), _SLICE
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        c = rolling_prefix(hashes[lo : hi + k - 1])
        at = np.arange(hi - lo)
        out[lo:hi] = span_hash(c, at, at + k)
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in log2(w) passes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[w - have : w - have + n]) if have < w else m[:n]


def text_blocks(batches: Iterator[pa.RecordBatch], size: int = 0) -> Iterator[tuple[list, list[bytes]]]:
    """From batches of (key columns..., text) the key tuples and the UTF-8 texts, some MB at a time; null is empty."""
    size = size or BLOCK_BYTES
    for batch in batches:
        *keys, text = (batch.column(i) for i in range(batch.num_columns))
        keys = list(zip(*(k.to_pylist() for k in keys), strict=True))
        text = text.cast(pa.large_binary())
        lo, held = 0, 0
        values: list[bytes] = []
        for i in range(len(text)):
            t = text[i].as_py() or b""
            if values and held + len(t) > size:
                yield keys[lo:i], values
                lo, held, values = i, 0, []
            values.append(t)
            held += len(t)
        if values:
            yield keys[lo:], values


def joined(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """The block of some texts and where each begins (with one more entry: its end)."""
    buf = np.frombuffer(sep.join([*texts, b""]), np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return buf, at
