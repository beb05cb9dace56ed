"""The numpy kernels and planners against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import blocks as B, packing, pii, sharding, simhash, suffix_array, suffix_dedup, toxicity, trigrams


def test_word_and_window_hashes():
    text = "b a b a ä  b\ta\nb".encode()
    buf, at = B.joined([text, b"", b"a b a"])
    s, e = B.word_spans(buf)
    words = [buf[x:y].tobytes() for x, y in zip(s, e)]
    assert words == text.split() + b"a b a".split()
    h = B.word_hashes(buf, s, e)
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    w = B.window_hashes(h, 3)
    same = lambda i, j: words[i : i + 3] == words[j : j + 3]
    assert all((w[i] == w[j]) == same(i, j) for i in range(len(w)) for j in range(len(w)))


def test_long_words_do_not_collide():
    """Texts of two letters on which polynomials modulo 2**64 agree, whatever their base."""
    thue = [0]
    for _ in range(12):
        thue += [1 - x for x in thue]
    a = bytes(97 + x for x in thue)
    b = bytes(98 - x for x in thue)
    buf, _ = B.joined([a, b, a, b"x" * (3 << 20), b"short"])
    h = B.word_hashes(buf, *B.word_spans(buf)).tolist()
    assert h[0] == h[2] and len(set(h)) == 4


@pytest.mark.parametrize("w", [1, 2, 3, 7, 16])
def test_sliding_min(w):
    x = np.random.default_rng(w).integers(0, 50, 40).astype(np.uint64)
    assert B.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(40 - w + 1)]


def test_suffix_array_finds_all_repeats():
    random.seed(5)
    for _ in range(300):
        alphabet = random.choice([b"a", b"ab", b"abc\0\xff"])
        base = bytes(random.choice(alphabet) for _ in range(60))
        strings, weights = [], []
        for _ in range(random.randint(1, 8)):
            a = random.randint(0, 50)
            x = bytearray(base[a : a + random.randint(1, 40)])
            if random.random() < 0.5:
                x[random.randrange(len(x))] = random.choice(alphabet)
            strings.append(bytes(x))
            weights.append(random.choice([1, 1, 2]))
        w = random.choice([2, 5, 9])
        count = Counter()
        for s, k in zip(strings, weights):
            for i in range(len(s) - w + 1):
                count[s[i : i + w]] += k
        want = [[i for i in range(len(s) - w + 1) if count[s[i : i + w]] > 1] for s in strings]
        assert [g.tolist() for g in suffix_array.repeated_places(strings, weights, w)] == want


def test_runs_hold_every_window_once_and_follow_content(monkeypatch):
    random.seed(6)
    for _ in range(100):
        alphabet = random.choice([b"a", b"ab", b"abcdefgh"])
        texts = [bytes(random.choice(alphabet) for _ in range(random.randint(0, 90))) for _ in range(random.randint(1, 6))]
        buf, at = B.joined(texts)
        if len(buf) <= 12:
            continue
        monkeypatch.setattr(suffix_dedup, "MOST", random.choice([7, 4096]))
        doc, lo, n, anchor, _, many = suffix_dedup.block_runs(buf, at[:-1], at[1:] - 1, 12, 4)
        got = sorted((d, x - at[d]) for d, a, k in zip(doc, lo, n) for x in range(a, a + k))
        assert got == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 11)]
        of: dict = {}
        runs = Counter(anchor.tolist())
        for a, k, h, m in zip(lo, n, anchor.tolist(), many):
            inside = [bytes(buf[x : x + 12]) for x in range(a, a + k)]
            assert all(of.setdefault(w, h) == h for w in inside)
            assert len(set(inside)) == len(inside) or m or runs[h] > 1


def test_covering_code():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**32, 200, dtype=np.uint64).astype(np.uint32)
    home, near = simhash.anchors(x)
    assert (np.bitwise_count(home ^ x) <= 1).all() and (simhash.syndrome(near.reshape(-1)) == 0).all()
    assert (np.bitwise_count(near ^ x[:, None]) <= 2).all()
    for bit in range(32):  # whoever differs in one bit visits the home
        _, other = simhash.anchors(x ^ np.uint32(1 << bit))
        assert (other == home[:, None]).any(axis=1).all()


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_is_best_fit_decreasing():
    random.seed(3)
    for _ in range(150):
        capacity = random.choice([10, 37, 64])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 150))]
        rules = packing.plan(Counter(lengths), capacity)
        bins: dict = {}
        for n, lo, hi, first, each, used in rules:
            for k in range(hi - lo):
                bins.setdefault(first + k // each, []).append((used + k % each * n, n))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= capacity
        assert sum(map(len, bins.values())) == len(lengths) and len(bins) == best_fit(lengths, capacity)


def test_tokenizer_by_words_equals_the_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["", "İstanbul Σας ΑΣ ΑΣ. x", "a<|endoftext|>b <|endoftext|> c", "é ́x a\x1cc\x85d", "it's 'S l’ÉTÉ 12³½ 　z", "Straße ÜBER × ÷ 3.14 ''t"] * 2
    own = packing.tokenizer(packing.TOKENIZER)
    got = [np.frombuffer(b, "<u4").tolist() for b in own.ids([t.encode() for t in texts])]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    long = ("hallo Wörld x" * 300).encode() + b" a" * 900
    assert b"".join(packing.slices(long, 500)) == long


@pytest.mark.parametrize("word", ["kGx9aQ/+", "\u6f6e\u6c50\u8a18\u865f"])
def test_tokenizer_takes_long_texts_without_white_space(word):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    text = "some words first " + word * (packing.LONG // len(word.encode()) + 1) + " and after"
    assert len(text.encode()) > packing.LONG
    got = list(packing.tokenizer(packing.TOKENIZER).ids([b"a b", text.encode(), b"c"]))
    assert len(got) == 3 and np.frombuffer(got[1], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pii_proposals():
    rules = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }

    def plain(t):
        out = []
        for k, r in rules.items():
            for m in r.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]
                if ok:
                    out.append((m.start(), m.end(), k))
        return out

    random.seed(1)
    for _ in range(20000):
        t = "".join(random.choice("a1.@- +(2é%") for _ in range(random.randint(1, 40)))
        assert [x for x in pii.proposals(t) if x[2] != "iban"] == plain(t)
    t = "Pay to IBAN DE89 3704 0044 0532 0130 00 or card 4111 1111 1111 1111."
    assert [x[2] for x in pii.proposals(t)] == ["card", "iban"]
    assert pii.score(t, 12, 39, "iban") > pii.PRIOR["iban"] and pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_trigram_queries_are_necessary():
    assert trigrams.query(r"[0-9a-f]{24,}") is None and trigrams.query("ab|cde") is None
    assert trigrams.query("AKIA[A-Z0-9]+") == frozenset([frozenset({"aki", "kia"})])
    for pattern, text in ((r"(?i:(pass|secret))\s*=", "x SeCrEt ="), (r"gh[ps]_[a-z]{3,}", "ghs_abc"), (r"api_?key", "apikey"), (r"(abc)+d?efg", "abcabcefg"), (r"x(ab){2}y", "xababy")):
        clauses, low = trigrams.query(pattern), re.search(pattern, text)[0].lower()
        assert clauses and any(all(t in low for t in c) for c in clauses)


def test_slot_map_balances_and_grows_minimally():
    r = random.Random(2)
    totals = [(s, r.randint(1, 1000), 1) for s in range(512)]
    first = sharding.dealt(totals, 8, 512)
    load = Counter()
    for s, b, _ in totals:
        load[first[s]] += b
    assert max(load.values()) - min(load.values()) <= 1000
    more = sharding.grown(first, totals, 8)
    assert all(b in (a, 8) for a, b in zip(first, more))
    new = sum(b for s, b, _ in totals if more[s] == 8)
    assert 0.9 < new / (sum(b for _, b, _ in totals) / 9) <= 1


def test_classifier_learns_stems_in_any_place():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    texts, y = [], []
    for i in range(1200):
        w = [word() for _ in range(r.randint(5, 120))]
        if i % 4 == 0:
            w[r.randrange(len(w))] = r.choice(["zzug" + word(), "moron", "scum"])
        texts.append(" ".join(w).encode())
        y.append(int(i % 4 == 0))
    m = toxicity.trained(texts[:1000], y[:1000], steps=500)
    p = np.concatenate([m.scores(texts[1000:]), m.scores([b""])])
    assert ((p[:-1] >= toxicity.CUT) == np.array(y[1000:], bool)).mean() > 0.93 and 0 <= p[-1] <= 1
    one = m.scores([b" ".join([b"abc"] * 200000 + [b"scum"])])
    assert one[0] > 0.5
    assert not toxicity.trained(texts[:3], [0, 0, 0]).scores([b"x"]).any()
