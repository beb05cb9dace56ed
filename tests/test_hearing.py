"""The keyword matcher against a plain one that tries each keyword at each place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import hearing as H


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def likeness(a, b):
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    some = [t[i : i + len(s)] for i in range(len(t) - len(s) + 1)] + [t[:k] for k in range(1, len(s))] + [t[len(t) - k :] for k in range(1, len(s))]
    return max(2 * lcs(s, x) / (len(s) + len(x)) for x in some)


def plainly(text, word):
    n = len(word)
    if text is None or len(text) < 2 or not word or n > len(text):
        return None
    places = range(len(text) - n + 1)
    for layer, far in ((1, 0), (2, 1)):
        for i in places:
            if edits(text[i : i + n].lower(), word.lower()) == far:
                return layer, i, text[i : i + n], 1.0 if layer == 1 else pytest.approx(0.4)
    for i in range(max(1, len(text) - 8 + 1)):
        r = likeness(word, text[i : i + 8])
        if r > 0.85:
            return 3, i, text[i : i + 8][:n], pytest.approx(0.6 * r)
    return None


def test_three_layers(spark):
    draw = random.Random(11)
    words = ["abcd", "abca", "aaaa", "bcdabcd", "abcdabcd", "dcba dcba ab", "ab", "c", "Éab", "ddccbbaa", "abcab", "cabbac", ""]
    texts = [None, "", "a", "ab", "abc", "ABCD", "xxabd", "abcdabc", "éab e", "dcba dcb", "a" * 40] + ["".join(draw.choices("abcd ", k=draw.randint(2, 24))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, n string")
    known = spark.createDataFrame([(w,) for w in [*words, "abcd", None]], "keyword string")
    got = {(r["id"], r["keyword"]): tuple(r)[2:] for r in H.heard(df, ["id"], "t", known).collect()}
    want = {(i, w): found for i, t in enumerate(texts) for w in words if (found := plainly(t, w))}
    assert got == want and {v[0] for v in want.values()} == {1, 2, 3}


def test_a_sound_may_be_longer_than_its_word(spark):
    """Edits are counted on the sound: one left out and one added as well as one changed."""
    sound = lambda c: F.regexp_replace(F.lower(c), "x", "ks")
    df = spark.createDataFrame([(1, "..taxi"), (2, "..taki.."), (3, "tazzz")], "id int, t string")
    got = {(r["id"], r["layer"], r["matched"]) for r in H.heard(df, ["id"], "t", spark.createDataFrame([("taxi",)], "keyword string"), sound=sound).collect()}
    assert got == {(1, 1, "taxi"), (2, 2, "taki")}


def test_a_large_dictionary_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "hello wurld again")], "id int, t string")
    words = spark.createDataFrame([("world",), ("hello",)], "keyword string")
    want = sorted(map(tuple, H.heard(df, ["id"], "t", words).collect()))
    monkeypatch.setattr(H, "SMALL_DICTIONARY", 0)
    assert sorted(map(tuple, H.heard(df, ["id"], "t", words).collect())) == want and len(want) == 2


def test_nothing_to_hear(spark):
    df = spark.createDataFrame([(1, "hello")], "id int, t string")
    assert H.heard(df, ["id"], "t", spark.createDataFrame([], "keyword string")).count() == 0
    assert H.heard(df.limit(0), ["id"], "t", spark.createDataFrame([("a",)], "keyword string")).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "hello")], "id int, t string")
    plan = H.heard(df, ["id"], "t", spark.createDataFrame([("hallo",)], "keyword string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_window_is_weighed_once_however_often_it_stands(spark, monkeypatch):
    """Layer 3's likenesses are made of distinct windows: a row of the segments is not in their plan's grouping."""
    seen = []
    whole = H.partial_ratios
    monkeypatch.setattr(H, "partial_ratios", lambda a, b, *c: seen.append(b) or whole(a, b, *c))
    segments = spark.createDataFrame([(i, "meant elle " * 5) for i in range(30)], "id bigint, t string")
    words = spark.createDataFrame([("mentelle",), ("nt el",)], "keyword string")
    out = H.heard(segments, ["id"], "t", words)
    assert len(seen) == 1 and "keys=[_w" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["keyword"], r["place"]) for r in out.collect()} == {("nt el", plainly("meant elle " * 5, "nt el")[1])} | ({("mentelle", plainly("meant elle " * 5, "mentelle")[1])} if plainly("meant elle " * 5, "mentelle") else set())


@pytest.mark.parametrize("seed", range(3))
def test_halves_find_all_that_is_one_edit_away(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("abAB") for _ in range(r.randint(1, 14))) for _ in range(40)]
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(12)})
    segments = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {(x["id"], x["keyword"]): (x["layer"], x["place"], x["matched"], x["confidence"]) for x in H.heard(segments, ["id"], "t", spark.createDataFrame([(w,) for w in words], "keyword string")).collect()}
    want = {(i, w): p for i, t in enumerate(texts) for w in words if (p := plainly(t, w))}
    assert got == want


def test_windows_that_can_match_nothing_are_not_made(spark):
    """A long text costs what it holds: its windows are told by the places of halves and of forms; stretches overlap."""
    draw = random.Random(4)
    text = "".join(draw.choices("xyz ", k=40_000))
    at = [0, 250, 255, 256, 505, 20_000, 39_992]
    words = ["mentelle", "queeau", "thatat of the"]
    for i, p in enumerate(at):
        w = ("mentelle", "menteele", "mentelxe", "ueeau")[i % 4]
        text = text[:p] + w + text[p + len(w) :]
    known = spark.createDataFrame([(w,) for w in words], "keyword string")
    turns = spark.createDataFrame([(i, text[lo:]) for i, lo in enumerate([0, 1, 251, 256, 257, 510, 20_001])], "id bigint, t string")
    found = H.heard(turns, ["id"], "t", known)
    got = {(r["id"], r["keyword"]): (r["layer"], r["place"], r["matched"], r["confidence"]) for r in found.collect()}
    whole = [r["t"] for r in turns.orderBy("id").collect()]
    near = lambda t, w: [p for p in range(len(t) - 7) if any(c in t[p : p + 8] for c in "mnteluaq")]
    for i, t in enumerate(whole):
        for w in words:
            places, n = near(t, w), len(w)
            want = None
            for layer, far in ((1, 0), (2, 1)):
                want = want or next(((layer, p, t[p : p + n], 1.0 if layer == 1 else pytest.approx(0.4)) for p in places if p + n <= len(t) and edits(t[p : p + n], w) == far), None)
            want = want or next(((3, p, t[p : p + 8][:n], pytest.approx(0.6 * r)) for p in places if (r := likeness(w, t[p : p + 8])) > 0.85), None)
            assert got.get((i, w)) == want
    made = []
    for pattern in (H.pattern_of(some) for some in H.windows_of(words, 8).values()):
        made.append(turns.select(F.size(H.begins(F.col("t"), pattern)).alias("n")).agg(F.sum("n")).first()[0])
    assert sum(made) < 1000


@pytest.mark.parametrize("word", ["c", "ab", "abcd", "aabbc", "abcabca", "abcdabcd", "abcdabcdabc", "a.(b]\\c"])
def test_forms_are_those_of_the_likeness(word):
    draw, forms = random.Random(2), H.windows_of([word], 8)
    for _ in range(300):
        window = "".join(draw.choices("abcd" if draw.random() < 0.7 else word, k=8))
        assert any(re.match(H.pattern_of(some), window[o:], re.S) for (_, at), some in forms.items() for o in at) == (likeness(word, window) > 0.85)


def test_characters_that_change_alone_or_take_two_units(spark):
    texts = ["x\u0130stanbul y", "\u039f\u0394\u039f\u03a3 \u03bf", "\U0001f600\U0001f601nich\U0001f600", "ab\U0001f600mentxlle"]
    words = ["istanb", "\u03bf\u03b4\u03bf\u03c2", "\u03bf\u03b4\u03bf\u03c3", "nich", "\U0001f600a", "mentelle"]
    turns = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    known = spark.createDataFrame([(w,) for w in words], "keyword string")
    plain = lambda c: F.concat(F.lower(c), F.lit(""))
    told = {tuple(r) for r in H.heard(turns, ["id"], "t", known).collect()}
    every = {tuple(r) for r in H.heard(turns, ["id"], "t", known, sound=plain).collect()}  # not narrowed: not known to be lower()
    assert told == every and {(r[0], r[1]) for r in told} >= {(2, "nich"), (3, "mentelle")}
