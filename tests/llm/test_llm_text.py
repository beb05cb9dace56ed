"""Collocations, aligned tokenizers and the licence scan against plain versions."""

import hashlib
import re
from collections import Counter

import pytest
from llm_samples import ROWS
from pyspark.sql import functions as F

from tidemark.llm import alignment, collocations, license_scan
from tidemark.llm.license_rules import RULES, Signature, wrapped
from tidemark.llm.shared import kept


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Collocations


def phrases_plainly(rows, least, longest=4, cover=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    frequent = {p: a for p, a in f.items() if a >= least}
    most = Counter()
    for (lang, p), a in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                most[lang, p[i : i + k]] = max(most[lang, p[i : i + k]], a)
    for lang in sorted(n):
        kept_ = []
        for (own, p), a in frequent.items():
            if own != lang or len(p) < 2 or ((own, p) in most and 100 * most[own, p] >= cover * a):
                continue
            score, _, left, right = min((2000000 * a // (f[own, p[:k]] + f[own, p[k:]]), k, f[own, p[:k]], f[own, p[k:]]) for k in range(1, len(p)))
            kept_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def spoken(spark, rows):
    return spark.createDataFrame([(i, lang, t, 1, "x", 2, "y") for i, (lang, t) in enumerate(rows)], "doc_id bigint, lang string, text string, a int, phrase string, words int, _bucket string")


TALK = [
    (None, "Cold water, cold WATER; cold  water\tcold water"), ("en", None), ("en", ""), ("en", " ,.;\n "), (None, "a a a a a a a"), ("en", "é\x00b é\x00b. é\x00b é\x00b"),
    *[("en", "New York City is New York\nnew york city")] * 5, ("fr", "New York City is New York"), ("fr", "new york " * 40), *[("de", "alle Rechte vorbehalten: alle Rechte!")] * 30,
    ("xx", "p q p q. q p"), ("xx", "p q"),
]


@pytest.mark.parametrize("least", [1, 2, 5, 30])
def test_op11_collocations(spark, least):
    got = collocations.collocations(spoken(spark, TALK).repartition(3), least=least).collect()
    assert sorted(map(tuple, got)) == sorted(phrases_plainly(TALK, least))


def test_op11_a_sketch_that_lets_all_pass_and_shards_of_a_part_of_a_text_change_nothing(spark, monkeypatch):
    rows = [("en", t) for _, t in ROWS if t and len(t) < 100_000] + TALK
    want = sorted(phrases_plainly(rows, 3, top=50))
    frame = spoken(spark, rows)
    assert sorted(map(tuple, collocations.collocations(frame, top=50, least=3).collect())) == want
    pieces = [b"a b. c" * 40, b"one piece without an end " * 9, b"", b"x, y\n"]
    monkeypatch.setattr(collocations, "SHARD_BYTES", 64)
    for text in pieces:
        assert b"".join(collocations.parts(text)) == text
        assert all(len(p) <= 64 or not re.search(rb"[.,;:!?\n-\r].", p, re.S) for p in collocations.parts(text))


def test_op11_cells_bound_counts_from_above(spark):
    rows = [("en", t) for _, t in ROWS if t and len(t) < 100_000]
    docs = spoken(spark, rows).select("lang", "text")
    sets = []
    for bits in (22, 26):
        there = collocations.reaching(kept(collocations.sketch(docs, bits), "sketch"), bits, 12)
        own = collocations.Shard("en", [t.encode().lower() for _, t in rows], bits)
        begin, cells = own.windows(2)
        words = own.words()
        count = Counter((words[i], words[i + 1]) for i in begin.tolist())
        for i in begin.tolist():
            bit = there[int(cells[i]) >> 3] >> (7 - int(cells[i]) % 8) & 1
            assert bit or count[words[i], words[i + 1]] < 12
        sets.append(sum(bin(b).count("1") for b in there[there > 0].tolist()))
    assert all(sets)


def test_op11_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000
    table = [("en", 1, "x", big), ("en", 1, "y", 3), ("en", 2, "x y", big), ("en", 2, "y x", 2), ("en", 3, "x y x", big - 1)]
    found = kept(spark.createDataFrame(table, "lang string, words int, phrase string, a bigint"), "big")
    got = {r["phrase"]: r["score"] for r in collocations.scored(found, 101).collect()}
    assert got == {"x y": 2000000 * big // (big + 3), "x y x": min(2000000 * (big - 1) // (big + 2), 2000000 * (big - 1) // (2 * big))}


def test_op11_ranks_and_empty_tables(spark, empty, monkeypatch):
    assert collocations.collocations(empty).count() == 0
    rows = [("en", f"w{i} v{i}. " * (2 + i % 3)) for i in range(300)]
    got = collocations.collocations(spoken(spark, rows), top=20, least=2).collect()
    assert sorted(map(tuple, got)) == sorted(phrases_plainly(rows, 2, top=20)) and len(got) == 20


# Aligned tokenizers


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers

    return alignment.Words(*(public_tokenizers.path(f) for f in (alignment.A_FILE, alignment.B_FILE)))


def aligned_plainly(rows, own):
    per, links = [], Counter()
    a_bytes, b_bytes = own.transducer.bytes
    for d, t in rows:
        a = own.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = list(own.b.encode(t)) if t else []
        whole = (" " + (t or "")).encode()
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a, b = [], []
        ends = [[0], [0]]
        for side, (ids, of) in enumerate(((a, a_bytes), (b, b_bytes))):
            for i in ids:
                ends[side].append(ends[side][-1] + len(of[i]))
        both = sorted(set(ends[0]) & set(ends[1]))
        place = [{e: i for i, e in enumerate(x)} for x in ends]
        ids = lambda side, x, lo, hi: ",".join(map(str, x[place[side][lo] : place[side][hi]]))
        groups = [f"{ids(0, a, lo, hi)}|{ids(1, b, lo, hi)}" for lo, hi in zip(both, both[1:])]
        own_links, j = [], 0
        for i, x in enumerate(a):
            while ends[1][j + 1] <= ends[0][i]:
                j += 1
            k = j
            while k < len(b) and ends[1][k] < ends[0][i + 1]:
                own_links.append((x, b[k]))
                k += 1
        links.update(own_links)
        per.append((d, len(a), len(b), groups, own_links))
    best = Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    return [
        (d, a, b, len(g), len(ls), sum(links[x] == best[x[1]] for x in ls), sum(links[x] for x in ls), sha(";".join(g)) if a else "") for d, a, b, g, ls in per
    ]


ODD = [
    (1, "a  b   c"), (2, " lead"), (3, "trail "), (4, "trail   "), (5, "x▁y"), (6, "tab\there\n\n  new  line \r\n x\r"), (7, "\x00nul é 日本語 \U0001f600 <|endoftext|> <s> </s> <unk> <0x41>"),
    (8, ""), (9, None), (10, " "), (11, "  "), (12, "a b　 c  d \x85 e \x1c f !\x1c g"), (13, "w" * 3000 + " " + "é" * 1500), (14, "́ ́a ﬁ Å ²."),
    (15, "don't I'LL we've 12345 67.89 a1b2, (x) \"y\"; z%%% w***"), (15, "don't I'LL we've 12345 67.89 a1b2, (x) \"y\"; z%%% w***"), (None, "﻿bom ​ zw"), (16, "\n\nA.\nB\tC.\t\tD"),
]


def test_op12_alignment(spark, tokens, empty):
    rows = ODD + [(d, t) for d, t in ROWS if not t or len(t) < 100_000]
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id bigint, text string, pair int, n int, _key string").repartition(3)
    want = Counter(aligned_plainly(rows, tokens))
    assert Counter(map(tuple, alignment.aligned(docs).collect())) == want
    assert Counter(map(tuple, alignment.aligned(docs, pair_bytes=0).collect())) == want  # pairs too many for all tasks
    assert alignment.aligned(empty).count() == 0 and alignment.aligned(empty, pair_bytes=0).count() == 0


def test_op12_words_end_where_both_tokenizers_do(tokens):
    """Ids of the words in a row are those of the whole text. (A text with B's own sign for a space is never spelt.)"""
    import random

    draw = random.Random(7)
    alphabet = ["a", "B", "é", "ß", "日", " ", " ", "  ", "\n", "\t", "\r", ".", ",", "!", ")", "'", "'s", '"', "1", "²", "́", "\xa0", "\x1c", "%", "*", "_", "×", "Ã", "ÿ", "word", "naïve", "😀"]
    assert tokens.divides
    for _ in range(3000):
        text = "".join(draw.choices(alphabet, k=draw.randint(1, 14)))
        buf, starts, ends, _ = tokens.cut([text.encode()])
        words = [buf[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        assert "".join(words) == " " + text
        assert [i for w in words for i in tokens.a.encode(w, add_special_tokens=False).ids] == tokens.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for w in words for i in tokens.b.encode(alignment.LEAD + w)[len(tokens.lead) :]] == list(tokens.b.encode(text)), repr(text)


def test_op12_transducer_remembers_and_forgets(monkeypatch):
    import numpy as np

    monkeypatch.setattr(alignment, "FEW", 0)
    machine = alignment.Transducer([b" ab", b"c", b" a", b"bc"], [b" ", b"abc", b" abcd", b"b", b"a"])
    ids = (np.array([0, 1, 2, 3, 0, 1, 0]), np.array([0, 1, 0, 1, 2, 0, 4, 3]))
    ends = (np.array([2, 4, 6, 7, 7]), np.array([2, 4, 5, 8, 8]))
    good, groups, links, text = machine.align(ids, ends)
    assert good.tolist() == [True, True, False, True, True]
    size = len(machine.keys)
    assert machine.align(ids, ends)[0].tolist() == good.tolist() and len(machine.keys) == size
    assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in links[text == 0]] == [(0, 0), (0, 1), (1, 1)]
    monkeypatch.setattr(alignment, "FEW", 99)
    monkeypatch.setattr(alignment, "TRANSITIONS", 1)
    again = machine.align(ids, ends)
    assert again[0].tolist() == good.tolist() and again[2].tolist() == links.tolist() and [g.tolist() for g in again[1]] == [g.tolist() for g in groups]


# Licence scan

NOTICES = [
    (1, "Licensed under CC BY-NC 4.0. foo all rights reserved, All Rights Reserved"), (2, None), (3, ""), (4, " .. "),
    (5, "This work is licensed under the GNU General Public License, version 3. cc by cc by cc-by"), (6, "SPDX-License-Identifier: Apache-2.0"), (7, "Released under the MIT License."),
    (8, "all rights reservedé all rights Reserved. ALL\nRIGHTS\x00reserved"), (9, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (9, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    (None, "mit license " * 700 + "cc by " * 300), (10, "Kcc by İ general public license"), (11, "https://www.gnu.org/licenses/gpl-3.0.html"), (12, "mozilla public license v2"),
]


def scanned_plainly(rows):
    out = []
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        laid = " " + "  ".join(w) + " "
        found = []
        for i, r in enumerate(RULES):
            if r.keyword in w:
                found += [(m.start() and laid[: m.start()].count(" ") // 2, laid[: m.end()].count(" ") // 2, r.priority, i) for m in re.finditer(r.pattern, laid)]
        stay = [x for x in found if not any(o != x and o[0] <= x[0] and o[1] >= x[1] and o[2] <= x[2] and ((o[0], -o[1], o[2], o[3]) < (x[0], -x[1], x[2], x[3])) for o in found)]
        # the base phrases, once more by hand
        base = []
        for words, label in ((["cc", "by"], "cc-by"), (["general", "public", "license"], "gpl"), (["all", "rights", "reserved"], "reserved")):
            base += [(i, label) for i in range(len(w)) if w[i : i + len(words)] == words]
        starts = [i for i, _ in base]
        labels = {label for _, label in base}
        more = labels | {RULES[x[3]].label for x in stay}
        out.append((d, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), max((RULES[x[3]].weight for x in stay), default=0.0)))
    return out


def test_op13_license_scan(spark, empty):
    rows = NOTICES + [(d, t) for d, t in ROWS if not t or len(t) < 100_000]
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id bigint, text string, found int, laid string, w int")
    assert Counter(map(tuple, license_scan.reported(docs).collect())) == Counter(scanned_plainly(rows))
    assert license_scan.reported(empty).count() == 0


def test_op13_rules_are_gated_rightly():
    """Each rule's keyword stands in every text that its pattern can match: no way through the pattern avoids it."""
    import string

    assert len(RULES) > 300 and {r.label for r in RULES if r.base} == {"cc-by", "gpl", "reserved"}
    for r in RULES:
        assert set(r.keyword) <= set(string.ascii_lowercase + string.digits)
        without = re.sub(rf"(?<![a-z0-9]){r.keyword}(?![a-z0-9])", "\x01", r.pattern)
        assert "\x01" in without, r
        # the shortest ways: drop optional parts; each alternative must still name the keyword
        parts = without.removeprefix(" (?:").removesuffix(") ")
        while True:
            less = re.sub(r"\((?:\?:)?[^()]*\)(\?|\{0,\d\})", "", parts)
            if less == parts:
                break
            parts = less
        while (inner := re.search(r"\((?:\?:)?([^()]*)\)", parts)) is not None:
            ways = inner[1].split("|")
            parts = parts.replace(inner[0], ways[0] if all("\x01" in w for w in ways) or not any("\x01" in w for w in ways) else "?", 1)
        assert all("\x01" in way for way in parts.split("|")), r


def test_op13_containment_and_priority(spark):
    rules = (
        Signature("wide", 2, 0.5, "b", wrapped("a b c d")), Signature("inside", 2, 0.9, "b", wrapped("b c")), Signature("higher", 1, 0.7, "c", wrapped("c d")),
        Signature("same", 2, 0.8, "b", wrapped("a b c d")), Signature("beside", 3, 0.1, "d", wrapped("d e")), Signature("two", 3, 0.1, "e", wrapped("(d|e) f")),
    )
    docs = spark.createDataFrame([(1, "a b c d e f. A,b:c d")], "doc_id int, text string")
    r = license_scan.detections(docs, rules).first()
    assert [(x["label"], x["start"], x["end"]) for x in r["stay"]] == [("wide", 0, 4), ("higher", 2, 4), ("beside", 3, 5), ("two", 4, 6), ("wide", 6, 10), ("higher", 8, 10)]
    assert r["n_words"] == 10 and len(r["found"]) == 10


def test_op13_many_detections(spark):
    """More than fit one step of the running maxima."""
    text = "cc by nc 4 0 all rights reserved " * 2000
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = license_scan.detections(docs).select(F.size("found").alias("n"), F.expr("size(filter(stay, x -> x.label = 'cc-by-nc'))").alias("a"), F.expr("size(filter(stay, x -> x.label = 'reserved'))").alias("b")).first()
    assert (got["a"], got["b"]) == (2000, 2000) and got["n"] >= 6000


# Rows repeated whole, in bulk


PASSAGE = " ".join(f"again{i}" for i in range(90))


def bulk(spark, n, same):
    """n rows, of which every third is one and the same, or (without ``same``) the same text under many doc_ids."""
    rows = [(-1 if same else i, PASSAGE) if i % 3 == 0 else (i, f"{i} " + " ".join(f"own{i}x{k}" for k in range(40)) + (" " + PASSAGE if i % 300 == 1 else "")) for i in range(n)]
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, copies string").repartition(4), rows


@pytest.mark.parametrize("same", [True, False])
def test_op6_rows_repeated_in_bulk(spark, same):
    from tidemark.llm import suffix_dedup

    docs, rows = bulk(spark, 1500, same)
    places = Counter()
    for d, t in rows:
        b = t.encode()
        places.update(b[i : i + 200] for i in range(len(b) - 199))
    want = Counter()
    for d, t in rows:
        b, hit = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - 199):
            if places[b[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        kept_ = bytes(x for x, h in zip(b, hit) if not h)
        want[d, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept_).hexdigest()] += 1
    assert Counter(map(tuple, suffix_dedup.digested(docs).collect())) == want


def test_op6_a_repeated_row_is_one_document_until_it_is_cut(spark):
    """The spans of a document do not grow with the number of rows that are it."""
    from tidemark.llm import suffix_dedup as S

    spans = []
    for n in (300, 1200):
        docs, _ = bulk(spark, n, True)
        got = S.removed_spans(docs, S.WINDOW, S.GRAM, S.PART_BYTES).collect()
        spans.append(max(len(r["spans"]) for r in got))
        again = S.repeated_rows(docs)
        assert [r["copies"] for r in again.collect()] == [n // 3] and S.once(docs, again).count() == n - n // 3 + 1
    assert spans[0] == spans[1]


@pytest.mark.parametrize("same", [True, False])
def test_op3_rows_repeated_in_bulk(spark, same):
    from tidemark.llm import substring_dedup

    docs, rows = bulk(spark, 1500, same)
    first = {}
    for d, t in rows:
        w = t.split(" ")
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            first[g] = min(first.get(g, (d, i)), (d, i))
    want = Counter()
    for d, t in rows:
        w = t.split(" ")
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (d, i) for j in range(i, i + 20)}
        want[d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert Counter(map(tuple, substring_dedup.digested(docs).collect())) == want


def test_op9_and_op10_rows_repeated_in_bulk(spark):
    from tidemark.llm import packing, simhash

    docs, rows = bulk(spark, 1500, True)
    got = simhash.near_classes(docs).collect()
    own = [r for r in got if r["doc_id"] == -1]
    assert len(got) == 1500 and len(own) == 500 and {r["component_id"] for r in own} == {-1}
    none = docs.withColumn("doc_id", F.when(F.col("doc_id") >= 0, F.col("doc_id")))  # a third without a doc_id
    laid = packing.packed(none, buckets=7).collect()
    assert len(laid) == 1500
    by = {}
    for r in laid:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    per = spark.createDataFrame([(r["length"],) for r in laid], "length bigint").groupBy("length").count().collect()
    plan = packing.plan({r["length"]: r["count"] for r in per})
    assert len(by) == max(first + -(-(hi - lo) // each) for _, lo, hi, first, each, _ in plan)
