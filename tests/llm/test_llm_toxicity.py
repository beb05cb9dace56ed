"""The convolutional classifier against a plain one: scores, gradients, thresholds, languages."""

import numpy as np
import pytest

from tidemark.llm import toxicity as T

TEXTS = [b"", b"!?", b"one", b"you are stupid trash and an idiot", "été achlich Ünd ñandú".encode(), b"a b c d e f g " * 50, b"trash", b"word " * 3, "日本語 text".encode()]


@pytest.fixture(scope="module")
def model():
    m = T.Model.fresh(3)
    r = np.random.default_rng(5)
    for w in T.WIDTHS:
        m.bias[w] = r.normal(0, 0.1, T.FILTERS).astype(np.float32)
    m.table *= 20
    m.out_bias = 0.25
    return m


def plainly(model, text):
    """Nested loops: embed each word, slide each filter, keep each filter's largest value over the places where a word begins."""
    rows, _ = T.features([text])
    words = [r for r in rows.tolist() if r[0]]
    none = np.zeros(T.DIM)
    vector = [sum((np.asarray(model.table[i], float) for i in w), none) for w in words]
    out = float(model.out_bias)
    for a, width in enumerate(T.WIDTHS):
        for f in range(T.FILTERS):
            best = 0.0
            for i in range(len(words)):
                value = float(model.bias[width][f])
                for o in range(width):
                    if i + o < len(words):
                        for d in range(T.DIM):
                            value += vector[i + o][d] * float(model.filters[width][o, d, f])
                best = max(best, value)
            out += best * float(model.out[a * T.FILTERS + f])
    return out


def test_logits_by_nested_loops(model):
    got = model.logits(TEXTS)
    assert got == pytest.approx([plainly(model, t) for t in TEXTS], abs=1e-4)
    assert [model.logits([t])[0] for t in TEXTS] == pytest.approx(got, abs=1e-6)


def test_gradients_by_differences(model):
    texts = TEXTS[2:7]
    y = np.array([0, 1, 0, 0, 1], np.float32)
    made = []
    for t in texts:
        rows, _ = T.features([t])
        made.append(rows[: len(rows) - T._PAD])
    g_f, g_b, g_out, g_bias, rows, grads = T.gradients(model, made, y)

    def loss():
        z = np.array([plainly(model, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    def slope(array, at, step=1e-3):
        old = array[at]
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        return (up - down) / (2 * step)

    r = np.random.default_rng(1)
    for w in T.WIDTHS:
        for _ in range(6):
            at = (r.integers(w), r.integers(T.DIM), r.integers(T.FILTERS))
            assert g_f[w][at] == pytest.approx(slope(model.filters[w], at), abs=2e-3)
        assert g_b[w][2] == pytest.approx(slope(model.bias[w], 2), abs=2e-3)
    for k in range(0, len(model.out), 5):
        assert g_out[k] == pytest.approx(slope(model.out, k), abs=2e-3)
    z = np.array([plainly(model, t) for t in texts])
    assert g_bias == pytest.approx(float(np.mean(1 / (1 + np.exp(-z)) - y)), abs=1e-4)
    for i in np.unique(rows[rows > 0])[:8].tolist():
        total = grads[rows == i].sum(axis=0)
        for d in (0, T.DIM - 1):
            assert total[d] == pytest.approx(slope(model.table, (i, d)), abs=2e-3)


def test_a_batch_of_texts_without_words_has_a_gradient_of_the_bias_alone(model):
    made = [np.zeros((T._PAD, 4), np.int32)] * 2
    g_f, g_b, g_out, g_bias, rows, _ = T.gradients(model, made, np.array([0, 0], np.float32))
    assert not len(rows) and not g_out.any() and not any(g.any() for g in g_f.values()) and g_bias == pytest.approx(1 / (1 + np.exp(-model.out_bias)), abs=1e-6)


def test_thresholds_by_trying_all():
    r = np.random.default_rng(2)
    for _ in range(50):
        z, y = r.normal(0, 2, 40), (r.random(40) < 0.3).astype(float)
        if not 0 < y.sum() < 40:
            continue
        f1 = lambda t: 2 * ((z > t) & (y == 1)).sum() / max(1, (z > t).sum() + y.sum())
        tries = [*((a + b) / 2 for a, b in zip(np.sort(z), np.sort(z)[1:])), z.min() - 1]
        assert f1(T.best_threshold(z, y)) == pytest.approx(max(f1(t) for t in tries), abs=1e-3)


def test_languages_are_learnt_from_texts():
    r = np.random.default_rng(4)
    alphabets = ["abcde", "fghij", "klmno"]
    texts, kind = [], []
    for i in range(120):
        kind.append(i % 3)
        texts.append(" ".join("".join(r.choice(list(alphabets[i % 3]), 5)) for _ in range(30)).encode())
    m = T.Model.fresh()
    m.languages = T.centres(texts, 3)
    got = [m.language(t) for t in texts]
    assert len(set(zip(kind, got))) == 3 and m.language(b"") == m.language(b"?") == 0
    assert T.centres([b"", b"x"]).shape == (1, T.PROFILE)


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    """Many shares: every labelled row that isn't held out is in one, and the scores don't follow the partitions."""
    import zlib

    r = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{k}" for k in r.integers(0, 300, 20)) + (" vermin" if i % 3 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(T, "SHARE_ROWS", 60)
    monkeypatch.setattr(T, "TOGETHER", 3)
    monkeypatch.setattr(T, "STEPS", 320)
    got, shares, kinds = T.examples(docs, labels)
    want = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert shares == -(-len(want) // 60) > 9 and kinds == 2 and {x["doc_id"] for x in got.collect()} == want
    models = [T.learnt(docs.repartition(n), labels) for n in (1, 5)]
    texts = [t.encode() for _, t in rows]
    a, b = (m.scores(texts) for m in models)
    assert (a == b).all()
    held = np.array([i not in want for i, _ in rows])
    assert ((a >= T.CUT) == np.array([i % 3 == 0 for i, _ in rows]))[held].mean() > 0.95
