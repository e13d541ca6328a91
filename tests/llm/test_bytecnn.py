"""The byte network: symbols, gradients' effect, held-out accuracy, bounds."""

import random
import zlib

import numpy as np

from tessera.llm import bytecnn


def test_symbols_mark_repeated_words():
    s = bytecnn.symbols(b"ab ab c ab")
    assert [int(x >= 256) for x in s[:10]] == [0, 0, 0, 1, 1, 0, 0, 0, 0, 0]
    assert bytes((s[:10] & 255).astype(np.uint8)) == b"ab ab c ab"
    for t in (b"", b" ", b"a", b"  a a", b"x" * 15, b"x" * 17, b"x " * 40):
        s = bytecnn.symbols(t)
        assert len(s) >= 16 and (len(s) - 16) % 8 == 0 and len(s) >= len(t)


def test_slices_pool_like_the_whole(monkeypatch):
    m = bytecnn.Model(1)
    t = bytecnn.symbols(bytes(np.random.default_rng(0).integers(32, 120, 5000, dtype=np.uint8)))
    want = m.pooled(t)
    monkeypatch.setattr(bytecnn, "SLICE", 64)
    got = m.pooled(t)
    assert np.allclose(want[0], got[0]) and (want[1] == got[1]).all()


def test_long_texts_score_like_the_whole(monkeypatch):
    m = bytecnn.Model(2)
    t = b" ".join(b"word%d again again" % (i % 97) for i in range(900))
    want = m.score(t)
    monkeypatch.setattr(bytecnn, "LONG", 2048)
    assert abs(m.score(t) - want) < 1e-6


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.7
        if not good:
            k = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if k == 0 else [x + "$%&" for x in w] if k == 1 else [x for x in w for _ in range(6)]
        out.append((i, " ".join(w), int(good)))
    return out


def test_held_out_accuracy(spark):
    data = rows(700, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(None, None, "y"), (9000, "", "z")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = bytecnn.digest(docs, labels).collect()
    assert len(got) == len(data) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, _, q in data}
    test = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(test) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.95
    kept = bytecnn.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_sample_is_bounded_and_never_held_out(spark):
    data = rows(300, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    texts, y = bytecnn.sample(docs, labels, rows=20, most=4000)
    assert max(y.count(0), y.count(1)) <= 20 and sum(map(len, texts)) <= 4000
    free = {t for i, t, _ in data if zlib.crc32(str(i).encode()) % 5}
    assert {t.decode() for t in texts} <= free
    assert bytecnn.digest(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in bytecnn.digest(docs, labels.where("quality = 1")).collect()}.pop() > 0.9


def test_sample_stays_bounded_when_an_id_repeats(spark):
    docs = spark.createDataFrame([(1, "x" * 500)] * 400 + [(i, f"text {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 1)] * 50, "doc_id long, quality int")
    texts, marks = bytecnn.sample(docs, labels, rows=5, most=4000)
    assert len(texts) == len(marks) <= 10 and sum(map(len, texts)) <= 4000


def test_pooling_equals_a_plain_convolution():
    """Every window by a loop, and the gradient by finite differences of the loss."""
    rng = np.random.default_rng(5)
    m = bytecnn.Model(3)
    m.bias = rng.standard_normal(bytecnn.FILTERS).astype(np.float32) * 0.1
    for text in (b"", b"a", b"abc abc " * 9, bytes(rng.integers(0, 256, 777).astype(np.uint8)), "é日 x x".encode() * 40):
        s = bytecnn.symbols(text)
        best = np.full(bytecnn.FILTERS, -np.inf)
        for at in range(0, len(s) - bytecnn.WIDTH + 1, bytecnn.STEP):
            best = np.maximum(best, sum(m.table[k, s[at + k]].astype(float) for k in range(bytecnn.WIDTH)))
        want = np.maximum(best + m.bias, 0)
        got, where = m.pooled(s)
        assert np.allclose(got, want, atol=1e-4)
        assert abs(m.score(text) - 1 / (1 + np.exp(-(want @ m.weight + m.offset)))) < 1e-5
        for f in range(0, bytecnn.FILTERS, 5):
            assert np.isclose(sum(float(m.table[k, s[where[f] + k], f]) for k in range(bytecnn.WIDTH)), best[f], atol=1e-4)
