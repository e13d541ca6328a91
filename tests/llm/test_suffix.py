"""Repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix


def brute(rows):
    """rows: (order, text) in order; per text the bytes covered by a 100-byte string that starts earlier."""
    seen, out = set(), []
    for text in rows:
        cover = np.zeros(len(text), bool)
        for i in range(len(text) - 99):
            s = text[i : i + 100]
            if s in seen:
                cover[i : i + 100] = True
            seen.add(s)
        out.append(cover)
    return out


def corpus(seed, n=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randint(10, 60)) for _ in range(6)]
    docs = []
    for _ in range(n):
        parts = [prose(rng.randint(0, 40)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(1, 5))]
        docs.append("".join(parts))
    for _ in range(15):  # near copies
        w = list(rng.choice(docs[:n]))
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = "#"
        docs.append("".join(w))
    return docs + ["", "x" * 99, "x" * 100, "x" * 350, "ab" * 200, "be be " * 90, shared[0], None]


def check(got, ids, texts):
    order = sorted(range(len(texts)), key=lambda i: ids[i])
    cover = dict(zip(order, brute([(texts[i] or "").encode() for i in order]), strict=True))
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        b, c, r = (t or "").encode(), cover[i], by[ids[i]]
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        spans = int((np.diff(np.r_[0, c.astype(int), 0]) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(c.sum()), spans, hashlib.sha256(kept).hexdigest()), (ids[i], t)


def test_runs_do_not_depend_on_slices(monkeypatch):
    texts = [(t or "").encode() for t in corpus(3)] + [(" ".join(t or "" for t in corpus(4))).encode() * 2]
    want = [r for t in texts for r in zip(*(x.tolist() for x in suffix.runs([t])[1:]), strict=True)]
    monkeypatch.setattr(suffix, "SLICE", 300)
    got = suffix.runs(texts)
    assert list(zip(*(x.tolist() for x in got[1:]), strict=True)) == want
    lo, hi, p = got[1], got[2], got[3]
    assert sum((hi - lo + 1).tolist()) == sum(max(0, len(t) - 99) for t in texts) and (hi <= p).all() and (p - lo <= 68).all()


@pytest.mark.parametrize("seed,group", [(1, 2000), (2, 3)])
def test_repeated(spark, seed, group):
    texts = corpus(seed)
    rng = random.Random(seed)
    ids = rng.sample(range(-500, 5000), len(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, doc string, pos int").repartition(5)
    check(suffix.repeated(df, group=group).collect(), ids, texts)


def test_repeated_ids_nulls_and_empty(spark):
    a = "The same sentence stands here, and it is long enough to be found by its hundred bytes, as you see. Fine."
    rows = [(3, a), (3, a), (None, a + "!"), (4, "x" + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in suffix.repeated(df).collect())
    assert got == [(False, 0, 0), (True, 3, len(a)), (True, 3, len(a)), (True, 4, len(a))]
    assert suffix.repeated(df.limit(0)).count() == 0
    spans = suffix.repeated(df, with_spans=True).where("doc_id = 4").first().spans
    assert [(s.b, s.e) for s in spans] == [(1, len(a) + 1)]
