"""Token ids, packing and shards against the library and brute force."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, sstable, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a  b   c", "a \n b", " lead", "trail ", "trail  ", "a\n\n b", "x\xa0 y　 z", "It's I'LL we'd", "ǅ İ Σας ΟΔΟΣ", "é é ﬁ", "日本語 テキスト", "😀 😀😀", "a\tb c\r\nd", "\x1c a", "12345 6 7a8", "<|endoftext|> x", "don't  stop", "a ́b", "é" * 100, "​ x", "!!! ??", "--- a.", "The end."]


def library(path):
    t = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def texts(n=250, seed=1):
    rng = random.Random(seed)
    parts = ["the", "of", "éê", "Ñandú", "word's", "x", "\n", "  ", "12", "£", "ß", "ﬀ", "....", "naïve,", "END", "İ"]
    return ODD + ["".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("memo", [20, 100_000])
def test_ids_equal_the_library(path, memo):
    e, all_texts = tokens.Encoder(path, memo), texts()
    want = library(path)(all_texts)
    for _ in range(2):
        got = []
        for i in range(0, len(all_texts), 37):
            ids, k = e.encode([t.encode() for t in all_texts[i : i + 37]])
            ends = np.cumsum(k)
            got += [ids[b:f].tolist() for b, f in zip(ends - k, ends, strict=True)]
        assert got == want


def solid(seed=5):
    """Texts without lone spaces: blocks of 4096 bytes that change places, and long runs."""
    rng = random.Random(seed)
    a, b = "ab" * 2048, "qzx1" * 1024
    run = "".join(rng.choice("abcXYZ0189/+=.%-_é日") for _ in range(9000))
    return [a + b, b + a, a + b + a, a + a + b, run, run[4096:8192] + run[:4096] + run[8192:], "https://x.y/" + run, "日本語テキスト" * 900, "x" * 20_000, "a\n" * 4000]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_texts_without_spaces_and_special_tokens(path):
    special = ["<|endoftext|>", "a<|endoftext|>", " <|endoftext|> b", "<|startoftext|>x <|endoftext|><|endoftext|>", "<|EndOfText|> c", "<|endoftext |>", "<|endoftext|>  "]
    all_texts = solid() + special + [s + t for s in special for t in ODD[:6]]
    ids, k = tokens.Encoder(path).encode([t.encode() for t in all_texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(k)[:-1])] == library(path)(all_texts)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_whose_hashes_meet(path, monkeypatch):
    """Whatever the hash finds, ids are the text's own."""
    real = tokens._hashes
    monkeypatch.setattr(tokens, "_hashes", lambda *a: real(*a) % np.uint64(50) + np.uint64(1))
    e, all_texts = tokens.Encoder(path, 30), texts(80, 9)
    for i in range(0, len(all_texts), 20):
        ids, k = e.encode([t.encode() for t in all_texts[i : i + 20]])
        assert [x.tolist() for x in np.split(ids, np.cumsum(k)[:-1])] == library(path)(all_texts[i : i + 20])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_texts_are_joined_again(path, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 200)
    long = " ".join(texts(40, 3))
    monkeypatch.setattr(tokens, "segments", lambda t, f=tokens.segments: f(t, 200))
    assert [x.tolist() for x in tokens.encode_docs(path, [b"a", long.encode(), b""])] == library(path)(["a", long, ""])


def test_cut():
    for n in (1, 5, 8, 9, 16, 17):
        b, k = packing.cut(n, 8)
        assert k.sum() == n and (k[1:] == 8).all() and (b == np.cumsum(k) - k).all() and 0 < k[0] <= 8


def brute(lengths, capacity):
    """The rule on explicit bins."""
    gaps = []
    for s in lengths:
        def cost(i):
            after = gaps[:i] + [gaps[i] - s] + gaps[i + 1 :]
            return sum(after.count(g) ** 2 for g in set(after) if g)
        fits = [i for i, g in enumerate(gaps) if g >= s]
        if fits:
            best = min(cost(i) for i in fits)
            i = min((gaps[i], i) for i in fits if cost(i) == best)[1]
            gaps[i] -= s
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


def test_sum_of_squares_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x = np.sort(rng.integers(1, 17, rng.integers(1, 40)))[::-1]
        bins, offsets = packing.sum_of_squares(x, 16)
        left = [16 - x[bins == b].sum() for b in range(bins.max() + 1)]
        assert sorted(left) == brute(x.tolist(), 16)
        for b in range(bins.max() + 1):
            o = np.argsort(offsets[bins == b])
            assert (offsets[bins == b][o] == np.cumsum(x[bins == b][o]) - x[bins == b][o]).all()


def frame(spark, rows, more="lang string, piece string"):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], f"doc_id long, text string, {more}")


def test_packed_documents(spark):
    rows = list(enumerate(texts(60))) + [(900, None), (None, "null id"), (901, "long word " * 4000), (5, "again"), (5, "again")]
    got = packing.packed(frame(spark, rows), BYTE, with_ids=True).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(library(BYTE)([t or ""])[0] + [2])
    for i, all_ids in want.items():
        mine = [r for r in got if r.doc_id == i]
        if len(all_ids) == 1:
            mine.sort(key=lambda r: r.piece)
            ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist()
            assert ids == all_ids[0] and [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
            assert all(r.length == 1024 for r in mine[1:]) and all(zlib.crc32(r.ids) == r.ids_crc32 for r in mine)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(s[-1]) <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) + 1
    assert packing.packed(frame(spark, []), BYTE).count() == 0


def test_many_groups_in_few_tasks(spark, monkeypatch):
    """Groups stream through a task one after another; copies of one document are spread over groups."""
    monkeypatch.setattr(packing, "TASKS", 2)
    rows = [(i, "some words of text " * (1 + i % 60)) for i in range(150)] + [(7, "hot " * 700)] * 100
    docs = frame(spark, rows).repartition(6)
    got = packing.packed(docs, BYTE, group=10_000).collect()
    total = sum(octets for octets in (len(t) for _, t in rows))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id))
    for s in by.values():
        s.sort()
        assert [o for o, _, _ in s] == np.cumsum([0] + [n for _, n, _ in s])[:-1].tolist() and s[-1][0] + s[-1][1] <= 1024
    assert len({s >> 40 for s in by}) > 5 and total > 50_000 and len({r.sequence_id >> 40 for r in got if r.doc_id == 7}) > 3
    assert len(got) == sum(-(-len(x) // 1024) for x in ([*i, 2] for i in library(BYTE)([t for _, t in rows])))


def test_shard_lookup():
    file, w_docs = io.BytesIO(), {}
    w = sstable.Writer(file)
    rng = np.random.default_rng(1)
    w.add(None, np.array([7, 2], np.uint16))
    for i in sorted(rng.integers(-(10**6), 10**6, 3000).tolist()):
        ids = rng.integers(0, 49000, rng.integers(1, 90)).astype(np.uint16)
        w.add(i, ids)
        w_docs.setdefault(i, []).append(ids)
    w.close()
    r = sstable.Reader(file)
    assert [i for i, _ in r] == [None] + [i for i, v in w_docs.items() for _ in v] and len(r.index) > 3
    assert all(np.array_equal(a, b) for i, v in w_docs.items() for a, b in zip(r.get(i), v, strict=True))
    reads = []
    r._entries = lambda b, f=r._entries: (reads.append(b), f(b))[1]
    absent = [i for i in range(10**6, 10**6 + 2000) if not r.get(i)]
    assert len(absent) == 2000 and len(reads) < 100
    with pytest.raises(ValueError):
        sstable.Reader(io.BytesIO(file.getvalue()[:-9] + b"x" + file.getvalue()[-8:]))


def test_shards_round_trip(spark):
    rows = list(enumerate(texts(60))) + [(900, None), (None, "null id"), (901, "long word " * 4000), (5, "again"), (-5, "before")]
    got = sorted(sstable.round_trip(frame(spark, rows).repartition(3), WORD, shards=4).collect(), key=lambda r: r.start)
    lib = library(WORD)
    want = sorted(((i is not None, i or 0), zlib.crc32(np.array(lib([t or ""])[0] + [2], "<u4"))) for i, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    assert sstable.round_trip(frame(spark, []), WORD, shards=2).count() == 0
