"""PII, sharding and mixing against brute force."""

import hashlib
import random
import re
import time
import zlib

import pytest

from tessera.llm import mixing, pii, sharding

#: The base patterns in their plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 if kind == "phone" else True


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def pii_texts():
    rng = random.Random(5)
    parts = ["a@b.c", "x.y@z-1.co.uk@q.r", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (437) 555-0689", "+49 30 1234567.", "é😀", " ", "\n", "@", "+", ".", "-", "card", "007.001.000.255", "a_b%c@d.e_f@g.h", "12 34", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "((("]
    out = [None, "", "a" * 30000, "1 " * 20000, "1" * 30000, "a.@" * 5000, "+1" * 5000, "1.2.3.4 " * 3000]
    return out + ["".join(rng.choice(parts) + rng.choice(["", " ", "😀"]) for _ in range(rng.randint(1, 30))) for _ in range(300)]


def test_pii_equals_plain_patterns(spark):
    texts = pii_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a@b.c")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in PLAIN] == want


def test_a_text_with_very_many_matches(spark):
    """Positions, context and redaction over many blocks; the cost grows with the text."""
    rng = random.Random(6)
    parts = [rng.choice(["aa@bb.cc ", "日本 ", "call +49 (30) 1234567, ", "x ", "10.0.0.1 ", "DE89370400440532013000 ", "é" * 50 + " "]) for _ in range(12_000)]
    text = "".join(parts)
    at, want = 0, {"email": [], "ip": [], "phone": []}
    for p in parts:
        for kind, m in (("email", "aa@bb.cc"), ("ip", "10.0.0.1"), ("phone", "+49 (30) 1234567")):
            if m in p:
                want[kind].append((at + p.index(m), at + p.index(m) + len(m)))
        at += len(p)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.digest(docs).collect()[0]
    spans = [x.split(":") for x in got.spans.split(",")]
    for kind, places in want.items():
        assert [(int(b), int(e)) for k, b, e in spans if k == kind] == places
    assert sum(k == "iban" for k, *_ in spans) == text.count("DE89")
    clean = pii.redact(docs).collect()[0].text
    assert clean == "".join(p.replace("aa@bb.cc", "[EMAIL]").replace("+49 (30) 1234567", "[PHONE]").replace("10.0.0.1", "[IP]").replace("DE89370400440532013000", "[IBAN]") for p in parts)
    assert time.time() - began < 60


def test_ibans_beside_words_and_numbers(spark):
    """An IBAN ends where its checksum says, whatever capital or digit comes next."""
    de, gb, xx = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "ZZ33 1234 5678 9012 345"
    texts = [f"{de} Please", "IBAN DE89 3704 0044 0532 0130 00 Thank you", "GB82WEST12345698765432 42 euros", f"{de} {gb} A", f"{gb} {de}", f"{de}X", f"x{de}", f"é {de}, 5", f"{de} I PAY 12 AB34", f"{de} " + "A " * 40, f"{xx} Or", "NO93 8601 1117 947 NO9386011117947"]
    want = ["0:22", "5:32", "0:22", "0:22,23:50", "0:27,28:50", "", "", "2:24", "0:22", "0:22", "0:23", "0:18,19:34"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    assert [",".join(s[5:] for s in got[i].split(",") if s.startswith("iban")) for i in range(len(texts))] == want
    clean = {r.doc_id: r.text for r in pii.redact(docs.where("doc_id < 3")).collect()}
    assert clean == {0: "[IBAN] Please", 1: "IBAN [IBAN] Thank you", 2: "[IBAN] 42 euros"}


def test_pii_checksums_and_context(spark):
    rows = [(0, "iban GB82 WEST 1234 5698 7654 32 ok"), (1, "iban GB83 WEST 1234 5698 7654 32"), (2, "my ssn is 123-45-6789"), (3, "code 123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "iban:5:32" and "iban" not in got[1] and got[2] == "ssn:10:21" and got[3] == ""


def test_redact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.c and 1.2.3.4!", "pii_spans"), (2, None, "x"), (3, "clean", "y")], "doc_id long, text string, kind string")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] and [IP]!", "pii_spans"), (2, None, "x"), (3, "clean", "y")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string, shard int")
    assert pii.digest(df).count() == sharding.shard_documents(df).count() == mixing.mix(df).count() == mixing.mixed_rows(df).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_sharding_law(spark, n):
    rows = [(i if i % 7 else None, ("é" * (i % 5)) if i % 3 else None, "x") for i in range(n)] + [(5, "same", "y")] * (n // 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    got = sharding.shard_documents(df, shards=4).collect()
    assert len(got) == len(rows)
    by = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in by) and max(map(len, by)) - min(map(len, by)) <= 1
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    again = sharding.shard_documents(df.repartition(5), shards=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 5, 99, 1000):
        x = spark.range(n).withColumn("f", sharding.feistel(F.col("id"), F.lit(n).cast("long"), 3))
        p = x.select(sharding.permuted(F.col("f"), F.lit(n).cast("long"), 3).alias("p")).collect()
        assert sorted(r.p for r in p) == list(range(n))


def water(sizes, weights=(5, 2, 1)):
    """Iterative resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    cap, left, open_, target = {s: 2.0 * sizes[s] for s in names}, 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > cap[s]}
        if not over:
            return target | {s: share * w[s] for s in open_}
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        open_ -= over
    return target


def test_mixing_targets_and_taken(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "ü", "😀", "z", None, "B"] + ["hot"] * 3), "w " * rng.randint(0, 60) if rng.random() > 0.05 else None) for i in range(800)] + [(7, "a", "x y z")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] + r.part for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    out = mixing.mixed_rows(df).collect()
    assert abs(sum(len((r.text or "").split()) for r in out) - sum(want.values())) <= len(sizes) + 8
    assert set(out[0].asDict()) == {"doc_id", "source", "text"}


def test_equal_rows_share_all_their_words(spark):
    """A source of rows alike in id and size meets its target to the word."""
    rows = [(7, "a b c d e f g", "x") for _ in range(40)] + [(8, "one two three", "x"), (9, "k " * 50, "y"), (None, "p q", None), (None, "r s", None), (5, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.source: r.target for r in mixing.mix(df).collect()}
    got = mixing.mixed_rows(df).collect()
    for s, t in want.items():
        assert sum(len(r.text.split()) for r in got if r.source == s) == round(t)
    assert max(sum(r.doc_id == 7 for r in got), 0) <= 80


def test_one_row_repeated_many_times(spark):
    df = spark.createDataFrame([(1, "same")] * 9000 + [(i, "other") for i in range(2, 200)], "doc_id long, text string")
    got = sharding.shard_documents(df, shards=4).collect()
    assert len(got) == 9198 and sorted({(r.shard, r.slot) for r in got}) == sorted((s, k) for s in range(4) for k in range(9198 // 4 + (s < 9198 % 4)))
