"""The pipeline's stages on a small folder, each against what its operator promises."""

import random
import re

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    for i in range(260):
        text, good = prose(rng.randint(20, 120)), 1
        if i % 5 == 0:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        if i % 11 == 3:
            text += " mail to ann.lee@mail.example.org or 10.20.30.40"
        docs.append((i, text, "en", ["a", "b", "c"][i % 3], len(text)))
        labels.append((i, good, 0))
    for i in range(6):  # near copies: one word of a long text changed
        words = prose(200).split()
        for k in range(4):
            docs.append((3000 + 10 * i + k, " ".join([*words[: 40 * k], "other", *words[40 * k + 1 :]]), "en", "b", 5))
    docs += [(1000 + i, docs[1][1], "en", "a", 5) for i in range(7)] + [(2000, None, "en", None, 0)]
    top = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        rows[name] = docs.collect()
    bad = {i for i in range(0, 260, 5)}
    kept = {r.doc_id for r in rows["quality"]}
    assert not kept & bad and len(kept - bad) >= 0.98 * (260 - len(bad) + 7 + 24)
    near = [r.doc_id for r in rows["near_dedup"]]
    assert len(near) == len(set(near)) and 1 in near and not any(1000 <= i < 1007 for i in near)
    sets = {r.doc_id: shingles(r.text) for r in rows["quality"]}
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    assert {b for _, b in pairs} | set(near) == set(sets) and not {b for _, b in pairs} & set(near)
    clean = {r.doc_id: r.text for r in rows["personal_data"]}
    assert set(clean) == set(near) and not any(re.search(r"@|10\.20", t or "") for t in clean.values())
    assert any("[EMAIL]" in (t or "") and "[IP]" in t for t in clean.values() if t)
    words = lambda rs: sum(len((r.text or "").split()) for r in rs)
    assert abs(words(rows["mixture"]) - 1.5 * words(rows["personal_data"])) < 8
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    by = {}
    for r in last:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 1024 for v in by.values()) and len(last) >= len(rows["mixture"])


def test_run_equals_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 150
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "mixture", "sequences"]
