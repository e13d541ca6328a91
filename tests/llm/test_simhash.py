"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import graph, simhash


def plain(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in nodes:
        for j in nodes:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(monkeypatch):
    rng = random.Random(3)
    texts = ["", " \n", "One", "one two", "A b\tC", "é\xa0É x y", "x " * 600] + [" ".join(rng.choice(["Ab", "é", "c", "d\n", "e"]) for _ in range(rng.randint(1, 700))) for _ in range(60)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain(t) for t in texts]
    monkeypatch.setattr(simhash, "SLICE", 50)
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain(t) for t in texts]
    assert [simhash.fingerprint(t.encode(), 5) for t in texts] == [plain(t, 5) for t in texts]


@pytest.mark.parametrize("group", [4096, 4])
def test_links_connect_all_near_pairs(spark, group):
    rng = random.Random(group)
    seeds = [rng.getrandbits(64) for _ in range(25)] + [0, 2**64 - 1]
    fps = set(seeds)
    for s in seeds:
        for _ in range(12):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(df, group=group)).collect()}
    want = reach(fps, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    assert {f: got.get(f, f) for f in fps} == want


def test_groups(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(300)) for _ in range(8)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(300)] = "new"
        rows.append((1000 - i, " ".join(w), "x"))
    rows += [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (None, "no id", "y"), (77, base[0], "x"), (77, base[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.digest(df).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows if r[0] is not None]
    fp = {r[0]: plain(r[1]) for r in rows}
    want = reach(sorted(set(ids)), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {i: (f"{fp[i]:016x}", want[i]) for i in ids}
    assert simhash.digest(df.limit(0)).count() == simhash.keep_one(df.limit(0)).count() == 0


def sets(text, n=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def near_copies(rng, base, n, most, words=300):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [20_000, 30])
def test_one_of_each_group_of_similar_texts(spark, hot, monkeypatch):
    """Against all pairs of texts by brute force; with frequent values of a segment dealt out, too."""
    monkeypatch.setattr(simhash, "FEW", hot)  # the smaller one: nothing is broadcast
    rng = random.Random(hot)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 999))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(300)]
        rows += near_copies(rng, base, 25, 3) + [" ".join(base).upper()] * 2
    rows += [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(150)] + ["a b", "a  B", "a", None, "", " \n"]
    # similar by half: clean texts that share a passage stay apart
    shared = [word() for _ in range(120)]
    rows += [" ".join(shared + [word() for _ in range(120)]) for _ in range(10)]
    rng.shuffle(rows)
    rows = [(1000 - i, t, i) for i, t in enumerate(rows)] + [(None, "no id one", 1), (None, "no id two", 1), (5000, "same id one", 1), (5000, "same id two", 1), (5001, "a row twice", 1), (5001, "a row twice", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root long").repartition(5)
    got = simhash.keep_one(df, hot=hot).collect()
    want = reach(range(len(rows)), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    groups = {}
    for i, r in want.items():
        groups.setdefault(r, set()).add(rows[i][0])
    least = sorted(min((x is None, x or 0) for x in g) for g in groups.values())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == least
    assert df.columns == ["doc_id", "text", "root"] and {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, _ in rows}
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_signatures_find_pairs_as_promised(spark):
    """Share of pairs of each similarity that some segment proposes."""
    rng = random.Random(2)
    rows, pairs = [], []
    for changed, least in ((1, 0.99), (4, 0.95), (8, 0.85)):
        for _ in range(60):
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
            other = list(base)
            for i in rng.sample(range(0, 400, 6), changed):
                other[i] = "changed"
            pairs.append((len(rows), least, jaccard(" ".join(base), " ".join(other))))
            rows += [" ".join(base), " ".join(other)]
    assert min(j for *_, j in pairs) > 0.8
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    root = {r.id: r.root for r in simhash.similar(df).collect()}
    for least in (0.99, 0.95, 0.85):
        own = [i for i, want, _ in pairs if want == least]
        assert sum(root[i] == root[i + 1] for i in own) >= least * len(own) - 1
    assert len(set(root.values())) >= len(pairs)


def test_no_pair_of_least_similarity_is_left_out(spark, monkeypatch):
    """Pairs of exactly 0.8 (96 shingles of 120), and just below it (96 of 121); half of the texts share a passage."""
    monkeypatch.setattr(simhash, "COUNTED", 1)
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    shared, rows, want = [word() for _ in range(30)], [], []
    for i in range(200):
        base = [word() for _ in range(70)]
        base = base + shared if i % 2 else base + [word() for _ in range(30)]
        tail = [word() for _ in range(24 + (i % 4 == 3))]  # 96 of 120, or of 121
        pair = [" ".join(base), " ".join(base + tail)]
        want.append(jaccard(*pair) >= 0.8)
        rows += pair
    assert want == [i % 4 != 3 for i in range(200)] and any(jaccard(rows[2 * i], rows[2 * i + 1]) == 0.8 for i in range(200))
    got = {r.id: r.root for r in simhash.similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(200)] == want
    assert len(set(got.values())) == len(rows) - sum(want)


def test_pairs_that_meet_in_large_keys():
    """All pairs of different roots that can be similar, whatever the groups' sizes and the batches' cuts."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = sorted((int(k), int(r), n, int(b), 10, int(at)) for n, (k, r, b, at) in enumerate(zip(np.repeat([3, 4, 9], [30, 300, 5]), rng.integers(0, 9, 335) ** 2 // 9, rng.integers(0, 3, 335), rng.integers(0, 3, 335), strict=True)))
    can = lambda x, y: x[1] != y[1] and (x[3] != y[3] or not x[5] or not y[5]) and (10 - max(x[5], y[5])) * 1.8 >= 16
    want = {tuple(sorted((x[2], y[2]))) for i, x in enumerate(rows) for y in rows[:i] if x[0] == y[0] and can(x, y)}
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", "root", "node", "before", "size", "at"])
    for cut in (400, 37):
        got = [(a, b) for x in simhash._meeting(0.8)(iter([batch.slice(i, cut) for i in range(0, 335, cut)])) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        assert want and set(got) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3), (500, 499)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {499: 499, 500: 499}


def test_parities_leave_out_no_similar_sets():
    rng = np.random.default_rng(6)
    sets = [np.zeros(0, np.uint64), np.array([5], np.uint64)]
    for n in [1, 3, 8, 40, 63, 64, 65, 300, 511, 513, 4000]:
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (1, 0.95, 0.9, 0.89, 0.8, 0.6, 0.3):
            fresh = rng.integers(0, 2**63, int(n * (1 - share) * rng.choice([0.5, 1, 2])), dtype=np.uint64)
            sets.append(np.unique(np.r_[base[: int(np.ceil(n * share))], fresh]))
    i, j = map(np.ravel, np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    size = np.array(list(map(len, sets)))
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    alike = both >= 0.8 * (size[i] + size[j] - both)
    may = simhash.may_be_similar([simhash.parity(s) for s in sets], size, i, j, 0.8)
    assert may[alike].all() and alike.sum() > 100
    apart = (np.minimum(size[i], size[j]) >= np.maximum(250, 0.8 * np.maximum(size[i], size[j]))) & (both < 0.6 * (size[i] + size[j] - both))
    assert apart.sum() > 10 and not may[apart].any()


def texts_of_one_base(rng, n, changed, words=200):
    """Texts whose sets share most shingles, each with ``changed`` words of its own (each of them in five shingles)."""
    base, out = [f"b{i}" for i in range(words)], []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(2, words - 2, 5), changed):
            w[k] = f"own{i}x{k}"
        out.append(" ".join(w))
    return out


@pytest.fixture
def tables(spark, monkeypatch):
    """Rows of each table that is written."""
    from pyspark.sql import DataFrameWriter

    found, write = [], DataFrameWriter.parquet

    def parquet(self, path, *a, **b):
        write(self, path, *a, **b)
        found.append(spark.read.parquet(path).count())

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return found


def test_rows_do_not_grow_with_the_square_of_a_group(spark, tables):
    """Many texts that share a base, none of them similar enough: their pairs are 79,800."""
    texts = texts_of_one_base(random.Random(4), 400, 4)
    got = {r.id: r.root for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    own = [sets(t) for t in texts]
    alike = [len(a & b) / len(a | b) for n, a in enumerate(own) for b in own[:n]]
    assert min(alike) > 0.6 and sum(x >= 0.8 for x in alike) < 10
    assert len(set(got.values())) >= len(texts) - sum(x >= 0.8 for x in alike)
    assert tables and max(tables) < 79_800 / 4


@pytest.mark.parametrize("most", [1, 6, 1000])
def test_texts_that_meet_by_tiles_lose_no_link(spark, most, monkeypatch):
    """Groups about the least similarity, whether pairs are made at once or texts meet in tiles of four."""
    monkeypatch.setattr(simhash, "MEET", most)
    monkeypatch.setattr(simhash, "TILE", 4)
    monkeypatch.setattr(simhash, "COUNTED", 1)
    monkeypatch.setattr(simhash, "candidates", lambda nodes, bits, hot: nodes.select(nodes["node"].alias("a"), nodes["node"].alias("b")).limit(0))
    rng = random.Random(most)
    texts = [t for k in (2, 4, 5, 6) for t in texts_of_one_base(rng, 12, k)]
    got = {r.id: r.root for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = reach(range(len(texts)), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    assert 1 < len(set(want.values())) < len(texts)
    assert {tuple(sorted(i for i in got if got[i] == r)) for r in set(got.values())} == {tuple(sorted(i for i in want if want[i] == r)) for r in set(want.values())}


def test_only_what_is_read_later_stays_in_the_shared_folder(spark):
    import os

    from tessera import scratch

    top = scratch.folder(spark).removeprefix("file:")
    there = set(os.listdir(top)) if os.path.isdir(top) else set()
    rows = simhash.keep_one(spark.createDataFrame([(i, f"text {i // 2} of a few words") for i in range(20)], "doc_id long, text string"))
    assert len(set(os.listdir(top)) - there) == 1 and rows.count() == 10
