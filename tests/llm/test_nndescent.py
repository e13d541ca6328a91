"""NN-descent against brute force."""

import numpy as np
import pytest

from tessera.llm import nndescent


def cloud(n, d, groups, size, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for g in range(groups):
        x[g * size : (g + 1) * size] = x[g * size] + rng.standard_normal((size, d)) * 0.08
    return x


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    comp = {i: i for i, _ in rows}
    ids = [i for i, _ in good]
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near), strict=True):
            m = min(comp[ids[a]], comp[ids[b]])
            changed |= comp[ids[a]] != m or comp[ids[b]] != m
            comp[ids[a]] = comp[ids[b]] = m
    return {i: 0 for i, _ in rows} | {i: int(c) for i, c in zip(ids, near.sum(1), strict=True)}, comp


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "TILE", 16)
    x = cloud(500, 16, 5, 40)
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[3].tolist()) for i in range(30)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0] * 15 + [None]), (3004, [1.0, 2.0]), (3005, []), (3006, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = nndescent.near_duplicates(df).collect()
    n, comp = brute(rows)
    assert len(got) == len(rows)
    assert {r.vec_id: r.n_links for r in got} == n
    assert {r.vec_id: r.component_id for r in got} == comp
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and got[0].audit_recall == 1.0


def test_tight_groups_near_each_other(spark, monkeypatch):
    """Lists that fill with their own group hide the links to the group beside it."""
    monkeypatch.setattr(nndescent, "TILE", 16)
    rng = np.random.default_rng(4)
    axes = np.eye(16)
    centres = [axes[0], axes[0] * 0.96 + axes[1] * 0.28, axes[0] * 0.6 + axes[2] * 0.8, axes[5]]
    x = np.concatenate([c + rng.standard_normal((20, 16)) * 0.001 for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[25].tolist()) for i in range(3)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, comp = brute(rows)
    assert {comp[0], comp[20], comp[40], comp[60]} == {0, 40, 60}
    assert {r.vec_id: r.n_links for r in got} == n
    assert {r.vec_id: r.component_id for r in got} == comp and {r.vec_id for r in got if r.kept} == {0, 40, 60}


def test_repeated_ids_and_magnitudes(spark):
    """Rows that share an id are vectors of their own; great and small vectors keep their links."""
    x = cloud(400, 16, 12, 18, seed=5)
    x[:3] *= [[1e200], [1e-200], [1e150]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[50].tolist()), (None, x[60].tolist())]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, _ = brute([(i, (v / np.abs(v).max()).tolist()) for i, v in enumerate(x)])
    assert len(got) == 402 and max(n.values()) > nndescent.NEIGHBOURS
    # the two rows that repeat vectors add a link to each of those vectors' neighbours
    extra = {i: int(sum(x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.95 for j in (50, 60))) for i in range(3, 400)}
    assert all(r.n_links == n[r.vec_id] + extra[r.vec_id] for r in got if r.vec_id not in (None, 0, 1, 2, 7))
    assert sorted((r.n_links, r.component_id) for r in got if r.vec_id in (None, 7)) == [(17, 0), (18, 7), (18, 54)]


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "audit", lambda *a: 0.5)
    with pytest.raises(RuntimeError):
        nndescent.near_duplicates(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<double>"))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nndescent.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(4, None), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:4] for r in nndescent.near_duplicates(one).orderBy("vec_id").collect()] == [(4, 0, 4, True), (5, 0, 5, True)]
