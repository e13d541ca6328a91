"""Operators on small inputs: hand-derived values, errors, and equivalence with direct computation."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import decompose, features, folds, gram, match, metrics, prep, relate, resample
from tessera.plans import harness


def test_hash_of_keys(spark):
    keys = ["a", "set_12", "é", "", "x" * 50]
    got = {r.k: r.fold for r in folds.hashed_folds(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()}
    assert got == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) % 12 for k in keys}


def test_folds_of_a_subset_stay(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    whole = {r.k: r.fold for r in folds.hashed_folds(df, "k").collect()}
    assert all(whole[r.k] == r.fold for r in folds.hashed_folds(df.where("k % 3 = 0"), "k").collect())


def test_fold_errors(spark):
    df = spark.createDataFrame([("a", '["b"]', True, False), ("b", '["a"]', False, True), ("c", None, None, None)], "k string, rel string, t boolean, h boolean")
    with pytest.raises(ValueError):
        folds.hashed_folds(df, "k", n_training=0)
    with pytest.raises(ValueError, match="both"):
        folds.hashed_folds(df, "k", keep_in_training=["t"], keep_in_holdout=["h"], keep_together=["rel"])
    with pytest.raises(ValueError, match="closed"):
        folds.hashed_folds(df.withColumn("rel", F.when(F.col("k") == "a", '["b"]')), "k", keep_together=["rel"])
    f = {r.k: r.fold for r in folds.hashed_folds(df, "k", keep_in_training=["t"], keep_together=["rel"]).collect()}
    assert f["a"] == f["b"] < 10


def test_null_labels_stay_in_training(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "l string")
    assert sorted((r.l or "", r.fold) for r in folds.labelled_folds(df, "l").collect()) == [("", -1), ("x", 0), ("y", 1)]


def test_ledger_of_filters_and_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (2.0, 2.0, 1), (None, 3.0, 1), (4.0, None, 1), (5.0, 5.0, 2)], "x double, y double, f int")
    led = {r.reason: r.lost for r in prep.filter_ledger(df, [("f1", F.col("f") > 0), ("f2", F.col("f") < 2), ("x", F.col("x").isNotNull()), ("y", F.col("y").isNotNull())]).collect()}
    assert led == {"f1": 1, "f2": 1, "x": 1, "y": 1}


def test_outliers_are_flagged(spark):
    df = spark.createDataFrame([(float(i), 1e6 if i == 99 else float(i)) for i in range(100)], "y double, x double")
    t = prep.trim_outliers(df, ["x", "y"], 6, trim=False).agg(F.sum(F.col("x_outlier").cast("int")), F.sum(F.col("y_outlier").cast("int"))).first()
    assert tuple(t) == (1, 0)


def test_salvage(spark):
    df = spark.createDataFrame([(str(i), "ab"[i % 2], f"n{i}") for i in range(99)] + [("Yay", "a", "z")], "x string, c string, junk string")
    out, done = prep.salvage(df, ["x", "c", "junk"])
    assert done == {"x": "numeric", "c": "categorical", "junk": "dropped"} and out.dropna(subset=["x"]).count() == 99


def test_specs_resolve_in_order_and_undo(spark):
    s = prep.resolve([(".*", prep.STANDARD), (["b"], prep.DROP_ONLY)], ["a", "b"])
    assert s["a"] == prep.STANDARD and s["b"] == prep.DROP_ONLY
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "a double")
    p = prep.Prepared({"a": prep.Spec(clip=0)}, df)
    assert sorted(r.a for r in p.undo(p.apply(df), {"a": "a"}).collect()) == pytest.approx([1, 2, 6])


def test_packed_round_trip(spark):
    df = spark.createDataFrame([(1, "[1.5, 2.0, 3.0]", "x"), (2, None, "y")], "k int, v string, s string")
    assert prep.packed_columns(df) == ["v"]
    rows = {r.k: (r.v_1, r.v_3) for r in prep.unpack_columns(df, ["v"]).collect()}
    assert rows == {1: (1.5, 3.0), 2: (None, None)} and prep.unpack_columns(df, ["v"], {"v": 2}).columns == ["k", "s", "v_1", "v_2"]


def test_interval_join_by_bins_equals_broadcast(spark):
    p = spark.createDataFrame([("1", i) for i in range(0, 500, 3)] + [("X", 7)], "c string, pos int")
    g = spark.createDataFrame([("1", 10, 90, "a"), ("1", 80, 300, "b"), ("X", 7, 7, "c")], "c string, s int, e int, name string")
    a = relate.interval_join(p, g, "c", "pos", "s", "e", 32)
    b = relate.interval_join(p, g, "c", "pos", "s", "e", 32, broadcast_rows=0)
    assert sorted(map(str, a.select("c", "pos", "name").collect())) == sorted(map(str, b.select("c", "pos", "name").collect())) and a.count() > 80


def test_ridge_and_ols_equal_direct_fits(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 3)) + [5, -100, 0]
    y = x @ [1.0, 2.0, -3.0] + 7 + rng.standard_normal(300)
    df = spark.createDataFrame([(*map(float, r), float(v), i % 5) for i, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, fold int")
    s = gram.gram(df, ["a", "b", "c", "y"], "fold")
    train = gram._total([v for k, v in s.items() if k != 2])
    keep = np.arange(300) % 5 != 2
    m = gram.ridge(train, 1, 3.0)
    xc, yc = x[keep] - x[keep].mean(0), y[keep] - y[keep].mean()
    beta = np.linalg.solve(xc.T @ xc + 3 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.beta[:, 0], beta) and np.isclose(m.intercept[0], y[keep].mean() - x[keep].mean(0) @ beta)
    assert np.allclose(gram.dual_ridge(x[keep], y[keep, None], 3.0).beta[:, 0], beta)
    e = y[~keep] - m.intercept[0] - x[~keep] @ beta
    assert np.isclose(gram.sse(s[2], m)[0], e @ e)
    f, design = gram.ols(gram._total(list(s.values()))), np.c_[np.ones(300), x]
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    res = y - design @ b
    cov = np.linalg.inv(design.T @ design) * (res @ res) / 296
    assert np.allclose(f["beta"], b) and np.allclose(f["se"], np.sqrt(np.diag(cov)))
    full, part = gram._total(list(s.values())), np.c_[np.ones(300), x[:, 0]]
    rss0 = np.linalg.lstsq(part, y, rcond=None)[1][0]
    assert np.isclose(gram.f_test(f, [1, 2])[0], (rss0 - res @ res) / 2 / ((res @ res) / 296))
    assert np.isclose(gram.lr_test(full, [1, 2])[0], 300 * np.log(rss0 / (res @ res)))


def test_special_functions():
    assert special.t_sf(2.0, 10) == pytest.approx(0.036694017385, abs=1e-10)
    assert special.f_sf(3.0, 2, 20) == pytest.approx(0.07253815, abs=1e-7)
    assert special.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(0.5, 3) == pytest.approx(math.erfc(0.5) + math.exp(-0.25) * math.sqrt(1 / math.pi), abs=1e-9)
    assert special.hypergeom_cdf(0, 99, 5, 9) == pytest.approx(math.comb(94, 9) / math.comb(99, 9))
    assert special.binom_cdf(1, 3, 0.5) == pytest.approx(0.5)
    assert special.gwas_power(0.0, 0.3, 1000) == pytest.approx(5e-8, rel=1e-6)
    assert special.beta_pdf(0.5, 2, 2) == pytest.approx(1.5)


def test_matchings():
    rng = np.random.default_rng(1)
    for n, m in ((3, 3), (4, 5), (5, 4)):
        for _ in range(20):
            g = rng.standard_normal((n, m))
            got = match.hungarian(g)
            rows = range(n)
            best = max(sum(g[i, p[i]] for i in rows) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(g[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
            assert sum(g[i, j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best)
            k = match.greedy(g)
            assert len({j for j in k if j >= 0}) == min(n, m)


def test_residual_pairs(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0), (1, 2.0, 5.0)], "k int, x double, y double")
    got = {(r.source, r.target): (r.x, r.y) for r in match.residuals(df, df, "k", ["x", "y"]).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (1, 2), (1, 0): (1, 2), (1, 1): (0, 0)}
    three = spark.createDataFrame([(i, float(i), 0.0) for i in range(3)], "k int, x double, y double")
    assert match.residuals(three, three, "k", ["x"]).count() == 9 and match.residuals(three, three, "k", ["x"], max_pairs=6).count() == 6


def test_matching_controls(spark):
    rng = np.random.default_rng(3)
    def accuracy(noise):
        v = rng.standard_normal((200, 30))
        w = v + noise * rng.standard_normal(v.shape)
        df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(v, w, strict=True))], "k long, a array<double>, b array<double>")
        p = match.similarity(match.pairs_in(match.lineups(df, "k", 20, 10), df, "k", "a", "b"))
        return match.match_accuracy(match.one_to_one(p)).first()[0]

    assert accuracy(0.3) > 0.9 and accuracy(50.0) < 0.3


def test_bootstrap_signs(spark):
    df = spark.range(500).select("id", (F.lit(1.0) + F.rand(1)).alias("base"), F.rand(2).alias("test"))
    b = resample.bootstrap(df, "id", "base", "test", 200).first()
    assert (b.stars, b.better) == ("**", 1.0)
    w = resample.bootstrap(df, "id", "test", "base", 200).first()
    assert (w.stars, w.worse) == ("!!", 1.0)
    same = resample.bootstrap(df.withColumn("test", F.col("base") + F.when(F.col("id") % 2 == 0, 0.1).otherwise(-0.1)), "id", "base", "test", 400).first()
    assert same.stars == "" and 0.3 < same.better < 0.7
    assert resample.bootstrap(df.repartition(7), "id", "base", "test", 200).first() == b


def test_select_at_n_with_ties(spark):
    pairs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, 0.5)], "source int, target int, distance double")
    k = metrics.match_ranks(pairs, "source", "target", "distance").first()
    assert (k["rank"], k.rank_min, k.rank_max, k.n_all) == (2, 2, 3, 3)


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 4)) @ np.diag([3, 2, 1, 0.5])
    df = spark.createDataFrame([(*map(float, r),) for r in x], "a double, b double, c double, d double")
    c = decompose.pca(df, list("abcd"), 3)
    assert np.allclose(c.variances, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:3]) and c.enough(0.5) == 1
    p = c.project(df, whiten=True).agg(F.var_pop("pc1"), F.covar_pop("pc1", "pc2")).first()
    assert p[0] == pytest.approx(1) and p[1] == pytest.approx(0, abs=1e-9)


def test_mrmr_prefers_unlike_columns(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 8, 600)
    rows = [(int(v), int(v % 4), int(v % 4), int(v // 4), int(rng.integers(0, 4))) for v in y]
    df = spark.createDataFrame(rows, "y int, a int, copy int, b int, noise int")
    assert features.mrmr(df, ["a", "copy", "b", "noise"], "y", 2, how="MID") == ["a", "b"]


def test_small_learners():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 3, 2))
    p = np.exp(x @ [1.0, -2.0])
    y = np.array([rng.choice(3, p=q / q.sum()) for q in p])
    assert np.allclose(decompose.maxent(x, y), [1, -2], atol=0.4)
    z = rng.standard_normal((300, 5))
    b = decompose.group_lasso(z, z[:, [0]] @ np.array([[2.0, -1.0]]) + 0.1 * rng.standard_normal((300, 2)), 0.2)
    assert (np.abs(b[1:]) < 1e-9).all() and (np.abs(b[0]) > 0.5).all()
    g = rng.standard_normal((150, 400))
    k = g @ g.T / 400
    u = g @ rng.standard_normal(400) / 20
    out = decompose.mixed_model(u + 0.1 * rng.standard_normal(150), np.ones((150, 1)), k)
    assert out["h2"] > 0.8
    s, v, noise = decompose.kernel_pca(k, 3)
    assert s.shape == (150, 3) and (np.diff(v) <= 0).all() and noise < v[-1]


def test_covariate_sets():
    s = harness.covariate_sets({"Age": ["age"], "Gender": ["gender"]}, {"face": ["pc1", "y"]}, "y")
    assert s == {"Age": ["age"], "Gender": ["gender"], "face": ["pc1"], "AG": ["age", "gender"], "AG + face": ["age", "gender", "pc1"]}


def test_quantile_of_new_values(spark):
    train = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 5)], "x double")
    new = spark.createDataFrame([(0, 0.0), (1, 2.0), (2, 3.0), (3, 9.0), (4, None)], "i int, x double")
    from statistics import NormalDist

    z = NormalDist().inv_cdf
    got = {r.i: r.z for r in prep.quantile_apply(new, train, "x", "z").collect()}
    assert got == pytest.approx({0: z(0.125), 1: z(0.5), 2: z(0.875), 3: z(0.875), 4: 0.0})
    with pytest.raises(ValueError):
        resample.bootstrap(new, "i", "x", "x", 0)


def test_logistic_by_fold_and_harness(spark):
    from tessera.operators import logistic

    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 2)) * [1, 5] + [0, 100]
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - 0.3 * (x[:, 1] - 100))))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(v), i % 3) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, y int, fold int")
    w = logistic.by_fold(df, ["a", "b"], "y", "fold", 3, l2=0.0, steps=25)
    keep = np.arange(600) % 3 != 1
    z, beta = np.c_[np.ones(keep.sum()), x[keep]], w[1]
    p = 1 / (1 + np.exp(-z @ beta))
    assert np.abs(z.T @ (y[keep] - p)).max() < 1e-3
    h = {(r.model, r.covariates): r for r in harness.evaluate_classes(df, "k", "y", {"A": ["a"], "AB": ["a", "b"]}).collect()}
    assert h["Logistic", "AB"].log_loss < h["Logistic", "A"].log_loss < h["ModeClass", ""].log_loss


def test_identification_and_knn(spark):
    from tessera.plans import identify

    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 4))
    t = x @ rng.standard_normal((4, 3)) + 0.01 * rng.standard_normal((300, 3))
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, t, strict=True))], "k long, a double, b double, c double, d double, x double, y double, z double")
    k, facts = identify.run(df, "k", list("abcd"), list("xyz"), 0.8)
    assert k.count() == 60 and facts["precision"] > 95 and facts["test"] == 60
    small = identify.ranks(identify.predicted(df.where("k >= 240"), identify.fit(df.where("k < 240"), list("abcd"), list("xyz")), list("abcd"), 3), "k", "predicted", list("xyz"), block=13)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, k.collect()))
    v = spark.createDataFrame([(i, a.tolist(), float(b[0])) for i, (a, b) in enumerate(zip(x, t, strict=True))], "k long, v array<double>, y double")
    got = {r.k: r.predicted for r in match.knn(v.where("k >= 20"), v.where("k < 20"), "k", "v", "y", 3, block=50).collect()}
    for i in range(20):
        near = np.argsort(((x[20:] - x[i]) ** 2).sum(1))[:3]
        assert got[i] == pytest.approx(t[20:, 0][near].mean())
    assert len(identify.sweep({"a": ["x"], "b": ["y"]}, [1, 2, 3], ["v1"])) == 6


def test_panel_and_tables(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((80, 3))
    df = spark.createDataFrame([(i, *map(float, r), *map(float, r + 0.01)) for i, r in enumerate(x)], "k long, a double, b double, c double, d double, e double, f double")
    got = {(r["columns"], r.metric, r.method): r.accuracy for r in match.panel(df, "k", {"all": (list("abc"), list("def"))}, ["Euclidean"], 5, 6).collect()}
    assert set(got.values()) == {1.0} and len(got) == 3
    t = spark.createDataFrame([("y", "Ridge", c, float(i)) for i, c in enumerate(["z", "AG + face", "AG", "face", "Age", ""])], "target string, model string, covariates string, r2 double")
    assert [r.covariates for r in harness.ordered(t, ["Age"], ["face"], "AG").collect()] == ["", "Age", "face", "AG", "AG + face", "z"]
    assert {r.covariates for r in harness.with_prefix(t, "AG").collect()} == {"", "Age", "AG", "AG + face", "z"}
    assert harness.side_by_side(t, ["y"], ["r2"]).columns == ["model", "covariates", "y: r2"]
    n = spark.createDataFrame([(1, 2.0, False), (2, 4.0, False), (3, None, True)], "k int, distance double, empty boolean")
    assert {r.k: r.distance for r in match.null_rows_mean(n, F.col("empty")).collect()}[3] == 3.0
