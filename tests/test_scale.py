"""Answers that must not depend on the table's size or its partitions, against direct computations."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import columns
from tessera.operators import folds, gram, relate, resample
from tessera.plans import cohort_queries, harness
from tessera.plans.registry import ORACLES
from tests.oracle import differ


@pytest.mark.parametrize("parts", [3, 16])
def test_next_value_of_a_large_table(spark, parts):
    rng = np.random.default_rng(parts)
    values, ref = np.round(rng.normal(0, 1000, 200_000), 2), np.unique(np.round(rng.normal(0, 700, 3_000), 2))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None)], "id long, v double")
        got = {r.id: r.n for r in relate.next_value(df, spark.createDataFrame([(float(v),) for v in ref] + [(None,)], "v double"), "v", "n").collect()}
        total = {r.id: (r.before, r.total) for r in relate.running_total(df.where("id < 50000 and id >= 0").withColumn("one", F.lit(1)), "v", "one", "before", "total").collect()}
        place = {r.id: r.position for r in folds.positions(df.where("id >= 0"), "v", "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    at = np.searchsorted(ref, values, "left")
    assert got[-1] is None and all(got[i] == (ref[k] if k < len(ref) else None) for i, k in enumerate(at.tolist()))
    assert [place[i] for i in np.lexsort((np.arange(len(values)), values)).tolist()] == list(range(len(values)))
    few = values[:50_000]
    assert {t for _, t in total.values()} == {50_000} and sorted(b for b, _ in total.values()) == list(range(50_000))
    assert all(abs(few[i] - np.sort(few)[total[i][0]]) < 1e-9 for i in range(0, 50_000, 997))


def test_next_value_by_group(spark):
    rng = np.random.default_rng(4)
    g, v = rng.integers(0, 7, 5000), np.round(rng.normal(0, 10, 5000), 1)
    rg, rv = rng.integers(0, 6, 300), np.round(rng.normal(0, 8, 300), 1)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(g, v, strict=True))], "id long, g int, v double")
    ref = spark.createDataFrame([(int(a), float(b)) for a, b in zip(rg, rv, strict=True)], "g int, v double")
    got = {r.id: r.n for r in relate.next_value(df, ref, "v", "n", ["g"]).collect()}
    assert all(got[i] == min((float(x) for x in rv[rg == g[i]] if x >= v[i]), default=None) for i in range(5000))


def test_ridge_without_intercept(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 1, (500, 2))
    y = 10 + x @ [1.0, 2.0] + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    m = gram.ridge(gram.gram(df, ["a", "b", "y"])[None], 1, 2.5, intercept=False)
    assert np.allclose(m.beta[:, 0], np.linalg.solve(x.T @ x + 2.5 * np.eye(2), x.T @ y), atol=1e-8) and m.intercept[0] == 0


def _md5_fold(key, n):
    return int(hashlib.md5(str(key).encode()).hexdigest(), 16) % n


def test_harness_equals_numpy(spark):
    """R2, MAE, MSE of out-of-fold and hold-out rows by direct ridge fits on the same folds."""
    rng = np.random.default_rng(9)
    n = 1500
    x = rng.normal(0, 1, (n, 3))
    y = 5 + x @ [1.0, -2.0, 0.5] + rng.normal(0, 1, n)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)] + [(n, None, 1.0, 1.0, 1.0)], "k long, a double, b double, c double, y double")
    sets = {"A": ["a"], "BC": ["b", "c"], "ALL": ["a", "b", "c"]}
    got = {r.covariates: r for r in harness.evaluate(df, "k", {"t": "y"}, sets, extra=("std", "holdout")).collect() if r.covariates}
    fold = np.array([_md5_fold(i, 12) for i in range(n)])
    inner = {r.id: r.i for r in spark.range(n).select("id", F.pmod(F.xxhash64("id", F.lit("inner")), F.lit(5)).alias("i")).collect()}
    inner = np.array([inner[i] for i in range(n)])

    def fit(rows, cols, alpha):
        m, my = x[rows][:, cols].mean(0), y[rows].mean()
        z = x[rows][:, cols] - m
        b = np.linalg.solve(z.T @ z + alpha * np.eye(len(cols)), z.T @ (y[rows] - my))
        return lambda q: my + (x[q][:, cols] - m) @ b

    inside, pos = fold < 10, {"a": 0, "b": 1, "c": 2}
    for label, names in sets.items():
        cols, pred, held, r2s = [pos[c] for c in names], np.zeros(n), [], []
        for f in range(10):
            train = inside & (fold != f)
            score = [sum(((y[q] - fit(train & (inner != i), cols, a)(q)) ** 2).sum() for i in range(5) for q in [train & (inner == i)]) for a in gram.ALPHAS]
            model = fit(train, cols, gram.ALPHAS[int(np.argmin(score))])
            own = fold == f
            pred[own] = model(own)
            r2s.append(1 - ((y[own] - pred[own]) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum())
            held.append(model(~inside))
        e, h = y[inside] - pred[inside], y[~inside] - np.mean(held, 0)
        r = got[label]
        assert r.samples == inside.sum() and abs(r.mae - np.abs(e).mean()) < 1e-3 and abs(r.r2 - (1 - (e**2).sum() / ((y[inside] - y[inside].mean()) ** 2).sum())) < 1e-5
        assert abs(r.std_r2 - np.std(r2s)) < 1e-5 and abs(r.holdout_r2 - (1 - (h**2).sum() / ((y[~inside] - y[~inside].mean()) ** 2).sum())) < 1e-5


def test_bootstrap_shares_equal_the_normal_limit(spark):
    """Shares of resamples above 0 against the normal law of the sum."""
    from math import erf, sqrt

    rng = np.random.default_rng(3)
    for shift in (0.0, 0.03, -0.05):
        g = rng.normal(shift, 1, 3000)
        df = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(g)], "k long, a double, b double")
        r = resample.bootstrap(df, "k", "a", "b", 2000).first()
        z = g.sum() / sqrt((g**2).sum())
        assert abs(r.better - 0.5 * (1 + erf(z / sqrt(2)))) < 0.05 and abs(r.better + r.worse - 1) < 1e-9


def test_sex_by_copy_numbers(spark):
    cases = {(2.0, 0.0): "Female", (1.0, 1.0): "Male", (2.0, 1.0): "", (1.0, 0.0): "", (1.0, 2.0): "", (3.0, 0.0): "", (None, 1.0): ""}
    df = spark.createDataFrame([(*k,) for k in cases], "x double, y double")
    rows = df.select("x", "y", *[c.alias(n) for n, c in columns.sex_qc(F.col("x"), F.col("y")).items()]).collect()
    assert {(r.x, r.y): r.sex for r in rows} == cases
    assert [r.outlier for r in rows] == [False, False, True, True, True, True, None] and [r.contaminated for r in rows][:6] == [False, False, True, False, False, False]


def test_shared_folder_keeps_its_file_system(spark):
    """A plain path belongs to the session's default file system, an address to its own."""
    assert scratch.folder(spark).startswith("file:/")
    p, _ = scratch._path(spark, "/checkpoints/x")
    assert p.toString().endswith(":/checkpoints/x")
    assert scratch._path(spark, "file:///tmp/y")[0].toString() == "file:/tmp/y"


def _together_by_sets(rows):
    fam = [(k, {k, *(r or [])}) for k, r in rows]
    return sorted((k, r) for k, f in fam for r in f for o, g in fam if r == o != k and f != g)


def test_families_that_differ_are_found_from_both_forms_of_lists(spark):
    """Own lists and shared lists, with rows that their list leaves out, against all pairs of sets."""
    lists = {1: ["a", "b", "c"], 2: ["d", "e"], 3: ["d", "e", "f"], 4: ["g", "zz"], 5: None}
    keys = [("a", 1), ("b", 1), ("c", 1), ("d", 2), ("f", 2), ("e", 3), ("g", 4), ("h", 4), ("i", 5), ("a", 1)]
    shared = spark.createDataFrame(list(lists.items()), "g int, rel array<string>")
    rows = spark.createDataFrame(keys, "k string, g int")
    want = _together_by_sets([(k, lists[g]) for k, g in keys])
    assert want and not any("a" in p for p in want)
    for found in (folds.check_together(rows, "k", ["rel"], shared, "g"), folds.check_together(rows.join(shared, "g"), "k", ["rel"])):
        assert sorted(map(tuple, found.collect())) == want


@pytest.fixture(scope="module")
def large_families(tmp_path_factory):
    """25 families of 400: lists in each row met all of their members' lists, 4 million pairs of lists of 400."""
    top = str(tmp_path_factory.mktemp("families"))
    duckdb.sql(f"copy (select (i + 1)::bigint as s_suppkey, (i % 25)::int as s_nationkey from range(10000) t(i)) to '{top}/supplier.parquet' (format parquet)")
    return top


def _rows_between(df):
    """The most rows that one operator of the executed plan puts out."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        plans += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else []
        plans += [p.children().apply(i) for i in range(p.children().size())]
        m = p.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
    return most


def test_violations_in_large_families_need_no_pairs(spark, large_families):
    found = cohort_queries.folds_together_violations(spark, large_families)
    assert _rows_between(found) <= 20_000 and found.isEmpty()


def connect_supplier(folder):
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{folder}/supplier.parquet'")
    return con


def test_masked_folds_check_large_families_without_pairs(spark, large_families, monkeypatch):
    made, check = [], folds.check_together
    monkeypatch.setattr(folds, "check_together", lambda *a: made.append(check(*a)) or made[-1])
    got = cohort_queries.folds_family_training_mask(spark, large_families)
    assert len(made) == 1 and _rows_between(made[0]) <= 20_000
    con = connect_supplier(large_families)
    assert differ(got, con, ORACLES["folds_family_training_mask"]) is None


def test_kept_folds_check_large_families_without_pairs(spark, large_families, monkeypatch):
    made, check = [], folds.check_together
    monkeypatch.setattr(folds, "check_together", lambda *a: made.append(check(*a)) or made[-1])
    got = cohort_queries.folds_keep_together(spark, large_families)
    assert len(made) == 1 and _rows_between(made[0]) <= 20_000
    con = connect_supplier(large_families)
    assert differ(got, con, ORACLES["folds_keep_together"]) is None
