"""Identification runs: predict a vector from covariates, then find each subject among all by its prediction."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import folds, gram, metrics


def fit(train: DataFrame, features: list[str], targets: list[str], alphas: tuple = gram.ALPHAS, inner: int = 5) -> gram.Linear:
    """Ridge with many targets from one pass; the penalty that is best over inner hash folds, summed over the targets in units of their variance."""
    d = train.withColumn("_inner", F.pmod(F.xxhash64(*features, *targets), F.lit(inner)))
    cells = gram.gram(d, [*features, *targets], "_inner")
    k, total = len(targets), gram._total(list(cells.values()))
    scale = np.maximum(gram.sst(total, k), 1e-300)
    def loss(a: float) -> float:
        return sum(float((gram.sse(s, gram.ridge(total - s, k, a), k) / scale).sum()) for s in cells.values() if total.n > s.n + 1)

    return gram.ridge(total, k, min(alphas, key=loss))


def predicted(df: DataFrame, model: gram.Linear, features: list[str], n_targets: int, out: str = "predicted") -> DataFrame:
    return df.withColumn(out, F.array(*[model.column(features, t) for t in range(n_targets)]))


def ranks(test: DataFrame, key: str, predicted_col: str, true: list[str], block: int = 512) -> DataFrame:
    """Per subject the rank of its own vector by cosine distance to its prediction, among all test subjects.

    Predictions are dealt into blocks and true vectors meet each block in one matrix product; only counts of nearer vectors leave a task. The test
    set is the query set here, so the work is its square by definition, but no pair is written out.
    """
    rows = test.select(F.col(key).cast("long").alias("id"), predicted_col, F.array(*[F.col(c).cast("double") for c in true]).alias("t"))
    n = max(1, -(-rows.count() // block))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"), F.lit(0).alias("side"), "id", F.col(predicted_col).alias("p"), "t")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("a"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"), F.lit(1).alias("side"), "id", F.col("t").alias("p"), "t")

    def meet(_, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        get = lambda t, c: np.array(t.column(c).to_pylist(), float).reshape(len(t), -1)
        l, r = (table.filter(pc.equal(table.column("side"), s)) for s in (0, 1))
        if not len(l) or not len(r):
            return pa.table({"id": pa.array([], pa.int64()), "nearer": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        p, own, all_ = unit(get(l, "p")), unit(get(l, "t")), unit(get(r, "p"))
        d, mine = 1 - p @ all_.T, 1 - (p * own).sum(1)
        other = l.column("id").to_numpy()[:, None] != r.column("id").to_numpy()[None, :]
        return pa.table({"id": l.column("id"), "nearer": pa.array(((d < mine[:, None] - 1e-12) & other).sum(1)), "n": pa.array(other.sum(1))})

    both = left.withColumn("a", F.col("a").cast("int")).unionByName(right)
    found = both.groupBy("a", "b").applyInArrow(meet, "id long, nearer long, n long")
    return found.groupBy("id").agg((F.sum("nearer") + 1).alias("rank"), (F.sum("n") + 1).alias("n_all"))


def run(df: DataFrame, key: str, features: list[str], targets: list[str], ratio: float = 0.93, **split) -> tuple[DataFrame, dict]:
    """Split, fit, predict, rank; the ranks and the run's facts (precision, top-5 share, mean reciprocal rank, errors)."""
    d = folds.train_test(df.dropna(subset=[*features, *targets]), key, ratio, **split)
    model = fit(d.where(~F.col("is_test")), features, targets)
    test = predicted(d.where("is_test"), model, features, len(targets))
    k = ranks(test, key, "predicted", targets)
    s = k.agg(F.avg(100 - F.col("rank") / F.col("n_all") * 100).alias("precision"), F.avg((F.col("rank") <= 5).cast("double") * 100).alias("top5"), F.avg(1 / F.col("rank")).alias("reciprocal_rank"), F.count(F.lit(1)).alias("test")).first().asDict()
    e = test.agg(*[metrics.mae(F.col(t), F.col("predicted")[i]).alias(t) for i, t in enumerate(targets)]).first().asDict()
    return k, s | {"mae": e}


def sweep(covariates: dict[str, list[str]], sizes: list[int], versions: list[str]) -> list[dict]:
    """All combinations of covariate sets, sample sizes and versions, as settings of runs."""
    return [{"covariates": c, "features": f, "size": n, "version": v} for (c, f), n, v in itertools.product(covariates.items(), sizes, versions)]
