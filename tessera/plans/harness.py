"""The evaluation matrix: covariate sets by targets, scored out of fold from one pass of sums for each target, and its baselines."""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import folds, gram, metrics
from tessera.plans.registry import table
from tessera.scratch import written


def out_of_fold(df: DataFrame, results: list[dict], features: list[str], fold: str = "fold", out: str = "predicted") -> DataFrame:
    """``df`` with each row's prediction by the model that did not see its fold: one projection, no join. Other folds' rows have none."""
    models = {x["fold"]: x["model"] for x in results if x["fold"] != "pooled"}
    if not models:
        return df.withColumn(out, F.lit(None).cast("double"))
    top = max(models) + 1
    pick = lambda value: F.get(F.array(*[F.lit(float(value(models[f])) if f in models else None) for f in range(top)]), F.col(fold))
    e = pick(lambda m: m.intercept[0])
    for j, c in enumerate(features):
        e = e + F.col(c) * pick(lambda m, j=j: m.beta[j, 0])
    return df.withColumn(out, F.when(F.col(fold) >= 0, e))


def with_holdout(df: DataFrame, results: list[dict], features: list[str], n_training: int, fold: str = "fold", out: str = "predicted") -> DataFrame:
    """Out-of-fold predictions of training rows; hold-out rows, which no model saw, get the mean of all models' predictions."""
    models = [x["model"] for x in results if x["fold"] != "pooled"]
    mean = gram.Linear(np.mean([m.intercept for m in models], 0), np.mean([m.beta for m in models], 0))
    held = folds.in_holdout(fold, n_training)
    inside = out_of_fold(df, results, features, fold, "_inside")
    return inside.withColumn(out, F.when(held, mean.column(features)).otherwise(F.col("_inside"))).drop("_inside")


def evaluate(df: DataFrame, key: str, targets: dict[str, str], sets: dict[str, list[str]], n_training: int = 10, n_holdout: int = 2, alphas: tuple = gram.ALPHAS, extra: tuple = ()) -> DataFrame:
    """One row for each target and covariate set: R2, MAE, MSE, samples, after the naive models' rows.

    Rows that lack a needed column are dropped for that target first, as one frame for all of its sets. Folds are computed once and written; one
    pass gives the naive models, one the sums of all columns by fold (a set's model picks its own from them), one the absolute errors of all sets.
    ``extra``: also "std" (deviation of R2 over the folds) and "holdout" (R2 of the hold-out rows, which no model saw).
    """
    spark, rows = df.sparkSession, []
    for name, target in targets.items():
        needed = list(dict.fromkeys([key, *chain.from_iterable(sets.values()), target]))
        columns = [c for c in needed if c not in (key, target)] + [target]
        all_rows = written(folds.hashed_folds(df.select(*needed).dropna(), key, n_training, n_holdout, check=False), "folds")
        own = all_rows.where(folds.in_training("fold", n_training))
        naive = metrics.naive_regression(own, target).collect()
        start = own.agg(*[F.avg(c).alias(c) for c in columns]).first()
        sums = gram.cells(own, columns, key, "fold", n_training, shift=[start[c] or 0.0 for c in columns])
        pred, found = all_rows, {}
        for i, (label, features) in enumerate(sets.items()):
            at = [columns.index(c) for c in [*features, target]]
            found[label] = gram.search({k: s.pick(at) for k, s in sums.items()}, list(alphas), lambda s, a: gram.ridge(s, 1, a))
            pred = with_holdout(pred, found[label], features, n_training, out=f"_p{i}")
        y, inside = F.col(target), folds.in_training("fold", n_training)
        r2 = lambda p: 1 - F.sum(F.when(~inside, F.pow(y - p, F.lit(2.0)))) / (F.var_pop(F.when(~inside, y)) * F.count_if(~inside))
        got = pred.agg(
            *[F.avg(F.when(inside, F.abs(y - F.col(f"_p{i}")))).alias(f"m{i}") for i in range(len(sets))], *[r2(F.col(f"_p{i}")).alias(f"h{i}") for i in range(len(sets))]
        ).first()
        rows += [(name, b["model"], "", float(b["r2"]), float(b["mae"]), float(b["mse"]), int(b["n"]), None, None) for b in naive]
        for i, label in enumerate(sets):
            pooled, each = found[label][-1], [x["r2"] for x in found[label][:-1]]
            rows.append((name, "Ridge", label, float(pooled["r2"]), float(got[f"m{i}"]), float(pooled["mse"]), int(pooled["n"]), float(np.std(each)), got[f"h{i}"]))
    out = spark.createDataFrame(rows, "target string, model string, covariates string, r2 double, mae double, mse double, samples long, std double, holdout double")
    more = [F.round(c, 6).alias(n) for c, n in (("std", "std_r2"), ("holdout", "holdout_r2")) if c in extra]
    return out.select("target", "model", "covariates", F.round("r2", 6).alias("r2"), F.round("mae", 3).alias("mae"), F.round("mse", 0).alias("mse"), "samples", *more)


class Wrapped:
    """A model that carries its preparation: fitted on the prepared training rows, it predicts raw rows on the target's own scale."""

    def __init__(self, train: DataFrame, features: list[str], target: str, specs: dict, alpha: float = 1.0) -> None:
        from tessera.operators.prep import Prepared

        self.features, self.target = features, target
        self.prepared = Prepared({c: specs[c] for c in [*features, target]}, train)
        self.inputs = Prepared({c: specs[c] for c in features}, train)
        self.model = gram.ridge(gram.gram(self.prepared.apply(train), [*features, target])[None], 1, alpha)

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        got = self.inputs.apply(df).withColumn(out, self.model.column(self.features))
        return self.prepared.undo(got, {out: self.target})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested cross-validated ridge of price on quantity, discount and tax, per outer fold."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    own = folds.hashed_folds(li, "l_orderkey", check=False)
    columns = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    start = li.agg(*[F.avg(c).alias(c) for c in columns]).first()
    sums = gram.cells(own.dropna(), columns, "l_orderkey", "fold", shift=[start[c] or 0.0 for c in columns])
    res = gram.search(sums, list(gram.ALPHAS), lambda s, a: gram.ridge(s, 1, a))
    rows = [(str(x["fold"]), float(x.get("alpha", 0.0)), float(x["r2"]), float(x["mse"]), int(x["n"])) for x in res]
    return spark.createDataFrame(rows, "fold string, alpha double, r2 double, mse double, n long").select("fold", "alpha", F.round("r2", 6).alias("r2"), F.round("mse", 0).alias("mse"), "n")


def initials(columns: dict[str, list[str]]) -> tuple[str, list[str]]:
    """The aggregate set's label (first letters) and columns."""
    return "".join(k[0] for k in columns).upper(), list(dict.fromkeys(chain.from_iterable(columns.values())))


def covariate_sets(standard: dict[str, list[str]], own: dict[str, list[str]], target: str) -> dict[str, list[str]]:
    """Standard sets, own sets, the aggregate of the standard ones, and each own set added to it; the target is taken out everywhere."""
    label, agg = initials(standard)
    sets = {**standard, **own, label: agg, **{f"{label} + {k}": list(dict.fromkeys([*agg, *v])) for k, v in own.items()}}
    return {k: kept for k, v in sets.items() if (kept := [c for c in v if c != target])}


def evaluate_classes(df: DataFrame, key: str, target: str, sets: dict[str, list[str]], n_training: int = 10, n_holdout: int = 2, l2: float = 1e-4) -> DataFrame:
    """One row for each covariate set of a two-class target: accuracy, error, log-loss, samples, pooled over out-of-fold rows; first the mode class's row."""
    from tessera.operators import logistic

    spark = df.sparkSession
    needed = list(dict.fromkeys([key, *chain.from_iterable(sets.values()), target]))
    own = folds.hashed_folds(df.select(*needed).dropna(), key, n_training, n_holdout, check=False).where(folds.in_training("fold", n_training))
    base = metrics.naive_classes(own, target).first()
    pred = own
    for i, features in enumerate(sets.values()):
        pred = pred.withColumn(f"_p{i}", logistic.probability(logistic.by_fold(own, features, target, "fold", n_training, l2), features, "fold"))
    y = F.col(target)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(len(sets)):
        p = F.col(f"_p{i}")
        aggs += [metrics.accuracy(y, (p >= 0.5).cast("int")).alias(f"a{i}"), metrics.log_loss(F.when(y == 1, p).otherwise(1 - p)).alias(f"l{i}")]
    r = pred.agg(*aggs).first()
    rows = [("ModeClass", "", 1 - base["error"], base["error"], base["log_loss"], r["n"])]
    rows += [("Logistic", label, r[f"a{i}"], 1 - r[f"a{i}"], r[f"l{i}"], r["n"]) for i, label in enumerate(sets)]
    out = spark.createDataFrame(rows, "model string, covariates string, accuracy double, error double, log_loss double, samples long")
    return out.select("model", "covariates", *[F.round(c, 6).alias(c) for c in ("accuracy", "error", "log_loss")], "samples")


def significance(df: DataFrame, key: str, target: str, sets: dict[str, list[str]], aggregate: str, n_training: int = 10, iterations: int = 1000) -> DataFrame:
    """The ladder of paired bootstraps on absolute out-of-fold errors: each single set against the better naive model, the best single set against the
    aggregate, and each set that adds to the aggregate against it. One row for each comparison."""
    from tessera.operators import resample

    needed = list(dict.fromkeys([key, *chain.from_iterable(sets.values()), target]))
    own = written(folds.hashed_folds(df.select(*needed).dropna(), key, n_training, check=False).where(folds.in_training("fold", n_training)), "folds")
    naive = metrics.naive_regression(own, target).collect()
    best_naive = min(naive, key=lambda r: r["mae"])["model"]
    stats = own.agg(F.avg(target).alias("Mean"), F.percentile(target, 0.5).alias("Median")).first()
    columns = [c for c in needed if c not in (key, target)] + [target]
    sums = gram.cells(own, columns, key, "fold", n_training)
    pred, score = own.withColumn("_naive", F.abs(F.col(target) - F.lit(float(stats[best_naive])))), {}
    for i, (label, features) in enumerate(sets.items()):
        at = [columns.index(c) for c in [*features, target]]
        res = gram.search({k: s.pick(at) for k, s in sums.items()}, list(gram.ALPHAS), lambda s, a: gram.ridge(s, 1, a))
        pred = out_of_fold(pred, res, features, out=f"_p{i}").withColumn(f"_e{i}", F.abs(F.col(target) - F.col(f"_p{i}")))
        score[label] = res[-1]["mse"]
    number = {label: i for i, label in enumerate(sets)}
    single = [s for s in sets if s != aggregate and not s.startswith(f"{aggregate} + ")]
    best = min(single, key=score.get)
    steps = [(best_naive, s, "_naive", f"_e{number[s]}") for s in single]
    steps += [(best, aggregate, f"_e{number[best]}", f"_e{number[aggregate]}")]
    steps += [(aggregate, s, f"_e{number[aggregate]}", f"_e{number[s]}") for s in sets if s.startswith(f"{aggregate} + ")]
    pred = pred.withColumn("_row", F.xxhash64(key, *dict.fromkeys(chain.from_iterable(sets.values())), target))
    out = None
    for base, test, a, b in steps:
        one = resample.bootstrap(pred.select("_row", a, b), "_row", a, b, iterations).select(F.lit(base).alias("baseline"), F.lit(test).alias("test"), "stars", "better", "worse")
        out = one if out is None else out.unionByName(one)
    return out


def ordered(table_: DataFrame, standard: list[str], own: list[str], aggregate: str) -> DataFrame:
    """Rows in reading order: baselines, standard sets, own sets, the aggregate, what adds to it, the rest by name."""
    c = F.col("covariates")
    place = F.when(c == "", 0).when(c.isin(*standard), 1).when(c.isin(*own), 2).when(c == aggregate, 3).when(c.startswith(f"{aggregate} + "), 4).otherwise(5)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, [*standard, *own])), c), F.lit(0))
    return table_.orderBy(place, rank, c, "model")


def side_by_side(table_: DataFrame, targets: list[str], metrics_: list[str]) -> DataFrame:
    """One row for each model and set, with "target: metric" columns."""
    wide = table_.groupBy("model", "covariates").pivot("target", targets).agg(*[F.first(m).alias(m) for m in metrics_])
    one = len(metrics_) == 1
    return wide.select("model", "covariates", *[F.col(f"`{t}`" if one else f"`{t}_{m}`").alias(f"{t}: {m}") for t in targets for m in metrics_])


def with_prefix(table_: DataFrame, aggregate: str, keep: bool = True) -> DataFrame:
    """Rows that do (or do not) carry the aggregate's prefix, always with the baselines and the sets that have no such twin."""
    c = F.col("covariates")
    twins = table_.where(c.startswith(f"{aggregate} + ")).select(F.substring("covariates", len(aggregate) + 4, 1000).alias("_own")).distinct()
    if keep:
        return table_.join(twins, c == F.col("_own"), "left_anti")
    return table_.where(~c.startswith(f"{aggregate} + "))
