"""Metrics as aggregations: pooled regression and class scores, naive baselines, rankings, confusion tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import select_at_n


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST over rows where both are there."""
    ok = y.isNotNull() & p.isNotNull()
    yy, e = F.when(ok, y), F.when(ok, y - p)
    return 1 - F.sum(e * e) / (F.var_pop(yy) * F.count(yy))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def log_loss(p_true: Column, total: Column | float = 1.0, eps: float = 1e-15) -> Column:
    """Mean of -ln of the true class's probability, clipped and divided by its row's total."""
    total = F.lit(total) if isinstance(total, float) else total
    return -F.avg(F.ln(F.least(F.greatest(p_true / total, F.lit(eps)), F.lit(1 - eps))))


def regression(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    yc, pc = F.col(y), F.col(p)
    return df.groupBy(*by).agg(r2(yc, pc).alias("r2"), mae(yc, pc).alias("mae"), mse(yc, pc).alias("mse"), F.count(F.when(yc.isNotNull() & pc.isNotNull(), 1)).alias("n"))


def robust_r2(df: DataFrame, y: str, p: str, k: float = 4) -> DataFrame:
    """R2 without the rows whose residual lies beyond the outlier limits."""
    from tessera.operators.prep import outlier_limits

    res = df.withColumn("_res", F.col(y) - F.col(p))
    lim = F.broadcast(outlier_limits(res, ["_res"], k))  # one row
    return res.crossJoin(lim).where(F.col("_res").between(F.col("_res_low"), F.col("_res_high"))).agg(r2(F.col(y), F.col(p)).alias("r2"), F.count(F.lit(1)).alias("n"))


def naive_regression(df: DataFrame, y: str) -> DataFrame:
    """Mean and median models scored on their own data."""
    base = df.where(F.col(y).isNotNull())
    stats = F.broadcast(base.agg(F.avg(y).alias("mean"), F.percentile(y, 0.5).alias("median")))  # one row
    long = base.crossJoin(stats).select(F.col(y).alias("_y"), F.inline(F.array(F.struct(F.lit("Mean").alias("model"), F.col("mean").alias("_p")), F.struct(F.lit("Median").alias("model"), F.col("median").alias("_p")))))
    return regression(long, "_y", "_p", ["model"])


def naive_classes(df: DataFrame, label: str) -> DataFrame:
    """The mode model from class counts alone: class, support, error, and the log-loss of answering with class shares."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).count()
    n = F.sum("count").over(Window.partitionBy())
    s = c.select(F.col(label).alias("class"), F.col("count").alias("support"), (F.col("count") / n).alias("f"))
    return s.agg(F.max_by("class", F.struct("support", F.struct(F.lit(0)))).alias("_any"), F.min_by("class", F.struct((-F.col("support")).alias("s"), "class")).alias("mode_class"), F.max("support").alias("support"), (1 - F.max("f")).alias("error"), (-F.sum(F.col("f") * F.ln("f"))).alias("log_loss")).drop("_any")


def naive_ordinal(df: DataFrame, code: Column) -> DataFrame:
    """Mode, mean and median class of an ordinal: error, MAE and MSE on the codes. Means and medians are rounded half to even."""
    base = df.select(code.alias("y")).where("y is not null")
    one = F.broadcast(base.agg(F.mode("y", True).alias("m"), F.bround(F.avg("y")).alias("a"), F.bround(F.percentile("y", 0.5)).alias("d")))  # one row
    parts = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("p")) for n, c in (("ModeClass", "m"), ("MeanClass", "a"), ("MedianClass", "d"))])
    long = base.crossJoin(one).select("y", F.inline(parts))
    return long.groupBy("model").agg((1 - accuracy(F.col("y").cast("double"), F.col("p"))).alias("error"), mae(F.col("y"), F.col("p")).alias("mae"), mse(F.col("y"), F.col("p")).alias("mse"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Counts of (true, predicted) and their share of the true class."""
    c = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1, support and its share of each label, from the confusion counts."""
    c = confusion(df, y, p)
    both = c.select(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    both = both.unionByName(c.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hit")))
    s = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("_p"), F.sum("hit").alias("_h"))
    pr, rc = F.when(F.col("_p") > 0, F.col("_h") / F.col("_p")).otherwise(0.0), F.when(F.col("support") > 0, F.col("_h") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("_h") > 0, 2 * F.col("_h") / (F.col("_p") + F.col("support"))).otherwise(0.0)
    return s.select("label", pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), "support", (F.col("support") / F.sum("support").over(Window.partitionBy())).alias("fraction"))


def match_ranks(pairs: DataFrame, group: str, candidate: str, distance: str) -> DataFrame:
    """Per group the true candidate's (same id) ordinal rank, least and greatest tied rank, and the group's size.

    Only counts of nearer and tied candidates are needed, so nothing is sorted: the true distance is joined back by group.
    """
    true = pairs.where(F.col(group) == F.col(candidate)).select(F.col(group).alias("_g"), F.col(distance).alias("_d"))
    j = pairs.join(true, F.col(group) == F.col("_g"))
    nearer, tied = F.col(distance) < F.col("_d"), F.col(distance) == F.col("_d")
    before = tied & (F.col(candidate) < F.col(group))
    return j.groupBy(group).agg((F.count_if(nearer | before) + 1).alias("rank"), (F.count_if(nearer) + 1).alias("rank_min"), F.count_if(nearer | tied).alias("rank_max"), F.count(F.lit(1)).alias("n_all"))


def selection(ranks: DataFrame, n: int = 10, top: int = 5) -> DataFrame:
    """select@n (plain, and averaged over tied ranks), identification precision, top-k share, mean reciprocal rank."""
    tied = F.aggregate(F.sequence("rank_min", "rank_max"), F.lit(0.0), lambda s, r: s + select_at_n(r, F.col("n_all"), n)) / (F.col("rank_max") - F.col("rank_min") + 1)
    return ranks.agg(
        F.avg(select_at_n(F.col("rank"), F.col("n_all"), n)).alias("select_at_n"),
        F.avg(tied).alias("select_at_n_ties"),
        F.avg(100 - F.col("rank") / F.col("n_all") * 100).alias("precision"),
        F.avg((F.col("rank") <= top).cast("double")).alias("top_share"),
        F.avg(1 / F.col("rank")).alias("reciprocal_rank"),
    )


def by_component(df: DataFrame, y: list[str], p: list[str]) -> DataFrame:
    """(component, r2, mae, mse, n) of each of several outputs, 0-based, from one pass over rows turned into components; and "weighted", whose R2 weighs components by their variance."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(str(i)).alias("component"), F.col(a).cast("double").alias("_y"), F.col(b).cast("double").alias("_p")) for i, (a, b) in enumerate(zip(y, p, strict=True))])))
    ok = F.col("_y").isNotNull() & F.col("_p").isNotNull()
    one = long.where(ok).groupBy("component").agg(F.sum((F.col("_y") - F.col("_p")) ** 2).alias("sse"), F.sum(F.abs(F.col("_y") - F.col("_p"))).alias("sae"), (F.var_pop("_y") * F.count("_y")).alias("sst"), F.count("_y").alias("n"))
    parts = one.unionByName(one.agg(F.lit("weighted").alias("component"), *[F.sum(c).alias(c) for c in ("sse", "sae", "sst", "n")]))  # one row for each component
    return parts.select("component", (1 - F.col("sse") / F.col("sst")).alias("r2"), (F.col("sae") / F.col("n")).alias("mae"), (F.col("sse") / F.col("n")).alias("mse"), "n")


def hybrid_score(y: Column, label: Column, probability: Column | None = None) -> Column:
    """Minus the log-loss where there are probabilities (of label 1), else the accuracy; greater is better."""
    if probability is None:
        return accuracy(y, label)
    return -log_loss(F.when(y == 1, probability).otherwise(1 - probability))


def weighted_log_loss(df: DataFrame, p_true: str, fold: str) -> DataFrame:
    """(log_loss, n): the folds' log-losses weighed by their sizes."""
    each = df.groupBy(fold).agg(log_loss(F.col(p_true)).alias("_l"), F.count(F.lit(1)).alias("_n"))
    return each.agg((F.sum(F.col("_l") * F.col("_n")) / F.sum("_n")).alias("log_loss"), F.sum("_n").alias("n"))
