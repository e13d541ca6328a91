"""Feature selection by mutual information, and genotype operators on long tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discretised(x: Column, mean: Column, std: Column, t: float = 1.0) -> Column:
    """Three levels by z-score."""
    z = (x - mean) / std
    return F.when(z > t, 1).when(z < -t, -1).otherwise(0)


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Bits that two discrete columns share, from their joint counts."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).count()
    every = Window.partitionBy()
    p = F.col("count") / F.sum("count").over(every)
    pa, pb = F.sum("count").over(Window.partitionBy("a")) / F.sum("count").over(every), F.sum("count").over(Window.partitionBy("b")) / F.sum("count").over(every)
    return c.select(p.alias("p"), (pa * pb).alias("q")).agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("bits"))


def information_table(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Mutual information of all pairs of columns, in one job: rows become (pair, value, value) counts, added before the shuffle."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(columns[i]).cast("string").alias("a"), F.col(columns[j]).cast("string").alias("b")) for i, j in pairs])
    c = df.select(F.inline(cells)).groupBy("i", "j", "a", "b").count()
    pair = Window.partitionBy("i", "j")
    n = F.sum("count").over(pair)
    pa, pb = F.sum("count").over(Window.partitionBy("i", "j", "a")) / n, F.sum("count").over(Window.partitionBy("i", "j", "b")) / n
    rows = c.select("i", "j", (F.col("count") / n).alias("p"), (pa * pb).alias("q")).groupBy("i", "j").agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("bits")).collect()
    return {(columns[r["i"]], columns[r["j"]]): r["bits"] for r in rows}


def mrmr(df: DataFrame, features: list[str], target: str, n: int, core: list[str] = (), how: str = "MIQ") -> list[str]:
    """Greedy choice of n columns: relevance to the target against mean redundancy with what is chosen (quotient MIQ or difference MID).

    The pool is the 500 + n most relevant columns. Ties go to the earlier column.
    """
    info = information_table(df, [*features, target])
    get = lambda x, y: info.get((x, y), info.get((y, x), 0.0))
    rel = {f: get(f, target) for f in features}
    pool = sorted(features, key=lambda f: -rel[f])[: 500 + n]
    chosen = [c for c in core if c in features]
    while len(chosen) < n and (left := [f for f in pool if f not in chosen]):
        red = {f: np.mean([get(f, c) for c in chosen]) if chosen else 0.0 for f in left}
        score = (lambda f: rel[f] / (red[f] + 1e-4)) if how == "MIQ" and chosen else (lambda f: rel[f] - red[f])
        chosen.append(max(left, key=score))
    return chosen


# -- genotypes: long tables (sample, variant, dosage) -----------------------------------
def allele_counts(g: DataFrame) -> DataFrame:
    """How often each variant has 0, 1, 2 or no dosage."""
    d = F.col("dosage")
    return g.groupBy("variant").agg(*[F.count_if(d == k).alias(f"n{k}") for k in (0, 1, 2)], F.count_if(d.isNull() | (d < 0)).alias("missing"))


def maf_filter(g: DataFrame, least: float) -> DataFrame:
    """Variants whose mean dosage (missing as the mean) is above ``least``, with it."""
    d = F.when(F.col("dosage") >= 0, F.col("dosage"))
    return g.groupBy("variant").agg(F.avg(d).alias("mean_dosage")).where(F.col("mean_dosage") > least)


def imputed_scaled(g: DataFrame) -> DataFrame:
    """Negative and missing dosages become the variant's mean; then (x - mean) / (max - min + 1e-5)."""
    d = F.when(F.col("dosage") >= 0, F.col("dosage").cast("double"))
    w = Window.partitionBy("variant")
    x = F.coalesce(d, F.avg(d).over(w))
    filled = g.select("sample", "variant", x.alias("x"))
    return filled.select("sample", "variant", ((F.col("x") - F.avg("x").over(w)) / (F.max("x").over(w) - F.min("x").over(w) + 1e-5)).alias("x"))


def standardised_snps(g: DataFrame, beta_shape: float | None = None) -> DataFrame:
    """Centred dosages times 1 / deviation, or times the beta density of the allele frequency; missing and constant variants become 0."""
    d = F.when(F.col("dosage") >= 0, F.col("dosage").cast("double"))
    stats = g.groupBy("variant").agg(F.avg(d).alias("_m"), F.stddev_pop(d).alias("_s"))
    if beta_shape is None:
        weight = F.when(F.col("_s") > 0, 1 / F.col("_s")).otherwise(0.0)
    else:
        from tessera.functions.special import beta_density

        f = F.col("_m") / 2
        weight = F.when(F.col("_s") > 0, beta_density(F.least(f, 1 - f), beta_shape, beta_shape)).otherwise(0.0)
    j = g.withColumn("dosage", d).join(stats.withColumn("_w", weight), "variant")
    return j.select("sample", "variant", F.coalesce((F.col("dosage") - F.col("_m")) * F.col("_w"), F.lit(0.0)).alias("x"))


def snp_kernel(x: DataFrame) -> DataFrame:
    """(a, b, k): inner products of samples over variants, divided by the mean of the diagonal. The result is samples squared by definition."""
    y = x.where("x <> 0")
    k = y.select("variant", F.col("sample").alias("a"), F.col("x").alias("_x")).join(y.select("variant", F.col("sample").alias("b"), F.col("x").alias("_y")), "variant").groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("k"))
    scale = k.where("a = b").agg(F.avg("k").alias("_d"))
    return k.crossJoin(F.broadcast(scale)).select("a", "b", (F.col("k") / F.col("_d")).alias("k"))  # one row


def moving_quantiles(df: DataFrame, x: str, y: str, quantiles: list[float], window: int, block: int = 100_000) -> DataFrame:
    """Centred moving quantiles and mean of y in order of x (then y): rows i - w/2 up to i + w/2 - 1.

    Rows are numbered, then dealt to blocks of positions; a block also gets the half windows before and after it, so no task sorts everything.
    """
    from tessera.operators.folds import positions

    half, block = window // 2, max(block, window)
    p = positions(df.select(x, y), x, y)
    own = F.floor(F.col("position") / block)
    near = F.array_distinct(F.array(own, F.floor((F.col("position") - half) / block), F.floor((F.col("position") + half) / block)))
    dealt = p.withColumn("_own", own).withColumn("_block", F.explode(near))
    w = Window.partitionBy("_block").orderBy("position").rowsBetween(-half, half - 1)
    cols = [F.percentile(y, q).over(w).alias(f"q{round(q * 100)}") for q in quantiles]
    return dealt.select(x, y, "_own", "_block", *cols, F.avg(y).over(w).alias("mean")).where("_own = _block").drop("_own", "_block")
