"""Bootstrap significance, shuffled splits, grids of settings, stability selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, settings: dict[str, list]) -> DataFrame:
    """One row for each combination of settings (a bounded table), in order of the grid."""
    import itertools

    rows = list(itertools.product(*settings.values()))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["point", *settings])


def bootstrap(df: DataFrame, key: str, baseline: str, test: str, iterations: int = 1000, smaller_better: bool = True, seed: int = 0, cells: int = 1 << 16) -> DataFrame:
    """(stars, better, worse) of a paired bootstrap: how often the resampled sum of improvements is above or below 0.

    Rows are dealt by hash of the key to cells, whose sums are made before the shuffle; each iteration draws every cell a Poisson(1) number of times, from
    a hash of cell, iteration and seed. With z the deviations of the sum of improvements from 0, cells widen the resamples' variance by the share z ** 2 / cells:
    0.01 % where the decision is near. The work is ``cells`` times ``iterations``, whatever the table's size.
    Above 99 % of the iterations: ** (better) or !! (worse); above 95 %: * or !. Rows that lack a value are left out.
    """
    if iterations <= 0:
        raise ValueError("iterations must be positive")
    gain = (F.col(baseline) - F.col(test)) if smaller_better else (F.col(test) - F.col(baseline))
    rows = df.select(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(cells)).alias("h"), gain.cast("double").alias("g")).where("g is not null")
    rows = rows.groupBy("h").agg(F.sum("g").alias("g"))
    steps = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(1, 12)]) + np.exp(-1)
    # a draw is the number of steps that a 32-bit hash lies above
    edges = (np.r_[np.exp(-1), steps] * 2.0**32).clip(0, 2**32 - 1).astype(np.uint32)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(iterations)
        it = (np.arange(iterations, dtype=np.uint64)[None, :] + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            h, g = b.column(0).to_numpy().view(np.uint64) * np.uint64(0xD6E8FEB86659FD93), b.column(1).to_numpy()
            for i in range(0, len(h), 256):
                x = h[i : i + 256, None] ^ it
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                u = ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32)
                for e in edges:
                    total += g[i : i + 256] @ (u >= e)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations)), pa.array(total)], ["i", "s"])

    sums = rows.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    share = sums.agg((F.count_if(F.col("s") > 0) / F.lit(iterations)).alias("better"), (F.count_if(F.col("s") < 0) / F.lit(iterations)).alias("worse"))
    stars = F.when(F.col("better") > 0.99, "**").when(F.col("better") > 0.95, "*").when(F.col("worse") > 0.99, "!!").when(F.col("worse") > 0.95, "!").otherwise("")
    return share.select(stars.alias("stars"), "better", "worse")


def bootstrap_of(df: DataFrame, key: str, baseline: str, tests: list[str], **how) -> DataFrame:
    """``bootstrap`` of one test column; more or fewer are no valid comparison: no star, one half each."""
    if len(tests) != 1:
        return df.sparkSession.createDataFrame([("", 0.5, 0.5)], "stars string, better double, worse double")
    return bootstrap(df, key, baseline, tests[0], **how)


def permuted_r2(df: DataFrame, key: str, base: list[str], tested: list[str], target: str, permutations: int = 100, cells: int = 256, seed: int = 0) -> dict[str, float]:
    """A set test: the cross-validated gain in R2 of ``tested`` over ``base``, and the share of sign-flipped cells' gains that reach it.

    Rows lie in hash cells; a cell's out-of-fold gain in squared error is exchangeable in sign if the set tells nothing, so permutations need sums only.
    """
    from tessera.operators import gram

    d = df.withColumn("_cell", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(cells)).cast("int"))
    sums = gram.gram(d, [*base, *tested, target], "_cell")
    total, small = gram._total(list(sums.values())), [*range(len(base)), len(base) + len(tested)]
    gains = []
    for s in sums.values():
        train = total - s
        e0 = float(gram.sse(s.pick(small), gram.ridge(train.pick(small), 1, 1e-8))[0]) if base else float(s.pick(small).raw()[0, 0] - 2 * (train.s / train.n + train.shift)[-1] * (s.s + s.n * s.shift)[-1] + s.n * (train.s / train.n + train.shift)[-1] ** 2)
        gains.append(e0 - float(gram.sse(s, gram.ridge(train, 1, 1e-8))[0]))
    g, rng = np.array(gains), np.random.default_rng(seed)
    flips = rng.choice([-1, 1], (permutations, len(g))) @ g
    return {"gain": float(g.sum() / gram.sst(total)[0]), "p": float((1 + (flips >= g.sum()).sum()) / (1 + permutations))}


def shuffled_r2(df: DataFrame, key: str, features: list[str], target: str, frac: float = 0.9, tries: int = 20, seed: int = 1) -> dict[str, float]:
    """Mean, median and population deviation of R2 over int(tries / (1 - frac)) seeded splits.

    Rows are dealt to cells by hash; a split's test part is a set of cells, so all splits share one pass of sums.
    """
    from tessera.operators import gram

    cells = 200
    d = df.withColumn("_cell", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(cells)).cast("int"))
    sums = gram.gram(d, [*features, target], "_cell")
    rng, scores = np.random.default_rng(seed), []
    for _ in range(int(tries / (1 - frac))):
        test = set(rng.permutation(cells)[: round(cells * (1 - frac))].tolist())
        tr, te = gram._total([s for c, s in sums.items() if c not in test]), gram._total([s for c, s in sums.items() if c in test])
        if tr is not None and te is not None and te.n > 1:
            scores.append(1 - float(gram.sse(te, gram.ridge(tr, 1, 1e-8))[0]) / float(gram.sst(te)[0]))
    return {"mean": float(np.mean(scores)), "median": float(np.median(scores)), "std": float(np.std(scores)), "splits": len(scores)}


def lasso(xx: np.ndarray, xy: np.ndarray, penalty: float, steps: int = 500) -> np.ndarray:
    """Coordinate descent on centred products (mean scale)."""
    b = np.zeros(len(xy))
    for _ in range(steps):
        old = b.copy()
        for j in range(len(b)):
            r = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - penalty, 0) / xx[j, j] if xx[j, j] else 0.0
        if np.abs(b - old).max() < 1e-10:
            break
    return b


def stability_selection(df: DataFrame, key: str, features: list[str], target: str, penalty: float, reps: int = 100, seed: int = 0) -> dict[str, float]:
    """How often each column enters the lasso on half of the rows; halves are halves of the hash cells, so one pass serves all."""
    from tessera.operators import gram

    cells = 64
    sums = gram.gram(df.withColumn("_cell", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(cells)).cast("int")), [*features, target], "_cell")
    rng, hits = np.random.default_rng(seed), np.zeros(len(features))
    for _ in range(reps):
        s = gram._total([sums[c] for c in rng.permutation(sorted(sums))[: max(1, len(sums) // 2)].tolist()])
        c, _ = s.centred()
        p = len(features)
        sd = np.sqrt(np.maximum(np.diag(c)[:p], 1e-300))
        hits += lasso(c[:p, :p] / np.outer(sd, sd), c[:p, p] / sd / np.sqrt(c[p, p]), penalty) != 0
    return dict(zip(features, (hits / reps).tolist(), strict=True))
