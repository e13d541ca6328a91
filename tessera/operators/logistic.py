"""Logistic regression for all folds at once: each Newton step is one pass whose partitions return one small matrix for each fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_fold(df: DataFrame, features: list[str], label: str, fold: str, n_folds: int, l2: float = 1e-4, balanced: bool = False, steps: int = 8) -> np.ndarray:
    """(n_folds, p + 1) weights, intercept first: row f is fitted on the rows outside fold f. ``label`` is 0 or 1; rows with a null go.

    Columns are standardised for the fit by one pass of sums. ``balanced`` weighs both classes alike.
    """
    from tessera.operators import gram

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"), F.col(fold).cast("int").alias("_f")).dropna()
    s = gram.gram(rows, [*features, "_y"])[None]
    c, m = s.centred()
    p = len(features)
    sd = np.sqrt(np.maximum(np.diag(c)[:p] / s.n, 1e-300))
    mean, share = (m + s.shift)[:p], float((m + s.shift)[p])
    cost = (0.5 / max(1 - share, 1e-9), 0.5 / max(share, 1e-9)) if balanced else (1.0, 1.0)
    w = np.zeros((n_folds, p + 1))
    q = p + 1

    def sums(batches):
        import pyarrow as pa

        g, h = np.zeros((n_folds, q)), np.zeros((n_folds, q, q))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[(b.column(i).to_numpy() - mean[i]) / sd[i] for i in range(p)]])
            y, f = b.column(p).to_numpy(), b.column(p + 1).to_numpy()
            z = 1 / (1 + np.exp(-np.clip(x @ w.T, -35, 35)))
            a = np.where(y > 0, cost[1], cost[0])
            for k in range(n_folds):
                use = f != k
                xa = x[use] * a[use, None]
                g[k] += xa.T @ (y[use] - z[use, k])
                h[k] += (xa * (z[use, k] * (1 - z[use, k]))[:, None]).T @ x[use]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g.ravel(), h.ravel()]).tolist()], pa.list_(pa.float64()))], ["s"])

    for _ in range(steps):
        total = sum(np.array(r["s"]) for r in rows.mapInArrow(sums, "s array<double>").toLocalIterator())  # one row of bounded size for each partition
        g, h = total[: n_folds * q].reshape(n_folds, q), total[n_folds * q :].reshape(n_folds, q, q)
        pen = l2 * s.n * np.r_[0, np.ones(p)]
        step = np.array([np.linalg.solve(h[k] + np.diag(pen + 1e-9), g[k] - pen * w[k]) for k in range(n_folds)])
        w += step
        if np.abs(step).max() < 1e-8:
            break
    beta = w[:, 1:] / sd
    return np.column_stack([w[:, 0] - beta @ mean, beta])


def probability(weights: np.ndarray, features: list[str], fold: str) -> F.Column:
    """Each row's out-of-fold probability as one expression."""
    out = F.lit(None).cast("double")
    for k, w in enumerate(weights):
        z = F.lit(float(w[0]))
        for c, b in zip(features, w[1:], strict=True):
            z = z + F.col(c) * F.lit(float(b))
        out = F.when(F.col(fold) == k, 1 / (1 + F.exp(-z))).otherwise(out)
    return out
