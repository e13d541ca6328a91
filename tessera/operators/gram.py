"""Least squares from sufficient statistics: one pass over the data, any number of models on the driver.

Each row adds its products to its group's sums; a group's sums are (p + 2)(p + 3) / 2 numbers, whatever its rows. Training sums of a
split are the total minus the split's own, so all splits, penalties and subsets of columns come from one job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalty of columns that shall not be penalised.
FREE = 1e-10
#: The default grid of penalties: a fixed set of values.
ALPHAS = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0, 1000000.0)


@dataclass
class Sums:
    """n, sums of columns and of their products, for columns x.. then targets; ``shift`` was taken off each first."""

    n: float
    s: np.ndarray
    xx: np.ndarray
    shift: np.ndarray

    def __sub__(self, o: Sums) -> Sums:
        return Sums(self.n - o.n, self.s - o.s, self.xx - o.xx, self.shift)

    def __add__(self, o: Sums) -> Sums:
        return Sums(self.n + o.n, self.s + o.s, self.xx + o.xx, self.shift)

    def pick(self, keep: list[int]) -> Sums:
        return Sums(self.n, self.s[keep], self.xx[np.ix_(keep, keep)], self.shift[keep])

    def raw(self) -> np.ndarray:
        """Products of the columns as they were, without the shift."""
        part = np.outer(self.s, self.shift)
        return self.xx + part + part.T + self.n * np.outer(self.shift, self.shift)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        m = self.s / self.n
        return self.xx - self.n * np.outer(m, m), m


def gram(df: DataFrame, columns: list[str], by: str | None = None, shift: list[float] | None = None) -> dict:
    """Group -> Sums, in one job (two where no ``shift``, numbers near the means, is given: it is taken off first, for precision). Rows with a null go."""
    rows = df.dropna(subset=columns).select(*([by] if by else []), *[F.col(c).cast("double").alias(c) for c in columns])
    if shift is None:
        m = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
        shift = [m[c] or 0.0 for c in columns]
    shift = np.array(shift, float)
    z = [F.col(c) - F.lit(float(v)) for c, v in zip(columns, shift, strict=True)]
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(z[i]).alias(f"s{i}") for i in range(p)], *[F.sum(z[i] * z[j]).alias(f"x{i}_{j}") for i, j in pairs]]
    out = {}
    for r in (rows.groupBy(by) if by else rows.groupBy()).agg(*aggs).collect():
        xx = np.zeros((p, p))
        for i, j in pairs:
            xx[i, j] = xx[j, i] = r[f"x{i}_{j}"] or 0.0
        out[r[by] if by else None] = Sums(r["n"], np.array([r[f"s{i}"] or 0.0 for i in range(p)]), xx, shift)
    return out


@dataclass
class Linear:
    intercept: np.ndarray
    beta: np.ndarray

    def column(self, names: list[str], target: int = 0):
        """The prediction as one expression."""
        e = F.lit(float(self.intercept[target]))
        for n, b in zip(names, self.beta[:, target], strict=True):
            e = e + F.col(n) * F.lit(float(b))
        return e


def ridge(sums: Sums, n_targets: int = 1, alpha: float | list[float] = 1.0, free: list[int] = (), intercept: bool = True) -> Linear:
    """Ridge with one penalty, or one for each column; ``free`` columns are not penalised."""
    c, m = sums.centred() if intercept else (sums.raw(), np.zeros(len(sums.s)))
    p = len(sums.s) - n_targets
    pen = np.full(p, float(alpha)) if np.isscalar(alpha) else np.asarray(alpha, float).copy()
    pen[list(free)] = FREE
    a = c[:p, :p] + np.diag(pen)
    try:
        beta = np.linalg.solve(a, c[:p, p:])
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(a, c[:p, p:], rcond=None)[0]
    full = m + sums.shift if intercept else m
    return Linear(full[p:] - full[:p] @ beta if intercept else np.zeros(n_targets), beta)


def sse(sums: Sums, model: Linear, n_targets: int = 1) -> np.ndarray:
    """Squared errors of a model on the rows behind ``sums``."""
    p = len(sums.s) - n_targets
    out = []
    for t in range(n_targets):
        v = np.r_[-model.beta[:, t], np.eye(n_targets)[t]]
        d = v @ sums.shift - model.intercept[t]  # residual = v . z + d
        out.append(v @ sums.xx @ v + 2 * d * (v @ sums.s) + sums.n * d * d)
    return np.array(out)


def sst(sums: Sums, n_targets: int = 1) -> np.ndarray:
    return np.diag(sums.centred()[0])[-n_targets:]


def dual_ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> Linear:
    """For more columns than rows: solve in the space of rows (small, on one machine)."""
    mx, my = x.mean(0), y.mean(0)
    xc = x - mx
    beta = xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(len(x)), y - my)
    return Linear(my - mx @ beta, beta)


def cells(df: DataFrame, columns: list[str], key: str, fold: str, n_training: int = 10, inner: int = 5, shift: list[float] | None = None) -> dict[tuple[int, int], Sums]:
    """(outer fold, inner fold) -> Sums, in one job; the inner fold is a hash of the key, so rows of one subject stay together."""
    kept = df.where(F.col(fold).between(0, n_training - 1))
    cell = F.col(fold) * inner + F.pmod(F.xxhash64(key, F.lit("inner")), F.lit(inner)).cast("int")
    return {(k // inner, k % inner): s for k, s in gram(kept.withColumn("_cell", cell), columns, "_cell", shift).items()}


def search(sums: dict[tuple[int, int], Sums], settings: list, fit, inner: int = 5) -> list[dict]:
    """Nested cross-validation from sums by cell: ``fit(sums, setting)`` gives a Linear model. One dict for each outer fold, and the pooled scores under 'pooled'.

    The setting of an outer fold is the one with the least squared error over the inner folds of its training rows; the first of equal ones.
    """
    total = lambda keep: _total([s for k, s in sums.items() if keep(k)])
    out, pooled = [], np.zeros(2)
    for f in sorted({k[0] for k in sums}):
        parts = [(total(lambda k, f=f, i=i: k[0] != f and k[1] != i), total(lambda k, f=f, i=i: k[0] != f and k[1] == i)) for i in range(inner)]
        parts = [p for p in parts if p[0] is not None and p[1] is not None]
        scores = [sum(float(sse(test, fit(train, s))[0]) for train, test in parts) for s in settings]
        best = settings[int(np.argmin(scores))] if parts else settings[0]
        train, test = total(lambda k, f=f: k[0] != f), total(lambda k, f=f: k[0] == f)
        m = fit(train, best)
        e = float(sse(test, m)[0])
        pooled += (e, test.n)
        out.append({"fold": f, "alpha": best, "model": m, "n": test.n, "mse": e / test.n, "r2": 1 - e / float(sst(test)[0])})
    everything = total(lambda k: True)
    out.append({"fold": "pooled", "n": everything.n, "mse": pooled[0] / pooled[1], "r2": 1 - pooled[0] / float(sst(everything)[0])})
    return out


def basic_search(sums: dict[int, Sums], settings: list, fit, weighted: bool = True) -> dict:
    """Plain cross-validation from sums by split: every split scored with every setting.

    ``scores``: (split, setting, mse, n); ``ranked``: (setting, mean mse), best first, a split weighing as many rows as it has (or all alike); ``best``: the first of
    them; ``models``: each split's model refitted with it on the other splits; ``model``: the one of all rows.
    """
    total, scores = _total(list(sums.values())), []
    for k, s in sorted(sums.items()):
        train = total - s
        scores += [(k, x, float(sse(s, fit(train, x))[0]) / s.n, s.n) for x in settings]
    weight = {k: s.n if weighted else 1 for k, s in sums.items()}
    mean = {x: sum(m * weight[k] for k, y, m, _ in scores if y == x) / sum(weight.values()) for x in settings}
    ranked = sorted(mean.items(), key=lambda t: t[1])
    best = ranked[0][0]
    return {"scores": scores, "ranked": ranked, "best": best, "models": {k: fit(total - s, best) for k, s in sorted(sums.items())}, "model": fit(total, best)}


def nested_ridge(df: DataFrame, features: list[str], target: str, fold: str, n_training: int = 10, alphas: tuple = ALPHAS, inner: int = 5, key: str | None = None) -> list[dict]:
    """Nested cross-validated ridge: outer folds as given, inner ones by hash of ``key`` (all columns, if there is none)."""
    keyed = df if key else df.withColumn("_key", F.xxhash64(*features, target))
    return search(cells(keyed, [*features, target], key or "_key", fold, n_training, inner), list(alphas), lambda s, a: ridge(s, 1, a), inner)


def _total(parts: list[Sums]) -> Sums | None:
    out = None
    for s in parts:
        out = s if out is None else out + s
    return out


def ols(sums: Sums, tol: float = 1e-10) -> dict:
    """Coefficients (intercept first), errors, R2, residual variance and log-likelihood; directions below ``tol`` of the largest are cut."""
    c, m = sums.centred()
    p = len(sums.s) - 1
    w, v = np.linalg.eigh(c[:p, :p])
    keep = w > tol * max(w.max(), 1e-300)
    inv = (v[:, keep] / w[keep]) @ v[:, keep].T
    beta = inv @ c[:p, p]
    rss, tss, n = float(c[p, p] - beta @ c[:p, p]), float(c[p, p]), sums.n
    dof = n - keep.sum() - 1
    var = rss / dof
    full = m + sums.shift
    b0 = full[p] - full[:p] @ beta
    cov0 = var * (1 / n + full[:p] @ inv @ full[:p])
    return {"beta": np.r_[b0, beta], "se": np.sqrt(np.r_[cov0, var * np.diag(inv)]), "cov": var * inv, "r2": 1 - rss / tss, "rss": rss, "tss": tss, "dof": dof, "n": n, "logl": -n / 2 * (np.log(2 * np.pi * rss / n) + 1)}


def t_test(fit: dict, one_sided: bool = True) -> np.ndarray:
    """P-values of the coefficients; one-sided (upper tail of |t|) unless asked otherwise."""
    from tessera.functions.special import t_sf

    p = np.array([t_sf(abs(b / s), fit["dof"]) for b, s in zip(fit["beta"], fit["se"], strict=True)])
    return p if one_sided else 2 * p


def f_test(fit: dict, which: list[int]) -> tuple[float, float]:
    """F and p-value of the hypothesis that these coefficients (0: first column) are all zero."""
    from tessera.functions.special import f_sf

    b, c = fit["beta"][1:][which], fit["cov"][np.ix_(which, which)]
    f = float(b @ np.linalg.solve(c, b)) / len(which)
    return f, f_sf(f, len(which), fit["dof"])


def lr_test(sums: Sums, which: list[int]) -> tuple[float, float]:
    """Likelihood ratio of the full model against the one without these columns, and its p-value."""
    from tessera.functions.special import chi2_sf

    p = len(sums.s)
    rest = [i for i in range(p) if i not in which]
    x = 2 * (ols(sums)["logl"] - ols(sums.pick(rest))["logl"])
    return x, chi2_sf(x, len(which))


def cumulative(sums: Sums, base: list[int], order: list[int]) -> list[dict]:
    """R2 of each column alone, with the base, over the base, and of the growing set; all from one Sums (target last)."""
    t = len(sums.s) - 1
    fit = lambda cols: ols(sums.pick([*cols, t]))["r2"] if cols else 0.0
    b, out = fit(base), []
    for i, c in enumerate(order):
        out.append({"column": c, "indiv": fit([c]), "plusbase": fit([*base, c]), "overbase": fit([*base, c]) - b, "cumm": fit([*base, *order[: i + 1]])})
    return out
