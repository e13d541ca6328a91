"""Entity matching: pair tables, similarities, one-to-one matching in line-ups, and their scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import cosine_distance, minkowski

METRICS = {"cosine": cosine_distance, "Euclidean": lambda a, b: minkowski(a, b, 2), "Manhattan": lambda a, b: minkowski(a, b, 1)}


def lineups(df: DataFrame, key: str, n_lineups: int, size: int, seed: int = 47) -> DataFrame:
    """(lineup, pos, id): each line-up draws ``size`` ids without replacement; pos 0 is the query. Draws depend on seed, line-up and id alone."""
    ids = df.select(F.col(key).alias("id")).distinct().withColumn("lineup", F.explode(F.sequence(F.lit(0), F.lit(n_lineups - 1))))
    best = ids.withColumn("pos", F.row_number().over(Window.partitionBy("lineup").orderBy(F.xxhash64("lineup", "id", F.lit(seed)), "id")) - 1)
    return best.where(F.col("pos") < size).select("lineup", "pos", "id")


def pairs_in(members: DataFrame, vectors: DataFrame, key: str, source: str, target: str, metric: str = "Euclidean") -> DataFrame:
    """(lineup, source, target, distance) for pairs within each line-up: two equality joins, so the count is line-ups times size squared, never the table squared."""
    a = members.join(vectors.select(F.col(key).alias("id"), F.col(source).alias("_a")), "id").select("lineup", F.col("id").alias("source"), "_a")
    b = members.join(vectors.select(F.col(key).alias("id"), F.col(target).alias("_b")), "id").select("lineup", F.col("id").alias("target"), "_b")
    return a.join(b, "lineup").select("lineup", "source", "target", METRICS[metric](F.col("_a"), F.col("_b")).alias("distance"))


def all_pairs(left: DataFrame, right: DataFrame, key: str, vector: str, metric: str = "cosine") -> DataFrame:
    """(source, target, distance) of every source with every target: for bounded samples, one side in blocks."""
    l = left.select(F.col(key).alias("source"), F.col(vector).alias("_a"))
    r = right.select(F.col(key).alias("target"), F.col(vector).alias("_b"))
    return l.crossJoin(r).select("source", "target", METRICS[metric](F.col("_a"), F.col("_b")).alias("distance"))


def grouped_distance(a: Column, b: Column, groups: list[tuple[int, int]]) -> Column:
    """Sum over groups (start, length; 0-based) of their Euclidean distance divided by their size."""
    out = F.lit(0.0)
    for start, n in groups:
        out = out + minkowski(F.slice(a, start + 1, n), F.slice(b, start + 1, n), 2) / n
    return out


def residuals(left: DataFrame, right: DataFrame, key: str, columns: list[str], p: int = 1, max_pairs: int | None = None, seed: int = 0) -> DataFrame:
    """(source, target, one |a - b| ** p for each column): all concordant pairs, and discordant ones up to ``max_pairs`` in hash order (at random, repeatably)."""
    l = left.select(F.col(key).alias("source"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    r = right.select(F.col(key).alias("target"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    res = lambda d: d.select("source", "target", *[F.pow(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")), F.lit(float(p))).alias(c) for c in columns])
    same = l.join(r, F.col("source") == F.col("target"))
    other = l.join(r, F.col("source") != F.col("target"))
    if max_pairs is not None:
        room = max(0, max_pairs - same.count())
        other = other.orderBy(F.xxhash64("source", "target", F.lit(seed)), "source", "target").limit(room)
    return res(same).unionByName(res(other))


def similarity(pairs: DataFrame, by: list[str] = ("lineup",)) -> DataFrame:
    """Largest distance of the group minus the distance."""
    top = F.max("distance").over(Window.partitionBy(*by)) if by else F.max("distance").over(Window.partitionBy())
    return pairs.withColumn("similarity", top - F.col("distance"))


def normalised(pairs: DataFrame, by: list[str] = ("source",), value: str = "similarity") -> DataFrame:
    return pairs.withColumn(value, F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def null_rows_mean(pairs: DataFrame, empty: Column, value: str = "distance", by: list[str] = ()) -> DataFrame:
    """Pairs of all-null rows get the mean distance of the others."""
    mean = F.avg(F.when(~empty, F.col(value))).over(Window.partitionBy(*by))
    return pairs.withColumn(value, F.when(empty, mean).otherwise(F.col(value)))


def argmax_match(pairs: DataFrame, by: list[str] = ("lineup",), value: str = "similarity") -> DataFrame:
    """Each source's best target; of equal ones the least."""
    best = F.min_by("target", F.struct((-F.col(value)).alias("v"), "target"))
    return pairs.groupBy(*by, "source").agg(best.alias("target"))


def hungarian(gain: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of greatest total gain (rows at most as many as columns), by shortest augmenting paths."""
    n, m = gain.shape
    if n > m:
        out = np.full(n, -1)
        for col, row in enumerate(hungarian(gain.T)):
            out[row] = col
        return out
    cost, u, v, owner, way = -gain, np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            cur = np.r_[np.inf, cost[i0 - 1] - u[i0] - v[1:]]
            better = ~used & (cur < low)
            low[better], way[better] = cur[better], j0
            j1 = int(np.where(used, np.inf, low).argmin())
            d = low[j1]
            u[owner[used]] += d
            v[used] -= d
            low[~used] -= d
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def greedy(gain: np.ndarray) -> np.ndarray:
    """Repeatedly the greatest entry left, its row and column then gone; ties by row, then column."""
    out, g = np.full(len(gain), -1), gain.astype(float).copy()
    for _ in range(min(g.shape)):
        i, j = np.unravel_index(int(g.argmax()), g.shape)
        out[i] = j
        g[i], g[:, j] = -np.inf, -np.inf
    return out


def one_to_one(pairs: DataFrame, how: str = "optimal", by: str = "lineup", value: str = "similarity") -> DataFrame:
    """(by, source, target): each group's greedy or best total matching. Groups are line-ups, whose size is a parameter."""
    solve = {"optimal": hungarian, "greedy": greedy}[how]

    def run(table):
        import pyarrow as pa

        t = table.to_pandas().sort_values(["source", "target"])
        g = t.pivot(index="source", columns="target", values=value)
        got = solve(g.fillna(g.min().min()).to_numpy())
        rows = [(s, g.columns[j]) for s, j in zip(g.index, got, strict=True) if j >= 0]
        return pa.table({by: pa.array([t[by].iloc[0]] * len(rows), pa.int64()), "source": pa.array([s for s, _ in rows], pa.int64()), "target": pa.array([x for _, x in rows], pa.int64())})

    slim = pairs.select(F.col(by).cast("long").alias(by), F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), value)
    return slim.groupBy(by).applyInArrow(run, f"{by} long, source long, target long")


def match_accuracy(matched: DataFrame, by: str = "lineup") -> DataFrame:
    """Mean over groups of the share of sources that met themselves."""
    return matched.groupBy(by).agg(F.avg((F.col("source") == F.col("target")).cast("double")).alias("a")).agg(F.avg("a").alias("accuracy"))


def learned_similarity(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Probability of concordance from residual columns, by logistic regression with balanced classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = pairs.withColumn("label", (F.col("source") == F.col("target")).cast("double"))
    n = d.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    w = F.when(F.col("label") > 0, n["n"] / (2.0 * max(n["p"], 1))).otherwise(n["n"] / (2.0 * max(n["n"] - n["p"], 1)))
    v = VectorAssembler(inputCols=columns, outputCol="_x").transform(d.withColumn("_w", w))
    model = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", regParam=1e-4).fit(v)
    return model.transform(v).select(*pairs.columns, vector_to_array("probability")[1].alias("similarity"))


def knn(train: DataFrame, test: DataFrame, key: str, vector: str, value: str, k: int, block: int = 2048) -> DataFrame:
    """(key, predicted): mean value of the k nearest training vectors (Euclidean). Blocks of both sides meet in matrix products; each task keeps k candidates of a query, so lists stay short."""
    rows = lambda d, side: d.select(F.lit(side).alias("side"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(value).cast("double").alias("y"))
    n, m = (max(1, -(-d.count() // block)) for d in (test, train))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    own = lambda c: F.pmod(F.xxhash64("id"), F.lit(c)).cast("int")
    both = rows(test, 0).withColumn("a", own(n)).withColumn("b", spread(m)).unionByName(rows(train, 1).withColumn("b", own(m)).withColumn("a", spread(n)))

    def meet(_, t):
        import pyarrow as pa
        import pyarrow.compute as pc

        q, r = (t.filter(pc.equal(t.column("side"), s)) for s in (0, 1))
        if not len(q) or not len(r):
            return pa.table({"id": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "y": pa.array([], pa.float64())})
        x, z = (np.array(v.column("x").to_pylist(), float) for v in (q, r))
        d = (x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * x @ z.T
        near = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        y = r.column("y").to_numpy()[near]
        return pa.table({"id": pa.array(np.repeat(q.column("id").to_numpy(), near.shape[1])), "d": pa.array(np.take_along_axis(d, near, 1).ravel()), "y": pa.array(y.ravel())})

    c = both.groupBy("a", "b").applyInArrow(meet, "id long, d double, y double")
    best = c.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("d", "y"))).where(F.col("n") <= k)
    return best.groupBy(F.col("id").alias(key)).agg(F.avg("y").alias("predicted"))


def panel(df: DataFrame, key: str, column_sets: dict[str, tuple[list[str], list[str]]], metrics_: list[str], n_lineups: int = 100, size: int = 10, seed: int = 47) -> DataFrame:
    """(columns, metric, method, accuracy) of every column set with every distance: one-to-one, greedy and independent matching in the same line-ups."""
    members, out = lineups(df, key, n_lineups, size, seed), None
    for label, (source, target) in column_sets.items():
        whole = df.dropna(subset=[*source, *target])
        v = whole.select(key, F.array(*[F.col(c).cast("double") for c in source]).alias("a"), F.array(*[F.col(c).cast("double") for c in target]).alias("b"))
        for m in metrics_:
            p = similarity(pairs_in(members, v, key, "a", "b", m))
            for method, got in (("match", one_to_one(p)), ("select_unique", one_to_one(p, "greedy")), ("select", argmax_match(p))):
                row = match_accuracy(got).select(F.lit(label).alias("columns"), F.lit(m).alias("metric"), F.lit(method).alias("method"), "accuracy")
                out = row if out is None else out.unionByName(row)
    return out


def compared(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two matchings side by side: source, each one's target, whether they agree; a source that one lacks has no target there."""
    x, y = (d.select("source", F.col("target").alias(f"target_{n}")) for d, n in ((a, names[0]), (b, names[1])))
    both = x.join(y, "source", "full")
    return both.withColumn("agree", F.col(f"target_{names[0]}").eqNullSafe(F.col(f"target_{names[1]}")))


def group_means(residual: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(source, target, mean of each group's residual columns that are there)."""
    means = []
    for name, columns in groups.items():
        there = [F.col(c).isNotNull().cast("int") for c in columns]
        total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
        means.append(F.when(sum(there, F.lit(0)) > 0, total / sum(there, F.lit(0))).alias(name))
    return residual.select("source", "target", *means)


def lineup_accuracies(pairs: DataFrame, by: str = "lineup") -> DataFrame:
    """(method, accuracy): one-to-one matching, independent and greedy choice of all sources, and both for the line-up's query (its least source) alone."""
    optimal, chosen, greedy_ = one_to_one(pairs, by=by), argmax_match(pairs, [by]), one_to_one(pairs, "greedy", by=by)
    query = pairs.groupBy(by).agg(F.min("source").alias("source"))
    rows = [("match", optimal), ("select", chosen), ("select_unique", greedy_), ("match_query", optimal.join(query, [by, "source"])), ("select_query", chosen.join(query, [by, "source"]))]
    out = None
    for name, got in rows:
        one = match_accuracy(got, by).select(F.lit(name).alias("method"), "accuracy")
        out = one if out is None else out.unionByName(one)
    return out
