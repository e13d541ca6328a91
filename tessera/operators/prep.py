"""Cohort preparation in two phases: one profiling aggregation for all columns, then one generated projection."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import clip, is_packed, numeric, standardise, unstandardise


# -- selection ----------------------------------------------------------------
def any_of(patterns: list[str]) -> str:
    """Patterns as alternatives of one."""
    return "|".join(f"({p})" for p in patterns)


def columns_like(columns: list[str], include: str, exclude: list[str] = ()) -> list[str]:
    """Names that ``include`` finds and no ``exclude`` finds, in order."""
    return [c for c in columns if re.search(include, c) and not any(re.search(x, c) for x in exclude)]


def exactly(names: list[str]) -> str:
    return "|".join(f"^{re.escape(n)}$" for n in names)


def sanitised(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with marks in column names replaced by underscores, and new name -> old name."""
    new = [re.sub(r"[.*+:\-~/ ]", "_", c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError("names meet after replacement")
    return df.toDF(*new), dict(zip(new, df.columns, strict=True))


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


# -- filters --------------------------------------------------------------------
def condition(column: str, rule) -> Column:
    """One rule of the filter language: a value, (value, '!='), (None, '!=' or '<>'), (list, 'in'), (list, '!in'), (value, other comparison), or a list of rules that all hold."""
    c = F.col(f"`{column}`")
    if isinstance(rule, list):
        return reduce(lambda a, b: a & b, (condition(column, r) for r in rule))
    value, op = rule if isinstance(rule, tuple) else (rule, "==")
    if value is None:
        return c.isNotNull() if op in ("!=", "<>") else c.isNull()
    ops = {"==": lambda: c == value, "!=": lambda: c != value, "<>": lambda: c != value, "in": lambda: c.isin(*value), "!in": lambda: ~c.isin(*value), "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value}
    return ops[op]()


def query(df: DataFrame, keys: list[str], filters: dict | None = None, with_nulls: bool = True) -> DataFrame:
    """Filtered projection of a source; both reach the scan. Without ``with_nulls`` rows that lack a key go."""
    for column, rule in (filters or {}).items():
        df = df.where(condition(column, rule))
    out = df.select(*[F.col(f"`{k}`") for k in keys])
    return out if with_nulls else out.dropna()


def filter_ledger(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(step, reason, lost): rows that each rule removes of what the rules before it left; one pass. A null verdict removes."""
    verdicts = [F.coalesce(c, F.lit(False)) for _, c in rules]
    passed, counts = F.lit(True), []
    for i, v in enumerate(verdicts):
        counts.append(F.count_if(passed & ~v).alias(f"_{i}"))
        passed = passed & v
    one = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(r).alias("reason"), F.col(f"_{i}").alias("lost")) for i, (r, _) in enumerate(rules)])
    return one.select(F.inline(rows))


def profile(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per column: rows, missing share, castable share of what is there, distinct values, first value. One aggregation for all."""
    kinds, aggs = dict(df.dtypes), [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        there = col.isNotNull() & ~F.isnan(col) if kinds[c] in ("double", "float") else col.isNotNull()
        aggs += [F.count_if(~there).alias(f"m{i}"), F.count_if(there & numeric(col.cast("string")).isNotNull()).alias(f"k{i}"), F.approx_count_distinct(col).alias(f"d{i}"), F.first(F.when(there, col), ignorenulls=True).cast("string").alias(f"f{i}")]
    r = df.agg(*aggs).first()
    n = max(r["n"], 1)
    return {c: {"n": r["n"], "missing": r[f"m{i}"] / n, "castable": r[f"k{i}"] / max(1, r["n"] - r[f"m{i}"]), "distinct": r[f"d{i}"], "first": r[f"f{i}"]} for i, c in enumerate(columns)}


def drop_missing(df: DataFrame, columns: list[str], warn: float = 0.4, drop: float = 1.0) -> tuple[DataFrame, list[str], list[str]]:
    """(frame, dropped, warned): columns whose missing share reaches ``drop`` go, those from ``warn`` on are named."""
    p = profile(df, columns)
    gone = [c for c in columns if p[c]["missing"] >= drop]
    return df.drop(*gone), gone, [c for c in columns if warn <= p[c]["missing"] < drop]


def tally_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, lost): rows that lack a value, attributed to the most-missing column among those that lack one."""
    p = profile(df, columns)
    order = sorted(columns, key=lambda c: (-p[c]["missing"], c))
    return filter_ledger(df, [(c, F.col(f"`{c}`").isNotNull()) for c in order]).select(F.col("reason").alias("column"), "lost")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Prune to the needed columns first, then drop rows that lack one, so unused nulls cost nothing."""
    return df.select(*[F.col(f"`{c}`") for c in columns]).dropna()


def salvage(df: DataFrame, columns: list[str], least: float = 0.9, max_categories: int = 10) -> tuple[DataFrame, dict[str, str]]:
    """Text columns: over ``least`` castable become numbers (junk: null), few categories stay for coding, others go. Also what was done."""
    kinds = dict(df.dtypes)
    text = [c for c in columns if kinds[c] == "string"]
    p, done, out = profile(df, text), {}, df
    for c in text:
        if p[c]["castable"] > least:
            done[c] = "numeric"
            out = out.withColumn(c, numeric(F.col(f"`{c}`")))
        elif p[c]["distinct"] <= max_categories:
            done[c] = "categorical"
        else:
            done[c] = "dropped"
            out = out.drop(c)
    return out, done


def treatment_coding(df: DataFrame, column: str, others: list[str] = (), levels: list | None = None) -> DataFrame:
    """0/1 columns ``column_level`` for all sorted levels but the first, and their products with ``others``."""
    levels = levels or sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    out = {}
    for lvl in levels[1:]:
        name = re.sub(r"[.*+:\-~/ ]", "_", f"{column}_{lvl}")
        flag = F.when(F.col(column).isNull(), None).otherwise((F.col(column) == lvl).cast("double"))
        out[name] = flag
        out |= {f"{name}__{o}": flag * F.col(o) for o in others}
    return df.withColumns(out)


# -- outliers -------------------------------------------------------------------
def outlier_limits(df: DataFrame, columns: list[str], k: float = 6, by: list[str] = ()) -> DataFrame:
    """Limits mean -+ k sample deviations of the inner [5 %, 95 %] values (all values where there are at most 10), one row (or one for each group)."""
    q = df.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).alias(f"_q_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns])
    joined = df.join(F.broadcast(q), list(by)) if by else df.crossJoin(F.broadcast(q))  # one row, or one for each class
    inner = lambda c: F.when((F.col(f"_n_{c}") <= 10) | F.col(c).between(F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]), F.col(c))
    stats = joined.groupBy(*by).agg(*[F.avg(inner(c)).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(inner(c)).alias(f"_s_{c}") for c in columns])
    return stats.select(*by, *[(F.col(f"_m_{c}") + s * k * F.coalesce(f"_s_{c}", F.lit(0.0))).alias(f"{c}_{n}") for c in columns for n, s in (("low", -1), ("high", 1))])


def trim_outliers(df: DataFrame, columns: list[str], k: float = 4, by: list[str] = (), trim: bool = True) -> DataFrame:
    """Values beyond the limits set to them, or only flagged in ``<column>_outlier``."""
    lim = F.broadcast(outlier_limits(df, columns, k, by))
    joined = df.join(lim, list(by)) if by else df.crossJoin(lim)
    for c in columns:
        lo, hi = F.col(f"{c}_low"), F.col(f"{c}_high")
        joined = joined.withColumn(c, clip(F.col(c), lo, hi)) if trim else joined.withColumn(f"{c}_outlier", (F.col(c) < lo) | (F.col(c) > hi))
    return joined.drop(*[f"{c}_{n}" for c in columns for n in ("low", "high")])


def winsorised_fit(df: DataFrame, x: str, y: str, grid: list[tuple[float, float]], unchanged: float = 0.3) -> DataFrame:
    """(low, high, r2) for each quantile window that leaves at least ``unchanged`` of y: squared correlation of x with y trimmed to the window."""
    grid = [(lo, hi) for lo, hi in grid if lo < hi and hi - lo >= unchanged]
    q = df.agg(*[F.percentile(y, F.array(F.lit(lo), F.lit(hi))).alias(f"_{i}") for i, (lo, hi) in enumerate(grid)])
    joined = df.crossJoin(F.broadcast(q))
    one = joined.agg(*[F.pow(F.corr(x, clip(F.col(y), F.col(f"_{i}")[0], F.col(f"_{i}")[1])), F.lit(2.0)).alias(f"r{i}") for i in range(len(grid))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.col(f"r{i}").alias("r2")) for i, (lo, hi) in enumerate(grid)])))


# -- per-column specifications -----------------------------------------------------
@dataclass(frozen=True)
class Spec:
    """How a column is prepared: missing 'mean', 'mode' or 'drop'; clip at ``clip`` deviations (not above 0: never); standardise or not."""

    missing: str = "mean"
    standard: bool = True
    clip: float = 4.0


STANDARD, DROP_ONLY = Spec(), Spec("drop", False, 0)


def resolve(rules: list[tuple[str | list[str], Spec]], columns: list[str]) -> dict[str, Spec]:
    """Each column's specification; later rules override. A rule names columns by pattern or as a list."""
    out = {}
    for who, spec in rules:
        for c in columns_like(columns, who) if isinstance(who, str) else [c for c in columns if c in who]:
            out[c] = replace(spec)
    return out


class Prepared:
    """Statistics fitted on one frame, applied to any: fill, clip, standardise, and the way back."""

    def __init__(self, specs: dict[str, Spec], train: DataFrame) -> None:
        self.specs = specs
        aggs = []
        for c in specs:
            aggs += [F.avg(c).alias(f"{c}|m"), F.stddev_pop(c).alias(f"{c}|s"), F.mode(c, True).alias(f"{c}|o")]
        self.stats = train.agg(*aggs).first().asDict() if aggs else {}

    def apply(self, df: DataFrame) -> DataFrame:
        drop = [c for c, s in self.specs.items() if s.missing == "drop"]
        df = df.dropna(subset=drop) if drop else df
        out = {}
        for c, s in self.specs.items():
            m, d = F.lit(self.stats[f"{c}|m"]), F.lit(self.stats[f"{c}|s"])
            x = F.col(c)
            if s.missing != "drop":
                x = F.coalesce(x, m if s.missing == "mean" else F.lit(self.stats[f"{c}|o"]))
            if s.clip > 0:
                x = clip(x, m - d * s.clip, m + d * s.clip)
            out[c] = standardise(x, m, d) if s.standard else x
        return df.withColumns(out)

    def undo(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """Predictions (column -> the target it predicts) back on the target's scale."""
        return df.withColumns({c: unstandardise(F.col(c), F.lit(self.stats[f"{t}|m"]), F.lit(self.stats[f"{t}|s"])) if self.specs[t].standard else F.col(c) for c, t in columns.items()})


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """(_v, _q): each distinct value and its average-tie rank (rank - 1/2) / n."""
    from tessera.operators.relate import running_total

    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return running_total(counts, "_v", "_c", "_b", "_n").select("_v", ((F.col("_b") + (F.col("_c") - 1) / 2 + 0.5) / F.col("_n")).alias("_q"))


def quantile_normal(df: DataFrame, column: str, key: str, out: str, distribution: str = "normal") -> DataFrame:
    """Average-tie ranks (rank - 1/2) / n through the inverse distribution; null becomes 0. 'uniform' gives q - 1."""
    from tessera.functions.special import normal_ppf

    q = quantiles(df, column)
    z = normal_ppf(F.col("_q")) if distribution == "normal" else F.col("_q") - 1
    return df.join(q, df[column] == q["_v"], "left").withColumn(out, F.coalesce(z, F.lit(0.0))).drop("_v", "_q")


def quantile_apply(df: DataFrame, train: DataFrame, column: str, out: str) -> DataFrame:
    """Values of any frame on the normal scale fitted on ``train``: each takes the target of the least training value not below it, beyond the last the last's; null becomes 0."""
    from tessera.functions.special import normal_ppf
    from tessera.operators.relate import next_value

    fitted = quantiles(train, column).withColumn("_v", F.col("_v").cast("double"))
    top = F.broadcast(fitted.agg(F.max("_v").alias("_top")))  # one row
    found = next_value(df, train.select(F.col(column)).where(F.col(column).isNotNull()).distinct(), column, "_next").crossJoin(top)
    at = found.withColumn("_at", F.when(F.col(column).isNotNull(), F.coalesce("_next", "_top")))
    return at.join(fitted, F.col("_at") == F.col("_v"), "left").withColumn(out, F.coalesce(normal_ppf(F.col("_q")), F.lit(0.0))).drop("_next", "_top", "_at", "_v", "_q")


# -- packed vectors -------------------------------------------------------------------
def packed_columns(df: DataFrame) -> list[str]:
    """Text columns whose first value is a packed vector; one aggregation."""
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return []
    r = df.agg(*[is_packed(F.first(f"`{c}`", ignorenulls=True)).alias(f"_{i}") for i, c in enumerate(text)]).first()
    return [c for i, c in enumerate(text) if r[i]]


def unpack_columns(df: DataFrame, columns: list[str], at_most: dict[str, int] | None = None) -> DataFrame:
    """Each packed column as ``column_1`` .. ``column_k``; k is the longest vector's length, or the given bound."""
    at_most = at_most or {}
    arrays = df.withColumns({c: F.from_json(f"`{c}`", "array<double>") for c in columns})
    r = arrays.agg(*[F.max(F.size(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    sizes = {c: min(r[i] or 0, at_most.get(c, r[i] or 0)) for i, c in enumerate(columns)}
    return arrays.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[F.get(c, F.lit(i)).alias(f"{c}_{i + 1}") for c in columns for i in range(sizes[c])])


def symmetrised(df: DataFrame, column: str) -> DataFrame:
    from tessera.functions.columns import mirror_average

    return df.withColumn(column, mirror_average(F.col(column)))


# -- whole frames -----------------------------------------------------------------------
def drop_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that lack all of these columns go."""
    return df.dropna(how="all", subset=columns)


def renamed(df: DataFrame, names: dict[str, str] | None = None, prefix: str = "", keep: list[str] = ()) -> DataFrame:
    """Columns by their new names; the others but ``keep`` get the prefix."""
    names = names or {}
    return df.withColumnsRenamed({c: names.get(c, c if c in keep else prefix + c) for c in df.columns})


def without(df: DataFrame, parts: list[str]) -> DataFrame:
    """``df`` without the columns whose names contain one of the parts."""
    return df.drop(*[c for c in df.columns if any(p in c for p in parts)])


def limited(df: DataFrame, key: str, most: int, forced: list = ()) -> DataFrame:
    """The forced rows, and others in order of a hash of their key until there are ``most``; forced rows always stay."""
    must = df.where(F.col(key).isin(*forced)) if forced else df.limit(0)
    room = max(0, most - must.count())
    rest = df.where(~F.col(key).isin(*forced)) if forced else df
    return must.unionByName(rest.orderBy(F.xxhash64(key), key).limit(room))


def expanded_names(names: DataFrame, column: str, sizes: dict[str, int]) -> DataFrame:
    """Rows of a table of names, each packed column's row once for each of its unpacked columns ``name_1`` .. ``name_k``."""
    n = F.lit(0)
    for c, k in sizes.items():
        n = F.when(F.col(column) == c, k).otherwise(n)
    at = F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(0))))
    return names.withColumn("_i", at).withColumn(column, F.when(F.col("_i") > 0, F.concat_ws("_", column, F.col("_i").cast("string"))).otherwise(F.col(column))).drop("_i")


def blocks(n: int, size: int) -> list[tuple[int, int]]:
    """Intervals [start, end) of ``size`` that cover 0 .. n."""
    return [(i, min(i + size, n)) for i in range(0, n, size)]


def cleaned_for_models(df: DataFrame, target: str, features: list[str], rules: dict | None = None, categorical: list[str] = (), drop: float = 1.0, trim: float | None = 6.0) -> tuple[DataFrame, list[str], dict]:
    """The whole preparation in its order: packed vectors to columns, the caller's filters, columns that are missing too often, text that is
    numbers, categories, outliers (set to missing), then rows that lack a value. Also the features that came out, and what was done."""
    done: dict = {"unpacked": [c for c in packed_columns(df) if c in features]}
    if done["unpacked"]:
        df = unpack_columns(df, done["unpacked"])
        features = [x for c in features for x in ([u for u in df.columns if u.startswith(f"{c}_")] if c in done["unpacked"] else [c])]
    for column, rule in (rules or {}).items():
        df = df.where(condition(column, rule))
    df, done["dropped"], done["missing"] = drop_missing(df, features, drop=drop)
    features = [c for c in features if c not in done["dropped"]]
    df, done["salvaged"] = salvage(df, [c for c in features if c not in categorical])
    features = [c for c in features if c in df.columns]
    for c in [c for c in features if c in categorical or done["salvaged"].get(c) == "categorical"]:
        before = set(df.columns)
        df = treatment_coding(df, c).drop(c)
        features = [f for f in features if f != c] + [x for x in df.columns if x not in before]
    numbers = [c for c, t in df.dtypes if c in features and t in ("double", "float", "int", "bigint")]
    if trim is not None and numbers:
        flagged = trim_outliers(df.withColumns({c: F.col(c).cast("double") for c in numbers}), numbers, trim, trim=False)
        df = flagged.withColumns({c: F.when(~F.coalesce(f"{c}_outlier", F.lit(False)), F.col(c)) for c in numbers}).drop(*[f"{c}_outlier" for c in numbers])
    return complete(df, [target, *features]), features, done
