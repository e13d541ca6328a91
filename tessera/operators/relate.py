"""Joins with the cohort library's rules: added columns, forced rows, intervals, nearest values, families of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ranges


def add_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on the key that adds only columns the left side lacks."""
    return left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key)


def force_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of ``left``; what ``right`` lacks is null."""
    return left.join(right, key, "left")


def outer_concat(left: DataFrame, right: DataFrame, key: str, prefer_right: bool = True) -> DataFrame:
    """Full outer join side by side; a column of both sides is taken from the preferred one."""
    lose, win = (left, right) if prefer_right else (right, left)
    return lose.drop(*[c for c in win.columns if c != key]).join(win, key, "full")


def composite(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality on several columns; no concatenated key."""
    return left.join(right, keys, how)


def interval_join(points: DataFrame, ranges: DataFrame, chrom: str, pos: str, start: str, end: str, width: int, before: int = 0, after: int = 0, base: int = 0, broadcast_rows: int = 100_000) -> DataFrame:
    """Points within ranges, both ends shifted by ``-base`` and padded.

    Few ranges (counted first) are broadcast. Otherwise ranges are dealt to the bins of ``width`` positions that they
    touch and the join is an equality on chromosome and bin; a point stands in one bin, so no pair comes twice.
    """
    r = ranges.withColumns({start: F.col(start) - base - before, end: F.col(end) - base + after})
    inside = F.col(pos).between(F.col(start), F.col(end))
    if ranges.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return points.join(F.broadcast(r.withColumnRenamed(chrom, "_chrom")), (F.col(chrom) == F.col("_chrom")) & inside).drop("_chrom")
    bins = r.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))).withColumnRenamed(chrom, "_chrom")
    p = points.withColumn("_at", F.floor(F.col(pos) / width))
    return p.join(bins, (F.col(chrom) == F.col("_chrom")) & (F.col("_at") == F.col("_bin")) & inside).drop("_chrom", "_bin", "_at")


def next_value(df: DataFrame, reference: DataFrame, value: str, out: str, by: list[str] = ()) -> DataFrame:
    """The least reference value not below each row's value (left search in sorted values), null beyond the last.

    One sort of both sides together, largest first, and one pass that carries the last reference value; with ``by`` each group is
    searched on its own, without it the values are dealt by range, and a range without a successor takes the next ranges' first value.
    """
    a = df.withColumns({"_v": F.col(value).cast("double"), "_side": F.lit(0), "_r": F.lit(None).cast("double")})
    b = reference.select(*by, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_side"), F.col(value).cast("double").alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    carried = lambda w: F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc("_v"), F.desc("_side"))
        return both.withColumn(out, F.when(F.col("_v").isNotNull(), carried(w))).where("_side = 0").drop("_v", "_side", "_r")
    rows = ranges.dealt(both.withColumn("_down", -F.col("_v")), F.col("_down").asc_nulls_last(), F.desc("_side"))
    least = rows.groupBy(F.col("_p").alias("_q")).agg(F.min("_r").alias("_f"))
    above = least.select("_q", F.last("_f", ignorenulls=True).over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    found = rows.withColumn("_own", carried(Window.partitionBy("_p").orderBy("_i"))).where("_side = 0")
    joined = found.join(F.broadcast(above), F.col("_p") == F.col("_q"))  # one row for each range
    return joined.withColumn(out, F.when(F.col("_v").isNotNull(), F.coalesce("_own", "_above"))).drop("_v", "_side", "_r", "_down", "_p", "_i", "_q", "_own", "_above")


def running_total(df: DataFrame, order: str, amount: str, out: str, total: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before it in ``order`` (ties in any order), and over all rows.

    Rows are dealt by range; each range sums its own, and the ranges' totals (one row for each range) are added from a broadcast table.
    """
    rows = ranges.dealt(df, order)
    own = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_own", F.sum(amount).over(own) - F.col(amount)).join(F.broadcast(ranges.before(rows, F.col(amount), "_before", total)), F.col("_p") == F.col("_q"))
    return placed.withColumn(out, F.col("_before") + F.col("_own")).drop("_p", "_i", "_q", "_before", "_own")


def masked_where_different(pairs: DataFrame, notes: DataFrame, key: str, note: str, value: str, fill: float) -> DataFrame:
    """Pairs (source, target) whose annotations differ get ``fill``."""
    a = notes.select(F.col(key).alias("source"), F.col(note).alias("_a"))
    b = notes.select(F.col(key).alias("target"), F.col(note).alias("_b"))
    j = pairs.join(a, "source", "left").join(b, "target", "left")
    return j.withColumn(value, F.when(F.col("_a") != F.col("_b"), F.lit(fill)).otherwise(F.col(value))).drop("_a", "_b")


def best_names(left: DataFrame, right: DataFrame, group: str, name: str, least: float = 95.0) -> DataFrame:
    """Each left name's best right name in its group: exact, then without case, then by edit ratio of at least ``least`` percent."""
    l, r = left.select(group, F.col(name).alias("source")), right.select(group, F.col(name).alias("target"))
    a, b = F.lower("source"), F.lower("target")
    ratio = 100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))
    score = F.when(F.col("source") == F.col("target"), 102.0).when(a == b, 101.0).otherwise(ratio)
    return l.join(r, group).withColumn("score", score).where(F.col("score") >= least).groupBy(group, "source").agg(F.max_by("target", F.struct("score", "target")).alias("target"), F.least(F.max("score"), F.lit(100.0)).alias("score"))


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def missing_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys that ``df`` lacks; empty if a list of subjects is complete."""
    return keys.select(key).distinct().join(df.select(key), key, "left_anti")


def set_feature(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column`` from ``values`` where both have the key, null elsewhere; an old column of that name is replaced."""
    return df.drop(column).join(values.select(key, column), key, "left")
