"""Total orders over partitions: rows are dealt by range and sorted once, and what follows reads that one deal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import written

#: Bits of a row's number within its range.
BITS = 33


def dealt(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with _p (number of the row's range) and _i (its place there) in the total order ``order``.

    Ranges come from a sample, and a second evaluation may sample others; so the dealt rows are written, and every later step reads those.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_dealt_id", F.monotonically_increasing_id())
    rows = written(placed, "ranges")
    return rows.withColumns({"_p": F.shiftright("_dealt_id", BITS), "_i": F.col("_dealt_id").bitwiseAND(F.lit((1 << BITS) - 1))}).drop("_dealt_id")


def before(rows: DataFrame, amount: Column, out: str, total: str) -> DataFrame:
    """(_q, out, total): for each range the sum of ``amount`` over all ranges before it, and over all; one row for each range."""
    sums = rows.groupBy(F.col("_p").alias("_q")).agg(F.sum(amount).alias("_s"))
    w = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("_q", (F.sum("_s").over(w) - F.col("_s")).alias(out), F.sum("_s").over(Window.partitionBy()).alias(total))
