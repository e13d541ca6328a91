"""Row-local operators on streams: folds, filters and cleaning need no state, so they run on readStream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import md5_mod
from tessera.operators import prep


def folded(stream: DataFrame, key: str, n_training: int = 10, n_holdout: int = 2, salt: str | None = None) -> DataFrame:
    """Hashed folds without constraints: the same numbers that a batch gets."""
    return stream.withColumn("fold", md5_mod(F.col(key), n_training + n_holdout, salt))


def filtered(stream: DataFrame, rules: dict) -> DataFrame:
    for column, rule in rules.items():
        stream = stream.where(prep.condition(column, rule))
    return stream


def windowed_mean(stream: DataFrame, time: str, value: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts and means by time window; rows later than ``late`` are dropped by the watermark, so state stays bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
