"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import folder as shared_folder  # noqa: F401  others import them from here
from tessera.scratch import new_path, remove, settled, written  # noqa: F401

#: ASCII white space; what lies between is a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All of a row as the struct ``_row``, and the named columns beside it: whatever names ``docs`` has, none clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def unboxed(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the box again, some of them changed."""
    return df.select(*[(changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in columns])


def with_running(df: DataFrame, arrays: dict[str, Column], step, block: int = 64) -> DataFrame:
    """``df`` with, for each element of arrays of longs, what ``step`` makes of all before it, from 0 on.

    ``step(state, x)`` must also join two states (sum, maximum). Long arrays go in three levels of blocks, so that
    the cost grows with the length and not with its square; each level is a column, so that none is computed twice.
    """
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<long>")

    def scan(a: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), empty.alias("out"))
        return F.aggregate(a, start, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def cut(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(a), F.lit(block)), lambda i: F.slice(a, i, F.lit(block)))

    levels = {n: [f"_{n}_{x}" for x in ("array", "blocks", "totals", "outer", "sums", "firsts")] for n in arrays}
    add = lambda of: {levels[n][of[0]]: of[1](*[F.col(c) for c in levels[n]]) for n in arrays}
    df = df.withColumns({levels[n][0]: arrays[n] for n in arrays})
    df = df.withColumns(add((1, lambda a, *_: F.when(F.size(a) > block, cut(a)))))
    df = df.withColumns(add((2, lambda a, b, *_: F.transform(b, lambda x: F.aggregate(x, zero, step)))))
    df = df.withColumns(add((3, lambda a, b, t, *_: F.when(t.isNotNull(), cut(t)))))
    df = df.withColumns(add((4, lambda a, b, t, o, *_: scan(F.transform(o, lambda x: F.aggregate(x, zero, step)), zero))))
    df = df.withColumns(add((5, lambda a, b, t, o, s, _: F.flatten(F.zip_with(o, s, scan)))))
    df = df.withColumns({n: F.when(F.size(v[0]) > block, F.flatten(F.zip_with(v[1], v[5], scan))).otherwise(scan(F.col(v[0]), zero)) for n, v in levels.items()})
    return df.drop(*[c for v in levels.values() for c in v])


#: Rows that a worker turns into Python objects at once.
ROWS = 512
#: Bytes of an Arrow batch.
BATCH = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold BATCH bytes at most unless it says otherwise: 10,000 whole texts at once take much of an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH))
    return df


def give_back() -> None:
    """Return what a worker has freed to the system: Arrow's pool, and the allocator's where it can. Workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def sliced(batches, rows: int = ROWS):
    """Arrow batches in slices of bounded rows, so that only a slice's texts are Python objects; freed memory goes back after every 16 batches and in the end."""
    for n, batch in enumerate(batches, 1):
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        if n % 16 == 0:
            give_back()
    give_back()
