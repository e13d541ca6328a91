"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Native: DataFrame functions only. Row numbers come from hash buckets whose counts are summed up,
so no task sees more than its bucket; equal rows are counted before the shuffle, so a row that is
repeated without end costs one record for each task that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the row numbering; the table of their offsets is broadcast, and never has more rows than this.
BUCKETS = 4096
#: Equal rows that one record stands for after the numbering.
RUN = 4096
ROUNDS = 6


def feistel(x: Column, n: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """Permute 0..a*b-1, where a*b is the least such rectangle (a = ceil(sqrt n)) that holds n numbers."""
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)
    left, right = F.floor(x / b), x % b
    for r in range(rounds):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), right), a), a)
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), left), b), b)
    return left * b + right


def permuted(x: Column, n: Column, seed: int, walk: int = 64) -> Column:
    """Position of row number x after the shuffle: walk the cycle until it is below n again.

    Fewer than ceil(sqrt n) numbers lie outside, so a walk has at most that many steps; ``walk``
    covers every n up to walk squared, and beyond that a longer walk has a chance below 1e-115.
    Such a walk raises an error instead of giving a wrong position.
    """
    step = lambda v: feistel(v, n, seed)
    more = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), x, lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return F.when(x < n, x).when(more < n, more).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def row_numbers(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The key columns with ``row`` (0.., each once) and ``n`` (how many rows there are).

    Rows are numbered by hash bucket of the keys, then by key. Rows with equal keys are
    interchangeable and get successive numbers. Nulls are keys like others.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64(*keys, F.lit("row")), F.lit(buckets)).cast("int"))
    counts = groups.groupBy("_bucket").agg(F.sum("_copies").alias("_in"))
    every = Window.partitionBy()
    offsets = counts.select(
        F.col("_bucket").alias("_b"),
        (F.sum("_in").over(every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")).alias("_before"),
        F.sum("_in").over(every).alias("n"),
    )
    within = Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.withColumn("_start", F.sum("_copies").over(within) - F.col("_copies"))
    placed = placed.join(F.broadcast(offsets), F.col("_bucket") == F.col("_b"))
    # many equal rows leave as runs of bounded length, dealt anew, so that no task writes them all
    start, end = F.col("_before") + F.col("_start"), F.col("_before") + F.col("_start") + F.col("_copies") - 1
    runs = placed.select(*keys, "n", end.alias("_end"), F.explode(F.sequence(start, end, F.lit(RUN).cast("long"))).alias("_at")).repartition("_at")
    return runs.select(*keys, "n", F.explode(F.sequence("_at", F.least("_end", F.col("_at") + (RUN - 1)))).alias("row"))


def shard_rows(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 20240501) -> DataFrame:
    """Give every row its shard and slot: row number -> Feistel -> (position mod shards, position div shards).

    Shard sizes differ by at most one, slots run from 0 without gaps, and both can be computed
    from row number, n and seed alone. An empty table gives an empty table.
    """
    rows = row_numbers(df, keys)
    start = feistel(F.col("row"), F.col("n"), seed)
    rows = rows.withColumn("_once", start).withColumn("position", permuted(F.col("_once"), F.col("n"), seed))
    return rows.select(*keys, "row", "n", (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 20240501) -> DataFrame:
    """Shards of documents under the law ``rows``.

    Only id, size and checksum leave the scan; the text isn't shuffled. Null text counts as
    empty (size 1, checksum 0); null ids and repeated rows are placed like others; other columns
    are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = shard_rows(slim, ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
