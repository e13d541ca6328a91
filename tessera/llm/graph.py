"""Connected components of an edge table, in rounds of joins whose results are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node that can be reached.

    Each round takes the least root among a node's neighbours, then jumps from root to root's root, so
    long chains shrink fast. Minima are taken before the shuffle, and a node with many edges
    is only a large group of an aggregation or one side of a join that Spark can split. Null nodes are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = e.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("l"))
    labels = written(labels, "labels")
    while True:
        heard = e.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("h"))
        near = labels.join(heard, "u").select("u", F.col("l").alias("was"), F.least("l", "h").alias("l"))
        roots = near.select(F.col("u").alias("r"), F.col("l").alias("up"))
        jumped = near.join(roots, near["l"] == roots["r"]).select("u", "was", F.least("l", "up").alias("l"))
        done = written(jumped, "labels")
        labels = done.select("u", "l")
        if done.where("was <> l").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("l").alias("root"))
