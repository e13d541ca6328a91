"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its weight's share of the wanted words, stopped at ``max_epochs`` times
its own size; what a stopped source leaves goes to the others by weight. Sorting the sources by
cap / weight gives the fixed point of that resharing directly, as running sums over one row per source.

Sampling: with r = target / size, each document is taken floor(r) times whole, and the rest of the
target is filled in a seeded order of documents: whole documents, then one cut at a word boundary.
A source's words thus meet its target to the word. The seeded order is dealt over hash buckets whose
sums are added up first, so a source with a third of all rows is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, boxed, unboxed, written
from tessera.operators.folds import positions

WEIGHTS = (5, 2, 1)
BUCKETS = 512


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """From (source, source_size): source, source_size, target. One row per source; null sorts last."""
    every = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = every.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = caps.select(
        "*",
        F.coalesce(F.sum("_cap").over(order), F.lit(0.0)).alias("_caps_before"),
        F.coalesce(F.sum("_w").over(order), F.lit(0.0)).alias("_w_before"),
        F.sum("_w").over(every).alias("_w_all"),
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("_want"),
    )
    # the level if exactly the sources before this one were stopped; the first source whose cap is above it ends the rise
    level = (F.col("_want") - F.col("_caps_before")) / (F.col("_w_all") - F.col("_w_before"))
    filled = filled.withColumn("_level", level)
    free = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(every)
    return filled.withColumn("_at", free["_level"]).select(
        "source", "source_size", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w"))).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies (whole), part (words of one more, cut copy).

    Null text has size 0 and is taken 0 words; a null source is a source of its own, last in order.
    Repeated rows are rows of their own. Reruns agree: the order depends on seed, id and size only.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = sized.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    sized = sized.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(BUCKETS)).cast("int"))
    within = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # narrow rows, written once: every later step reads these, and words are counted in one pass over the texts
    sized = written(sized, "sizes").repartition("source", "_bucket")
    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_in"))
    goal = targets(sums.groupBy("source").agg(F.sum("_in").alias("source_size")), **how)
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = sums.withColumn("_before", F.sum("_in").over(ahead) - F.col("_in"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = before.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        F.col("b.source").alias("_s"), F.col("b._bucket").alias("_b"), "_before", "source_size", "target", whole.alias("_whole"),
        (F.round(F.col("target")).cast("long") - whole * F.col("source_size")).alias("_rest"),
    )
    placed = sized.withColumn("_at", F.sum("size").over(within) - F.col("size"))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.col("_at"))).cast("long")
    full = (extra == F.col("size")) & (F.col("size") > 0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") * F.col("size") + extra).alias("taken"),
        (F.col("_whole") + full.cast("long")).alias("copies"),
        F.when(full, F.lit(0)).otherwise(extra).cast("long").alias("part"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word (n at least 1)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.split(text, WORD, -1)
    kept = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), n.cast("int")), F.slice(words, F.lit(1), n.cast("int"))), lambda p: F.concat(p["0"], p["1"]))
    return F.array_join(kept, "")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: each document as often as the mix takes it.

    Whole copies are unchanged; a fractional copy is the document up to the end of its last taken word. Rows that are
    equal in id, source and size share their words evenly; what is left over goes to the first ones, one word each.
    """
    m = written(mix(docs, id_col, source_col, text_col, **how).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("_sum"), F.count(F.lit(1)).alias("_rows")), "takes")
    m = m.where("_sum > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_sz"), "_sum", "_rows")
    keyed = boxed(docs, id=F.col(id_col), source=F.col(source_col), text=F.col(text_col), size=word_count(F.col(text_col)))
    on = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("size") == F.col("_sz"))
    joined = keyed.join(m.where("_rows = 1"), on).withColumn("_take", F.col("_sum"))
    alike = m.where("_rows > 1")
    if not alike.isEmpty():
        placed = positions(keyed.join(alike, on).withColumn("_n", F.monotonically_increasing_id()), "id", "source", "size", "_n")
        first = placed.groupBy("id", "source", "size").agg(F.min("position").alias("_first")).select(F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_first")
        same = F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
        more = (F.col("position") - F.col("_first") < F.col("_sum") % F.col("_rows")).cast("long")
        shared = placed.join(first, same).withColumn("_take", F.floor(F.col("_sum") / F.col("_rows")) + more)
        joined = joined.unionByName(shared.select(joined.columns))
    # -1: a whole copy
    part = F.col("_take") % F.col("_sz")
    takes = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("_take") / F.col("_sz")).cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    out = joined.where("_take > 0").withColumn("_copy", F.explode(takes))
    text = F.when(F.col("_copy") < 0, F.col("text")).otherwise(first_words(F.col("text"), F.col("_copy")))
    return unboxed(out, docs.columns, **{text_col: text})
