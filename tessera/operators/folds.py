"""Deterministic folds: hashed, labelled, contiguous, ratio and random splits as columns, never as row offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import any_true, md5_mod
from tessera.operators import ranges


def relatives(df: DataFrame, together: list[str]) -> F.Column:
    """All relatives of a row as one array; packed strings and nulls are accepted."""
    kinds = dict(df.dtypes)
    parts = [F.coalesce(F.from_json(c, "array<string>") if kinds[c] == "string" else F.col(c).cast("array<string>"), F.array().cast("array<string>")) for c in together]
    return F.array_distinct(F.flatten(F.array(*parts)))


def _listed(df: DataFrame, key: str, together: list[str], families: DataFrame | None, on: str | None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_list``, its list's name, and ``_least``, its family's least key; and the members (_list, m) of each different list, once.

    A family of n is n members here, not n rows of n relatives each.
    """
    own = F.col(key).cast("string")
    if families is None:
        rows = df.withColumn("_members", F.sort_array(F.array_union(F.array(own), relatives(df, together)))).withColumn("_list", F.md5(F.to_json("_members")))
        listed = rows.select("_list", "_members").distinct().select("_list", F.explode("_members").alias("m"))
        return rows.withColumn("_least", F.array_min("_members")).drop("_members"), listed
    name = F.coalesce(F.concat(F.lit("="), F.col(on).cast("string")), F.lit(""))
    listed = families.select(name.alias("_list"), F.explode(relatives(families, together)).alias("m")).distinct()
    least = listed.groupBy("_list").agg(F.min("m").alias("_of"))
    rows = df.withColumn("_list", name)
    return rows.join(least.withColumnRenamed("_list", "_l"), F.col("_list") == F.col("_l"), "left").withColumn("_least", F.least(own, F.col("_of"))).drop("_l", "_of"), listed


def check_together(df: DataFrame, key: str, together: list[str], families: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """Rows whose relatives don't list the same family: (key, relative). Empty if relations are closed and symmetric.

    Lists are columns of ``df``, or of ``families``, which has one row for each value of the column ``on`` that both share.
    Each different list meets its members' lists once; rows come in again only where two differ. Families are compared
    by their size and the sums of two hashes of their members.
    """
    rows, listed = _listed(df, key, together, families, on)
    hashes = lambda c: [F.xxhash64(c, F.lit(seed)).cast("decimal(20,0)") for seed in (1, 2)]
    of = listed.groupBy(F.col("_list").alias("_l")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(hashes("m"))])
    named = rows.select(F.col(key).cast("string").alias("k"), "_list")
    inside = listed.select(F.col("_list").alias("_i"), "m")
    named = named.join(inside, (F.col("_list") == F.col("_i")) & F.col("k").eqNullSafe(F.col("m")), "left").join(of, F.col("_list") == F.col("_l"), "left")
    # a row that its own list leaves out joins it
    extra = [F.when(F.col("_i").isNull(), x).otherwise(F.lit(0)) for x in (F.lit(1), *hashes("k"))]
    mark = F.struct(*[(F.coalesce(F.col(c), F.lit(0)) + x).alias(c) for c, x in zip(("n", "h0", "h1"), extra, strict=True)])
    marked = named.select("k", "_list", mark.alias("mark"))
    theirs = marked.select(F.col("k").alias("m"), F.col("mark").alias("theirs"))
    apart = marked.select("_list", "mark").distinct().join(listed, "_list").join(theirs, "m").where("mark <> theirs")
    return marked.join(apart, ["_list", "mark"]).where("k <> m").select(F.col("k").alias("key"), F.col("m").alias("relative"))


def hashed_folds(
    df: DataFrame,
    key: str,
    n_training: int = 10,
    n_holdout: int = 2,
    keep_in_training: list[str] = (),
    keep_in_holdout: list[str] = (),
    keep_together: list[str] = (),
    salt: str | None = None,
    check: bool = True,
    out: str = "fold",
    families: DataFrame | None = None,
    on: str | None = None,
) -> DataFrame:
    """``df`` with a fold number: 0.. for training, n_training.. for hold-out, -1 for kept-out rows without hold-out folds.

    Flags in ``keep_in_*`` (null: false) bind a row and all its relatives. Families hash by their least key.
    Lists of relatives are columns of ``df``, or of ``families``, one row for each value of the column ``on`` that both share.
    Raises ValueError for impossible counts, and, if ``check``, for open families and contradicting flags.
    """
    if n_training < 1 or n_holdout < 0:
        raise ValueError("n_training must be positive, n_holdout not negative")
    own = F.col(key).cast("string")
    together = list(keep_together)
    rows, listed = _listed(df, key, together, families, on) if together else (df.withColumns({"_list": F.lit(""), "_least": own}), None)
    flagged = rows.withColumns({"_train": any_true(*map(F.col, keep_in_training)) if keep_in_training else F.lit(False), "_hold": any_true(*map(F.col, keep_in_holdout)) if keep_in_holdout else F.lit(False)})
    if together:
        if check and (bad := check_together(df, key, together, families, on).limit(5).collect()):
            raise ValueError(f"families are not closed: {[tuple(r) for r in bad]}")
        if keep_in_training or keep_in_holdout:
            told = flagged.where("_train or _hold").select("_list", own.alias("m"), "_train", "_hold")
            lists = told.groupBy("_list").agg(F.bool_or("_train").alias("_train"), F.bool_or("_hold").alias("_hold")).join(listed, "_list")
            spread = lists.unionByName(told).groupBy(F.col("m").alias("_k")).agg(F.bool_or("_train").alias("_t"), F.bool_or("_hold").alias("_h"))
            flagged = flagged.join(spread, own == F.col("_k"), "left").withColumns({"_train": F.col("_train") | F.coalesce("_t", F.lit(False)), "_hold": F.col("_hold") | F.coalesce("_h", F.lit(False))}).drop("_k", "_t", "_h")
    if check and keep_in_training and keep_in_holdout:
        bad = flagged.where("_train and _hold").select(key).limit(5)
        if not bad.isEmpty():
            raise ValueError(f"both in training and in hold-out: {[r[0] for r in bad.collect()]}")
    hash_key = F.col("_least")
    held = F.lit(n_training) + md5_mod(hash_key, n_holdout, salt) if n_holdout else F.lit(-1)
    fold = F.when(F.col("_train"), md5_mod(hash_key, n_training, salt)).when(F.col("_hold"), held).otherwise(md5_mod(hash_key, n_training + n_holdout, salt))
    return flagged.withColumn(out, fold.cast("int")).drop("_list", "_least", "_train", "_hold")


def in_training(fold: str = "fold", n_training: int = 10) -> F.Column:
    return (F.col(fold) >= 0) & (F.col(fold) < n_training)


def in_holdout(fold: str = "fold", n_training: int = 10) -> F.Column:
    return (F.col(fold) < 0) | (F.col(fold) >= n_training)


def subject_of(key: F.Column) -> F.Column:
    """The second part of a sample key: set_subject_.."""
    return F.split(key, "_")[1]


def labelled_folds(df: DataFrame, label: str, only: list[str] | None = None, out: str = "fold") -> DataFrame:
    """The label's index among the sorted labels; null labels are -1 (always training). ``only``: exactly these labels, null ones dropped too."""
    if only is not None:
        df = df.where(F.col(label).isin(*only))
    labels = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_l")).distinct()
    numbered = labels.withColumn("_n", F.row_number().over(Window.orderBy("_l")) - 1)  # one row for each label
    return df.join(numbered, df[label] == numbered["_l"], "left").withColumn(out, F.coalesce("_n", F.lit(-1)).cast("int")).drop("_l", "_n")


def positions(df: DataFrame, *order: str, out: str = "position") -> DataFrame:
    """``df`` with each row's 0-based place in a total order and ``_all``, the number of rows: places in ranges and the ranges' counts, so no single task sorts everything."""
    rows = ranges.dealt(df, *order)
    placed = rows.join(F.broadcast(ranges.before(rows, F.lit(1), "_before", "_all")), F.col("_p") == F.col("_q"))  # one row for each range
    return placed.withColumn(out, (F.col("_before") + F.col("_i")).cast("long")).drop("_p", "_q", "_i", "_before")


def contiguous_folds(df: DataFrame, k: int, *order: str, out: str = "fold") -> DataFrame:
    """k runs of rows in the given order; the first n mod k are one longer."""
    placed = positions(df, *order)
    q, m, r = F.floor(F.col("_all") / k), F.col("_all") % k, F.col("position")
    fold = F.when(r < m * (q + 1), F.floor(r / (q + 1))).otherwise(m + F.floor((r - m * (q + 1)) / F.greatest(q, F.lit(1))))
    return placed.withColumn(out, fold.cast("int")).drop("position", "_all")


def head_split(df: DataFrame, ratio: float, *order: str, out: str = "is_test") -> DataFrame:
    """The first int(n * ratio) rows are training."""
    placed = positions(df, *order)
    return placed.withColumn(out, F.col("position") >= F.floor(F.col("_all") * F.lit(ratio))).drop("position", "_all")


def random_split(df: DataFrame, key: str, frac: float, seed: int = 1, out: str = "is_test") -> DataFrame:
    """A seeded split that depends on key and seed alone, so it is the same for any partitioning."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumn(out, u >= frac)


def leave_one_out(df: DataFrame, n_training: int = 10, fold: str = "fold") -> DataFrame:
    """Each training row once for each split, with ``split`` and ``is_test``; the number of splits is a constant."""
    return df.where(in_training(fold, n_training)).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_training - 1)))).withColumn("is_test", F.col(fold) == F.col("split"))


def train_test(df: DataFrame, key: str, ratio: float = 0.93, held_out: list = (), removed: list = (), forced_test: list | None = None) -> DataFrame:
    """Sample lists first, then the ratio by key order: removed rows go, held-out and forced ones are test."""
    df = df.where(~F.col(key).isin(*removed)) if removed else df
    if forced_test is not None:
        return df.withColumn("is_test", F.col(key).isin(*forced_test))
    rest = head_split(df.where(~F.col(key).isin(*held_out)) if held_out else df, ratio, key)
    return rest.unionByName(df.where(F.col(key).isin(*held_out)).withColumn("is_test", F.lit(True))) if held_out else rest
