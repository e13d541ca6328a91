"""Near-duplicate vectors by NN-descent.

The neighbour graph starts from random hyperplane orders: along each, every vector meets those that
stand next to it. Rounds of neighbours-of-neighbours joins then refine it: around each vector its neighbours, in
either direction, are compared with each other, and only pairs that beat the worst entry of a list
travel on. A list that is full of neighbours above the threshold is saturated: it may hide more, in its own component or in another
that is saturated too. Its room is enlarged to the whole of them: members are dealt to tiles that are compared tile by tile, within a component and
between such components whose tiles lie near each other. Lists of that room would be as long as the component, so only their counts are
kept. An audit compares a bounded sample with all vectors; further rounds run until its recall is high enough, and a recall that stays too low is an error.

Equal vectors are one node with a weight, so copies are never paired.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.graph import components

#: Length of a neighbour list before it is enlarged; hyperplane orders of the start, vectors compared along each.
NEIGHBOURS, ORDERS, LEAF = 10, 8, 32
#: A component's tiles: as many as give TILE members each, but no more than SPREAD before a tile holds MOST; tiles of a block of caps, rows of one product.
TILE, SPREAD, MOST, BLOCK, ROWS = 256, 16, 8192, 1024, 1024
#: The audit's sample (never more, whatever the table's size), the recall it wants, the recall below which the result is refused, and the rounds that may be added.
AUDIT, RECALL, LEAST, ROUNDS, MORE = 256, 0.97, 0.9, 2, 3
ARROW = "u long, v long, sim double"


def _unit(column) -> np.ndarray:
    """Rows of unit vectors in double precision."""
    flat = column.flatten() if hasattr(column, "flatten") else column.values
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers would leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(v) -> F.Column:
    """Not null, not empty, not zero, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _batch(rows, names=("u", "v", "sim")):
    import pyarrow as pa

    kinds = {"sim": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(r, kinds.get(n, pa.int64())) for r, n in zip(rows, names, strict=True)], list(names))


def start(nodes: DataFrame, k: int, orders: int, leaf: int, seed: int) -> DataFrame:
    """First lists: the best of the vectors that stand in one leaf of a hyperplane order."""
    import pyarrow as pa

    def codes(batches):
        for b in batches:
            x = _unit(b.column("e"))
            for t in range(orders):
                planes = np.random.default_rng((seed, t)).standard_normal((x.shape[1], 24))
                code = ((x @ planes) > 0) @ (1 << np.arange(23, -1, -1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("e"), pa.array(code + (t << 24))], ["id", "e", "code"])

    def leaves(batches):
        held = None
        for b in _with_end(batches):
            table = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if table is None or not len(table):
                return
            whole = len(table) if b is None else len(table) - len(table) % leaf
            held = table.slice(whole).combine_chunks()
            table = table.slice(0, whole).combine_chunks()
            if not whole:
                continue
            ids, x = table.column("id").to_numpy(), _unit(table.column("e").combine_chunks())
            out = [[], [], []]
            for i in range(0, whole, leaf):
                # a leaf also sees half of the next, so that no pair is parted by its edge alone
                own, all_ = slice(i, min(i + leaf, whole)), slice(i, min(i + leaf + leaf // 2, whole))
                s = x[own] @ x[all_].T
                s[ids[own][:, None] == ids[all_][None, :]] = -2  # a leaf may hold the end of one order and the start of the next
                top = np.argsort(-s, axis=1)[:, :k]
                for j, r in enumerate(top):
                    r = r[s[j, r] > -2]
                    out[0].extend([int(ids[i + j])] * len(r))
                    out[1].extend(ids[all_][r].tolist())
                    out[2].extend(s[j, r].tolist())
            yield _batch(out)

    kind = dict(nodes.dtypes)["e"]
    coded = nodes.select("id", "e").mapInArrow(codes, f"id long, e {kind}, code long")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(n, "code", F.xxhash64("id")).sortWithinPartitions("code", F.xxhash64("id"))
    return best(ordered.mapInArrow(leaves, ARROW), k)


def best(pairs: DataFrame, k: int) -> DataFrame:
    """(u, v, sim) without repeats: the k most similar of each u."""
    once = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("n") <= k)
    return ranked.select("u", "v", "sim")


def around(lists: DataFrame, k: int) -> DataFrame:
    """(u, v): what each vector's neighbourhood holds: its list, itself, and the k nearest of those whose lists hold it."""
    back = best(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"), k)
    return lists.select("u", "v").unionByName(back.select("u", "v")).unionByName(lists.select("u", F.col("u").alias("v"))).distinct()


def compared(nodes: DataFrame, near: DataFrame, worst: DataFrame) -> DataFrame:
    """(u, v, sim) of vectors that meet in a neighbourhood of ``near`` and are more alike than u's ``worst`` (m, worst; -1 for vectors it lacks)."""
    info = nodes.select(F.col("id").alias("i"), "e").join(worst, F.col("i") == F.col("m"), "left").select("i", "e", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
    dealt = near.join(info, F.col("v") == F.col("i")).select("u", "v", "e", "worst").repartition("u").sortWithinPartitions("u")

    def local(batches):
        import pyarrow as pa

        held = None
        for b in _with_end(batches):
            table = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if table is None or not len(table):
                return
            u = table.column("u").to_numpy()
            edges = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            whole = len(u) if b is None else int(edges[-1])
            held = table.slice(whole).combine_chunks()
            table = table.slice(0, whole).combine_chunks()
            if not whole:
                continue
            v, x, w = table.column("v").to_numpy(), _unit(table.column("e").combine_chunks()), table.column("worst").to_numpy()
            cuts = [*edges[edges < whole].tolist(), whole]
            out = [[], [], []]
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
                s = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(s, -2)
                a, c = np.nonzero(s > w[lo:hi, None])
                out[0].append(v[lo:hi][a]), out[1].append(v[lo:hi][c]), out[2].append(s[a, c])
            a, c, s = (np.concatenate(o) if o else np.zeros(0) for o in out)
            order = np.lexsort((c, a))  # a pair that meets in several neighbourhoods of a batch leaves once
            order = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])]] if len(order) else order
            yield _batch([a[order], c[order], s[order]])

    return dealt.mapInArrow(local, ARROW)


def refine(nodes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """One round: around each vector, compare its neighbours with each other and keep what betters a list."""
    worst = lists.groupBy("u").agg(F.min("sim").alias("w"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("m"), F.when(F.col("c") < k, F.lit(-1.0)).otherwise(F.col("w")).alias("worst"))
    return best(lists.unionByName(compared(nodes, around(lists, k), worst)), k)


def saturated(lists: DataFrame, room: int, threshold: float) -> DataFrame:
    """(node): vectors with at least ``room`` neighbours that reach the threshold."""
    return lists.where(F.col("sim") >= threshold).groupBy("u").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= room).select(F.col("u").alias("node"))


def _with_end(batches):
    yield from batches
    yield None


def close_tiles(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(root, t, other, o): ordered pairs of tiles, in one component or two, that may hold a link; a tile is a pair with itself.

    A tile lies in the cap around its mean. Caps whose centres are further apart than both radii and the
    threshold's angle hold no link, so nothing is lost. Caps are compared block by block.
    """
    def cap(key, table):
        import pyarrow as pa

        x = _unit(table.column("e").combine_chunks())
        c = x.sum(0) if np.linalg.norm(x.sum(0)) > 1e-9 else x[0]
        c = c / np.linalg.norm(c)
        return pa.table({"root": [key[0].as_py()], "t": pa.array([key[1].as_py()], pa.int32()), "c": [c.tolist()], "reach": [float(np.arccos(np.clip(x @ c, -1, 1)).max())]})

    caps = written(rows.groupBy("root", "t").applyInArrow(cap, "root long, t int, c array<double>, reach double"), "caps")
    n = max(1, -(-caps.count() // block))
    dealt, every = caps.withColumn("at", F.pmod(F.xxhash64("root", "t"), F.lit(n)).cast("int")), F.sequence(F.lit(0), F.lit(n - 1))
    left = dealt.select("*", F.explode(every).alias("x")).select(F.col("at").alias("a"), F.col("x").alias("b"), F.lit(0).alias("side"), "root", "t", "c", "reach")
    right = dealt.select("*", F.explode(every).alias("x")).select(F.col("x").alias("a"), F.col("at").alias("b"), F.lit(1).alias("side"), "root", "t", "c", "reach")
    angle = float(np.arccos(threshold)) + 1e-6  # more than rounding can take

    def meet(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        l, r = (table.filter(pc.equal(table.column("side"), s)).combine_chunks() for s in (0, 1))
        if not len(l) or not len(r):
            return pa.table({"root": pa.array([], pa.int64()), "t": pa.array([], pa.int32()), "other": pa.array([], pa.int64()), "o": pa.array([], pa.int32())})
        x, y = (_unit(t.column("c").combine_chunks()) for t in (l, r))
        apart = np.arccos(np.clip(x @ y.T, -1, 1))
        i, j = np.nonzero(apart <= l.column("reach").to_numpy()[:, None] + r.column("reach").to_numpy()[None, :] + angle)
        return pa.table({"root": l.column("root").take(i), "t": l.column("t").take(i), "other": r.column("root").take(j), "o": r.column("t").take(j)})

    return written(left.unionByName(right).groupBy("a", "b").applyInArrow(meet, "root long, t int, other long, o int"), "close")


def dense(nodes: DataFrame, members: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(id, root, other, links): linked weight of each member of the components in ``members`` (id, root) in component ``other``, all tiles compared that may hold a link.

    Members are dealt to tiles by hash. A vector is sent once for each tile that its own meets: at most ``SPREAD`` times, or members / ``MOST`` times in components beyond that.
    """
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.greatest(F.ceil(F.col("size") / MOST), F.least(F.lit(SPREAD), F.ceil(F.col("size") / tile)))
    placed = members.join(size, "root").withColumn("t", F.pmod(F.xxhash64("id", F.lit("tile")), tiles).cast("int")).select("id", "root", "t")
    rows = written(nodes.join(placed, "id").select("root", "t", "id", "e", "weight"), "tiles")
    pairs = close_tiles(rows, threshold)
    # each tile meets each tile near it, at home as the rows that count, elsewhere as those that are counted
    names = ["root", "t", "other", "o", "side", "id", "e", "weight"]
    left = rows.join(pairs, ["root", "t"]).withColumn("side", F.lit(0)).select(names)
    right = rows.withColumnsRenamed({"root": "other", "t": "o"}).join(pairs, ["other", "o"]).withColumn("side", F.lit(1)).select(names)

    def meet(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        l, r = (table.filter(pc.equal(table.column("side"), s)).combine_chunks() for s in (0, 1))
        x, y = (_unit(t.column("e").combine_chunks()) for t in (l, r))
        own, theirs, weight = (t.column(c).to_numpy() for t, c in ((l, "id"), (r, "id"), (r, "weight")))
        links = np.concatenate([((x[i : i + ROWS] @ y.T >= threshold) & (own[i : i + ROWS, None] != theirs[None, :])) @ weight for i in range(0, len(x), ROWS)])
        i = np.flatnonzero(links)
        return pa.table({"id": l.column("id").take(i), "root": l.column("root").take(i), "other": pa.array(np.full(len(i), key[2].as_py(), np.int64)), "links": pa.array(links[i])})

    met = left.unionByName(right).groupBy("root", "t", "other", "o").applyInArrow(meet, "id long, root long, other long, links long")
    return met.groupBy("id", "root", "other").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, found: DataFrame, threshold: float, size: int) -> float:
    """Mean over ``size`` hash-chosen vectors that have links of the share of them that ``found`` (id, links) has, against all vectors."""
    import pyarrow as pa

    sample = nodes.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(size).select("id", "e").toArrow().combine_chunks()
    if not len(sample):
        return 1.0
    ids, x = sample.column("id").to_numpy(), _unit(sample.column("e").combine_chunks())

    def count(batches):
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            near = (x @ _unit(b.column("e")).T >= threshold) & (ids[:, None] != b.column("id").to_numpy()[None, :])
            total += near @ b.column("weight").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "n"])

    true = nodes.select("id", "e", "weight").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("n"))
    return true.where("n > 0").join(found, "id", "left").agg(F.coalesce(F.avg(share), F.lit(1.0)).alias("recall")).first()["recall"]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, k: int = NEIGHBOURS, seed: int = 11, wanted: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall: one row per vector.

    Null, zero and non-finite vectors, and those of another length than most, link with nothing. Vectors
    that are equal link with each other. Rows that repeat an id, or have none, are vectors of their own; a null id is a component's id only
    if all of its members' ids are null. An empty table gives an empty table.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"))
    sized = given.where(usable(F.col("e"))).groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sized["d"] if sized else 0
    ok = usable(F.col("e")) & (F.size("e") == dim)
    # two hashes of 64 bits stand for a vector in joins and groups
    given = given.select("vec_id", "e", ok.alias("ok")).withColumns({"h": F.when(F.col("ok"), F.xxhash64("e")), "g": F.when(F.col("ok"), F.xxhash64("e", F.lit("second")))})
    found = given.where("ok").groupBy("h", "g").agg(F.min("vec_id").alias("id0"), F.count(F.lit(1)).alias("weight"), F.first("e").alias("e"))
    nodes = written(found.select(F.col("h").alias("id"), "id0", "e", "weight", "h", "g"), "nodes")
    lists = written(start(nodes, k, ORDERS, LEAF, seed), "lists")
    for _ in range(ROUNDS):
        lists = written(refine(nodes, lists, k), "lists")
    for extra in range(MORE + 1):
        full = written(saturated(lists, k, threshold), "full")
        near = lists.where(F.col("sim") >= threshold)
        both = near.select("u", "v").unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        roots = written(components(near.select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots")
        large = roots.join(full, "node").select("root").distinct()
        members = roots.join(large, "root").select(F.col("node").alias("id"), "root")
        listed = both.join(nodes.select(F.col("id").alias("v"), "weight"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("links"))
        if not full.isEmpty():
            met = written(dense(nodes, members, threshold), "met")
            counted = met.groupBy("id").agg(F.sum("links").alias("links"))
            # a full list can be filled by its own group: links between such components join them
            joined = components(met.where("root <> other").select(F.col("root").alias("a"), F.col("other").alias("b")).distinct()).toDF("root", "top")
            roots = written(roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
            listed = listed.join(members.select("id"), "id", "left_anti").unionByName(counted)
        links = written(listed, "links")
        recall = audit(nodes, links, threshold, AUDIT)
        if recall >= wanted or extra == MORE:
            break
        lists = written(refine(nodes, lists, k), "lists")
    if recall < LEAST:
        raise RuntimeError(f"the audit found {recall:.3f} of the links after {ROUNDS + MORE} rounds; raise k")
    classes = nodes.join(links, "id", "left").join(roots, nodes["id"] == roots["node"], "left").select(
        F.col("h").alias("_h"), F.col("g").alias("_g"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_n"), F.coalesce("root", "id").alias("_root"), "id0"
    )
    classes = written(classes, "classes")
    least = classes.groupBy(F.col("_root").alias("_r")).agg(F.min("id0").alias("_least"))
    classes = classes.join(least, F.col("_root") == F.col("_r")).select("_h", "_g", "_n", "_least")
    kept = F.col("component_id")
    out = given.select("vec_id", "h", "g").join(classes, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left").select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_least", "vec_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == kept, F.lit(False)).alias("kept"), F.lit(recall).alias("audit_recall"))
