"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most three bits agree, up to one bit, in one of their two halves. Each
half is indexed once for each of its bits, with that bit left out; equal keys propose pairs, and the whole
distance confirms them. Equal fingerprints are one node, so copies are never paired.

A key that many fingerprints share is not compared all against all: its members go through the same
cut again on the bits that they need not agree in yet (halves of 16, then of 8 bits), until the groups are small.
With all three cuts made, fewer than 2**12 distinct fingerprints can share a key.

``similar`` links texts by the similarity of their sets of shingles. Fingerprints of 128 bits are cut into seven
segments, each indexed once for each of its bits, with that bit left out: texts of similarity 0.8 agree up to one bit in some
segment with probability 0.82, of 0.9 with 0.98, of 0.95 with 0.999. Equal keys propose pairs, the whole distance keeps those that can be similar
enough, and the sets themselves decide. Within a key every text is compared with the key's leaders (texts that had no leader near
them), so copies make rows, not pairs; a segment's value that many texts have is dealt out over several tasks, whose leaders then meet.

What fingerprints and leaders miss is found without chance: with shingles in one order for all texts, two sets of size n and similarity t
have their first common shingle among the first n - ceil(t n) + 1 of each. Texts that share one of these and are not linked so far
are compared; the order puts frequent shingles last, so that they are few. Where many texts share such a shingle they aren't made into pairs:
they come together with the parities of their sets.

Before sets are read, parities are: a set's elements are dealt over a power of two of bits, and a bit is 1 if an odd number came to it. Parities of two
sets differ in at most as many bits as the sets in elements, so pairs that differ in more bits than similar sets may are left out without loss.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import boxed, settled, sliced, small_batches, unboxed, written
from tessera.llm.graph import components

BITS = 64
DISTANCE = 3
#: Words of a shingle.
SHINGLE = 3
#: Members of a key that are compared with each other at once; larger keys are cut further.
GROUP = 4096
#: Bytes of a text that are hashed at once.
SLICE = 1 << 22


def _slices(text: bytes):
    """Word lists of a text, each repeating the last words of the one before, so that no shingle is lost."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit is 1 if it is set in over half of the XXH64 (seed 42) of the lower-cased shingles, repeats included."""
    from xxhash import xxh64_intdigest

    counts, total, carried = np.zeros(64, np.int64), 0, []
    for words in _slices(text.lower()):
        words = carried + words
        if len(words) < shingle:
            carried = words
            continue
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        ends = starts[shingle - 1 :] + lengths[shingle - 1 :]
        hashes = np.array([xxh64_intdigest(line[b:e], 42) for b, e in zip(starts.tolist(), ends.tolist())], np.uint64)  # noqa: B905
        counts += bit_counts(hashes)
        total += len(hashes)
        carried = words[len(words) - shingle + 1 :] if shingle > 1 else []
    if not total and carried:
        counts, total = bit_counts(np.array([xxh64_intdigest(b" ".join(carried), 42)], np.uint64)), 1
    return int.from_bytes(np.packbits((2 * counts > total)[::-1]).tobytes(), "big")


_LANES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set: eight byte lanes are added at once, 255 values at most before they could overflow."""
    out = np.zeros((8, 8), np.int64)
    at = np.arange(0, len(h), 255)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, at)
        out[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out.ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of whole texts; fp is the fingerprint as a signed long. Null and wordless texts: 0."""
    import pyarrow as pa

    def run(batches):
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            fps = np.array([fingerprint(t or b"", shingle) for t in (x.as_py() for x in texts)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame, width: int) -> DataFrame:
    """Rows (fp, key, other): for both segments of ``width`` bits below ``other`` (null: the whole), each with one bit left out.

    ``key`` continues the key that the row had, so that rows meet only within it.
    """
    base = F.coalesce(F.col("other"), F.lit(0))
    grid = F.array(*[F.struct(F.lit(s * width).alias("seg"), F.lit((1 - s) * width).alias("sib"), F.lit(j).alias("bit")) for s in (0, 1) for j in range(width)])
    rows = fps.select("fp", F.col("key").alias("_old"), base.alias("_base"), F.explode(grid).alias("_g"))
    segment = F.expr(f"shiftrightunsigned(fp, _base + _g.seg) & {(1 << width) - 1}L & ~shiftleft(1L, _g.bit)")
    whole = F.expr("shiftleft(cast(_g.seg + _g.bit as bigint), 32)")  # 6 bits that tell segment and bit, above the value
    key = F.when(F.col("_old").isNull(), whole.bitwiseOR(segment)).otherwise(F.xxhash64("_old", "_g.seg", "_g.bit", segment))
    return rows.select("fp", key.alias("key"), (F.col("_base") + F.col("_g.sib")).cast("int").alias("other"))


def _forest(v: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges that span the links among distinct fingerprints: from each to the least of its group."""
    root = np.arange(len(v))
    near = [np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= limit) + i + 1 for i in range(len(v) - 1)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, js in enumerate(near):
        for j in js.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(i, r) for i in range(len(v)) if (r := find(i)) != i]


def links(fps: DataFrame, limit: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Edges (a, b) of fingerprints within ``limit`` (at most 3) bits that connect whatever all such pairs connect. ``fps``: distinct."""
    import pyarrow as pa

    if not 0 <= limit <= 3:
        raise ValueError("two segments that differ by one bit cover distances up to 3")

    def run(batches, last: bool):
        """Rows come sorted by key: compare each run's members, or pass on the rows of a run that is too long."""
        key, held, edges, rest = None, [], [], []

        def close():
            v = np.unique(np.array(held, np.int64))
            if len(v) > 1:
                u = v.view(np.uint64)
                edges.extend((int(v[i]), int(v[r])) for i, r in _forest(u, limit))

        def out():
            cols = [[*(a for a, _ in edges), *(f for f, _, _ in rest)], [*(b for _, b in edges), *(None for _ in rest)], [*(None for _ in edges), *(k for _, k, _ in rest)], [*(None for _ in edges), *(o for _, _, o in rest)]]
            edges.clear(), rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "key", "other"])

        long = other_of = None
        for batch in batches:
            f, k, o = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(k):
                continue
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]).tolist() + [len(k)]
            for b, e in zip(starts, starts[1:]):  # noqa: B905
                if k[b] != key:
                    if not long and len(held) > 1:
                        close()
                    key, held, long, other_of = k[b], [], False, int(o[b])
                    if e - b == 1 and e < len(k):
                        continue  # alone
                if not long:
                    held.extend(f[b:e].tolist())
                    if len(held) > group and not last:
                        rest.extend((x, int(key), other_of) for x in held)
                        held, long = [], True
                else:
                    rest.extend((x, int(key), other_of) for x in f[b:e].tolist())
            if len(edges) + len(rest) > 10_000:
                yield out()
        if not long and len(held) > 1:
            close()
        yield out()

    found, todo = None, fps.select("fp", F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("other"))
    for width in (32, 16, 8):
        dealt = variants(todo, width).repartition("key").sortWithinPartitions("key")
        got = written(dealt.mapInArrow(lambda it, last=width == 8: run(it, last), "a long, b long, key long, other int"), "links")
        edges = got.where("b is not null").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        todo = got.where("b is null").select(F.col("a").alias("fp"), "key", "other").distinct()
        if todo.isEmpty():
            break
    return found.distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links) of each row.

    Rows with equal fingerprints, wordless texts among them, are linked. A null id stays null and is
    never a component's id unless all of its members are null. Repeated rows are returned as often as they come.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes.select("fp"), limit))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), "classes")
    return fps.join(named, fps["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame, **how) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups(docs, **how).select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Fingerprint words, segments, and bits of a segment for texts linked by similarity.
LANES, SEGMENTS, WIDTH = 2, 7, 18
#: Words of a shingle and least similarity of two sets of shingles, unless a caller says otherwise.
WORDS, SIMILAR = 5, 0.8
#: Texts that one value of a segment may bring to one task; rows (ids and hashes, about 100 bytes each) that are broadcast at most.
HOT, FEW = 20_000, 400_000
#: One of so many texts is counted to put frequent shingles last, and the most shingles that are put last. Any order gives the same links.
COUNTED, LAST = 16, 200_000
#: Texts that share a shingle and are made into pairs at once, and, where more share it, texts of a tile.
MEET, TILE = 64, 2048


def _sent(rows: DataFrame) -> DataFrame:
    """A written table of ids and hashes, broadcast if it has been counted small; beyond that texts are shuffled to it."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def shingles(text: bytes, shingle: int = WORDS) -> np.ndarray:
    """Distinct XXH64 (seed 42) of the lower-cased shingles, sorted; fewer words: the whole sequence; none: empty."""
    from xxhash import xxh64_intdigest

    parts, carried, some = [], [], False
    for words in _slices(text.lower()):
        words = carried + words
        carried = words
        if len(words) >= shingle:
            line = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            starts = np.cumsum(lengths + 1) - lengths - 1
            ends = starts[shingle - 1 :] + lengths[shingle - 1 :]
            parts.append(np.array([xxh64_intdigest(line[b:e], 42) for b, e in zip(starts.tolist(), ends.tolist())], np.uint64))  # noqa: B905
            carried, some = words[len(words) - shingle + 1 :] if shingle > 1 else [], True
    if not some and carried:
        parts.append(np.array([xxh64_intdigest(b" ".join(carried), 42)], np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray, lanes: int = LANES) -> list[int]:
    """Signed 64-bit words of a set's fingerprint: a bit is 1 if it is set in over half of the members' mixed hashes."""
    out = []
    for lane in range(lanes):
        h = hashes + np.uint64((lane * 0x9E3779B97F4A7C15) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = 2 * bit_counts(h ^ (h >> np.uint64(31))) > len(h) if len(h) else np.zeros(64, bool)
        out.append(int(np.packbits(bits, bitorder="little").view(np.int64)[0]))
    return out


def parity(hashes: np.ndarray) -> bytes:
    """Of each of at least 64 bits, a power of two from twice the set's size on, whether an odd number of members is dealt to it."""
    m = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(bits: list[bytes], size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the parities and sizes of sets ``i`` and ``j`` (places in ``bits``) allow that similarity; never false for sets that have it."""
    length, ok = np.fromiter(map(len, bits), np.int64, len(bits)) // 8, np.zeros(len(i), bool)
    least = np.minimum(length[i], length[j])
    most = (size[i].astype(np.int64) + size[j]) * (1 - similarity) / (1 + similarity) + 1e-6
    for n in np.unique(least).tolist():
        at = np.flatnonzero(least == n)
        used = np.unique(np.r_[i[at], j[at]])
        # a longer parity is folded: bits that the shorter one does not tell apart are added
        words = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint64).reshape(-1, n), axis=0) for k in used.tolist()])
        x, y, step = np.searchsorted(used, i[at]), np.searchsorted(used, j[at]), max(1, (1 << 19) // n)
        for c in range(0, len(at), step):
            own = slice(c, c + step)
            ok[at[own]] = np.bitwise_count(words[x[own]] ^ words[y[own]]).sum(1, dtype=np.int64) <= most[at[own]]
    return ok


def _row_key(id_col: str, text_col: str) -> list:
    """What tells rows apart: id and a hash of the text."""
    return [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("c")]


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, c, node, size, f0, f1, bits) of each row; equal sets of shingles have one node. ``bits``: the set's parity."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    def run(batches):
        for batch in sliced(batches):
            rows, bits = [[], [], [], []], []
            for t in batch.column(2).cast(pa.large_binary()).to_pylist():
                h = shingles(t or b"", shingle)
                node = xxh64_intdigest(h.tobytes(), 1)
                for column, v in zip(rows, (node - (node >> 63 << 64), len(h), *signature(h)), strict=True):
                    column.append(v)
                bits.append(parity(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(r, pa.int64()) for r in rows], pa.array(bits, pa.binary())], ["id", "c", "node", "size", "f0", "f1", "bits"])

    return small_batches(docs).select(*_row_key(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(run, "id long, c long, node long, size long, f0 long, f1 long, bits binary")


#: Bits of a group's number that tell the parts of a key.
PART = 28


def _leaders(bits: int):
    """A function of Arrow batches sorted by ``group`` (a key and, in its last PART bits, a part): (a, b) of each text and the leaders of its group within ``bits``, and the leaders (b null) of groups that are marked ``hot``."""
    import pyarrow as pa

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int16) <= bits

    def run(batches):
        last, nodes, prints = None, np.zeros(0, np.int64), np.zeros((0, LANES), np.uint64)
        for batch in batches:
            group, node, hot = (batch.column(c).to_numpy() for c in ("group", "node", "hot"))
            key = group >> PART
            fp = np.stack([batch.column(f"f{i}").to_numpy().view(np.uint64) for i in range(LANES)], axis=1)
            if not len(group):
                continue
            out = [[], [], [], [], []]  # a, b, key of leaders and their prints

            def lead(i: np.ndarray) -> None:
                i = i[hot[i] > 0]
                out[0].append(node[i]), out[1].append(np.full(len(i), -1)), out[2].append(i)

            fresh = np.r_[True, group[1:] != group[:-1]]
            cuts = np.flatnonzero(fresh)
            sizes = np.diff(np.r_[cuts, len(group)])
            # groups that lie within this batch and are small: all members against all, one distance in the order at a time
            first, tail = (1 if group[0] == last else 0), len(cuts) - 1
            small = np.zeros(len(cuts), bool)
            small[first:tail] = sizes[first:tail] <= 64
            at = np.flatnonzero(np.repeat(small, sizes))
            follows = np.zeros(len(group), bool)  # has a leader already
            ends = np.repeat(cuts + sizes, sizes)
            step, i, hits = 1, at, ([], [])
            while True:
                i = i[i + step < ends[i]]
                if not len(i):
                    break
                hit = np.bitwise_count(fp[i] ^ fp[i + step]).sum(1) <= bits
                hits[0].append(i[hit]), hits[1].append(i[hit] + step)
                follows[i[hit] + step] = True
                step += 1
            if hits[0]:  # who has leaders near it is paired with them, others with all before them
                i, j = map(np.concatenate, hits)
                led = np.zeros(len(group), bool)
                led[j[~follows[i]]] = True
                own = ~follows[i] | ~led[j]
                out[3].append(node[i[own]]), out[4].append(node[j[own]])
            lead(at[~follows[at]])
            for j in np.flatnonzero(~small).tolist():
                b, e = int(cuts[j]), int(cuts[j] + sizes[j])
                if group[b] != last:
                    last, nodes, prints = group[b], np.zeros(0, np.int64), np.zeros((0, LANES), np.uint64)
                while b < e:
                    own = slice(b, min(e, b + 512))
                    hit = near(fp[own], prints) if len(nodes) else np.zeros((own.stop - b, 0), bool)
                    r, c = np.nonzero(hit)
                    out[3].append(nodes[c]), out[4].append(node[own][r])
                    alone = np.flatnonzero(~hit.any(1)) + b
                    while len(alone):  # the first becomes a leader, and those near it follow
                        nodes, prints = np.append(nodes, node[alone[0]]), np.concatenate([prints, fp[alone[:1]]])
                        lead(alone[:1])
                        close = near(fp[alone[1:]], fp[alone[:1]])[:, 0]
                        out[4].append(node[alone[1:][close]]), out[3].append(np.full(int(close.sum()), node[alone[0]]))
                        alone = alone[1:][~close]
                    b = own.stop
            at = np.concatenate(out[2]) if out[2] else np.zeros(0, np.int64)
            a, b = (np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in (3, 4))
            own = a != b
            a, b = np.minimum(a, b)[own], np.maximum(a, b)[own]
            empty = pa.nulls(len(a), pa.int64())
            columns = [pa.array(np.r_[a, node[at]].astype(np.int64)), pa.concat_arrays([pa.array(b), pa.nulls(len(at), pa.int64())])]
            columns += [pa.concat_arrays([empty, pa.array(v)]) for v in (key[at], *(batch.column(f"f{i}").to_numpy()[at] for i in range(LANES)))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "f0", "f1"])

    return run


def candidates(nodes: DataFrame, bits: int, hot: int = HOT) -> DataFrame:
    """Distinct pairs (a, b) of nodes (node, f0, f1) that share a key and differ in at most ``bits`` bits, each text with its key's leaders."""
    per = 64 // WIDTH
    value = [F.expr(f"shiftrightunsigned(f{k // per}, {k % per * WIDTH}) & {(1 << WIDTH) - 1}L") for k in range(SEGMENTS - 1)]
    # the last segment takes the bits that the others leave over
    left = 64 - per * WIDTH
    value.append(F.expr(f"shiftleft(shiftrightunsigned(f0, {per * WIDTH}) & {(1 << WIDTH // 2) - 1}L, {WIDTH // 2}) | (shiftrightunsigned(f1, {per * WIDTH}) & {(1 << WIDTH // 2) - 1}L)"))
    assert SEGMENTS == LANES * per + 1 and left * 2 >= WIDTH
    cut = nodes.select("node", "f0", "f1", F.posexplode(F.array(*value)).alias("seg", "value"))
    often = written(cut.groupBy("seg", "value").count().where(F.col("count") > hot).select(F.col("seg").alias("s"), F.col("value").alias("v"), F.ceil(F.col("count") / hot).cast("int").alias("parts")), "often")
    marked = cut.join(often, (F.col("seg") == F.col("s")) & (F.col("value") == F.col("v")), "left") if not often.isEmpty() else cut.withColumn("parts", F.lit(None).cast("int"))
    bit = F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("bit")
    keyed = marked.select("node", "f0", "f1", "parts", "seg", "value", bit)
    key = F.expr("((seg * 32L + bit) * 16777216L) + (value & ~shiftleft(1L, bit))")
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")) + 1, F.lit(0))
    keyed = keyed.select("node", "f0", "f1", key.alias("key"), part.alias("part"))
    # a key whose two values are not both frequent would meet itself only in part: its rare side goes to the second round too
    keyed = keyed.select("node", "f0", "f1", "key", (F.col("key") * (1 << PART) + F.col("part")).alias("group"))
    schema = "a long, b long, key long, f0 long, f1 long"
    run = _leaders(bits)
    if often.isEmpty():
        # a row holds nothing that another of its columns tells: there is one for each of a text's keys
        met = keyed.select("node", "f0", "f1", "group").repartition("group").withColumn("hot", F.lit(0)).sortWithinPartitions("group", "node").mapInArrow(run, schema)
        return written(met.select("a", "b").distinct(), "pairs")
    busy = often.select(F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("bit"), F.col("s").alias("seg"), F.col("v").alias("value")).select(key.alias("k")).distinct()
    keyed = keyed.join(busy, F.col("key") == F.col("k"), "left").select("node", "f0", "f1", "group", F.col("k").isNotNull().cast("int").alias("hot"))
    met = written(keyed.repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, schema), "met")
    ahead = met.where("b is null").select(F.col("a").alias("node"), "f0", "f1", (F.col("key") * (1 << PART)).alias("group"), F.lit(0).alias("hot"))
    again = ahead.repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, schema)
    return written(met.where("b is not null").select("a", "b").unionByName(again.select("a", "b")).distinct(), "pairs")


def _frequent(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that some texts share, sorted, and the logarithm of how often: their place in the order, after all others."""
    import pyarrow as pa

    def run(batches):
        for batch in sliced(batches):
            found = [shingles(t or b"", shingle) for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    texts = small_batches(docs).select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0)
    counts = texts.mapInArrow(run, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(LAST)
    found = counts.toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    by = np.argsort(h)
    return h[by], np.log2(found.column("count").to_numpy()[by]).astype(np.int64)


def prefix(hashes: np.ndarray, frequent: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's shingles, as many as must hold one of every set of at least ``similarity``."""
    rank = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rank = np.where(frequent[at] == hashes, place[at], 0)
    return hashes[np.lexsort((hashes, rank))][: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]


ROWS = "key long, root long, node long, before long, size int, at int"


def _meeting(similarity: float, most: int | None = None):
    """A function of Arrow batches sorted by key and root: pairs (a, b) of different roots that can have the key as their first common shingle and be similar enough.

    With ``most``, rows of keys that more rows share are passed on beside the pairs (b null). Rows that have ``bits``, their sets' parities, and a ``part`` make
    pairs that the parities allow; those of one part make none, unless it is -1.
    """
    import pyarrow as pa

    columns, types = ["key", "root", "node", "before", "size", "at"], [*[pa.int64()] * 4, *[pa.int32()] * 2]

    def pairs(key, root, node, before, size, at, part=None, bits=None):
        def can(i, j):
            first = (before[i] != before[j]) | (at[i] == 0) | (at[j] == 0)  # else the shingle before is common, too
            room = np.minimum(size[i] - at[i], size[j] - at[j]) * (1 + similarity) >= similarity * (size[i] + size[j]) - 1e-9
            met = True if part is None else (part[i] != part[j]) | (part[i] < 0)
            return (root[i] != root[j]) & first & room & met

        def out(i, j):
            if bits is not None:
                ok = may_be_similar(bits, size, i, j, similarity)
                i, j = i[ok], j[ok]
            found = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
            made = pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])
            return made if most is None else pa.RecordBatch.from_arrays([*made.columns, *[pa.nulls(made.num_rows, t) for t in types]], ["a", "b", *columns])

        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        sizes, mixed = ends - starts, root[starts] != root[ends - 1]
        end = np.repeat(ends, sizes)
        i, step, hits = np.flatnonzero(np.repeat(mixed & (sizes <= (64 if most is None else most)), sizes)), 1, []
        while len(i := i[i + step < end[i]]):
            hit = i[can(i, i + step)]
            hits.append((hit, hit + step))
            step += 1
        if hits:
            yield out(*map(np.concatenate, zip(*hits, strict=True)))
        large = mixed & (sizes > (64 if most is None else most))
        if most is not None:
            i = np.flatnonzero(np.repeat(large, sizes))
            rows = [pa.array(x[i], t) for x, t in zip((key, root, node, before, size, at), types, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64()), *rows], ["a", "b", *columns])
            return
        for g in np.flatnonzero(large).tolist():
            b, e = int(starts[g]), int(ends[g])
            for c in range(b, e, 64):
                rows = np.arange(c, min(c + 64, e))[:, None]
                # rows of one root pass over the rest of that root
                low = c if root[c] != root[rows[-1, 0]] else b + int(np.searchsorted(root[b:e], root[c], "right"))
                for d in range(low, e, 8192):
                    others = np.arange(d, min(d + 8192, e))[None, :]
                    r, o = np.nonzero(can(rows, others) & (rows < others))
                    if len(r):
                        yield out(rows[r, 0], others[0, o])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
            own = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
            cut = int(np.searchsorted(own[0], own[0][-1]))  # the last key may go on
            held = [x[cut:] for x in own]
            if cut:
                yield from pairs(*[x[:cut] for x in own])
        if held:
            yield from pairs(*held)

    return run


def near_enough(pairs: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that sizes and parities allow; ``parities``: (node, size, bits)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            size = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
            ok = np.minimum(size[:n], size[n:]) >= np.maximum(size[:n], size[n:]) * similarity - 1e-9
            at = np.flatnonzero(ok)
            ok[at] = may_be_similar([*batch.column("x").to_pylist(), *batch.column("y").to_pylist()], size, at, at + n, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(parities.toDF("a", "na", "x"), "a").join(parities.toDF("b", "nb", "y"), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def unlinked(texts: DataFrame, parities: DataFrame, frequent: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different roots among which are all pairs of at least ``similarity``. ``texts``: (node, root, text); ``parities``: (node, size, bits)."""
    import pyarrow as pa

    def run(batches):
        for batch in sliced(batches):
            nodes, roots = (batch.column(c).to_numpy() for c in ("node", "root"))
            sets = [shingles(t or b"", shingle) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            firsts = [prefix(h, *frequent, similarity) for h in sets]
            n = [len(f) for f in firsts]
            before = [np.r_[np.uint64(0), f[:-1]][: len(f)] for f in firsts]
            columns = [np.concatenate(firsts).view(np.int64), np.repeat(roots, n), np.repeat(nodes, n), np.concatenate(before).view(np.int64)]
            columns += [np.repeat([len(h) for h in sets], n).astype(np.int32), np.concatenate([np.arange(k) for k in n]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "root", "node", "before", "size", "at"])

    dealt = texts.mapInArrow(run, ROWS).repartition("key").sortWithinPartitions("key", "root")
    met = written(dealt.mapInArrow(_meeting(similarity, MEET), f"a long, b long, {ROWS}"), "met")
    found = near_enough(met.where("b is not null").select("a", "b").distinct(), parities, similarity)
    large = met.where("b is null").drop("a", "b")
    if large.isEmpty():
        return found
    # rows of a key that many share meet by tiles, so that pairs leave only where the parities allow them
    tiles = large.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    placed = large.join(tiles, F.col("key") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    part = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("part")
    placed = placed.select(key, "root", "node", "before", placed["size"], "at", part).join(parities.select(F.col("node").alias("n"), "bits"), F.col("node") == F.col("n")).drop("n")
    more = placed.repartition("key").sortWithinPartitions("key", "root").mapInArrow(_meeting(similarity), "a long, b long")
    return found.unionByName(more).distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """(id, c, root) of each row: c is a hash of the text; rows whose texts are linked by sets of shingles of at least ``similarity`` (Jaccard) share the root.

    Texts with the same shingles are linked, all texts without words among them. Null text counts as empty.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = written(signatures(docs, id_col, text_col, shingle), "signatures")
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "f0", "f1", "bits")], F.min(F.struct(F.col("id").isNull(), "id", "c")).alias("row"))
    nodes = written(nodes.select("node", "size", "f0", "f1", "bits", F.col("row.id").alias("id"), F.col("row.c").alias("c")), "nodes")
    parities = nodes.select("node", "size", "bits")
    share = 2 * similarity / (1 + similarity)  # the cosine of equal sets; the distance it makes likely, and four deviations more
    p = float(np.arccos(share) / np.pi)
    bits = int(64 * LANES * p + 4 * np.sqrt(64 * LANES * p * (1 - p)))
    pairs = settled(spark, "near", lambda: near_enough(candidates(nodes.where("size > 0").select("node", "f0", "f1"), bits, hot), parities, similarity))

    def sets(batches):
        for batch in sliced(batches):
            blobs = [shingles(t or b"", shingle).tobytes() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["node", "members"])

    def verify(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) if len(v.as_buffer()) else np.zeros(0, np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    all_texts = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("text"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("c") == F.col("k"))

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("n")).unionByName(pairs.select(F.col("b").alias("n"))).distinct()
        held = written(nodes.join(wanted, F.col("node") == F.col("n"), "left_semi").select(F.col("id").alias("i"), F.col("c").alias("k"), "node"), "held")
        texts = all_texts.join(_sent(held), same).select("node", "text")
        members = written(texts.mapInArrow(sets, "node long, members binary").groupBy("node").agg(F.first("members").alias("members")), "members")
        met = pairs.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return met.mapInArrow(verify, "a long, b long")

    linked = settled(spark, "linked", lambda: verified(pairs))
    roots = settled(spark, "roots", lambda: components(linked))
    rooted = nodes.where("size > 0").join(roots.toDF("n", "root"), F.col("node") == F.col("n"), "left")
    rooted = written(rooted.select(F.col("id").alias("i"), F.col("c").alias("k"), "node", F.coalesce("root", "node").alias("root")), "rooted")
    texts = all_texts.join(_sent(rooted), same).select("node", "root", "text")
    pairs = settled(spark, "unlinked", lambda: unlinked(texts, parities, _frequent(docs, text_col, shingle), shingle, similarity))
    more = settled(spark, "linked", lambda: verified(pairs))
    if not more.isEmpty():  # links between components: their roots are joined, and no link is met again
        root = rooted.select("node", "root")
        tops = more.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").select("ra", "rb").distinct()
        tops = settled(spark, "roots", lambda: components(tops, "ra", "rb"))
        roots = root.join(tops.toDF("r", "top"), F.col("root") == F.col("r"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return rows.join(roots, rows["node"] == roots["node"], "left").select("id", "c", F.coalesce("root", rows["node"]).alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the least id (null last), then of the least hash of its text.

    Rows that are alike in id and text are one; other rows that share an id, or have none, are rows of their own.
    """

    def chosen() -> DataFrame:
        rows = similar(docs, id_col, text_col, **how)
        least = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "c")).alias("row"))
        count = rows.groupBy("id", "c").agg(F.count(F.lit(1)).alias("n"))
        return least.select(F.col("row.id").alias("i"), F.col("row.c").alias("k")).join(count, F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("c"))).select("i", "k", "n")

    kept = settled(docs.sparkSession, "kept", chosen)
    key = _row_key(id_col, text_col)
    keyed = boxed(docs, id=key[0], c=key[1])
    on = F.col("id").eqNullSafe(F.col("i")) & (F.col("c") == F.col("k"))
    single = keyed.join(_sent(kept.where("n = 1")), on, "left_semi")
    copies = keyed.join(_sent(kept.where("n > 1")), on, "left_semi").groupBy("id", "c").agg(F.first("_row").alias("_row"))
    return unboxed(single.select("_row").unionByName(copies.select("_row")), docs.columns)
