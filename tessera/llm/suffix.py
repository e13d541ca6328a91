"""Repeated passages by distributed prefix doubling over sampled positions.

A position's name at length 2h joins the names at length h of the position and of the one h further, so equal
names mean equal strings; names are 64-bit hashes, which tasks double on their own up to the threshold. Spark sorts
(name, position) pairs at two lengths, and only positions that are still not unique go on:

1. Each window of ``LENGTH`` bytes is represented by the least 32-byte name in it (its anchor), so equal windows have
   equal anchors, and only about one position in 35 is sorted. Anchors with a unique name are done. Anchors whose whole
   context (the union of their windows) is equal are ranked by position: all but the first are removed.
2. First anchors that share a name but not the context are doubled to the threshold: each of their windows gets its
   full-length name, and all but the first window of a name are removed.

Names are compared only among positions with the same anchor, which keeps the chance that two different strings meet far below
that of a plain 64-bit hash. Sorted runs are read as a stream; an anchor with more than ``GROUP`` contexts sends its windows
through the shuffle one by one instead of meeting in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

LENGTH, GRAM = 100, 32
#: Contexts of an anchor that are compared in one task; bytes of text whose names are made at once.
GROUP, SLICE = 2000, 1 << 18
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S = np.uint64(29)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name of two names, in order."""
    r = a * _A
    r += b * _B
    r ^= r >> _S
    r *= _C
    r ^= r >> np.uint64(32)
    return r


def names(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 32 and of the 100 bytes that start at each position (as far as there are that many)."""
    n = len(text)
    x = np.empty(n - 7, np.uint64)
    for o in range(min(8, n - 7)):
        x[o::8] = np.frombuffer(text, "<u8", (n - o) // 8, o)[: len(x[o::8])]
    x = _mix(x, np.uint64(1) + (x >> np.uint64(7)))
    for h in (8, 16):
        x = _mix(x[:-h], x[h:])
    gram = x
    x = _mix(x[:-32], x[32:])
    return gram, _mix(x[:-36], x[36:])


def anchors(gram: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` grams the position of its least name, the leftmost of equal ones; windows double."""
    v, q, have = gram, np.arange(len(gram), dtype=np.int32), 1
    while have < width:
        s = min(have, width - have)
        right = v[s:] < v[:-s]
        q = np.where(right, q[s:], q[:-s])
        v = np.minimum(v[s:], v[:-s])
        have += s
    return q


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text number, first window, last window, anchor, anchor's name, context's name)."""
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= SLICE):
            total += len(texts[upto])
            upto += 1
        sizes = np.fromiter(map(len, texts[at:upto]), np.int64, upto - at)
        if upto - at == 1:
            out += [(np.full(len(r[0]), at, np.int64), *r) for r in _long(texts[at])]
        else:
            begin = np.cumsum(sizes) - sizes
            r = _runs(b"".join(texts[at:upto]), begin, begin + sizes)
            if r is not None:
                doc = np.searchsorted(begin, r[0], "right") - 1
                out.append((doc + at, r[0] - begin[doc], r[1] - begin[doc], r[2] - begin[doc], *r[3:]))
        at = upto
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _long(text: bytes):
    """Runs of one long text, in slices. A slice starts where a run starts, and its last run, which may go on, is left to the next; so runs are those of the whole text."""
    n = len(text)
    if n < LENGTH:
        return
    at = 0
    while at <= n - LENGTH:
        end = min(n, at + 4 * SLICE)
        r = _runs(text[at:end], np.array([0]), np.array([end - at]))
        lo, hi, p, g, c = r[0] + at, r[1] + at, r[2] + at, r[3], r[4]
        own = np.ones(len(lo), bool) if end == n else hi < end - LENGTH
        yield lo[own], hi[own], p[own], g[own], c[own]
        if end == n:
            return
        at = int(hi[own][-1]) + 1


def _runs(buf: bytes, begin: np.ndarray, end: np.ndarray):
    if len(buf) < LENGTH:
        return None
    gram, full = names(buf)
    q = anchors(gram, LENGTH - GRAM + 1)
    edge = np.zeros(len(buf) + 1, np.int32)
    long = end - begin >= LENGTH
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, end[long] - LENGTH + 1, -1)
    i = np.flatnonzero(np.cumsum(edge[: len(q)]) > 0)
    if not len(i):
        return None
    p = q[i]
    first = np.r_[True, (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1)]
    starts = np.flatnonzero(first)
    # texts that touch: the next one's first window follows this one's last only if they are apart by LENGTH - 1 positions
    lo, hi, p = i[starts], i[np.r_[starts[1:] - 1, len(i) - 1]], p[starts].astype(np.int64)
    shape = ((hi - lo) << 8 | (p - lo)).astype(np.uint64)
    return lo, hi, p, gram[p], _mix(_mix(full[lo], full[hi]), shape)


def _pack(lo, hi, p):
    return lo << 16 | (hi - lo) << 8 | (p - lo)


def _first(order_keys: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, true where a row begins a run of equal ``same`` in that order)."""
    order = np.lexsort((*order_keys[::-1], *same[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for s in same:
        t = s[order]
        new[1:] |= t[1:] != t[:-1]
    return order, new


def _arrow(columns, schema):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    parts = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)], [n for n, _ in parts])


def _texts(column) -> list[bytes]:
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def _np(batch, *names_):
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names_]


SAMPLED = "k long, c long, doc long, pos long, kind int"
DECIDED = "kind int, doc long, pos long, k long"


def sampled(docs: DataFrame) -> DataFrame:
    """One row per run. Runs that repeat an earlier one of the same batch are decided already (kind 1) and keep away from their name's partition."""

    def run(batches):
        for b in batches:
            doc_ids = b.column(0).to_numpy(zero_copy_only=False)
            t, lo, hi, p, g, c = runs(_texts(b.column(1)))
            doc, pos = doc_ids[t], _pack(lo, hi, p)
            order, new = _first((doc, pos), (g, c))
            kind = np.empty(len(order), np.int32)
            kind[order] = np.where(new, 0, 1)
            k = np.where(kind == 0, g, _mix(doc.astype(np.int64).view(np.uint64), pos.astype(np.int64).view(np.uint64)))
            for i in range(0, len(k), 50_000):
                s = slice(i, i + 50_000)
                yield _arrow([k[s], c[s], doc[s], pos[s], kind[s]], SAMPLED)

    return docs.select("doc", "text").mapInArrow(run, SAMPLED)


def decided(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """From the sorted runs: kind 1 (an equal context comes earlier), and first runs of names with several contexts: kind 2, or 3 for more than ``group``."""

    def run(batches):
        last = None  # (k, c) of the row before
        pending: list[tuple[int, int]] = []  # first runs of the name at hand, while they are at most ``group``
        hot = False

        def settle():
            kind = 2
            got = [(kind, d, p, last[0]) for d, p in pending] if len(pending) > 1 and not hot else []
            pending.clear()
            return got

        for b in batches:
            k, c, doc, pos, kind = _np(b, "k", "c", "doc", "pos", "kind")
            out = [(kind[kind == 1], doc[kind == 1], pos[kind == 1], k[kind == 1])]
            own = kind == 0
            k, c, doc, pos = k[own], c[own], doc[own], pos[own]
            if len(k):
                new_k = np.r_[last is None or k[0] != last[0], k[1:] != k[:-1]]
                new_c = new_k | np.r_[last is None or c[0] != last[1], c[1:] != c[:-1]]
                dup = ~new_c
                out.append((np.ones(int(dup.sum()), np.int32), doc[dup], pos[dup], k[dup]))
                # names with one run alone are the bulk: only the others, and the ends of the batch, are looked at one by one
                heads = np.flatnonzero(new_c)
                starts = np.flatnonzero(new_k[heads])
                sizes = np.diff(np.r_[starts, len(heads)])
                more: list[tuple[int, int, int, int]] = []
                lead = heads[: starts[0]] if len(starts) else heads
                for i in lead.tolist():  # goes on with the name before
                    pending.append((int(doc[i]), int(pos[i])))
                    if hot or len(pending) > group:
                        more += [(3, d, p, last[0]) for d, p in pending]
                        pending.clear()
                        hot = True
                if len(starts):
                    more += settle() if last is not None else []
                    hot = False
                    for j in np.flatnonzero((sizes > 1) & (np.arange(len(sizes)) < len(sizes) - 1)).tolist():
                        part = heads[starts[j] : starts[j] + sizes[j]]
                        out.append((np.full(len(part), 2 if len(part) <= group else 3, np.int32), doc[part], pos[part], k[part]))
                    tail = heads[starts[-1] :].tolist()
                    last = (int(k[-1]), int(c[-1]))
                    pending = [(int(doc[i]), int(pos[i])) for i in tail]
                    if len(pending) > group:
                        more += [(3, d, p, last[0]) for d, p in pending]
                        pending.clear()
                        hot = True
                else:
                    last = (int(k[-1]), int(c[-1]))
                if more:
                    out.append(tuple(np.array(x, t) for x, t in zip(zip(*more, strict=True), (np.int32, np.int64, np.int64, np.int64), strict=True)))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            if len(cols[0]):
                yield _arrow(cols, DECIDED)
        if last is not None and (rest := settle()):
            yield _arrow([list(x) for x in zip(*rest, strict=True)], DECIDED)

    # a row repeated as it is (same document, same place) is no earlier occurrence
    return rows.repartition("k").sortWithinPartitions("k", "c", "doc", "pos").mapInArrow(run, DECIDED)


OPEN = "k long, sub long, doc long, pos long, ctx binary"
SPANS = "doc long, b long, e long"


def _windows(pos: np.ndarray, ctx: list[bytes]):
    """All windows of packed runs: (run number, place, name with the anchor's distance)."""
    lo, more, dist = pos >> 16, pos >> 8 & 255, pos & 255
    _, full = names(b"".join(ctx))
    sizes = np.fromiter(map(len, ctx), np.int64, len(ctx))
    base = np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(pos)), more + 1)
    step = np.arange(len(run)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    return run, lo[run] + step, _mix(full[base[run] + step], (dist[run] - step + 256).astype(np.uint64))


def opened(joined: DataFrame) -> DataFrame:
    """The open runs with their bytes (kind 2), or window by window (kind 3)."""

    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text, open_ in zip(b.column("doc").to_pylist(), _texts(b.column("text")), b.column("open").to_pylist(), strict=True):
                hot = [(o["pos"], o["k"]) for o in open_ if o["kind"] == 3]
                for o in open_:
                    if o["kind"] == 2:
                        lo = o["pos"] >> 16
                        for c, v in zip(rows, (o["k"], 0, doc, o["pos"], text[lo : lo + (o["pos"] >> 8 & 255) + LENGTH]), strict=True):
                            c.append(v)
                if hot:
                    pos, k = np.array([p for p, _ in hot], np.int64), np.array([x for _, x in hot], np.int64)
                    r, at, name = _windows(pos, [text[p >> 16 : (p >> 16) + (p >> 8 & 255) + LENGTH] for p in pos.tolist()])
                    keys = _mix(k.view(np.uint64)[r], name)
                    for c, v in zip(rows, (keys.view(np.int64).tolist(), name.view(np.int64).tolist(), [doc] * len(r), at.tolist(), [None] * len(r)), strict=True):
                        c.extend(v)
            if rows[0]:
                yield _arrow(rows, OPEN)

    return joined.select("doc", "doc_id", "text", "open").mapInArrow(run, OPEN)


def doubled(open_: DataFrame) -> DataFrame:
    """Byte spans of windows whose full-length name occurs earlier."""
    import pyarrow as pa

    def local(t):
        """Runs with bytes, names complete."""
        if not len(t):
            return None
        k, doc, pos = (t.column(n).to_numpy() for n in ("k", "doc", "pos"))
        r, at, name = _windows(pos, t.column("ctx").to_pylist())
        order, new = _first((doc[r], at), (k[r], name))
        # equal document and place: the same window, read twice
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        later = (doc[r][order] != doc[r][order[head]]) | (at[order] != at[order[head]])
        hit = order[later]
        hit = hit[np.lexsort((at[hit], r[hit]))]
        if not len(hit):
            return None
        cut = np.flatnonzero(np.r_[True, (r[hit][1:] != r[hit][:-1]) | (at[hit][1:] != at[hit][:-1] + 1)])
        ends = np.r_[cut[1:] - 1, len(hit) - 1]
        return _arrow([doc[r[hit[cut]]], at[hit[cut]], at[hit[ends]] + LENGTH], SPANS)

    def run(batches):
        import pyarrow.compute as pc

        held, last = None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            alone = t.filter(pc.is_null(t.column("ctx")))
            if len(alone):  # window by window: sorted by name, then place
                k, sub, doc, pos = (alone.column(n).to_numpy() for n in ("k", "sub", "doc", "pos"))
                same = np.r_[last is not None and (int(k[0]), int(sub[0])) == last[:2], (k[1:] == k[:-1]) & (sub[1:] == sub[:-1])]
                head = np.maximum.accumulate(np.where(~same, np.arange(len(k)), -1))
                d0, p0 = np.where(head >= 0, doc[head], last[2] if last else 0), np.where(head >= 0, pos[head], last[3] if last else 0)
                later = (doc != d0) | (pos != p0)
                last = (int(k[-1]), int(sub[-1]), int(d0[-1]), int(p0[-1]))
                if later.any():
                    yield _arrow([doc[later], pos[later], pos[later] + LENGTH], SPANS)
            t = t.filter(pc.is_valid(t.column("ctx")))
            t = t if held is None else pa.concat_tables([held, t])
            k = t.column("k").to_numpy()
            whole = int(np.flatnonzero(k != k[-1])[-1]) + 1 if len(k) and (k != k[-1]).any() else 0
            if whole < 5000 and len(k) < 4 * GROUP:
                held = t
                continue
            held = t.slice(whole)
            if (out := local(t.slice(0, whole))) is not None:
                yield out
        if held is not None and (out := local(held)) is not None:
            yield out

    return open_.repartition("k").sortWithinPartitions(F.col("ctx").isNull(), "k", "sub", "doc", "pos").mapInArrow(run, SPANS)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, text): ``doc`` orders documents and is unique. It is the id itself unless ids repeat or are null."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if d.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return d.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    ordered = d.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "keyed")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``spans``: begin and end of the removed runs) of each document.

    A byte goes if a string of 100 bytes over it also starts earlier. Null text counts as empty. Null ids come
    first; rows that share an id are documents of their own, ordered by a hash of their text, so a repeated row loses its copy.
    """
    base = keyed(docs, id_col, text_col)
    found = written(decided(sampled(base), group), "decided")
    text = base.where("doc is not null").repartition("doc")  # both joins below ask for the same columns and rows, so one exchange serves both
    waiting = found.where("kind > 1").groupBy("doc").agg(F.collect_list(F.struct("kind", "pos", "k")).alias("open")).withColumnRenamed("doc", "d")
    late = doubled(opened(text.join(waiting, F.col("doc") == F.col("d"), "left").where("open is not null")))
    lo = F.shiftright("pos", 16)
    early = found.where("kind = 1").select("doc", lo.alias("b"), (lo + F.shiftright("pos", 8).bitwiseAND(F.lit(255)) + LENGTH).alias("e"))
    spans = early.unionByName(late).groupBy("doc").agg(F.collect_list(F.struct("b", "e")).alias("spans")).withColumnRenamed("doc", "d")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<b:bigint,e:bigint>>" if with_spans else "")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [[] for _ in range(5)]
            for doc_id, data, found_ in zip(b.column("doc_id").to_pylist(), _texts(b.column("text")), b.column("spans").to_pylist(), strict=True):
                cut = _merged([(s["b"], s["e"]) for s in found_ or []])
                h, at = hashlib.sha256(), 0
                for s, e in cut:
                    h.update(data[at:s])
                    at = e
                h.update(data[at:])
                for c, v in zip(rows, (doc_id, len(data), sum(e - s for s, e in cut), h.hexdigest(), [{"b": s, "e": e} for s, e in cut]), strict=True):
                    c.append(v)
            ids, n, gone, sha, cut = rows
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(list(map(len, cut)), pa.int64()), pa.array(sha, pa.string())]
            if with_spans:
                columns.append(pa.array(cut, pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return text.join(spans, F.col("doc") == F.col("d"), "left").select("doc", "doc_id", "text", "spans").mapInArrow(run, schema)
