"""Best-fit packing of token pieces into fixed-length sequences by the sum-of-squares rule.

A piece goes to the open sequence whose choice makes the sum, over residual gaps, of the squared
counts of open sequences smallest; a new sequence is opened where none has room. All pieces are
known beforehand, so they come in falling length, which leaves far fewer sequences open at the end than
arrival order does. Sequences with equal gaps are alike, so the state is one count for each gap.

Pieces are dealt by hash to groups of about ``GROUP`` bytes of text, each packed on its own: more text means more groups.
Spark sorts the pieces of a group, and a task places them as they stream by, so it holds the open sequences'
numbers but no pieces, however large a group is.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import give_back, sliced, small_batches

LENGTH = 1024
#: Bytes of text whose pieces are packed together; tasks that pack at most (each packs its groups in turn); bytes of ids that leave the encoder at once.
GROUP, TASKS, FLUSH = 16 << 20, 20_000, 4 << 20
#: Chunks that a worker remembers where pieces carry their ids, which need room too. It bounds memory and changes no result.
MEMO_IDS = 260_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of a document of n ids: whole ones, but the first may be shorter."""
    k = -(-n // length)
    first = n - (k - 1) * length
    starts = np.concatenate([[0], first + length * np.arange(k - 1)]) if k > 1 else np.zeros(1, np.int64)
    return starts.astype(np.int64), np.concatenate([[first], np.full(k - 1, length)]).astype(np.int64)


class Bins:
    """Csirik et al.'s rule on counts of open bins by gap, for items that come in falling length."""

    def __init__(self, capacity: int = LENGTH) -> None:
        self.capacity, self.used = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of each further item."""
        capacity, count, open_bins = self.capacity, self.count, self.open
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for i, s in enumerate(lengths.tolist()):
            have = count[s:]
            # moving a bin from gap g to g - s changes the sum by 2 (count[g - s] - count[g]) + 2; a filled bin is open no more
            change = 2 * (count[: capacity + 1 - s] - have) + 2
            change[0] = 1 - 2 * have[0]
            change[have == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if have[k]:
                b = open_bins[s + k].pop()
                count[s + k] -= 1
            else:
                b, k = self.used, capacity - s
                self.used += 1
            bins[i], offsets[i] = b, capacity - s - k
            if k:
                count[k] += 1
                open_bins[k].append(b)
        return bins, offsets


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, for items in falling length."""
    return Bins(capacity).place(lengths)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, each with the end id: doc_id, piece, start, length, ids_crc32, ``ids`` (little-endian uint32) if wanted, and ``split``, the task that read it.

    Null text counts as empty: one piece that holds only the end id.
    """
    import pyarrow as pa

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if with_ids else 5]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)] + ["split"]

    def table(rows):
        columns = [pa.array(c, t) for c, t in zip(rows, types, strict=False)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows[0]), TaskContext.get().partitionId(), np.int32))], names)

    def run(batches):
        for batch in sliced(batches):
            rows, held = [[], [], [], [], [], []], 0
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode_docs(tokenizer, tokens.texts_of(batch.column(1)), MEMO_IDS if with_ids else None), strict=True):
                full = np.empty(len(ids) + 1, "<u4")
                full[:-1], full[-1] = ids, tokens.END
                starts, sizes = cut(len(full), length)
                view = memoryview(full)
                for k, (b, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
                    part = view[b : b + n]
                    for column, v in zip(rows, (doc, k, b, n, zlib.crc32(part), bytes(part) if with_ids else None), strict=True):
                        column.append(v)
                held += len(full) * 4 * with_ids
                if held > FLUSH:
                    yield table(rows)
                    rows, held = [[], [], [], [], [], []], 0
            yield table(rows)

    schema = PIECES + (", ids binary" if with_ids else "") + ", split int"
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(parts: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """``parts`` (with doc_id, piece, length, ids_crc32, split) and each one's sequence_id and offset.

    Offsets in a sequence run without gaps from 0. Groups are dealt by doc_id, piece and the task that read the row, so that copies of
    one document do not meet in one group, and ordered by length, doc_id, piece and checksum, so reruns over the same splits agree;
    equal rows are interchangeable.
    """
    import pyarrow as pa

    kept = [f for f in parts.schema.fields if f.name != "split"]

    def run(batches):
        tokens.forget()  # a worker that has tokenized before needs its memo no more
        give_back()
        at, bins = None, Bins(length)
        for batch in batches:
            group, sizes = batch.column("group").to_numpy(), batch.column("length").to_numpy()
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(group) else []
            ids, offsets = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
            for b, e in zip(cuts, [*cuts[1:], len(group)], strict=True):
                if group[b] != at:
                    at, bins = int(group[b]), Bins(length)
                ids[b:e], offsets[b:e] = bins.place(sizes[b:e])
                ids[b:e] += at << 40
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.array(offsets)], [f.name for f in kept] + ["sequence_id", "offset"])

    group = F.pmod(F.xxhash64("doc_id", "piece", "split"), F.lit(groups))
    dealt = parts.select("*", group.alias("group")).drop("split").repartition(min(groups, TASKS), "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return dealt.mapInArrow(run, f"{columns}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False, text_col: str = "text", group: int = GROUP, **columns) -> DataFrame:
    """Tokenize, cut and pack ``docs``; one row per piece. One pass over the text's sizes tells how many groups there are."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return pack(pieces(docs, tokenizer, length, text_col=text_col, with_ids=with_ids, **columns), max(1, -(-total // group)), length)
