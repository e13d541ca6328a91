"""Token ids in sorted-string-table shards.

A shard holds documents by ascending identifier: blocks of prefix-compressed keys with their ids,
a sparse index (last key, place and size of each block), a Bloom filter of the keys, and a footer.
``Reader.get`` looks at the filter, finds the block by binary search in the index, and reads only that block.

Layout: block* | index | filter | footer. A block is zstd of entries; an entry is three varints
(bytes shared with the key before, further key bytes, value bytes), key bytes, value. A value is ids as little-endian uint16.
The footer is fixed: places and sizes of index and filter, documents, tokens, crc32 of index and filter, magic.

Shards go to the shared folder, each attempt under a name of its own; the manifest names those that count.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import new_path, written

MAGIC = b"TSSSTBL1"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK = 1 << 16
BITS, PROBES = 10, 7
#: Bytes of Parquet that one shard gets, about.
SHARD_BYTES = 16 << 20
#: Zstandard's level, and documents' bytes that are encoded at once.
LEVEL = 1


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort like the id; null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    """Bits of a key in the filter, by double hashing."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard to a binary file; keys come in ascending order, equal ones included."""

    def __init__(self, file) -> None:
        import zstandard

        self.file, self.zip = file, zstandard.ZstdCompressor(LEVEL)
        self.block, self.last, self.at, self.index, self.keys = bytearray(), b"", 0, [], []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        shared = 0
        if self.block:
            if key < self.last:
                raise ValueError("keys must ascend")
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u2").tobytes()
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.last, *self._put(self.zip.compress(bytes(self.block)))))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        bits = max(64, BITS * len(self.keys))
        table = np.zeros(bits, bool)
        for k in self.keys:
            table[probes(k, bits)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(table).tobytes()
        self._put(index)
        self._put(bloom)
        self.file.write(FOOTER.pack(self.at - len(bloom) - len(index), len(index), self.at - len(bloom), len(bloom), len(self.keys), self.tokens, zlib.crc32(index + bloom), MAGIC))


class Reader:
    """Reads one shard from a seekable binary file."""

    def __init__(self, file) -> None:
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        size = file.tell()
        at_index, n_index, at_bloom, n_bloom, self.documents, self.tokens, crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        index, bloom = self._read(at_index, n_index), self._read(at_bloom, n_bloom)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError("not a whole shard")
        self.bits = struct.unpack_from("<Q", bloom)[0]
        self.bloom, self.index, at = bloom[8:], [], 0
        while at < len(index):
            n, at = read_varint(index, at)
            key = index[at : at + n]
            place, at = read_varint(index, at + n)
            length, at = read_varint(index, at)
            self.index.append((key, place, length))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, block: tuple[bytes, int, int]):
        data, at, key = self.unzip.decompress(self._read(*block[1:])), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            more, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            yield key, data, at + more, size
            at += more + size

    def __iter__(self):
        """(doc_id, ids) in order."""
        for block in self.index:
            for key, data, at, size in self._entries(block):
                yield id_of(key), np.frombuffer(data, "<u2", size // 2, at)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this id; reads no block if the filter denies it."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] & 128 >> (p & 7) for p in probes(key, self.bits)):
            return []
        out = []
        for block in self.index[bisect.bisect_left(self.index, key, key=lambda b: b[0]) :]:
            for k, data, at, size in self._entries(block):
                if k == key:
                    out.append(np.frombuffer(data, "<u2", size // 2, at))
                elif k > key:
                    return out
        return out


def opened(uri: str, mode: str = "rb"):
    """A file at any address that Arrow's file systems know; Hadoop's names for S3 are S3 to Arrow."""
    from pyarrow import fs

    for name in ("s3a://", "s3n://"):
        uri = uri.replace(name, "s3://", 1) if uri.startswith(name) else uri
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path) if mode == "rb" else system.open_output_stream(path)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize ``docs`` and write them as shards in ascending id order; the manifest: shard, path, documents, tokens.

    Equal ids are all kept, in order of their text's hash. Null text counts as empty, a null id sorts first.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm_path)

    def run(batches):
        writer = file = path = None
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode_docs(tokenizer, tokens.texts_of(batch.column(1))), strict=True):
                if writer is None:
                    path = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
                    file = opened(path, "wb")
                    writer = Writer(file)
                full = np.empty(len(ids) + 1, np.uint16)
                full[:-1], full[-1] = ids, tokens.END
                writer.add(doc, full)
        if writer is not None:
            writer.close()
            file.close()
            one = [[TaskContext.get().partitionId()], [path], [len(writer.keys)], [writer.tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "documents", "tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = slim.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return written(ordered.mapInArrow(run, "shard int, path string, documents long, tokens long"), "manifest")


def read_shards(manifest: DataFrame, shards: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the shards that the manifest names."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with opened(path) as file:
                    reader, at, rows = Reader(file), first, ([], [], [], [])
                    for doc, ids in reader:
                        for column, v in zip(rows, (doc, at, len(ids), zlib.crc32(ids.astype("<u4"))), strict=True):
                            column.append(v)
                        at += len(ids)
                    if len(rows[0]) != reader.documents or at - first != reader.tokens:
                        raise ValueError(f"{path}: its footer tells other counts")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    placed = manifest.withColumn("first", F.sum("tokens").over(before) - F.col("tokens")).select("shard", "path", "first")
    return placed.repartition(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, shards: int | None = None, **columns) -> DataFrame:
    """Write ``docs`` as shards into the shared folder and return what reading them back gives. An empty table has no shard."""
    spark = docs.sparkSession
    if shards is None:
        total = sum(_size(spark, f) for f in docs.inputFiles())
        shards = max(1, -(-total // SHARD_BYTES))
    return read_shards(write_shards(docs, tokenizer, new_path(spark, "sst"), shards, **columns), shards)


def _size(spark, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
