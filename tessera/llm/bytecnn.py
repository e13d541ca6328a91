"""Text quality by a byte-level convolutional network in numpy.

Input: each byte of the whole text with one bit that tells whether its word repeats the word before.
Filters see windows of 16 such symbols that overlap by half; a filter's value is the sum of one table entry for each
position, rectified. Values are max-pooled over all windows of the document, and a logistic layer
combines the pooled values into one probability. Training follows only the windows that won the pooling.

The model is fitted on the driver with a bounded sample of labelled rows (ROWS of each class at most and
BYTES of text at most, chosen by hash, whatever the tables' size); scoring streams over everything.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import boxed, give_back, small_batches, unboxed

#: Window, step, filters, symbols (byte and repeat bit).
WIDTH, STEP, FILTERS, SYMBOLS = 16, 8, 16, 512
#: Bound of the sample: rows of each class, bytes of text in all.
ROWS, BYTES = 1200, 8 << 20
#: Passes over the sample at least, batches at least (small samples get more passes), learning rate, and the score from which a text counts as good.
EPOCHS, STEPS, RATE, THRESHOLD = 14, 1000, 0.01, 0.3
#: Bytes whose windows are computed at once.
SLICE = 1 << 18
#: Texts beyond it are read in parts.
LONG = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def symbols(text: bytes) -> np.ndarray:
    """Bytes as 0..255, plus 256 where the word is the same as the one before; padded with spaces to a whole window."""
    b = np.frombuffer(text, np.uint8)
    out = b.astype(np.int16)
    space = _SPACE[b]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(b) else np.zeros(0, np.int64)
    if len(starts) > 1:
        ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        # a word's hash: a difference of running sums of mixed bytes, each weighted by its place in the word
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)])) if starts[0] == 0 else np.r_[np.zeros(starts[0], np.int64), np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))]
        mixed = (b.astype(np.uint64) + np.uint64(1)) * _WEIGHT[place & 63]
        total = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
        h, n = total[ends] - total[starts], ends - starts
        same = np.r_[False, (h[1:] == h[:-1]) & (n[1:] == n[:-1])]
        flag = np.zeros(len(b) + 1, np.int16)
        flag[starts[same]] += 256
        flag[ends[same]] -= 256
        out = out + np.cumsum(flag[:-1], dtype=np.int16)
    short = max(WIDTH - len(b), -(len(b) - WIDTH) % STEP)
    return np.r_[out, np.full(short, 32, np.int16)]


_WEIGHT = np.random.default_rng(64).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Model:
    """Tables (position, symbol, filter), bias, and the logistic layer."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((WIDTH, SYMBOLS, FILTERS)) * 0.1).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = (rng.standard_normal(FILTERS) * 0.3).astype(np.float32)
        self.offset = np.float32(0)

    def pooled(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest value of each filter, start of its window) over all windows of a text."""
        top, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        for at in range(0, len(s) - WIDTH + 1, SLICE):
            part = s[at : at + SLICE + WIDTH - STEP]
            n = (len(part) - WIDTH) // STEP + 1
            z = np.take(self.table[0], part[0 : (n - 1) * STEP + 1 : STEP], axis=0)
            for k in range(1, WIDTH):
                z += np.take(self.table[k], part[k : k + (n - 1) * STEP + 1 : STEP], axis=0)
            best = z.argmax(0)
            value = z[best, np.arange(FILTERS)]
            better = value > top
            top[better], where[better] = value[better], at + best[better] * STEP
        return np.maximum(top + self.bias, 0), where

    def score(self, text: bytes) -> float:
        """Probability of label 1. Empty texts are one window of spaces; long ones go in parts whose windows join without a gap."""
        if len(text) <= LONG:
            h, _ = self.pooled(symbols(text))
        else:
            h = np.zeros(FILTERS, np.float32)
            for at in range(0, len(text), LONG):
                lead = min(at, 1024)  # shows the word before the part
                h = np.maximum(h, self.pooled(symbols(text[at - lead : at + LONG + WIDTH - STEP])[lead:])[0])
        return float(1 / (1 + np.exp(-(h @ self.weight + self.offset))))


def fit(texts: list[bytes], labels: list[int], seed: int = 0, epochs: int = EPOCHS, steps: int = STEPS) -> Model:
    """Adam on batches of 32 texts; classes weigh the same. One class alone, or none, gives a model that answers with it (none: one half)."""
    m, y = Model(seed), np.array(labels, np.float32)
    if len(set(labels)) < 2:
        m.weight[:] = 0
        m.offset = np.float32(0 if not labels else 4 if labels[0] else -4)
        return m
    rng = np.random.default_rng(seed + 1)
    inputs = [symbols(t) for t in texts]
    cost = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    params = [m.table, m.bias, m.weight, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, epochs = 0, max(epochs, -(-steps // -(-len(inputs) // 32)))
    for epoch in range(epochs):
        order = rng.permutation(len(inputs))
        for lo in range(0, len(order), 32):
            grads, rows = [np.zeros_like(p) for p in params], order[lo : lo + 32]
            for i in rows:
                h, where = m.pooled(inputs[i])
                p = 1 / (1 + np.exp(-(h @ m.weight + params[3][0])))
                d = np.float32((p - y[i]) * cost[i] / len(rows))
                back = np.where(h > 0, d * m.weight, 0)
                # windows of the winners: (filter, position) symbols
                won = inputs[i][where[:, None] + np.arange(WIDTH)[None, :]]
                np.add.at(grads[0], (np.arange(WIDTH)[None, :], won, np.arange(FILTERS)[:, None]), back[:, None])
                grads[1] += back
                grads[2] += d * h
                grads[3] += d
            step += 1
            rate = RATE * min(1.0, 2 * (1 - epoch / epochs)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                g += 1e-4 * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    m.offset = params[3][0]
    # put the threshold midway between the classes' near ends, where they are apart
    z = np.array([m.pooled(s)[0] @ m.weight + m.offset for s in inputs])
    low, high = np.quantile(z[y == 0], 0.98), np.quantile(z[y == 1], 0.02)
    if low < high:
        m.offset += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - (low + high) / 2)
    return m


def held_out(doc_id) -> F.Column:
    """Rows whose labels nobody learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = BYTES) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most ``rows`` rows of each class, in hash order, until ``most`` bytes are reached; held-out rows and null labels never."""
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    order = F.xxhash64("doc_id", F.lit("fit"))
    chosen = None
    for c in (0, 1):
        part = own.where(F.col("quality") == c).orderBy(order, "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.collect()  # two bounded lists of ids
    spark = docs.sparkSession
    few = spark.createDataFrame([(r.doc_id, r.quality) for r in ids], "doc_id long, quality int")
    # rows that share an id are one: the text of the least hash, so both lists stay as long as ``chosen``
    text = F.coalesce("text", F.lit(""))
    one = lambda few: docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min_by(text, F.xxhash64(text)).alias("text")).withColumn("h", order)
    got = one(few)
    sizes = sorted((r.h, r.doc_id, r.quality, r.n) for r in got.select("h", "doc_id", "quality", F.octet_length("text").alias("n")).collect())
    take, total = set(), [0, 0]
    for _, doc, q, n in sizes:
        if total[q] + n <= most // 2:
            total[q] += n
            take.add(doc)
    few = spark.createDataFrame([(r.doc_id, r.quality) for r in ids if r.doc_id in take] or [], "doc_id long, quality int")
    texts = sorted((r.h, r.doc_id, r.quality, r.text) for r in one(few).collect())
    return [t.encode() for *_, t in texts], [q for _, _, q, _ in texts]


def trained(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    return fit(*sample(docs.select("doc_id", "text"), labels, **bounds))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column of scores of whole texts; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        out = pa.array([m.score(t.as_py() or b"") for t in texts.cast(pa.large_binary())], pa.float64())
        give_back()
        return out

    return small_batches(docs).withColumn(out, score(F.col(text_col)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null id counts as held out.

    The tables' columns are ``doc_id``, ``text`` and ``doc_id``, ``quality``; others are ignored.
    """
    s = scored(docs.select("doc_id", "text"), trained(docs, labels)).drop("text")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored below the threshold."""
    s = scored(boxed(docs, text=F.col("text")), trained(docs, labels), out="score")
    return unboxed(s.where(F.col("score") >= threshold), docs.columns)


def crc_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
