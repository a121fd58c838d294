"""Problem 9: texts packed into containers of one capacity, neighbours along a space-filling curve together."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, spread
from . import tokens

CAPACITY = 2048
#: The hashed vectors are projected to DIMS dimensions of BITS bits each.
DIMS, BITS = 3, 10
#: Neighbours along the curve are packed in windows of so many items; so many open containers pass to the next window.
WINDOW, OPEN = 4096, 512


def projection(size: int, dims: int = DIMS) -> np.ndarray:
    """A fixed random direction for each token id, the same on every executor.

    In a byte-pair vocabulary an id grows as its token gets rarer, so directions are scaled by its logarithm.
    """
    weight = np.log2(2 + np.arange(size, dtype=np.float32)) / 16
    return np.random.default_rng(20_240_601).standard_normal((size, dims)).astype(np.float32) * weight[:, None]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of integer points (rows, each coordinate below 2**bits) along the Hilbert curve.

    The coordinates are turned into the curve's transposed Gray form from the highest bit down, undoing at each
    level the exchange and reflection of the subcube a point lies in; then their bits are interleaved.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            hit = (x[:, i] & bit) != 0
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(hit, low, swap)
            x[:, i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[:, n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(sizes: np.ndarray, ids: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents, given as the sizes of their lists of token ids and all ids end to end: directions of ids summed, scaled and cut into cells."""
    v = np.zeros((len(sizes), table.shape[1]), np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        n = sizes[some]
        v[some] = np.add.reduceat(table[ids], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
    cells = np.clip((np.tanh(v / 2) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1)
    return hilbert(cells, bits)


class Packer:
    """Containers of one partition: best fit, largest first, over a window of neighbours."""

    def __init__(self, capacity: int, prefix: str):
        self.capacity, self.prefix, self.made = capacity, prefix, 0
        self.open: list[tuple[int, int]] = []  # (free space, number of the container), in order

    def pack(self, sizes: list[int]) -> list[str]:
        """Containers for the items of a window, by position."""
        at = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            j = bisect_left(self.open, (sizes[i], -1))
            if j < len(self.open):
                free, container = self.open.pop(j)
            else:
                free, container = self.capacity, self.made
                self.made += 1
            if free > sizes[i]:
                insort(self.open, (free - sizes[i], container))
            at[i] = container
        # the emptiest stay open for the next neighbours
        self.open = self.open[-OPEN:]
        return [f"{self.prefix}-{c:08d}" for c in at]


def items(docs: DataFrame, capacity: int = CAPACITY, path: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, piece_no, n_tokens, curve_key): each text as one item, one over the capacity as full pieces and a rest.

    Null and empty texts are items of size 0.
    """
    of_byte, merges, texts = tokens.vocabulary(path)
    sent = docs.sparkSession.sparkContext.broadcast((of_byte, merges, tokens.Reach.of(texts), len(texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = table = None
        for batch in batches:
            if merger is None:
                *own, n = sent.value
                merger, table = tokens.Merger(*own), projection(n)
            texts_in = batch.column(1).to_pylist()
            for start, end in tokens.runs(texts_in):
                n_tokens, ids = merger.encode(texts_in[start:end])
                keys = curve_keys(n_tokens, ids, table)
                pieces = np.maximum(1, -(-n_tokens // capacity))
                at = np.repeat(np.arange(len(pieces)), pieces)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(capacity, n_tokens[at] - piece * capacity)
                columns = [batch.column(0).slice(start, end - start).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(keys[at], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece_no", "n_tokens", "curve_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, piece_no int, n_tokens int, curve_key long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, piece_no, n_tokens, container_id): a container for each text or piece of a text.

    Items are range-sorted by Hilbert key; the id breaks ties, so that many copies of one text spread over
    partitions. Each partition packs its neighbours in windows. No text is shuffled, only sizes and keys. No
    container is over ``capacity``; a text within it is never split; items of size 0 lie with their neighbours;
    repeated rows are items each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, f"{TaskContext.get().partitionId():06d}")
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            names = packer.pack(whole["n_tokens"].to_pylist())
            return whole.drop_columns(["curve_key"]).append_column("container_id", pa.array(names, pa.string())).combine_chunks().to_batches()[0]

        for batch in batches:
            for start in range(0, batch.num_rows, WINDOW):
                held.append(batch.slice(start, WINDOW))
                if sum(b.num_rows for b in held) >= WINDOW:
                    yield out()
        if held:
            yield out()

    order = ["curve_key", "doc_id", "piece_no"]
    checkpoint_dir(docs.sparkSession)
    light = items(docs, capacity, path).checkpoint()  # range bounds need a pass of their own: texts are encoded once
    return light.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "doc_id long, piece_no int, n_tokens int, container_id string")


def fill(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: (n_containers, capacity, n_tokens, used_share)."""
    per = pack(docs, capacity).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens")).select(
        "n_containers", F.lit(capacity).alias("capacity"), "n_tokens", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * capacity).alias("used_share")
    )
