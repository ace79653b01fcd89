"""Documents packed into containers of a fixed number of tokens, neighbours in content together.

1. Each text is measured in tokens of a public tokenizer. Its token counts, hashed with random signs, are
   projected to DIMS dimensions; the point's place along a Hilbert curve is the document's key.
2. Documents are range-sorted by the key. One that is longer than a container fills containers of its own, and
   its remainder is an item like the others.
3. Each range is packed in one pass: the next BLOCK items along the curve (fewer at the end of an Arrow batch), greatest first, each into the fullest open
   container that has room. Containers that stay open go on to the next block.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydrift.tables import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
DIMS, BITS = 3, 10
#: Items looked at together, containers that may stay open after a block, and items to a range.
BLOCK, OPEN, RANGE = 4096, 64, 50_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _signs(size: int) -> np.ndarray:
    """The projection of each token: DIMS signs from its number."""
    n = np.arange(size, dtype=np.uint64)[:, None] * np.uint64(DIMS) + np.arange(DIMS, dtype=np.uint64)
    n = (n ^ (n >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    n = (n ^ (n >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((n >> np.uint64(63)) & np.uint64(1)).astype(np.int8) * 2 - 1)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows of coordinates below 2**bits).

    Coordinates are turned to Gray-coded transposed form, bit plane by bit plane, and then interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _measure(path: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        signs = _signs(enc.n_vocab)
        for b in batches:
            sizes, points = [], []
            for t in b.column(1).to_pylist():
                ids = enc.encode_to_numpy(t, disallowed_special=()) if t else np.empty(0, np.uint32)
                sizes.append(len(ids))
                points.append(signs.take(ids, axis=0).sum(axis=0, dtype=np.int64))
            n = np.array(sizes, np.int64)
            # A sum of n random signs has deviation sqrt(n); the squashing spreads its usual values over the grid.
            z = np.array(points, np.float64).reshape(-1, DIMS) / np.sqrt(np.maximum(n, 1))[:, None] / 4
            cells = np.clip(((np.tanh(z) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(hilbert_key(cells, BITS))], ["doc_id", "n_tokens", "curve"])

    return measure


class Packer:
    """Best-fit decreasing over blocks of items, with the open containers carried from block to block."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open = capacity, first, []  # open: (room, container), ascending

    def pack(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and offset in it of each item."""
        box, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for k in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[k])
            at = bisect_left(self.open, (size, -1))
            if at < len(self.open):
                room, c = self.open.pop(at)
            else:
                room, c = self.capacity, self.next
                self.next += 1
            box[k], offset[k] = c, self.capacity - room
            insort(self.open, (room - size, c))
        # The fullest are closed first.
        del self.open[:max(0, len(self.open) - OPEN)]
        return box, offset


def _pack(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                box, offset = packer.pack(part.column("size").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in ("doc_id", "n_tokens", "piece", "token_from", "size")] + [pa.array(box), pa.array(offset)],
                    ["doc_id", "n_tokens", "piece", "token_from", "size", "container_id", "container_offset"])

    return pack


def measured(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, curve) of each document. Null and empty texts have no tokens."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(_measure(tokenizer), "doc_id long, n_tokens long, curve long"))


def packed(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """Where the pieces of each measured document go.

    Columns: doc_id, piece (from 0), token_from, size, container_id, container_offset. A document is one piece unless it
    has more than ``capacity`` tokens; then all pieces but the last fill a container each. A document without tokens
    keeps its row, with size 0. Repeated documents are packed each time; every row is kept.
    """
    full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity)
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), full))).withColumn("token_from", F.col("piece") * capacity)
    pieces = pieces.withColumn("size", F.least(F.col("n_tokens") - F.col("token_from"), F.lit(capacity)))
    # A full piece needs no search; its container is numbered by partition and row, below zero.
    whole = (pieces.where(F.col("size") == capacity).withColumn("container_id", -F.monotonically_increasing_id() - 1)
             .withColumn("container_offset", F.lit(0).cast("long")))
    rest = pieces.where(F.col("size") < capacity)
    ranges = max(1, -(-sizes.count() // RANGE))
    boxed = (
        rest.repartitionByRange(ranges, "curve", "doc_id", "piece").sortWithinPartitions("curve", "doc_id", "piece")
        .mapInArrow(_pack(capacity), "doc_id long, n_tokens long, piece long, token_from long, size long, container_id long, container_offset long")
    )
    names = ["doc_id", "piece", "token_from", "size", "container_id", "container_offset"]
    return boxed.select(names).unionByName(whole.select(names))
