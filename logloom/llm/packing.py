"""Sequence packing along a Hilbert curve.

Each document's distinct-word hashes are summed into a signed vector of a few
dimensions; the vector's place on a Hilbert curve is its key.  Key and ids are
made in one reading and written to the shared folder, then range-partitioned by
Spark's sample of the keys and sorted (equal keys are spread by a hash of the
id).  Each partition packs its stream of tokens into sequences: neighbours on
the curve share sequences.  Every sequence but a partition's last is full;
the rest of a partition is cut into sequences whose lengths are powers of two,
so nothing is padded.

Defined results: a null or empty text is its end token alone; repeated rows are
packed one by one; a null id stays null; documents of any length are cut into
pieces, and one document's ids are held at once; further columns are ignored; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Stored, as_bytes, blocks, buffers, needed, shuffle_partitions

#: Dimensions of a document vector and bits of each on the curve.
DIMENSIONS, BITS = 4, 10
SEQUENCE, END_TOKEN = 2048, 1
#: Text bytes that one partition packs, about.
PARTITION_BYTES = 128 << 20
#: Bytes of text in a block; a block's distinct words are encoded once.
TEXT_BLOCK = 16 << 20
#: Sequences are numbered from partition << this.
PARTITION_SHIFT = 40

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, d), by the transpose form of Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(block: bpe.Words, dims: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each text from signed sums of its words' hashes, scaled by their standard deviation."""
    hashes = np.fromiter((zlib.crc32(w.strip()) for w in block.words), np.int64, len(block.dictionary))
    signs = np.stack([((hashes >> (7 * k)) & 1) * 2 - 1 for k in range(dims)]) if len(hashes) else np.zeros((dims, 0), np.int64)
    n = np.diff(block.first)
    point = np.empty((len(n), dims), np.int64)
    for k in range(dims):
        sums = np.concatenate([[0], np.cumsum(signs[k][block.codes])])
        scaled = (sums[block.first[1:]] - sums[block.first[:-1]]) / np.sqrt(np.maximum(n, 1))
        share = 1 / (1 + np.exp(-0.8 * scaled))
        point[:, k] = np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    return hilbert(point, bits)


def _spread(doc_ids: pa.Array) -> np.ndarray:
    """16 bits of each id, to tell equal keys apart."""
    ids = np.array(doc_ids.fill_null(0), dtype=np.int64).astype(np.uint64)
    return ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(key, doc_id, ids) of every document (doc_id, text): ids as little-endian 16-bit numbers with the end token."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.encoder(path)
        for block in blocks(batches, "text", TEXT_BLOCK):
            split = bpe.Words(*buffers(as_bytes(block.column("text"))))
            key = (curve_keys(split) << 16) | _spread(block.column("doc_id"))
            ids, at = words.ids(split)
            end = np.array([END_TOKEN], np.uint16).tobytes()
            packed = [ids[a:b].tobytes() + end for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key), block.column("doc_id"), pa.array(packed, pa.binary())], names=["key", "doc_id", "ids"])

    return docs.mapInArrow(of, "key long, doc_id long, ids binary")


class Packer:
    """Packs one partition's stream; pieces of the open sequence wait until it is full."""

    def __init__(self, first_sequence: int, length: int = SEQUENCE):
        self.next, self.length = first_sequence, length
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            some = ids[at : at + self.length - self.filled]
            self.open.append((doc_id, at, some, len(ids)))
            self.filled += len(some)
            at += len(some)
            if self.filled == self.length:
                self.close(self.open)
                self.open, self.filled = [], 0

    def close(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """The rest, as sequences whose lengths are powers of two."""
        rest, self.open = self.open, []
        while rest:
            room, now = 1 << (sum(len(x[2]) for x in rest).bit_length() - 1), []
            while room:
                doc_id, start, ids, n = rest.pop(0)
                now.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], n))
                room -= min(room, len(ids))
            self.close(now)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], names=names)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens, a power of two."""
    spark = docs.sparkSession
    docs = needed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(shuffle_partitions(spark), -(-total // PARTITION_BYTES))
    rows = Stored(spark, "packing", {"parquet.enable.dictionary": "false"}).put(tokenized(docs, path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << PARTITION_SHIFT, length)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                packer.add(doc_id, np.frombuffer(ids.as_buffer(), np.uint16))
            if packer.rows:
                yield packer.take()
        packer.finish()
        if packer.rows:
            yield packer.take()

    # ids at last, so that a task that runs again packs in the same order
    dealt = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(cut, PIECES)
