"""Encoding and decoding with a distinct-word table.

1. Tasks split their texts into words.  A block of texts keeps, for each word in
   turn, its code among the block's distinct words; frequent words have small
   codes.  Distinct words are dealt out by hash, one compressed row for each
   block and part of the hash's range.
2. Together the parts are one table of distinct words: all blocks' words of a part
   meet in one task, and the tokenizer library encodes each of them once.
3. Ids are joined back to the blocks by part and place, and within its block each
   code takes them to its positions: what is shuffled is an entry for each distinct
   word of a block, not for each word of a text.
4. Decoding joins the ids of a block's words with the vocabulary's table from id
   to piece, which has a fixed size and goes to every task.

Defined results: a null or empty text has no tokens and decodes to ''; repeated
rows are encoded one by one; a null id stays null; a text of any length is one
block at most; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Stored, as_bytes, blocks, buffers, needed, release, shuffle_partitions

#: Bytes of text in a block.
TEXT_BLOCK = 32 << 20
#: Blocks are numbered from the task's partition << this.
PARTITION_SHIFT = 32
#: Words that the library encodes at once.
WORDS_AT_ONCE = 20_000
#: Place of a block's codes, after its parts.
CODES = (1 << 31) - 1

#: Parts have words, later ids, as body; codes have texts, too.  sum tells whether parts and codes are of one splitting.
_ROWS = "block long, part int, sum long, body binary, texts binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _shut(*numbers: np.ndarray, rest: bytes = b"") -> bytes:
    """Arrays of numbers and bytes, compressed; the numbers' low bytes stand together, as their high ones do."""
    import zstandard

    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in numbers]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*(len(x).to_bytes(8, "little") for x in numbers), *planes, rest]))


def _opened(body: bytes, *kinds: str) -> tuple:
    """What _shut() was given, numbers as these kinds."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body)
    out, at = [], 8 * len(kinds)
    for k, kind in enumerate(map(np.dtype, kinds)):
        n = int.from_bytes(raw[8 * k : 8 * k + 8], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return *out, raw[at:]


def _split(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of each block: its distinct words by part; its documents and where their words begin, with the codes of all words and each code's part."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << PARTITION_SHIFT
        for block in blocks(batches, "text", TEXT_BLOCK):
            words = bpe.Words(*buffers(as_bytes(block.column("text"))))
            n = len(words.dictionary)
            by_rank = np.argsort(-np.bincount(words.codes, minlength=n), kind="stable")
            rank = np.empty(n, "<u4")
            rank[by_rank] = np.arange(n)
            part = (pd.util.hash_array(np.array([*words.words, None], object)[:-1], categorize=False) % np.uint64(parts)).astype("<u4")[by_rank]
            order = np.argsort(part, kind="stable")
            offsets, data = buffers(words.dictionary.take(pa.array(by_rank[order])))
            bounds = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            some = [k for k in range(parts) if bounds[k] < bounds[k + 1]]
            bodies = [_shut(np.diff(offsets[bounds[k] : bounds[k + 1] + 1]).astype("<u4"), rest=data[offsets[bounds[k]] : offsets[bounds[k + 1]]].tobytes()) for k in some]
            bodies.append(_shut(rank[words.codes], part))
            texts = [b""] * len(some) + [_packed(block.column("doc_id"), words.first)]
            total = zlib.crc32(data) ^ n
            columns = [pa.array([number] * len(bodies)), pa.array([*some, CODES], pa.int32()), pa.array([total] * len(bodies)), pa.array(bodies, pa.binary()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
            number += 1

    return docs.mapInArrow(of, _ROWS)


def _packed(doc_id: pa.Array, first: np.ndarray) -> bytes:
    """Ids that may be null, and numbers one more than they, as bytes: list columns that are null in most rows are slow on their way to Python."""
    ids, valid = np.asarray(doc_id.fill_null(0), "<i8"), np.asarray(doc_id.is_valid(), np.uint8)
    return ids.tobytes() + valid.tobytes() + np.asarray(first, "<i4").tobytes()


def _unpacked(texts: bytes) -> tuple[pa.Array, np.ndarray]:
    n = (len(texts) - 4) // 13
    ids, valid = np.frombuffer(texts, "<i8", n), np.frombuffer(texts, np.uint8, n, 8 * n)
    return pa.array(ids, mask=valid == 0), np.frombuffer(texts, "<i4", n + 1, 9 * n)


def _encoded(split: DataFrame, path: str, parts: int) -> DataFrame:
    """The rows with ids in the place of words: how many each word has, and all as 16-bit numbers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = bpe.encoder(path)
        known: dict[bytes, bytes] = {}  # this task's distinct words

        def ids(body: bytes) -> bytes:
            size, data = _opened(body, "<u4")
            ends = np.cumsum(size, dtype=np.int64).tolist()
            words = [data[a:b] for a, b in zip([0, *ends], ends)]
            new = [w for w in words if w not in known]
            for at in range(0, len(new), WORDS_AT_ONCE):
                some = new[at : at + WORDS_AT_ONCE]
                known.update(zip(some, library.by_library(some), strict=True))
            packed = [known[w] for w in words]
            return _shut(np.fromiter(map(len, packed), "<u4", len(packed)) // np.uint32(2), np.frombuffer(b"".join(packed), "<u2"))

        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                if one.column("part")[0].as_py() != CODES:
                    one = one.set_column(3, "body", pa.array([ids(one.column("body")[0].as_py())], pa.binary()))
                yield one

    # codes go to any task
    to = F.when(F.col("part") == CODES, F.pmod(F.xxhash64("block"), F.lit(parts))).otherwise(F.col("part"))
    return split.repartitionById(parts, to.cast("int")).mapInArrow(of, _ROWS)


_PIECES: dict[str, np.ndarray] = {}


def vocabulary(path: str) -> np.ndarray:
    """The vocabulary's pieces by id, loaded once by each Python worker."""
    if path not in _PIECES:
        by_id = {i: w for w, i in bpe.load(path).get_vocab(with_added_tokens=True).items()}
        _PIECES[path] = np.array([by_id.get(i, "") for i in range(max(by_id) + 1)], object)
    return _PIECES[path]


class _Table:
    """Of a block's words by code: number of ids, ids as text, and pieces as text."""

    def __init__(self, path: str, n: np.ndarray, ids: np.ndarray):
        self.n = n.astype(np.int64)
        # the join of ids with the vocabulary's table: a row of both for each id, in order
        pieces, texts = vocabulary(path)[ids].tolist(), _NUMBERS[ids].tolist()
        ends = np.cumsum(self.n).tolist()
        self.ids = [" ".join(texts[a:b]) if b - a > 1 else texts[a] if b > a else "" for a, b in zip([0, *ends], ends)]
        self.pieces = [" ".join(pieces[a:b]) if b - a > 1 else pieces[a] if b > a else "" for a, b in zip([0, *ends], ends)]

    def of(self, codes: np.ndarray) -> tuple[int, str, str]:
        n = self.n[codes]
        some = codes[n > 0].tolist()
        return int(n.sum()), " ".join([self.ids[k] for k in some]), " ".join([self.pieces[k] for k in some])


_NUMBERS = np.array([str(i) for i in range(1 << 16)], object)


def _assembled(encoded: DataFrame, path: str, row: Callable[[int, str, str], tuple], schema: str) -> DataFrame:
    """Documents from blocks: the ids of their parts, then their codes."""
    names = [x.split()[0] for x in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        sums: set[int] = set()
        for batch in batches:
            for k in range(batch.num_rows):
                _, part, total, body, texts = (c[k].as_py() for c in batch.columns)
                sums.add(total)
                if part != CODES:
                    held.append(_opened(body, "<u4", "<u2"))
                    continue
                codes, parts, _ = _opened(body, "<u4", "<u4")
                if len(sums) > 1 or sum(len(x[0]) for x in held) != len(parts):
                    raise ValueError("words and codes of a block are of different splittings")
                table = _Table(path, *(np.concatenate([x[i] for x in held] or [np.zeros(0, kind)]) for i, kind in enumerate(("<u4", "<u2"))))
                # the words stand by part, and within it by code
                place = np.empty(len(parts), np.int64)
                place[np.argsort(parts, kind="stable")] = np.arange(len(parts))
                codes = place[codes]
                doc_id, first = _unpacked(texts)
                out = [row(*table.of(codes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_id, *(pa.array(list(x)) for x in zip(*out, strict=True))], names=names)
                held, sums = [], set()

    return encoded.repartition(F.col("block")).sortWithinPartitions("block", "part").mapInArrow(of, schema)


def _map(docs: DataFrame, path: str, id_col: str, text_col: str, row: Callable[[int, str, str], tuple], schema: str) -> DataFrame:
    spark = docs.sparkSession
    store = Stored(spark, "words", {"compression": "uncompressed", "parquet.enable.dictionary": "false"})
    parts = shuffle_partitions(spark)
    split = _split(needed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")), parts)
    encoded = store.put(_encoded(split, path, parts))
    del split
    release(spark)
    return _assembled(encoded, path, row, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its ids as decimal text and the decoded text."""
    return _map(docs, path, id_col, text_col, lambda n, ids, text: (n, ids, text), "doc_id long, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with SHA-256 of both texts in their place, so that neither leaves its task."""

    def row(n: int, ids: str, text: str):
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _map(docs, path, id_col, text_col, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
