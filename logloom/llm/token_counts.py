"""Token counts with overlap resynchronisation for huge documents.

A huge document is encoded in overlapping chunks with offsets.  A boundary is
proven stable when both chunks start a pre-token at the same character, far
enough from both chunk ends that nothing cut off there can matter:

* the pre-tokenizer scans from left to right without look-behind, so two scans
  that start a match at one character agree from there on;
* a match is only changed by text up to one character behind it, so what the
  left chunk shows more than ``GUARD`` characters before its end is final;
* a special string has fewer than ``GUARD`` characters, so one that lies across
  the boundary would be seen whole by both chunks and leave no boundary there.

The counts left and right of the first such boundary are added.  Without one,
the overlap is widened (doubled) until there is, at last to the whole rest.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted one by one; a null id stays null; texts of any length are counted whole, and
one text is held at once; columns other than the id and the text are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import as_bytes, blocks, buffers, needed

#: Characters in a chunk and in the first overlap tried.
CHUNK_CHARS, OVERLAP_CHARS = 16_384, 256
#: More than the characters of any added token of the vocabularies.
GUARD = 32

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def _starts(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Character offset at which each token begins, and whether it begins a pre-token."""
    at = np.array([a for a, _ in encoding.offsets], dtype=np.int64)
    word = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (word[1:] != word[:-1]) | (word[1:] < 0)
    return at, first


def count_long(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a long text by overlapping chunks; equal to encoding it whole."""
    total, begin, end = 0, 0, min(len(text), chunk)
    left = tokenizer.encode(text[begin:end], add_special_tokens=False)
    # the tokens of the chunk in hand that count begin with number skip
    skip = 0
    while end < len(text):
        wide = overlap
        while True:
            start = max(begin, end - wide)
            stop = min(len(text), max(end, start) + chunk)
            if start <= begin:  # the overlap is the whole chunk: encode both as one
                stop = min(len(text), end + max(chunk, end - begin))  # twice as long, so that no text is encoded many times
                right = tokenizer.encode(text[begin:stop], add_special_tokens=False)
                joined = None
                break
            right = tokenizer.encode(text[start:stop], add_special_tokens=False)
            (la, lf), (ra, rf) = _starts(left), _starts(right)
            la, ra = la + begin, ra + start
            low, high = start + GUARD, end - GUARD
            lk = np.flatnonzero(lf & (la >= low) & (la <= high) & (np.arange(len(la)) >= skip))
            rk = np.flatnonzero(rf & (ra >= low) & (ra <= high))
            # a character that several tokens share is no boundary
            common, i, j = np.intersect1d(la[lk], ra[rk], return_indices=True)
            joined = (int(lk[i[0]]), int(rk[j[0]])) if len(common) else None
            if joined:
                break
            wide *= 2
        if joined is None:
            left, end = right, stop  # begin and skip stay
            continue
        total += joined[0] - skip
        left, skip, begin, end = right, joined[1], start, stop
    return total + len(left.ids) - skip


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Per document: id, UTF-8 bytes and tokens of the whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.encoder(path)
        if any(len(t.content) >= GUARD for t in words.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token is longer than the guard")
        for block in blocks(batches, "text"):
            column = as_bytes(block.column("text"))
            offsets, data = buffers(column)
            size = np.diff(offsets)
            long = np.flatnonzero(size > chunk)
            short = column if not len(long) else pa.array([b"" if n > chunk else x for x, n in zip(column.to_pylist(), size, strict=True)], pa.large_binary())
            n = words.counts(bpe.Words(*buffers(short)))
            for k in long:
                n[k] = count_long(words.tokenizer, column[int(k)].as_py().decode("utf-8", "replace"), chunk, overlap)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(size), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    ids = needed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return ids.mapInArrow(count, SCHEMA)
