"""Repeated-substring removal by external, sparse induced sorting.

Every byte inside a string of ``LENGTH`` bytes that also starts somewhere else
goes.  Sorting every suffix of the corpus would take many times its size on
disk, so suffixes are sorted only where a repeat is possible, and the rest of
their order is induced from there:

1. Each window of ``LENGTH`` bytes has one *anchor*: the leftmost of its
   ``GRAM``-byte strings with the least hash.  Equal windows have equal anchors
   at equal places.  Consecutive windows with one anchor are a *stretch*.
2. Stretches are counted by anchor and content.  An anchor that stands once is
   dropped; stretches with equal content are repeats as they are, and one of them
   stands for all.
3. For anchors with several contents, the suffixes that start at the anchor are
   sorted by Spark's external sort, and their common-prefix lengths are taken.
   The order of the suffixes one byte earlier is then induced: the tuples (rank,
   common prefix, stretch) go through first-in-first-out queues, one for each
   preceding byte, which is what a priority queue does here, since all that it
   would compare besides that byte is the order of arrival; a new common prefix
   is one more than the least between two tuples of a queue.  This recurs byte
   by byte until the stretch begins.  A window is a repeat where the common
   prefix with a neighbour reaches ``LENGTH``.  Queues larger than
   ``QUEUE_ROWS`` are kept in memory-mapped files of the task.

Shards are Spark partitions and are streamed; only one anchor's stretches with
different contents are held at once, their matrices on disk if they are many.

Defined results: a null text counts as empty; texts shorter than LENGTH stay;
matches never cross rows; repeated rows (also of one id) are copies of each
other; a null id stays null and is an id like any other; texts of any length are cut
into segments that overlap; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .common import Stored, as_bytes, blocks, buffers, needed, release

LENGTH, GRAM = 200, 32
#: Bytes whose windows are handled at once; positions within need 24 bits.
SEGMENT = 512 << 10
#: Rows of stretches that are induced at once, and beyond which queues are files.
BATCH_ROWS, QUEUE_ROWS = 20_000, 200_000

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not any(k >= n for k in _POWERS):
        size = max(n, SEGMENT + 1024)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return next(iter(_POWERS.values()))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-byte string of data, from prefix sums."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive entries (van Herk 1992)."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    square = padded.reshape(rows, width)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, first window, windows, anchor place) of each stretch of a block, by segments."""
    last = np.maximum(offsets[1:] - (length - 1), offsets[:-1])  # windows of text k start in offsets[k]..last[k]
    for at in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        n = len(part) - length + 1
        h = gram_hashes(part, gram)
        packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_least(packed, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        valid = np.zeros(n + 1, np.int32)
        a, b = np.clip(offsets[:-1] - at, 0, n), np.clip(last - at, 0, n)
        np.add.at(valid, a, 1)
        np.add.at(valid, b, -1)
        valid = np.cumsum(valid[:-1]) > 0
        same = np.zeros(n + 1, bool)
        same[1:-1] = valid[1:] & valid[:-1] & (place[1:] == place[:-1])
        first = np.flatnonzero(valid & ~same[:-1])
        end = np.flatnonzero(valid & ~same[1:]) + 1
        yield h[place[first]].view(np.int64), first + at, end - first, place[first] + at


STRETCH = "anchor long, content long, doc_id long, h long, start long, windows int, lead int"


def _stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Stretches of all texts: place in the text, number of windows, bytes before the anchor, hash of the content."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for block in blocks(batches, "text"):
            offsets, data = buffers(as_bytes(block.column("text")))
            raw = memoryview(np.ascontiguousarray(data))
            for anchor, first, n, place in stretches(data, offsets, length, gram):
                content = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)), np.uint64, len(first))
                text = np.searchsorted(offsets, first, side="right") - 1
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(content.view(np.int64)), block.column("doc_id").take(rows), block.column("h").take(rows), pa.array(first - offsets[text]), pa.array(n.astype(np.int32)), pa.array((place - first).astype(np.int32))],
                    names=[x.split()[0] for x in STRETCH.split(", ")],
                )

    return docs.mapInArrow(of, STRETCH)


def _repeated(found: DataFrame) -> DataFrame:
    """Of all stretches those that may repeat, with copy: another one has this content; and several: its anchor has other contents.

    Contents are counted before they are shuffled, and a join deals the counts out
    again, so that an anchor or a content that stands very often is spread.
    """
    seen = found.groupBy("anchor", "content").agg(F.count("*").alias("n"))
    anchors = seen.groupBy("anchor").agg(F.count("*").alias("contents"), F.max("n").alias("most")).where("contents > 1 OR most > 1")
    flags = seen.join(anchors.select("anchor", "contents"), "anchor").where("n > 1 OR contents > 1")
    return found.join(flags.select("anchor", "content", (F.col("n") > 1).alias("copy"), (F.col("contents") > 1).alias("several")), ["anchor", "content"])


def _heads(repeated: DataFrame) -> DataFrame:
    """The first stretch of each content of anchors that have several."""
    place = F.struct("doc_id", "h", "start", "windows", "lead")
    first = repeated.where("several").groupBy("anchor", "content").agg(F.min(place).alias("first"), F.max("copy").alias("copy"))
    return first.select("anchor", "first.*", "copy")


CONTENT = "anchor long, doc_id long, h long, start long, windows int, copy boolean, lead binary, suffix binary"


def _contents(docs: DataFrame, heads: DataFrame, length: int) -> DataFrame:
    """Heads with their bytes: what leads to the anchor, and the suffix that starts there."""
    lists = heads.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "start", "windows", "lead", "copy")).alias("heads"))
    joined = docs.join(lists, docs.doc_id.eqNullSafe(lists.doc_id) & (docs.h == lists.h)).select(docs.doc_id, docs.h, "text", "heads")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            lists = block.column("heads")
            flat = lists.flatten()
            rows = lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else pa.array(np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())))
            texts = as_bytes(block.column("text")).to_pylist()
            start, windows, lead = (np.asarray(flat.field(c)).tolist() for c in ("start", "windows", "lead"))
            leads, suffixes = [], []
            for k, s, n, a in zip(rows.to_pylist(), start, windows, lead, strict=True):
                leads.append(texts[k][s : s + a])
                suffixes.append(texts[k][s + a : s + n - 1 + length])
            yield pa.RecordBatch.from_arrays(
                [flat.field("anchor"), block.column("doc_id").take(rows), block.column("h").take(rows), flat.field("start"), flat.field("windows"), flat.field("copy"), pa.array(leads, pa.binary()), pa.array(suffixes, pa.binary())],
                names=[x.split()[0] for x in CONTENT.split(", ")],
            )

    return joined.mapInArrow(of, CONTENT)


def _matrix(column: pa.ChunkedArray, width: int, backward: bool, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, read backwards on request, in a file if a folder is given; and their lengths."""
    offsets, data = buffers(as_bytes(column))
    size = np.diff(offsets)
    shape = (len(size), width)
    out = np.memmap(os.path.join(folder, f"{width}-{backward}"), np.uint8, "w+", shape=shape) if folder else np.zeros(shape, np.uint8)
    for at in range(0, len(size), 8192):
        n = size[at : at + 8192]
        row = np.repeat(np.arange(at, at + len(n)), n)
        col = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[row, np.repeat(n, n) - 1 - col if backward else col] = data[offsets[at] : offsets[at] + int(n.sum())]
    return out, size


def _common(suffix: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the row before it."""
    out = np.zeros(len(suffix), np.int32)
    for at in range(1, len(suffix), 8192):
        to = min(at + 8192, len(suffix))
        differ = suffix[at:to] != suffix[at - 1 : to - 1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), suffix.shape[1])
        out[at:to] = np.minimum(first, np.minimum(size[at:to], size[at - 1 : to - 1]))
    return out


def induce(group: np.ndarray, lead: np.ndarray, lead_size: np.ndarray, common: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bytes before the anchor) of every window that repeats.

    Rows are sorted by group and suffix; common[k] is the common prefix of rows
    k-1 and k; lead holds the bytes before the anchor, nearest first.
    """
    member = np.arange(len(group))
    common = common.astype(np.int32)
    begins = np.ones(len(group), bool)
    begins[1:] = group[1:] != group[:-1]
    lowest = lead_size - windows + 1  # the last window starts so many bytes before the anchor
    most = int(lead_size.max(initial=0))
    rows, levels = [], []
    for level in range(most + 1):
        # tuples whose common prefix cannot reach the length any more part here
        begins = begins | (common + (most - level) < length)
        alone = begins & np.append(begins[1:], True)
        if alone.any():
            keep = ~alone
            member, common, begins = member[keep], common[keep], begins[keep]
        if not len(member):
            break
        hit = ~begins & (common >= length)
        hit[:-1] |= hit[1:].copy()
        hit &= (lowest[member] <= level) & (lead_size[member] >= level)
        if hit.any():
            rows.append(member[hit])
            levels.append(np.full(int(hit.sum()), level))
        stay = np.flatnonzero(lead_size[member] > level)
        if not len(stay):
            break
        # queues: stable by (group, byte before)
        byte = lead[member[stay], level]
        part = np.cumsum(begins)[stay]
        order = np.argsort(part * 256 + byte, kind="stable")
        at = stay[order]
        key = (part * 256 + byte)[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new = np.zeros(len(at), np.int32)
        k = np.flatnonzero(~fresh)
        if len(k):
            ends = np.empty(2 * len(k), np.int64)
            ends[::2], ends[1::2] = at[k - 1] + 1, at[k] + 1
            new[k] = np.minimum.reduceat(np.append(common, 0), ends)[::2] + 1
        member, common, begins = member[at], new, fresh
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(levels)


MARK = "doc_id long, h long, start long, windows int"


def _induced(contents: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of repeated windows among heads, anchor by anchor."""
    dealt = contents.repartition(F.col("anchor")).sortWithinPartitions("anchor", "suffix")
    width = length - gram + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            with tempfile.TemporaryDirectory() as folder:
                disk = folder if part.num_rows > QUEUE_ROWS else None
                lead, lead_size = _matrix(part.column("lead"), width, True, disk)
                suffix, suffix_size = _matrix(part.column("suffix"), length, False, disk)
                common = _common(suffix, suffix_size)
                row, level = induce(np.asarray(part.column("anchor")), lead, lead_size, common, np.asarray(part.column("windows")), length)
                del lead, suffix
            new = ~np.asarray(part.column("copy"))[row]  # copies are marked already
            row, level = row[new], level[new]
            start = np.asarray(part.column("start"))[row] + lead_size[row] - level
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            at = tiles.starts(row, start - np.arange(len(start)))
            first = at[:-1]
            rows = pa.array(row[first])
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks().take(rows), part.column("h").combine_chunks().take(rows), pa.array(start[first]), pa.array(np.diff(at).astype(np.int32))],
                names=[x.split()[0] for x in MARK.split(", ")],
            )

        rest: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            rest.append(batch)
            n += batch.num_rows
            if n < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(rest)
            anchor = np.asarray(table.column("anchor"))
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield marks(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks().to_batches()
            n = table.num_rows - cut
        if rest:
            yield marks(pa.Table.from_batches(rest))

    return dealt.mapInArrow(of, MARK)


def marked(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, marks): of docs (doc_id, text, h), the runs of windows that repeat, as a list of (start, windows)."""
    spark = docs.sparkSession
    store = Stored(spark, "suffixes", {"parquet.enable.dictionary": "false"})
    # stretches are found twice, once to be counted: stored, they would take as much disk as the texts
    found = store.put(_repeated(_stretches(docs, length, gram)))
    release(spark)
    induced = store.put(_induced(_contents(docs, _heads(found), length), length, gram))
    release(spark)
    runs = found.where("copy").select("doc_id", "h", "start", "windows").unionByName(induced)
    return store.last(runs.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "windows")).alias("marks")))


def _spans(marks: list, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of bytes (from, to) of one text."""
    start = np.array([m["start"] for m in marks], np.int64)
    end = start + np.array([m["windows"] for m in marks], np.int64) + length - 1
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _with_marks(docs: DataFrame, length: int, gram: int, columns: list[str]) -> DataFrame:
    marks = marked(docs.select("doc_id", "text", "h"), length, gram)
    release(docs.sparkSession)
    return docs.join(marks, docs.doc_id.eqNullSafe(marks.doc_id) & (docs.h == marks.h), "left").select(*(docs[c] for c in columns), "marks")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return needed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, and SHA-256 of what is left."""
    joined = _with_marks(_identified(docs, id_col, text_col), length, gram, ["doc_id", "text"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            out = []
            for text, marks in zip(as_bytes(block.column("text")).to_pylist(), block.column("marks").to_pylist(), strict=True):
                removed = spans = 0
                digest = hashlib.sha256()
                at = 0
                if marks:
                    a, b = _spans(marks, length)
                    removed, spans = int((b - a).sum()), len(a)
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        digest.update(text[at:x])
                        at = y
                digest.update(text[at:])
                out.append((len(text), removed, spans, digest.hexdigest()))
            n, removed, spans, digests = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents, all columns kept, with repeated strings removed from the text.

    A character of which some bytes go, goes whole.
    """
    with_id = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))
    joined = _with_marks(with_id, length, gram, ["row", "text"])

    @F.pandas_udf("string")
    def cut(texts, marks):
        import pandas as pd

        out = []
        for text, runs in zip(texts, marks, strict=True):
            if text is not None and runs is not None and len(runs):
                raw, at, kept = text.encode(), 0, []
                for x, y in zip(*(s.tolist() for s in _spans(runs, length)), strict=True):
                    kept.append(raw[at:x])
                    at = y
                text = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    done = joined.select("row", F.when(F.col("marks").isNull(), F.col("text")).otherwise(cut("text", "marks")).alias("text"))
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
