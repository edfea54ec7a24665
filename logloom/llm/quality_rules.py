"""Quality rules: base counts of each text, and an isolation forest on rule statistics.

The base rules fail texts with too few words or too many repeated ones.  For
the others, the rule statistics (shares, so that length itself is no anomaly)
go through an isolation forest: random splits of random statistics isolate
unusual documents after few steps.  The forest is grown from a bounded sample
of labelled rows (``SAMPLE_ROWS``, those with the least hash of their id)
of quality 1, so that what isolates is unlike good documents.  Its thresholds,
one for each band of text length, are calibrated on all labelled rows: the
anomaly score above which a band's rows are dropped is where labels 0 exceed
``REJECT_WEIGHT`` times labels 1 the most.

Defined results: a null, empty or blank text has no words and fails the base
rules; repeated rows are judged one by one; a null id stays null and has no label;
texts of any length are read whole, one block at most; further columns are ignored; an
empty table gives an empty result; without labelled rows of both kinds only the
base rules judge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, as_bytes, blocks, needed

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Labelled rows of quality 1 that the forest is grown from, at most.
SAMPLE_ROWS = 8192
TREES, TREE_ROWS = 128, 256
SEED = 7
#: Upper ends of the bands of words, each with its own threshold.
BANDS = (20, 40, 80, 160, 320)
#: Score bins for calibration, and how much a dropped good row weighs against a dropped bad one.
BINS, REJECT_WEIGHT = 500, 3.0

SYMBOLS = re.compile(rb"[#*$%&|<>]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("chars_per_word", "symbols", "dup_lines", "repeats", "bar_words", "distinct_words", "punctuation", "sentence_ends", "stutter")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", ratios array<float>"

_SPACE = b" \t\n\x0b\x0c\r"
_KEEP_PUNCTUATION = bytes(c for c in range(256) if not (33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126))
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_mask(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Which words lie inside windows that stand at least twice in the list."""
    none = np.zeros(len(words), bool)
    n = len(words) - window + 1
    if n < 2:
        return none
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    size = len(seen)
    if size == len(words):
        return none
    key, span = code[:n].copy(), size
    for k in range(1, window):
        if span * size >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            span = int(key.max()) + 1
        key, span = key * size + code[k : k + n], span * size
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return none
    at = np.union1d(order[1:][same], order[:-1][same])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return np.cumsum(cover[:-1]) > 0


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand at least twice in the list."""
    return int(repeated_mask(words, window).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols = len(SYMBOLS.findall(text))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    m = max(n, 1)
    letters = max(chars, 1)
    spread = np.log1p([m, len(set(words))])
    ratios = [
        chars / m, symbols / m, dup / max(len(lines), 1), repeats / m,
        (words.count(b"|") + sum(w == b"-" for w in words)) / m,
        float(spread[1] / spread[0]),
        len(text.translate(None, _KEEP_PUNCTUATION)) / letters,
        sum(w.endswith((b".", b"!", b"?")) for w in words) / m,
        sum(map(eq, words, words[1:])) / m,
    ]
    return [n, chars, symbols, dup, repeats], ratios


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base counts, ratios) of every text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            base, ratios = zip(*(statistics(x) for x in as_bytes(block.column("text")).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*base, strict=True)), pa.array(ratios, pa.list_(pa.float32()))], names=["doc_id", *BASE, "ratios"])

    ids = needed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return ids.mapInArrow(of, SCHEMA)


class IsolationForest:
    """Random trees as flat arrays: split column and value, children, and path length at leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.depth = max(int(np.ceil(np.log2(max(self.size, 2)))), 1)
        column, value, left, right, length, self.roots = [], [], [], [], [], []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(column)
            for x, first in ((column, -1), (value, 0.0), (left, at), (right, at), (length, 0.0)):
                x.append(first)
            low, high = part.min(axis=0), part.max(axis=0)
            can = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) < 2 or not len(can):
                length[at] = depth + self.average(len(part))
                return at
            c = int(rng.choice(can))
            v = rng.uniform(low[c], high[c])
            column[at], value[at] = c, v
            left[at] = grow(part[part[:, c] < v], depth + 1)
            right[at] = grow(part[part[:, c] >= v], depth + 1)
            return at

        for _ in range(trees):
            self.roots.append(grow(rows[rng.choice(len(rows), self.size, replace=False)], 0))
        self.column, self.value = np.array(column), np.array(value)
        self.left, self.right, self.length = np.array(left), np.array(right), np.array(length)

    @staticmethod
    def average(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in 0 to 1 of each row."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                c = self.column[at]
                go = rows[each, np.maximum(c, 0)] < self.value[at]
                at = np.where(c < 0, at, np.where(go, self.left[at], self.right[at]))
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / max(self.average(self.size), 1e-9))


def scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """The statistics with the anomaly score of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("ratios").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *BASE)), pa.array(forest.score(rows) if len(rows) else np.zeros(0))], names=["doc_id", *BASE, "anomaly"])

    return stats.select("doc_id", *BASE, "ratios").mapInArrow(of, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", anomaly double")


def _band():
    return sum((F.col("n_words") > b).cast("int") for b in BANDS)


def thresholds(labelled: DataFrame) -> list[float]:
    """For each band the score above which rows are dropped (2: none), from bins of all labelled rows."""
    bins = labelled.groupBy("band", F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), "quality").count().collect()
    counts = np.zeros((len(BANDS) + 1, BINS, 2))
    for r in bins:
        counts[r["band"], r["bin"], r["quality"]] += r["count"]
    out = []
    for band in counts:
        gain = np.cumsum((band[:, 0] - REJECT_WEIGHT * band[:, 1])[::-1])[::-1]  # of dropping bin k and above
        k = int(gain.argmax())
        out.append(k / BINS if gain[k] > 0 else 2.0)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base counts, base_failed, anomaly, kept) of every document; labels has doc_id and quality."""
    spark = docs.sparkSession
    store = Stored(spark, "rules")
    stats = store.put(rule_statistics(docs, id_col, text_col))
    marks = needed(labels, doc_id="doc_id", quality="quality").where("quality in (0, 1)")
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    good = stats.where(~base_failed).join(marks.where("quality = 1"), "doc_id", "left_semi")
    sample = good.select("doc_id", "ratios", F.xxhash64("doc_id").alias("k")).orderBy("k", "doc_id", "n_words").limit(SAMPLE_ROWS).collect()
    names = ["doc_id", *BASE]
    if len(sample) < 2:
        return stats.select(*names, base_failed.alias("base_failed"), F.lit(None).cast("double").alias("anomaly"), (~base_failed).alias("kept"))
    forest = IsolationForest(np.array([r["ratios"] for r in sample], dtype=np.float64))
    judged = store.put(scored(stats, forest).withColumn("base_failed", base_failed).withColumn("band", _band()))
    limits = thresholds(judged.where(~F.col("base_failed")).join(marks, "doc_id"))
    limit = F.element_at(F.array(*map(F.lit, limits)), F.col("band") + 1)
    return judged.select(*names, "base_failed", "anomaly", (~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) / BINS < limit)).alias("kept"))
