"""Quality classifier by attention-based multiple-instance learning (Ilse et al. 2018).

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage of
the whole text is encoded: hashed byte pairs, shares of kinds of characters,
repeated windows and lines, and how long the document is.  A hidden layer, gated
attention over the passages and an output on the attention-weighted sum are
learnt together from the document labels.  The training rows are a bounded
sample (``SAMPLE_ROWS`` labelled rows with the least hash of their id, texts up
to ``SAMPLE_BYTES``); scoring reads every passage of every text, block by block.

Defined results: null, empty and blank texts are one empty passage and get its
score; repeated rows get equal scores; a null id stays null, has no label and isn't
held out; texts of any length are scored over all their passages; all other columns are passed through or
ignored, never used; an empty table gives an empty result; without training
rows of both labels every score is the share of label 1 (one half without any).
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import as_bytes, buffers, needed, trim
from .quality_rules import repeated_mask

PASSAGE_WORDS = 48
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 65_536
#: A row is held out from training where crc32(id) modulo this is 0; documents scoring less than ACCEPT are rejected.
FOLDS, ACCEPT = 5, 0.3
PAIRS, HIDDEN, GATE = 256, 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 16, 32, 0.01, 1e-4, 11
#: Bytes of text encoded at once.
ENCODE_BYTES = 2 << 20

_KIND = np.full(256, 7, np.uint8)  # other
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#*$%&|<>", b"!\"'()+,-./:;=?@[\\]^_`{}~")):
    _KIND[list(_chars)] = _k
_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(13)) % np.uint64(PAIRS)).astype(np.int64)
FEATURES = PAIRS + 8 + 8


def encode(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages of a block of texts as rows, and the first passage of each text (and the end)."""
    n_texts = len(offsets) - 1
    white = bpe.WHITE[data]
    before = np.ones(len(data), bool)
    before[1:] = white[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(~white & before)
    first_word = np.searchsorted(begin, offsets)
    words = np.diff(first_word)
    n = np.maximum(-(-words // PASSAGE_WORDS), 1)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(n_texts), n)
    turn = np.arange(first[-1]) - first[text]
    # a passage starts at its first word, the first one at the start of its text
    at = np.where(turn == 0, offsets[text], begin[np.minimum(first_word[text] + turn * PASSAGE_WORDS, max(len(begin) - 1, 0))] if len(begin) else 0)
    size = np.diff(np.append(at, len(data)))
    rows = len(at)
    out = np.zeros((rows, FEATURES), np.float32)
    owner = np.repeat(np.arange(rows), size)
    if len(data):
        pair = _PAIR[data[:-1].astype(np.int64) << 8 | data[1:]]
        out[:, :PAIRS] = np.bincount(owner[:-1] * PAIRS + pair, minlength=rows * PAIRS).reshape(rows, PAIRS)
        out[:, PAIRS : PAIRS + 8] = np.bincount(owner * 8 + _KIND[data], minlength=rows * 8).reshape(rows, 8)
        out[:, : PAIRS + 8] /= np.maximum(size, 1)[:, None]
        np.sqrt(out, out=out)
    k = PAIRS + 8
    own = np.minimum(words[text] - turn * PASSAGE_WORDS, PASSAGE_WORDS)
    out[:, k] = np.log1p(words[text]) / 4
    out[:, k + 1] = np.log1p(own) / 4
    out[:, k + 2] = size / np.maximum(own, 1) / 16
    raw = data.tobytes()
    repeated, stutter, fresh = (np.zeros(len(begin) + 1, np.int64) for _ in range(3))
    dup_lines = np.zeros(n_texts)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        one = raw[a:b]
        own_words, span = one.split(), slice(first_word[i], first_word[i + 1])
        repeated[span] = repeated_mask(own_words)
        stutter[span] = list(map(eq, own_words, [b"", *own_words]))
        seen: set[bytes] = set()
        fresh[span] = [not (w in seen or seen.add(w)) for w in own_words]
        lines = [x for x in one.split(b"\n") if x.strip()]
        dup_lines[i] = 1 - len(set(lines)) / len(lines) if lines else 0
    from_word = first_word[text] + turn * PASSAGE_WORDS
    for c, marks in enumerate((repeated, stutter, fresh)):
        total = np.concatenate([[0], np.cumsum(marks)])
        out[:, k + 3 + c] = (total[from_word + own] - total[from_word]) / np.maximum(own, 1)
    out[:, k + 6] = dup_lines[text]
    out[:, k + 7] = 1
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Gated attention over passages; all weights are small arrays."""

    def __init__(self, share: float = 0.5):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        normal = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {"in": normal(FEATURES, HIDDEN), "in0": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, GATE), "u": normal(HIDDEN, GATE), "a": normal(GATE, 1), "out": np.zeros((HIDDEN, 1), np.float32), "out0": np.array([np.log(share / (1 - share))], np.float32)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.w, first[:-1]
        h = np.tanh(x @ w["in"] + w["in0"])
        v, u = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        e = ((v * u) @ w["a"])[:, 0]
        n = np.diff(first)
        top = np.repeat(np.maximum.reduceat(e, at), n)
        weight = np.exp(e - top)
        weight /= np.repeat(np.add.reduceat(weight, at), n)
        z = np.add.reduceat(h * weight[:, None], at, axis=0)
        return {"h": h, "v": v, "u": u, "weight": weight, "z": z, "p": _sigmoid(z @ w["out"] + w["out0"])[:, 0]}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, first)
        n = np.diff(first)
        d = ((f["p"] - y) / len(y)).astype(np.float32)[:, None]
        g = {"out": f["z"].T @ d, "out0": d.sum(axis=0)}
        dz = np.repeat(d @ w["out"].T, n, axis=0)
        dw = (dz * f["h"]).sum(axis=1)
        de = f["weight"] * (dw - np.repeat(np.add.reduceat(f["weight"] * dw, first[:-1]), n))
        gate = f["v"] * f["u"]
        g["a"] = gate.T @ de[:, None]
        dg = de[:, None] * w["a"].T
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        g["v"], g["u"] = f["h"].T @ dv, f["h"].T @ du
        dh = (dz * f["weight"][:, None] + dv @ w["v"].T + du @ w["u"].T) * (1 - f["h"] ** 2)
        g["in"], g["in0"] = x.T @ dh, dh.sum(axis=0)
        return g

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
        """Fit on passages x, which are scaled in place."""
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 1e-3)
        x -= self.mean
        x *= self.scale
        rng, step = np.random.default_rng(SEED), 0
        m, s = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                n = first[some + 1] - first[some]
                begin = np.concatenate([[0], np.cumsum(n)])
                rows = np.arange(begin[-1]) + np.repeat(first[some] - begin[:-1], n)
                step += 1
                for k, g in self.gradients(x[rows], begin, y[some]).items():
                    g = g + DECAY * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of texts (large_binary without nulls), block by block."""
        out = np.zeros(len(texts))
        offsets, _ = buffers(texts)
        at = 0
        while at < len(texts):
            to = max(int(np.searchsorted(offsets, offsets[at] + ENCODE_BYTES, side="right")) - 1, at + 1)
            x, first = encode(*buffers(texts.slice(at, to - at)))
            x -= self.mean
            x *= self.scale
            out[at:to] = self.forward(x, first)["p"]
            at = to
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold; labels has doc_id and quality."""
    marks = needed(labels, doc_id="doc_id", quality="quality").where("quality in (0, 1)").where(~held_out("doc_id"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    texts = needed(docs, doc_id=id_col, text=text_col).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    # the sample has sample_rows rows at most, and as many texts are taken, also where ids repeat
    rows = texts.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample_rows).toArrow()
    y = np.asarray(rows.column("quality")).astype(np.float32)
    if not 0 < y.sum() < len(y):
        return Model((y.sum() + 1) / (len(y) + 2))
    order = np.argsort(np.asarray(rows.column("doc_id")), kind="stable")
    column = as_bytes(rows.column("text").take(pa.array(order)))
    parts, first, at = [], [np.zeros(1, np.int64)], 0
    for k in range(0, len(column), 256):
        x, f = encode(*buffers(column.slice(k, 256)))
        parts.append(x)
        first.append(f[1:] + at)
        at += len(x)
    x = np.concatenate(parts)
    del rows, column, parts
    model = Model(float(y.mean())).fit(x, np.concatenate(first), y[order])
    del x
    trim()
    return model


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == 0


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(as_bytes(pa.array(texts, pa.large_string()))))

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels, id_col, text_col)
    rows = needed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), score(model, F.col("text")).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, that the classifier does not reject."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(score(model, F.col(f"`{text_col}`")) >= ACCEPT)
