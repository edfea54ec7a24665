"""Byte-pair encoding of whole blocks of text through a table of distinct words.

A block of texts is cut where a white-space run begins.  No pattern of the two
tokenizers matches across such a cut (white space can only stand first in a
match, and the one look-ahead they have looks at white space), so the ids of a
text are the ids of its cuts in order.  Each distinct cut of a block is encoded
once, and the ids are joined back by position.  Plain cuts of a byte-level
vocabulary are encoded many at a time, by the same merges; where each cut's ids
end is checked against its bytes.  All others are encoded by the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import buffers

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: White space beyond ASCII, in UTF-8: no cut may follow it directly.
WIDE_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Entries kept between blocks by one Python worker.
CACHE_ENTRIES = 300_000
#: Bytes of words that are encoded as one text.
JOINT_BYTES = 1 << 18
#: Fixed value: how a byte-level vocabulary parts text before it merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cuts beyond this many bytes are encoded but not kept.
CACHE_WORD_BYTES = 64


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the cuts of a block start: at each text's start and at each start of a white-space run."""
    if not len(data):
        return np.zeros(0, np.int64)
    white = WHITE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = white[:-1]
    if (data > 0xC1).any():
        for m in WIDE_WHITE.finditer(data.tobytes()):
            if m.end() < len(before):
                before[m.end()] = True
    start = white & ~before
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(start)


class Words:
    """The distinct cuts of one block: code of each cut, the cuts as bytes, and the first cut of each text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        starts = cut(data, offsets)
        ends = np.append(starts, len(data)).astype(np.int64)
        cuts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = cuts.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.dictionary = coded.dictionary
        self.first = np.searchsorted(starts, offsets)  # of each text, and the end

    @property
    def words(self) -> list[bytes]:
        return self.dictionary.to_pylist()


def _byte_level(tokenizer):
    """A byte-level vocabulary's own encoder of ordinary text, or None.

    In such a vocabulary each id past the bytes is the merge of two smaller ones, in order of id, so merging the
    pair of least id gives what the merge list gives.
    """
    import tiktoken

    kind = json.loads(tokenizer.to_str())
    if kind["normalizer"] is not None or (kind["pre_tokenizer"] or {}).get("type") != "ByteLevel" or not kind["pre_tokenizer"].get("use_regex", True) or kind["pre_tokenizer"].get("add_prefix_space"):
        return None
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(shown)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in w): i for w, i in tokenizer.get_vocab(with_added_tokens=False).items() if w not in added}
    return tiktoken.Encoding("words", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _joint(offsets: np.ndarray, data: np.ndarray, tokenizer) -> np.ndarray:
    """Which words may be encoded as one text.

    By the module's rule those that start with white space and end with neither white space nor a character beyond
    ASCII; without special strings; and of characters up to U+04FF, whose classes no version of Unicode changes.
    """
    out = np.zeros(len(offsets) - 1, bool)
    if not len(data):
        return out
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    last = data[offsets[full + 1] - 1]
    odd = np.concatenate([[0], np.cumsum(data > 0xD3)])
    out[full] = WHITE[data[offsets[full]]] & (last < 128) & ~WHITE[last] & (odd[offsets[full + 1]] == odd[offsets[full]])
    raw = data.tobytes()
    for token in tokenizer.get_added_tokens_decoder().values():
        special, at = token.content.encode(), -1
        while (at := raw.find(special, at + 1)) >= 0:
            out[np.searchsorted(offsets, at, side="right") - 1] = False
    return out


class Encoder:
    """Ids of distinct cuts, with a bounded table kept between blocks."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.kept: dict[bytes, bytes] = {}
        self.fast = _byte_level(self.tokenizer)
        if self.fast:
            self.fast_sizes = np.array([len(self.fast.decode_single_token_bytes(i)) for i in range(self.fast.n_vocab)], np.int64)

    def by_library(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint16).tobytes() for x in found]

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Packed 16-bit ids of each word."""
        kept = self.kept
        new = [w for w in words if w not in kept]
        own: dict[bytes, bytes] = {}
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            own.update(zip(some, self.by_library(some), strict=True))
        out = [own[w] if w in own else kept[w] for w in words] if own else [kept[w] for w in words]
        if len(kept) + len(own) > CACHE_ENTRIES:
            kept.clear()
        for w, ids in own.items():
            if len(w) <= CACHE_WORD_BYTES:
                kept[w] = ids
                if len(kept) >= CACHE_ENTRIES:
                    break
        return out

    def table(self, block: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the block's distinct words: number of ids, where they begin, and all ids."""
        offsets, data = buffers(block.dictionary)
        joint = _joint(offsets, data, self.tokenizer) if self.fast else np.zeros(len(offsets) - 1, bool)
        size = np.diff(offsets)
        n, begin = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        flat, total = [], 0
        some, steps = np.flatnonzero(joint), np.cumsum(size[joint]) // JOINT_BYTES
        cuts = np.append(np.flatnonzero(np.diff(steps, prepend=-1)), len(some)).tolist() if len(some) else []
        for a, b in zip(cuts, cuts[1:]):
            part = some[a:b]
            wanted = np.cumsum(size[part])
            text = data[np.arange(wanted[-1]) + np.repeat(offsets[part] - wanted + size[part], size[part])]
            ids = self.fast.encode_to_numpy(text.tobytes().decode()).astype(np.uint16)
            ends = np.cumsum(self.fast_sizes[ids])
            to = np.searchsorted(ends, wanted) + 1
            if ends[-1] != wanted[-1] or (ends[to - 1] != wanted).any():
                raise ValueError("ids do not end where words do")
            n[part] = np.diff(to, prepend=0)
            begin[part] = total + to - n[part]
            flat.append(ids)
            total += len(ids)
        rest = np.flatnonzero(~joint)
        packed = self.look_up([block.dictionary[int(k)].as_py() for k in rest]) if len(rest) else []
        n[rest] = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
        begin[rest] = total + np.cumsum(n[rest]) - n[rest]
        return n, begin, np.concatenate([*flat, np.frombuffer(b"".join(packed), np.uint16)])

    def counts(self, block: Words) -> np.ndarray:
        """Tokens of each text of the block."""
        total = np.concatenate([[0], np.cumsum(self.table(block)[0][block.codes])])
        return total[block.first[1:]] - total[block.first[:-1]]

    def ids(self, block: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and where each text's ids begin (and the end)."""
        lens, begin, flat = self.table(block)
        n = lens[block.codes]
        total = np.concatenate([[0], np.cumsum(n)])
        where = np.arange(total[-1]) + np.repeat(begin[block.codes] - total[:-1], n)
        return flat[where], total[block.first]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
