"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has bit b set if over half of its shingles' XXH64
values have it.  Equal fingerprints are one row before anything is compared.
Two fingerprints within the radius r (3 of 64 bits) agree on at least two of
r + 2 blocks of bits, so rows are compared exactly, with exclusive-or and bit
counts, wherever they share two blocks (ten tables for r = 3): no link is lost.
A wide radius has short blocks, so its work nears all pairs.  Within a key,
rows lie in tiles by their population count, and tile pairs whose counts differ
by more than the radius are skipped.  Links are spanning forests of the tiles;
components are found in Spark.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; fewer words than a shingle make one shingle; repeated
rows share a component; a null id never names a component: such a row has its
group's smallest other id or null; texts of any length are read whole, one block
at most; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .common import Stored, as_bytes, blocks, needed
from .components import connected_components

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
#: Blocks of bits at least; two of them make a key.
LEAST_BLOCKS = 5
#: Near copies: shingles, similarity, radius of their fingerprints, tables of least shingles, and bytes of text in a block.
NEAR_WORDS, SIMILARITY, NEAR_RADIUS, TABLES, NEAR_BLOCK = 5, 0.8, 20, 8, 4 << 20
#: Odd multipliers that put hashes into each table's order.
_ORDERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(TABLES)], np.uint64)
#: Rows of a tile, and bits of population count in a band of tiles.
TILE_ROWS, BAND = 4096, 4


def _hashes(text: bytes, width: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(line, SEED)]
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate([[0], end[:-width]]).tolist()
    last = (end[width - 1 :] - 1).tolist()
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last, strict=True)]


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    h = np.array(_hashes(text, width), dtype="<u8")
    if not len(h):
        return 0
    raw = h.view(np.uint8).reshape(-1, 8)
    # how often each byte value stands in each of the eight bytes, then bits from that
    ones = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BYTE_BITS for k in range(8)]) if len(h) > 256 else np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > len(h)].sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            fp = np.array([fingerprint(x, width) for x in as_bytes(block.column("text")).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    ids = needed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return ids.mapInArrow(of, "doc_id long, fp long")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of so many blocks that fingerprints within the radius agree on two."""
    n = max(LEAST_BLOCKS, radius + 2)
    sizes = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(sizes[:k]), bits) for k, bits in enumerate(sizes)]


def _keys(radius: int) -> F.Column:
    """The keys of a fingerprint (ten for five blocks): the table's number above the bits of its two blocks."""
    part = [F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1) for at, bits in _blocks(radius)]
    pairs = [(i, j) for i in range(len(part)) for j in range(i + 1, len(part))]
    return F.array(*[F.lit(k << 26).cast("long").bitwiseOR(F.shiftleft(part[i], 13)).bitwiseOR(part[j]) for k, (i, j) in enumerate(pairs)])


def _near(fp: np.ndarray, tile: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of fingerprints within the radius, within a tile (same) or between the two tiles of a pair."""
    count = np.bitwise_count(fp).astype(np.int64)
    order = np.argsort(count, kind="stable")
    sides = [order, order] if same else [order[tile[order] == t] for t in (tile.min(), tile.max())]
    step = 512
    for at in range(0, len(sides[0]), step):
        left = sides[0][at : at + step]
        low, high = count[left[0]] - radius, count[left[-1]] + radius
        a, b = np.searchsorted(count[sides[1]], [low, high + 1])
        for to in range(max(a, at) if same else a, b, step):
            right = sides[1][to : min(to + step, b)]
            near = np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= radius
            i, j = np.nonzero(near)
            yield left[i], right[j]


def _dealt(keyed: DataFrame, radius: int) -> DataFrame:
    """Rows (id, fp, key) in tiles by their population count."""
    return tiles.spread(keyed, "key", F.xxhash64("fp", "id"), TILE_ROWS, F.floor(F.bit_count("fp") / BAND), max(1, -(-radius // BAND)))


def _forest(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b): for each tile pair a spanning forest of the links between its rows (id, fp, key)."""

    def work(fp: np.ndarray, tile: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        forest = tiles.Forest(len(fp))
        for i, j in _near(fp.view(np.uint64), tile, same, radius):
            forest.join(i, j)
        return forest.links()

    return tiles.compared(_dealt(keyed, radius), ["fp"], work)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest of the links between rows (id, fp) with distinct fp."""
    if not 0 <= radius <= 62:
        raise ValueError("radius must be from 0 to 62")
    return _forest(prints.select("id", "fp", F.explode(_keys(radius)).alias("key")), radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    store = Stored(docs.sparkSession, "simhash")
    prints = store.put(fingerprints(docs, id_col, text_col, width))
    distinct = store.put(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    linked = connected_components(links(distinct, radius), "a", "b")
    group = distinct.join(linked, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(group, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def _sketch(text: bytes, width: int) -> tuple[int, int, list[int], np.ndarray]:
    """Fingerprint, hash of the set of shingles, least values under each table's order, and the set itself."""
    h = np.array(_hashes(text, width), dtype=np.uint64)
    distinct = np.unique(h)
    if not len(h):
        return 0, 0, [], distinct
    raw = h.view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    mixed = (distinct[None, :] ^ (distinct[None, :] >> np.uint64(29))) * _ORDERS[:, None]
    mixed ^= mixed >> np.uint64(32)
    return int(_WEIGHTS[2 * ones > len(h)].sum()), xxh64_of(distinct), mixed.min(axis=1).view(np.int64).tolist(), distinct


def xxh64_of(values: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(np.ascontiguousarray(values))


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """(k, doc_id, set, fp, least) of rows (k, doc_id, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", NEAR_BLOCK):
            found = [_sketch(x, width)[:3] for x in as_bytes(block.column("text")).to_pylist()]
            fp, sets = (pa.array(np.array([x[i] for x in found], np.uint64).view(np.int64)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([block.column("k"), block.column("doc_id"), sets, fp, pa.array([x[2] for x in found], pa.list_(pa.int64()))], names=["k", "doc_id", "set", "fp", "least"])

    return rows.mapInArrow(of, "k long, doc_id long, set long, fp long, least array<long>")


def _shingles(rows: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of rows (id, text): the hashes of the distinct shingles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", NEAR_BLOCK):
            found = [np.unique(np.array(_hashes(x, width), np.uint64)).view(np.int64) for x in as_bytes(block.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    return rows.mapInArrow(of, "id long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have the similarity."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    return both.where(F.col("common") >= SIMILARITY * (F.size("a_set") + F.size("b_set") - F.col("common")) - 1e-9).select("a", "b")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9


def _joined(fp: np.ndarray, open_: np.ndarray, group: np.ndarray, shingles: np.ndarray, tile: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Similar rows of a tile or a pair of tiles, as few as connect them; rows of one group are connected already."""
    _, up = np.unique(group, return_inverse=True)
    up = up.tolist()
    heads = list(range(max(up) + 1))

    def top(x: int) -> int:
        while heads[x] != x:
            heads[x] = x = heads[heads[x]]
        return x

    size = np.fromiter(map(len, shingles), np.int64, len(shingles))
    out = []
    for i, j in _near(fp.view(np.uint64), tile, same, radius):
        may = ((open_[i] | open_[j]) > 0) & (i != j) & (np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j]) - 1e-9)
        for x, y in zip(i[may].tolist(), j[may].tolist(), strict=True):
            a, b = top(up[x]), top(up[y])
            if a != b and _similar(shingles[x], shingles[y]):
                heads[a] = b
                out.append((x, y))
    return tuple(np.array([x[k] for x in out], np.int64) for k in (0, 1))


def similar_links(store: Stored, rows: DataFrame, units: DataFrame, width: int = NEAR_WORDS, radius: int = NEAR_RADIUS) -> DataFrame:
    """(a, b): links between units (id, k, fp, least) of similar shingle sets that connect all that are similar.

    rows are (k, text).  Fingerprints within the radius link units of a tile; the
    exact similarity decides.  First each unit meets the first of its group of
    linked fingerprints.  The tiles of those that aren't similar to it are then
    compared again with the sets at hand, and only what connects is handed on, so
    a group never becomes all its pairs.
    """
    table = F.posexplode("least").alias("table", "value")
    keyed = store.put(units.where("size(least) > 0").select("id", "fp", table).select("id", "fp", F.xxhash64("table", "value").alias("key")))
    groups = store.put(connected_components(_forest(keyed, radius), "a", "b"))
    texts = rows.join(units.join(groups, F.col("id") == F.col("node")).select("k", "id"), "k").select("id", "text")
    # rows of one key have one text
    sets = store.put(_shingles(texts, width).dropDuplicates(["id"]))
    stars = store.put(_verified(groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")), sets))
    judged = groups.join(stars.select(F.col("a").alias("node"), F.lit(True).alias("star")), "node", "left").withColumn("open", F.when(F.col("star") | (F.col("node") == F.col("component")), 0).otherwise(1))
    judged = judged.select(F.col("node").alias("id"), "open", F.when(F.col("open") == 1, F.col("node")).otherwise(F.col("component")).alias("group"))
    marked = keyed.join(judged, "id")
    # only keys with an open row and another one can add links
    useful = marked.groupBy("key").agg(F.sum("open").alias("n_open"), F.count("*").alias("n")).where("n_open > 0 AND n > 1").select("key")
    again = marked.join(useful, "key", "left_semi").join(sets, "id")
    found = tiles.compared(_dealt(again, radius), ["fp", "open", "group", "shingles"], partial(_joined, radius=radius))
    return stars.unionByName(found)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WORDS, radius: int = NEAR_RADIUS) -> DataFrame:
    """One document (the first by id) of each group of near copies, with all columns.

    Near are texts whose sets of shingles of so many words have a Jaccard
    similarity of ``SIMILARITY`` or more; groups are what such links connect.
    Candidates are fingerprints within a wide radius in tiles that share a least
    shingle in one of ``TABLES`` orders: two texts at the similarity share none
    with a chance of 0.2 ** TABLES, and differ in more bits than the radius with
    a chance below 0.001 (measured in the tests); what is found is exact.  Equal
    rows, even of one id, are copies of each other, and one stays; rows that
    share an id but not the text are judged each by its text; a null id counts as
    the smallest; texts without a word are equal to each other; null texts count
    as empty.
    """
    store = Stored(docs.sparkSession, "near")
    own = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    own = own.withColumn("k", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text"))
    known = store.put(_sketches(own.select("k", "doc_id", "text"), width))
    first = known.groupBy("set").agg(F.min(F.struct("doc_id", "k", "fp", "least")).alias("first")).select("first.*")
    # numbered in the order of ids; the numbers are written before anything uses them
    units = store.put(first.orderBy("doc_id", "k").withColumn("id", F.monotonically_increasing_id()))
    linked = connected_components(similar_links(store, own.select("k", "text"), units, width, radius), "a", "b")
    stay = store.last(units.join(linked.where("node != component"), F.col("id") == F.col("node"), "left_anti").select("k"))
    kept = own.join(stay, "k", "left_semi").withColumn("copy", F.expr("row_number() OVER (PARTITION BY k ORDER BY k)")).where("copy = 1")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
