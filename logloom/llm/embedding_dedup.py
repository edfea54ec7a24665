"""Embedding near-duplicates by random-hyperplane sign hashing.

Several tables of sign hashes bring vectors with a small angle together; every
pair that meets is checked by its exact cosine in double precision.  Equal
vectors are one row with a weight before anything is compared.  A pair counts in
the first table where it meets, so links are counted without listing pairs, and
from each tile only a spanning forest of links is kept.  Components are found in
Spark.  Bits follow the number of vectors (about ``BUCKET_ROWS`` to a bucket)
and tables follow the bits, so that a pair at the threshold is missed in every
table with probability 1 - ``RECALL`` at most.  Beyond ``BUCKET_ROWS`` << ``MOST_BITS``
vectors buckets grow, and their tiles compare them whole.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are kept; so do vectors of other lengths than
the one they are compared with; repeated rows link with each other; a null id
never names a component: such a row has its group's smallest other id and isn't
kept, or null and is; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .common import Stored, needed
from .components import connected_components

THRESHOLD = 0.9
#: Share of pairs at exactly the threshold that some table brings together.
RECALL = 0.97
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 64, 8, 28
TILE_ROWS = 2048
SEED = 20_240


def plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a hash and number of tables."""
    bits = min(max(math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)), LEAST_BITS), MOST_BITS)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def hashes(matrix: np.ndarray, bits: int, n_tables: int) -> np.ndarray:
    """Sign hash of each row in each table (n, tables)."""
    planes = np.random.default_rng(SEED).standard_normal((n_tables, matrix.shape[1], bits))
    weights = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([(matrix @ planes[k] > 0) @ weights for k in range(n_tables)], axis=1)


def unit(rows: list) -> np.ndarray:
    matrix = np.array(rows, dtype=np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)  # no overflow in the squares
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _tile(matrix: np.ndarray, signs: np.ndarray, turn: int, weight: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, tiles.Forest]:
    """New links (weighted) of each row and their forest; side tells the two tiles of a pair apart."""
    n = len(matrix)
    count, forest = np.zeros(n, np.int64), tiles.Forest(n)
    left = np.arange(n) if side is None else np.flatnonzero(side == side.min())
    right = np.arange(n) if side is None else np.flatnonzero(side != side.min())
    step = 512
    for at in range(0, len(left), step):
        a = left[at : at + step]
        for to in range(at if side is None else 0, len(right), step):
            b = right[to : to + step]
            near = matrix[a] @ matrix[b].T >= threshold
            if side is None and to == at:
                near &= np.triu(np.ones(near.shape, bool), 1)
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            if turn:  # a pair that met in an earlier table was counted there
                new = ~(signs[i, :turn] == signs[j, :turn]).any(axis=1)
                i, j = i[new], j[new]
            count += np.bincount(i, weights=weight[j], minlength=n).astype(np.int64) + np.bincount(j, weights=weight[i], minlength=n).astype(np.int64)
            forest.join(i, j)
    return count, forest


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    store = Stored(spark, "embeddings")
    rows = needed(vectors, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
    # adding zero makes both zeros one; equal vectors then have equal keys
    clean = F.transform("vector", lambda x: x + F.lit(0.0))
    fit = F.coalesce((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = store.put(rows.select("vec_id", F.when(fit, clean).alias("vector")).withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.hash("vector")))
    copies = rows.where("vector is not null").groupBy("k1", "k2", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    distinct = store.put(copies.withColumn("dims", F.size("vector")))
    size = distinct.count()
    bits, n_tables = plan(size, threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column("vector").to_pylist()
            out = np.zeros((len(got), n_tables), np.int64)
            dims = np.array([len(x) for x in got])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                out[at] = hashes(unit([got[k] for k in at]), bits, n_tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * n_tables, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "weight", "vector", "dims")), lists], names=["id", "weight", "vector", "dims", "signs"])

    signed = distinct.select("id", "weight", "vector", "dims").mapInArrow(sign, "id long, weight long, vector array<double>, dims int, signs array<long>")
    keyed = signed.select("id", "weight", "vector", "dims", "signs", F.posexplode("signs").alias("turn", "sign"))
    keyed = keyed.withColumn("key", F.xxhash64("dims", "turn", "sign"))
    counted = store.put(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = tiles.spread(keyed.join(counted.select("key"), "key", "left_semi"), "key", F.xxhash64("id"), TILE_ROWS)
    dealt = dealt.repartition(F.col("key"), F.col("tile_a"), F.col("tile_b")).sortWithinPartitions("key", "tile_a", "tile_b", "turn", "dims", "sign")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(part: pa.Table, last: bool):
            part = part.combine_chunks()
            cols = {c: np.asarray(part.column(c)) for c in ("key", "tile_a", "tile_b", "turn", "dims", "sign", "tile", "id", "weight")}
            at = tiles.starts(*(cols[c] for c in ("key", "tile_a", "tile_b", "turn", "dims", "sign")))
            upto = len(at) - 1 if last else len(at) - 2
            found = []
            signs = part.column("signs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_tables)
            flat = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(cols["dims"])])
            for k in range(upto):
                a, b = int(at[k]), int(at[k + 1])
                if b - a < 2:
                    continue
                side = None if cols["tile_a"][a] == cols["tile_b"][a] else cols["tile"][a:b]
                if side is not None and side.min() == side.max():
                    continue
                matrix = unit(flat[begin[a] : begin[b]].reshape(b - a, -1))
                count, forest = _tile(matrix, signs[a:b], int(cols["turn"][a]), cols["weight"][a:b], side, threshold)
                hit = np.flatnonzero(count)
                root = forest.roots(hit)
                found.append((cols["id"][a:b][hit], cols["id"][a:b][root], count[hit]))
            out = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b", "n"]), part.slice(int(at[upto]))

        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            if rest.num_rows < 20_000:
                continue
            out, rest = groups(rest, False)
            yield out
        if rest is not None and rest.num_rows:
            yield groups(rest, True)[0]

    columns = ("id", "weight", "vector", "dims", "signs", "turn", "sign", "key", "tile", "tile_a", "tile_b")
    met = store.put(dealt.select(*columns).mapInArrow(compare, "a long, b long, n long"))
    linked = connected_components(met, "a", "b")
    links = met.groupBy("a").agg(F.sum("n").alias("links"))
    found = distinct.join(links, distinct.id == links.a, "left").join(linked, distinct.id == linked.node, "left")
    found = found.select("k1", "k2", "vector", "id", F.coalesce("links", F.lit(0)).alias("links"), "weight", F.coalesce("component", "id").alias("component_id"))
    joined = rows.join(found, ["k1", "k2", "vector"], "left")
    n_links = F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0))
    return joined.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.col("component_id").isNull()))
