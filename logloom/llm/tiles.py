"""Exact comparison of keyed rows in tiles.

Rows that share a key are compared with each other.  A key with few rows is one
tile; a hot key is spread over several tiles, and each pair of tiles becomes a
task's work of its own, so no key is ever gathered whole.  From each tile pair
only a spanning forest of its links is kept, whose size is linear in the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts over which the rows of a key lie when they learn how many they are.
SALTS = 64


def spread(rows: DataFrame, key: str, salt: Column, tile_rows: int, band: Column | None = None, reach: int = 0) -> DataFrame:
    """Rows with tile_a <= tile_b, one for each tile pair that they take part in, and their own tile.

    With a band (a small integer), tiles lie within one band, and pairs of
    tiles whose bands differ by more than reach are left out.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > tile_rows)
    counts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(counts, [key, "_salt"], "left").drop("_salt")
    tiles = F.coalesce(F.ceil(F.col("_n") / tile_rows), F.lit(1)).cast("int")
    at = F.pmod(salt, F.col("_tiles")).cast("int")
    out = joined.withColumn("_tiles", tiles)
    if band is None:
        out = out.withColumn("tile", at).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    else:
        hot = F.col("_tiles") > 1
        out = out.withColumn("_band", F.when(hot, band.cast("int")).otherwise(0)).withColumn("tile", F.col("_band") * F.col("_tiles") + at)
        low = F.when(hot, F.greatest(F.col("_band") - reach, F.lit(0))).otherwise(0) * F.col("_tiles")
        high = F.when(hot, F.col("_band") + reach).otherwise(0) * F.col("_tiles") + F.col("_tiles") - 1
        out = out.withColumn("_other", F.explode(F.sequence(low, high)))
    return out.withColumn("tile_a", F.least("tile", "_other")).withColumn("tile_b", F.greatest("tile", "_other")).drop("_n", "_tiles", "_other", "_band")


def compared(dealt: DataFrame, columns: list[str], work: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): pairs of ids that work finds in each tile pair of rows from spread() with columns key, tile, tile_a, tile_b and id.

    work gets the columns named, the tiles and whether it is one tile, and returns two arrays of row numbers.
    """
    names = ["key", "tile_a", "tile_b", "tile", "id", *columns]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(table: pa.Table, last: bool):
            cols = [table.column(c).to_numpy() for c in names]
            at = starts(*cols[:3])
            upto = len(at) - 1 if last else len(at) - 2
            sizes = np.diff(at[: upto + 1])
            a, b = [], []
            for k in np.flatnonzero(sizes > 1):
                s = slice(at[k], at[k + 1])
                same = cols[1][at[k]] == cols[2][at[k]]
                if not same and cols[3][s].min() == cols[3][s].max():
                    continue
                i, j = work(*(c[s] for c in cols[5:]), tile=cols[3][s], same=same)
                a.append(cols[4][s][i])
                b.append(cols[4][s][j])
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], names=["a", "b"])
            return out, table.slice(int(at[upto]))

        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            if rest.num_rows < 50_000:
                continue
            out, rest = groups(rest, False)
            yield out
        if rest is not None and rest.num_rows:
            yield groups(rest, True)[0]

    rows = dealt.repartition(F.col("key"), F.col("tile_a"), F.col("tile_b")).sortWithinPartitions("key", "tile_a", "tile_b")
    return rows.select(*names).mapInArrow(of, "a long, b long")


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, given sorted columns; the end comes last."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), n)


class Forest:
    """Union-find over row numbers, in whole arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        found = self.up[x]
        while (above := self.up[found]) is not None and (above != found).any():
            found = above
        return found

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, root) of each row that is not its own root."""
        root = self.roots(np.arange(len(self.up)))
        child = np.flatnonzero(root != np.arange(len(root)))
        return child, root[child]
