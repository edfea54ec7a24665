"""Connected components of links in Spark: alternating large-star and small-star steps.

Every step is a minimum by node (combined before its shuffle) and an equi-join;
no component is ever gathered.  Each round is written to the shared folder, so
the lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

#: The steps need about log2 of the longest path; more rounds than this mean a fault.
MAX_ROUNDS = 60


def _linked(edges: DataFrame) -> DataFrame:
    """Every node's smallest neighbour or itself, given (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes with links; component is the smallest node that can be reached.

    Null ends and self links are ignored; repeated links count once; without
    links the result is empty.
    """
    spark = links.sparkSession
    store = Stored(spark, "components")
    big, small = F.greatest(a, b), F.least(a, b)
    edges = store.put(links.where(F.col(a) != F.col(b)).select(big.cast("long").alias("u"), small.cast("long").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_linked(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        step = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = store.put(step)
        store.drop(store.n - 2)
        now, edges = mark(new), new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
