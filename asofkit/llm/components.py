"""Connected components by contraction of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of the edges a, b; the root is some node of its component.

    Each round maps every node to the smallest of itself and its neighbours and keeps the edges
    between different images, which at least halves the nodes that still have edges. Every round
    is a written table; the mappings are composed at the end. Nothing comes to the driver.
    """
    current = materialise(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        maps.append(materialise(least, "cc-map"))
        left = maps[-1].select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = maps[-1].select(F.col("node").alias("b"), F.col("root").alias("rb"))
        following = current.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where(F.col("a") != F.col("b")).distinct()
        following = materialise(following, "cc-edges")
        discard(current)
        current = following
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = m.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    done = materialise(out, "cc")
    for m in maps:
        discard(m)
    return done
