"""Exact top-k search by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


class SortedLists:
    """One block of vectors with, for each dimension, its rows in ascending order of value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()  # dimension, place
        self.value = np.take_along_axis(x, self.order.T, axis=0).T.copy()

    def search(self, q: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows for ``q`` but the one with id ``own``.

        Sorted access goes down all lists in step, from the end that the sign of the query's
        component favours, at doubling depths; each row met is scored by random access. It stops
        when the bound for rows not met yet, the product of the query with the last values read,
        is below the kth score, here or, as ``floor``, elsewhere. An equal bound goes on, as an unseen
        row may have a smaller id. Rows below the floor are left out.
        """
        n, dims = len(self.ids), np.flatnonzero(q)
        up = q[dims] > 0
        seen = np.zeros(n, bool)
        found = np.empty(0, np.int64)
        scores = np.empty(0, np.int64)
        depth = 0
        while depth < n:
            last, depth = depth, min(n, max(4 * k, 4 * depth))
            fresh = np.zeros(n, bool)
            if len(dims):
                fresh[self.order[dims[up], n - depth : n - last]] = True
                fresh[self.order[dims[~up], last:depth]] = True
            else:
                fresh[last:depth] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            new = new[self.ids[new] != own]
            found = np.r_[found, new]
            scores = np.r_[scores, (self.x[new] @ q).astype(np.int64)]
            top = best(scores, self.ids[found], k)
            found, scores = found[top], scores[top]
            edge = np.where(up, self.value[dims, n - depth], self.value[dims, depth - 1])
            if max(floor, scores[-1] if len(scores) == k else -np.inf) > edge @ q[dims]:
                break
        return self.ids[found][scores >= floor], scores[scores >= floor]


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """The k rows of highest inner product for each query, exactly.

    ``vectors`` has vec_id and embedding; queries are the rows whose vec_id is divisible by
    ``every``. Components become floor(scale * x). Rows whose vector is null or holds a null or
    non-finite component, and rows without vec_id, take no part. Vectors of other lengths than a
    query's have no inner product with it and are no candidates for it. A query's own row is
    every row with its vec_id. Ties go to the smaller vec_id. Repeated rows are candidates each, and
    one query together.

    Rows are dealt into blocks of about ``block`` rows and queries into blocks of about
    ``query_block``; each pair of blocks is one bounded task, and only its k best per query
    leave it. Each query is searched in one block first; its kth score there is a floor for the
    bound in all others. Scaled components above 2^53 / the vectors' length in product lose the last
    digits of a score, as doubles do. Extra columns are ignored. Returns query_id, rank (from 1), vec_id and score.
    """
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("x"))
    sizes = kept.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    n_blocks, n_queries = max(1, math.ceil(sizes[0] / block)), max(1, math.ceil(sizes[1] / query_block))
    # Blocks are dealt once and written down, as all copies of a row must agree on them.
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(seed)), F.lit(n)).cast("int")
    rows = materialise(kept.select("vec_id", "x", deal(n_blocks, 1).alias("cb")), "topk-rows")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int").alias("qb")).distinct()
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cands = rows.select("vec_id", "x", F.lit(False).alias("q"), "cb", upto(n_queries).alias("qb"))
    asks = asked.select("vec_id", "x", F.lit(True).alias("q"), upto(n_blocks).alias("cb"), "qb")

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        floors = pdf.pop("floor").fillna(-np.inf)
        dims = pdf["x"].map(len)
        for d, part in pdf.groupby(dims):
            q, c = part[part["q"]], part[~part["q"]]
            if not len(q) or not len(c):
                continue
            lists = SortedLists(c["vec_id"].to_numpy(), np.stack(c["x"].to_numpy()))
            for own, x, floor in zip(q["vec_id"].tolist(), q["x"], floors[q.index].tolist()):
                ids, scores = lists.search(np.asarray(x), own, k, floor)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    schema = "query_id long, vec_id long, score long"
    home = F.pmod(F.col("qb"), F.lit(n_blocks))
    found = materialise(cands.unionByName(asks).where(F.col("cb") == home).withColumn("floor", F.lit(None).cast("double")).groupBy("cb", "qb").applyInPandas(cell, schema), "topk-first")
    if n_blocks > 1:
        # Equal scores at the kth place make one floor; a query that is asked twice shares it.
        kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        floors = found.distinct().withColumn("r", kth).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
        others = cands.where(F.col("cb") != home).withColumn("floor", F.lit(None).cast("double")).unionByName(asks.where(F.col("cb") != home).join(floors, "vec_id", "left"))
        found = found.unionByName(others.groupBy("cb", "qb").applyInPandas(cell, schema))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: The same rows by brute force.
OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
