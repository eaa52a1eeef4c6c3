"""Sharding by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialise, numbered, table


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item: the one whose residual capacity has the highest dot product with it.

    Items come in order of their largest share of a dimension; ties go to the lower shard. A
    residual counts from the fullest shard's point of view, so it stays comparable when negative.
    """
    caps = np.maximum(vectors.sum(axis=0) / n_shards, 1e-9)
    share = vectors / caps
    residual = np.ones((n_shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = s = int(np.argmax(residual @ share[i]))
        residual[s] -= share[i]
    return out


def shard_documents(docs: DataFrame, n_shards: int = 8, bundles: int = 4096) -> DataFrame:
    """Assign every document to one of ``n_shards`` shards of near equal bytes, tokens and rows.

    A group is the documents of one text (null counts as empty). Groups above 1/``bundles`` of
    the bytes, tokens or rows, at most 3 * ``bundles`` of them, are placed one by one; the others
    fall by hash into ``bundles`` bundles that are placed as wholes. So the driver handles at
    most 4 * ``bundles`` vectors, whatever the input. A group larger than a whole shard is cut by
    a written hash of its rows into parts of an eighth of a shard, whether or not these have ids, and
    ``cut`` is true for its rows; every other group stays together. Very long texts are ordinary: one
    above a shard's bytes has a shard of its own.

    Returns doc_id, size (UTF-8 bytes + 1), tokens, text_crc32, law ('bytes'), shard, slot
    (gapless from 0 within the shard), grown_shard (null) and cut. Null doc_ids are ordinary rows, an
    empty table gives an empty result, extra columns are ignored, repeated rows count each.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("group"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("salt"),
        ),
        "shard-base",
    )
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    b, t, r = base.agg(*sums).first()
    total = [b or 0, t or 0, r]
    groups = base.groupBy("group").agg(*sums)
    heavy = F.lit(False)
    for c, x in zip("btr", total):
        heavy = heavy | (F.col(c) > x / bundles)
    bundle = F.pmod(F.crc32(F.col("group")), F.lit(bundles)).cast("int")
    items = (
        groups.select(F.when(heavy, F.col("group")).alias("g"), F.when(~heavy, bundle).alias("k"), "b", "t", "r")
        .groupBy("g", "k")
        .agg(*[F.sum(c).alias(c) for c in "btr"])
        .collect()
    )  # at most 4 * bundles rows
    caps = [x / n_shards for x in total]
    huge = {i.g: 8 * math.ceil(max(i.b / caps[0], i.r / caps[2])) for i in items if i.g and (i.b > caps[0] or i.r > caps[2])}
    part_of = F.lit(0)
    for g, n in huge.items():  # fewer than 2 * n_shards
        part_of = F.when(F.col("group") == g, F.pmod("salt", F.lit(n)).cast("int")).otherwise(part_of)
    entries = [(i.g, 0, i.k, i.b, i.t, i.r) for i in items if i.g not in huge]
    if huge:
        cut = base.where(F.col("group").isin(*huge)).groupBy("group", part_of.alias("p")).agg(*sums).collect()
        entries += [(i.group, i.p, None, i.b, i.t, i.r) for i in cut]
    entries.sort(key=lambda e: (e[0] or "", e[1], -1 if e[2] is None else e[2]))
    at = place(np.array([e[3:] for e in entries], float).reshape(-1, 3), n_shards).tolist()
    single = [(e[0], e[1], s) for e, s in zip(entries, at) if e[0]]
    bundled = [(e[2], s) for e, s in zip(entries, at) if not e[0]]
    # Both lists are bounded by `bundles`, so they can be broadcast at any input size.
    one = F.broadcast(spark.createDataFrame(single, "group string, part int, s1 int"))
    many = F.broadcast(spark.createDataFrame(bundled, "bundle int, s2 int"))
    placed = (
        base.withColumns({"part": part_of, "bundle": bundle})
        .join(one, ["group", "part"], "left")
        .join(many, "bundle", "left")
        .select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), F.coalesce("s1", "s2").alias("shard"), F.col("group").isin(*huge).alias("cut"))
    )
    return numbered(placed, "shard", "slot", "shard-slots").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens", "cut"
    )


def op1_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
