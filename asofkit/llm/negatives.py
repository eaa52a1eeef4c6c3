"""Hard negatives by distributed radix selection over integer score histograms."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .katz import grow, shrink

#: Rows of a block, and anchors of a block: the sides of a bounded piece of the score matrix.
BLOCK, ANCHORS = 4096, 4096
#: Row blocks that one task compares with one block of anchors, about.
BLOCKS_A_TASK = 8
#: Bits of a digit at most.
DIGIT = 12
#: A window's number is its anchor's, times this, plus the rank of its positive (0: the anchor's own window).
RANKS = 1024


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, by doubles where these can't round and in 64-bit integers elsewhere."""
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if bound < 2**53:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    return anchors @ rows.T


def _matrix(x: pd.Series, dims: int) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.int64).reshape(len(x), dims)


def _row_blocks(kept: DataFrame) -> DataFrame:
    """Rows as compressed blocks of vectors of one length; each partition cuts its own."""

    def work(frames):
        pid, number = TaskContext.get().partitionId(), 0
        for pdf in frames:
            for dims, part in pdf.groupby("dims"):
                for at in range(0, len(part), BLOCK):
                    p = part.iloc[at : at + BLOCK]
                    data = shrink(p["vec_id"].to_numpy(np.int64), p["label"].to_numpy(np.int64), _matrix(p["x"], dims).ravel())
                    yield pd.DataFrame({"block": [pid << 32 | number], "dims": [dims], "data": [data]})
                    number += 1

    return kept.mapInPandas(work, "block long, dims int, data binary")


def _anchor_blocks(kept: DataFrame, every: int) -> DataFrame:
    """The different anchors in blocks, numbered."""
    asked = kept.where(F.col("vec_id") % every == 0).distinct()
    n = max(1, math.ceil(asked.count() / ANCHORS))
    dealt = asked.withColumn("ab", F.pmod(F.xxhash64("vec_id", "label"), F.lit(n)).cast("long"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out, first = [], 0
        for dims, p in pdf.groupby("dims"):
            number = (int(pdf["ab"].iat[0]) << 32) + first + np.arange(len(p))
            first += len(p)
            data = shrink(number, p["vec_id"].to_numpy(np.int64), p["label"].to_numpy(np.int64), _matrix(p["x"], dims).ravel())
            out.append((int(pdf["ab"].iat[0]), int(dims), data))
        return pd.DataFrame(out, columns=["ab", "dims", "anchors"])

    return dealt.groupBy("ab").applyInPandas(work, "ab long, dims int, anchors binary")


class Cells:
    """Pairs of a row block and an anchor block, each met in one bounded step."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        self.rows, self.anchors = rows, anchors
        self.of_rows = max(1, math.ceil(rows.count() / BLOCKS_A_TASK))
        self.of_anchors = (anchors.agg(F.max("ab")).first()[0] or 0) + 1

    def map(self, windows: DataFrame, work: Callable, schema: str) -> DataFrame:
        """Apply ``work`` to the windows of an anchor block and the scores of one row block, for all pairs of blocks.

        ``work`` gets the windows (a dict of arrays), each window's scores as a function of its
        place, and the rows' ids and labels.
        """
        names = ["w", "own", "label", "same", "top", "width", "prefix", "need", "whole"]

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("w")
            return pd.DataFrame({"of": [int(pdf["ab"].iat[0])], "windows": [shrink(*[pdf[n].to_numpy(np.int64) for n in names])]})

        packed = windows.withColumn("ab", F.shiftright("w", 32 + RANKS.bit_length() - 1))
        packed = packed.groupBy("ab").applyInPandas(pack, "of long, windows binary")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = self.anchors.join(packed, F.col("ab") == F.col("of")).drop("of").withColumn("cell", upto(self.of_rows))
        right = self.rows.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(self.of_rows)).cast("long")).withColumn("ab", upto(self.of_anchors))

        def run(frames):
            for pdf in frames:
                for r in pdf.itertuples():
                    number, _, _, a = grow(r.anchors)
                    ids, labels, x = grow(r.data)
                    a, x = a.reshape(-1, r.dims), x.reshape(-1, r.dims)
                    win = dict(zip(names, grow(r.windows)))
                    at = win["w"] // RANKS - number[0]
                    mine = np.flatnonzero((at >= 0) & (at < len(number)))
                    for lo in range(0, len(number), 512):
                        part = mine[(at[mine] >= lo) & (at[mine] < lo + 512)]
                        if len(part):
                            scores = _products(a[lo : lo + 512], x)
                            yield from work({n: v[part] for n, v in win.items()}, lambda i: scores[at[part[i]] - lo], ids, labels)  # noqa: B023

        return right.join(left, ["ab", "dims", "cell"]).select("dims", "data", "anchors", "windows").mapInPandas(run, schema)


def _inside(win: dict, i: int, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows in window i, and how far each one's score is below the window's top."""
    below = win["top"][i] - score
    ok = (below >= 0) & (below <= win["width"][i]) & ((labels == win["label"][i]) == bool(win["same"][i])) & (ids != win["own"][i])
    at = np.flatnonzero(ok)
    return at, below[at]


def select(cells: Cells, windows: DataFrame, k: int, widest: int) -> DataFrame:
    """The k rows of highest score in each window (all, if fewer), ties to the smaller id: w, rank, vec_id, score.

    Rows are counted by the leading digit of their distance from the window's top. The digit at which
    the count reaches k is the kth row's; the next digit is counted among rows of that one alone, and
    so on, until its score is known. Only rows of that score or a higher one are then gathered. A
    task sends the counts of as many leading digits as hold k of its own rows, as the kth row of
    all can't lie beyond the kth one of a part.
    """
    bits = max(1, int(widest).bit_length())
    rounds = -(-bits // DIGIT)
    digit = -(-bits // rounds)
    state = materialise(windows.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("whole")), "negatives-windows")
    for n in reversed(range(rounds)):
        shift = n * digit

        def count(win, scores, ids, labels):
            out = []
            for i in np.flatnonzero(win["whole"] == 0):
                _, below = _inside(win, i, scores(i), ids, labels)
                below = below[below >> (shift + digit) == win["prefix"][i]]  # noqa: B023
                if len(below):
                    held = np.bincount((below >> shift) & ((1 << digit) - 1))  # noqa: B023
                    some = np.flatnonzero(held)
                    some = some[: np.searchsorted(np.cumsum(held[some]), win["need"][i]) + 1]
                    out.append((np.full(len(some), win["w"][i]), some, held[some]))
            if out:
                w, d, c = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"of": w, "digit": d, "n": c})

        sums = cells.map(state, count, "of long, digit long, n long").groupBy("of", "digit").agg(F.sum("n").alias("n"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("of").orderBy("digit")))
        reached = upto.join(state.select(F.col("w").alias("of"), F.col("need").alias("wanted")), "of").where("upto >= wanted")
        found = reached.groupBy("of").agg(F.min(F.struct("digit", F.expr("wanted - (upto - n)").alias("left"))).alias("hit"))
        after = state.join(found, F.col("w") == F.col("of"), "left").drop("of")
        # A window with fewer than k rows is taken whole; only the first digit can show it.
        whole = F.when((F.col("whole") == 1) | F.col("hit").isNull(), 1).otherwise(0).cast("long")
        prefix = F.when(whole == 0, F.shiftleft(F.col("prefix"), digit) + F.col("hit.digit")).otherwise(F.col("prefix"))
        fixed = ["w", "own", "label", "same", "top", "width"]
        before, state = state, materialise(after.select(*fixed, prefix.alias("prefix"), F.coalesce("hit.left", "need").alias("need"), whole.alias("whole")), "negatives-windows")
        discard(before)

    def gather(win, scores, ids, labels):
        out = []
        for i in range(len(win["w"])):
            score = scores(i)
            at, below = _inside(win, i, score, ids, labels)
            if not win["whole"][i]:
                near = below <= win["prefix"][i]
                at, below = at[near], below[near]
            at = at[np.lexsort((ids[at], below))][:k]
            if len(at):
                out.append((np.full(len(at), win["w"][i]), ids[at], score[at]))
        if out:
            w, v, s = (np.concatenate(x) for x in zip(*out))
            yield pd.DataFrame({"w": w, "vec_id": v, "score": s})

    got = cells.map(state, gather, "w long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", best).where(F.col("rank") <= k).select("w", "rank", "vec_id", "score")


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, scale: int = 256, every: int = 100, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its positives, the hardest rows of another label within a window of scores.

    ``vectors`` has vec_id, label (a whole number) and embedding. Components become floor(scale * x); a
    row's score is its inner product with the anchor, exact as long as it fits 64 bits. Anchors
    are the rows whose vec_id is divisible by ``every``. An anchor's positives are the other rows
    of its label with the highest scores; negatives of a positive with score p are the rows of another label with
    low * p <= 100 * score <= high * p, the highest scores first. Ties go to the smaller vec_id.

    Rows with a null vec_id or label, a null or empty vector, or a null or non-finite component take
    no part. Vectors of other lengths than an anchor's have no inner product with it. Rows with
    an anchor's own vec_id are no candidates for it. Equal rows are candidates each, so one may be a
    positive twice, and one anchor together. Extra columns are ignored; an empty table gives an
    empty result. Raises ValueError if scores may exceed 61 bits.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    if positives >= RANKS:
        raise ValueError(f"at most {RANKS - 1} positives")
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = F.transform(e, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    kept = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size(e).alias("dims"), x.alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    bound = math.ceil((kept.agg(F.max(norm)).first()[0] or 0.0) * (1 + 1e-9)) + 1  # no score is larger
    if bound >= 1 << 61:
        raise ValueError("scores may exceed 61 bits")
    cells = Cells(materialise(_row_blocks(kept), "negatives-rows"), materialise(_anchor_blocks(kept, every), "negatives-anchors"))

    def unpack(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                number, ids, labels, _ = grow(r.anchors)
                yield pd.DataFrame({"w": number * RANKS, "own": ids, "label": labels})

    anchors = cells.anchors.mapInPandas(unpack, "w long, own long, label long")
    own = anchors.select("*", F.lit(1).cast("long").alias("same"), F.lit(bound).cast("long").alias("top"), F.lit(2 * bound).cast("long").alias("width"))
    near = materialise(select(cells, own, positives, 2 * bound), "negatives-positives")
    # Whole numbers only: the highest and the lowest score that the window allows.
    s = F.col("score")
    upper, lower = F.expr(f"cast(floor(cast(score as decimal(20, 0)) * {high} / 100) as long)"), F.expr(f"cast(ceil(cast(score as decimal(20, 0)) * {low} / 100) as long)")
    pairs = near.join(anchors, "w").select((F.col("w") + F.col("rank")).alias("w"), "own", "label", F.lit(0).cast("long").alias("same"), upper.alias("top"), (upper - lower).alias("width"), "vec_id", s)
    pairs = materialise(pairs, "negatives-pairs")
    asked = pairs.where("width >= 0").drop("vec_id", "score")
    hard = select(cells, asked, negatives, max(1, bound * max(0, high - low) // 100 + 1))
    named = pairs.select("w", F.col("own").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, "w").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


#: The same rows by brute force.
OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x)
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 80 * p.positive_score AND 100 * p.positive_score
  WHERE p.place <= 5
)
SELECT * FROM n WHERE rank <= 5
"""
