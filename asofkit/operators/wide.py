"""Statistics of many columns at once: blocks of rows become small arrays, which are merged.

A partition sends one array of a few numbers a column, whatever its rows, so several hundred columns cost
one pass and no expression each. Nulls and NaN are missing values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Arrays that the driver merges at last: at most so many, of so many numbers together.
FAN_IN, FAN_IN_NUMBERS = 64, 8_000_000
#: Distinct values of all columns up to which their ranks are sent to all tasks (32 MB).
RANK_VALUES = 2_000_000
#: Buckets of a narrowing step, and values from which the next step looks at each.
BUCKETS, FEW = 2048, 4096
_SIGN = np.uint64(1 << 63)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns as doubles, missing ones NaN, and no negative zero."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) + 0.0


def doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def fold(df: DataFrame, columns: Sequence[str], block: Callable, merge: Callable, zero: np.ndarray) -> np.ndarray:
    """One array for the table from ``block(x)`` of its blocks of rows, put together by the associative ``merge(a, b)``."""
    shape, fan_in = zero.shape, max(1, min(FAN_IN, FAN_IN_NUMBERS // max(zero.size, 1)))

    def work(batches):
        total = zero
        for b in batches:
            total = merge(total, block(matrix(b)))
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId() % fan_in], "sums": [total.ravel()]}, pa.schema([("part", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        total = zero
        for s in pdf["sums"]:
            total = merge(total, np.asarray(s).reshape(shape))
        return pd.DataFrame({"part": [0], "sums": [total.ravel()]})

    kind = "part int, sums array<double>"
    parts = doubles(df, columns).mapInArrow(work, kind).groupBy("part").applyInPandas(together, kind)
    out = zero
    for r in parts.collect():  # at most FAN_IN rows of FAN_IN_NUMBERS numbers
        out = merge(out, np.asarray(r["sums"]).reshape(shape))
    return out


def _moments(x: np.ndarray) -> np.ndarray:
    """Count, mean, and sums of the second to fourth power of the distance from it; least and greatest value."""
    some = ~np.isnan(x)
    n = some.sum(axis=0).astype(float)
    mean = np.where(some, x, 0).sum(axis=0) / np.maximum(n, 1)
    d = np.where(some, x - mean, 0)
    d2 = d * d
    return np.stack([n, mean, d2.sum(axis=0), (d2 * d).sum(axis=0), (d2 * d2).sum(axis=0), np.where(some, x, np.inf).min(axis=0, initial=np.inf), np.where(some, x, -np.inf).max(axis=0, initial=-np.inf)])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two parts together, by the pairwise update of central moments."""
    na, ma, a2, a3, a4, lo_a, hi_a = a
    nb, mb, b2, b3, b4, lo_b, hi_b = b
    n = np.maximum(na + nb, 1)
    d = np.where((na > 0) & (nb > 0), mb - ma, 0)
    return np.stack([
        na + nb,
        np.where(na > 0, ma, mb) + d * nb / n,
        a2 + b2 + d**2 * na * nb / n,
        a3 + b3 + d**3 * na * nb * (na - nb) / n**2 + 3 * d * (na * b2 - nb * a2) / n,
        a4 + b4 + d**4 * na * nb * (na**2 - na * nb + nb**2) / n**3 + 6 * d**2 * (na**2 * b2 + nb**2 * a2) / n**2 + 4 * d * (na * b3 - nb * a3) / n,
        np.minimum(lo_a, lo_b),
        np.maximum(hi_a, hi_b),
    ])


def moments(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """n, mean, second to fourth central sums, min and max, a row each, of all columns."""
    k = len(columns)
    return fold(df, columns, _moments, _merged, np.stack([*np.zeros((5, k)), np.full(k, np.inf), np.full(k, -np.inf)]))


def counts(df: DataFrame, columns: Sequence[str], tests: Callable) -> np.ndarray:
    """How many rows of each column meet each of the conditions, an array that ``tests(x)`` gives for a block (condition, row, column)."""
    rows = len(tests(np.empty((0, len(columns)))))
    return fold(df, columns, lambda x: np.asarray(tests(x)).sum(axis=1).astype(float), np.add, np.zeros((rows, len(columns))))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order."""
    b = np.ascontiguousarray(x).view(np.int64)
    return (b ^ ((b >> 63) & np.int64((1 << 63) - 1))).view(np.uint64) ^ _SIGN


def _double(key: int) -> float:
    b = np.array([key], np.uint64) ^ _SIGN
    b = b.view(np.int64)
    return float((b ^ ((b >> 63) & np.int64((1 << 63) - 1))).view(np.float64)[0])


def values_at(df: DataFrame, columns: Sequence[str], places: Sequence[Sequence[int]], ends: np.ndarray) -> list[list[float]]:
    """The values at places (from 0) in each column's order, exactly, by narrowing ranges of values.

    ``ends`` has the columns' least and greatest values. Each step deals a range that holds a wanted
    place into equal parts, counts them, and goes on with the part that holds the place; a range of few
    values is dealt into single ones. So what is shuffled is bounded by the ranges, and
    no value but these few is sent.
    """
    spark = df.sparkSession
    out = [[float("nan")] * len(p) for p in places]
    # Each open place: column, which of its places, first number of the range, its width, the place within, how many values.
    todo = []
    for c, ps in enumerate(places):
        if ps:
            lo, hi = (int(v) for v in _ordered(ends[:, c]))
            todo += [(c, i, lo, hi - lo + 1, int(p), None) for i, p in enumerate(ps)]
    while todo:
        ranges = sorted({(c, lo, width, 1 if n is not None and n <= FEW else -(-width // BUCKETS)) for c, _, lo, width, _, n in todo})
        number = {r[:3]: i for i, r in enumerate(ranges)}

        def count(batches):
            for b in batches:
                x = matrix(b)
                out_i, out_b, out_n = [], [], []
                for i, (c, lo, width, step) in enumerate(ranges):  # noqa: B023
                    v = x[:, c]
                    key = _ordered(v[~np.isnan(v)])
                    far = key - np.uint64(lo)  # what lies before wraps around to beyond
                    part, n = np.unique(far[(key >= np.uint64(lo)) & (far <= np.uint64(width - 1))] // np.uint64(step), return_counts=True)
                    out_i.append(np.full(len(part), i, np.int32))
                    out_b.append(part.view(np.int64))
                    out_n.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (out_i, out_b, out_n)], names=["item", "part", "n"])

        # Parts of a range of few values may have numbers from 2^63 on as longs below 0; their order is that of the bits.
        found = doubles(df, columns).mapInArrow(count, "item int, part long, n long").groupBy("item", "part").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("item").orderBy((F.col("part") < 0), "part")
        wanted = spark.createDataFrame([(i, number[(c, lo, width)], rank) for i, (c, _, lo, width, rank, _) in enumerate(todo)], "todo int, item int, rank long")
        upto = found.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(wanted), "item").where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        after = []
        for r in upto.collect():  # one row a place
            c, i, lo, width, rank, _ = todo[r["todo"]]
            step, part = ranges[number[(c, lo, width)]][3], r["part"] % (1 << 64)
            lo, width = lo + part * step, min(step, width - part * step)
            if width == 1:
                out[c][i] = _double(lo)
            else:
                after.append((c, i, lo, width, rank - (r["upto"] - r["n"]), r["n"]))
        todo = after
    return out


def gram(df: DataFrame, columns: Sequence[str], centred: Callable) -> np.ndarray:
    """Counts, sums, sums of squares and of products over the complete rows of each pair, of what ``centred(x)`` makes of a block."""
    k = len(columns)

    def block(x: np.ndarray) -> np.ndarray:
        x = centred(x)
        some = np.isfinite(x).astype(float)
        x = np.where(some > 0, x, 0.0)
        return np.stack([some.T @ some, x.T @ some, (x * x).T @ some, x.T @ x])

    return fold(df, columns, block, np.add, np.zeros((4, k, k)))


def correlations(g: np.ndarray) -> np.ndarray:
    """Pearson's r from ``gram``, NaN for fewer than two rows or a side that is constant among them."""
    n, sx, sxx, sxy = g
    with np.errstate(all="ignore"):
        cov = sxy / n - (sx / n) * (sx.T / n)
        var = np.maximum(sxx / n - (sx / n) ** 2, 0.0)
        r = cov / np.sqrt(var * var.T)
    ok = (n >= 2) & (var > 1e-12 * np.maximum(1.0, sxx / np.maximum(n, 1))) & (var.T > 1e-12 * np.maximum(1.0, sxx.T / np.maximum(n, 1)))
    return np.where(ok, np.clip(r, -1, 1), np.nan)


def rank_tables(df: DataFrame, columns: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """For each column its distinct values in order and their average ranks; None if there are too many to send."""
    item = [F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v")) for i in range(len(columns))]
    long = doubles(df, columns).select(F.inline(F.array(*item))).where("v is not null and not isnan(v)")
    counts = long.groupBy("c", (F.col("v") + 0.0).alias("v")).agg(F.count("*").alias("n"))
    few = counts.limit(RANK_VALUES + 1).toArrow()
    if len(few) > RANK_VALUES:
        return None
    c, v, n = (few.column(x).to_numpy() for x in ("c", "v", "n"))
    order = np.lexsort((v, c))
    c, v, n = c[order], v[order], n[order]
    at = np.searchsorted(c, np.arange(len(columns) + 1))
    return [(v[a:b], np.cumsum(n[a:b]) - n[a:b] + (n[a:b] + 1) / 2) for a, b in zip(at, at[1:])]


def rank_gram(df: DataFrame, columns: Sequence[str]) -> np.ndarray | None:
    """``gram`` of the columns' average ranks over their own values, without a shuffle of rows; None if there are too many values."""
    tables = rank_tables(df, columns)
    if tables is None:
        return None
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def centred(x: np.ndarray) -> np.ndarray:
        out = np.full(x.shape, np.nan)
        for i, (v, r) in enumerate(shared.value):
            if len(v):
                some = ~np.isnan(x[:, i])
                out[some, i] = r[np.searchsorted(v, x[some, i])] - r.mean()
        return out

    return gram(df, columns, centred)
