"""Exploratory statistics: every report is one or two aggregations, whatever the number of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wide

NEAR_ZERO = 1e-8
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def classify(df: DataFrame, labels: Sequence[str] = (), identity: Sequence[str] = ()) -> dict[str, str]:
    """identity, label, mask, boolean, numeric or other, by name and type."""

    def kind(f: T.StructField) -> str:
        if f.name in identity:
            return "identity"
        if f.name in labels or f.name.startswith("label_"):
            return "label"
        if f.name.startswith("obs_"):
            return "mask"
        if isinstance(f.dataType, T.BooleanType):
            return "boolean"
        return "numeric" if isinstance(f.dataType, _NUMERIC) else "other"

    return {f.name: kind(f) for f in df.schema}


def missing(df: DataFrame, columns: Sequence[str], flag: str | None = None) -> DataFrame:
    """Nulls and their share, and with ``flag`` the shares where it is true and where it isn't."""
    k, held = len(columns), F.coalesce(F.col(flag), F.lit(False)).cast("double") if flag else F.lit(1.0)
    marks = df.select(*[F.col(f"`{c}`").isNull().cast("double").alias(f"n{i}") for i, c in enumerate(columns)], held.alias("held"))
    sums = lambda x: np.stack([np.r_[x[:, :k].sum(axis=0), len(x)], np.r_[(x[:, :k] * x[:, k:]).sum(axis=0), x[:, k].sum()]])
    (nulls, of_held) = wide.fold(marks, marks.columns, sums, np.add, np.zeros((2, k + 1)))
    n, n_held = nulls[k], of_held[k]
    share = lambda a, b: float(a / b) if b else None
    rows = [(c, int(n), int(nulls[i]), share(nulls[i], n)) + ((share(of_held[i], n_held), share(nulls[i] - of_held[i], n - n_held)) if flag else ()) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column string, n long, nulls long, share double" + (", share_observed double, share_unobserved double" if flag else ""))


def missing_by(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """column, value of ``by``, n, nulls and share of nulls; ``by`` has few values, each a row of one small array."""
    kinds = [r[0] for r in df.select(by).distinct().orderBy(by).collect()]
    k, at = len(columns), F.lit(len(kinds))
    for i, v in enumerate(kinds):
        at = F.when(F.col(by).eqNullSafe(F.lit(v)), i).otherwise(at)
    marks = df.select(*[F.col(f"`{c}`").isNull().cast("double").alias(f"n{i}") for i, c in enumerate(columns)], at.cast("double").alias("at"))

    def block(x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros((len(kinds), k + 1)), x[:, k].astype(int)
        np.add.at(out, rows, np.c_[x[:, :k], np.ones(len(x))])
        return out

    sums = wide.fold(marks, marks.columns, block, np.add, np.zeros((len(kinds), k + 1)))
    rows = [(c, v, int(sums[j, k]), int(sums[j, i]), float(sums[j, i] / sums[j, k])) for j, v in enumerate(kinds) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("column", T.StringType()), T.StructField(by, df.schema[by].dataType), *[T.StructField(n, T.LongType()) for n in ("n", "nulls")], T.StructField("share", T.DoubleType())]))


def target_bands(df: DataFrame, columns: Sequence[str], band: Column) -> DataFrame:
    """column, band, n, mean and standard deviation of each column within the bands of a target; null bands are left out."""
    rows = df.where(band.isNotNull()).select(band.alias("band"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    return rows.groupBy("column", "band").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, null counting as one; counted in two steps, so no row is repeated for each column of a wide aggregate."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])))
    found = long.groupBy("column", "v").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("n_unique"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"))


def shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample variance, whether that is near zero, population skewness and excess kurtosis (from 3 values)."""
    n, mean, m2, m3, m4, *_ = wide.moments(df, columns)
    rows = []
    for i, c in enumerate(columns):
        variance = m2[i] / (n[i] - 1) if n[i] > 1 else None
        vary = n[i] >= 3 and m2[i] > 0
        skewness = m3[i] / n[i] / (m2[i] / n[i]) ** 1.5 if vary else None
        kurtosis = m4[i] / n[i] / (m2[i] / n[i]) ** 2 - 3 if vary else None
        rows.append((c, int(n[i]), float(mean[i]) if n[i] else None, variance, bool(variance is not None and variance < NEAR_ZERO), skewness, kurtosis))
    plain = [tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows]
    return df.sparkSession.createDataFrame(plain, "column string, n long, mean double, variance double, near_zero boolean, skewness double, kurtosis double")


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and v (double) of every value that isn't null."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v is not null")


def ordered_counts(values: DataFrame) -> DataFrame:
    """column, v, n, before, total: each distinct value with its count and how many smaller ones there are.

    Values are dealt into ranges at approximate quantiles, which are literals of the plan; running
    sums are taken within ranges, and the ranges' totals, one row for each column and range, tell
    where each range starts. So no task orders a whole column.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = values.groupBy("column", "v").agg(F.count("*").alias("n"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    splits = F.broadcast(values.groupBy("column").agg(F.array_distinct(F.percentile_approx("v", shares, F.lit(10 * parts))).alias("_splits")))  # one row a column
    ranged = counts.join(splits, "column").withColumn("_range", F.size(F.filter("_splits", lambda x: x <= F.col("v")))).drop("_splits")
    totals = ranged.groupBy("column", "_range").agg(F.sum("n").alias("_n"))  # at most `parts` rows a column
    of_column = Window.partitionBy("column")
    starts = totals.select(
        "column", "_range", F.sum("_n").over(of_column).alias("total"),
        F.coalesce(F.sum("_n").over(of_column.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy("column", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["column", "_range"]).select(
        "column", "v", "n", (F.col("_start") + F.col("_before")).alias("before"), "total"
    )


def nearest_quantile(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """n and the values at the sorted places nearest to q * (n - 1), the upper one at a half."""
    n, *_, low, high = wide.moments(df, [column])
    places = [[math.floor(q * (n[0] - 1) + 0.5) for q in shares] if n[0] else []]
    found = wide.values_at(df, [column], places, np.stack([low, high]))[0] or [None] * len(shares)
    return df.sparkSession.createDataFrame([(int(n[0]), *found)], "n long, " + ", ".join(f"q{round(q * 100)} double" for q in shares))


def outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside the linearly interpolated quartiles by 1.5 of their range, and beyond 3 sample deviations."""
    n, mean, m2, *_, low, high = wide.moments(df, columns)
    at = lambda q, m: (math.floor(q * (m - 1)), math.ceil(q * (m - 1)))
    found = wide.values_at(df, columns, [[*at(0.25, m), *at(0.75, m)] if m else [] for m in n], np.stack([low, high]))
    between = lambda q, m, a, b: a + (b - a) * (q * (m - 1) - math.floor(q * (m - 1)))
    q1, q3 = (np.array([between(q, m, *v[i : i + 2]) if v else np.nan for m, v in zip(n, found)]) for q, i in ((0.25, 0), (0.75, 2)))
    spread = 1.5 * (q3 - q1)
    with np.errstate(all="ignore"):
        sd = np.sqrt(np.where(n > 1, m2 / np.maximum(n - 1, 1), np.nan))
    wide_, far = wide.counts(df, columns, lambda x: [(x < q1 - spread) | (x > q3 + spread), np.abs(x - mean) > 3 * sd])
    rows = [(c, int(w), int(f), int(m)) for c, w, f, m in zip(columns, wide_, far, n)]
    return df.sparkSession.createDataFrame(rows, "column string, iqr_outliers long, z_outliers long, n long")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's r of the complete pairs; null for fewer than two, or if either side is constant among them.

    Constant is what has one value: merged means of equal values may differ in the last digit, and then
    so does the deviation from 0.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def average_rank(value: str | Column, *partition: str | Column) -> Column:
    """Ranks from 1, equal values sharing the mean of theirs; null stays null."""
    v = F.col(value) if isinstance(value, str) else value
    some = v.isNotNull()
    ordered, equal = Window.partitionBy(*partition, some).orderBy(v), Window.partitionBy(*partition, some, v)
    return F.when(some, F.rank().over(ordered) + (F.count(F.lit(1)).over(equal) - 1) / 2.0)


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b and r for all pairs of columns in order, from pairwise complete rows, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def _pairs(df: DataFrame, columns: Sequence[str], g: np.ndarray) -> DataFrame:
    r, k = wide.correlations(g), len(columns)
    rows = [(columns[i], columns[j], int(g[0, i, j]), None if np.isnan(r[i, j]) else float(r[i, j])) for i in range(k) for j in range(i + 1, k)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, n long, r double")


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n and r of all pairs of columns in order, over each pair's complete rows, for many columns.

    Each partition sends sums of products of values and of their presence, four matrices of one row
    a column; values are taken from their means first, which keeps the sums small.
    """
    mean = wide.moments(df, columns)[1]
    return _pairs(df, columns, wide.gram(df, columns, lambda x: x - np.where(np.isfinite(mean), mean, 0.0)))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As ``pearson_matrix``, of the columns' average ranks over their own values.

    Up to a number of distinct values, their ranks go to all tasks, and rows aren't shuffled; beyond
    it, rows meet the ranks by value.
    """
    g = wide.rank_gram(df, columns)
    return pearson_matrix(ranked(df, columns), columns) if g is None else _pairs(df, columns, g)


def ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns replaced by their average ranks over their own values, found by value, all at once.

    Rows without any value are left out. Equal values of one column meet as one row on the side of
    the ranks; AQE splits a value that most rows have.
    """
    item = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
    # Numbered before the values are dealt out, so that a row's values keep one number.
    long = df.withColumn("_i", F.monotonically_increasing_id()).select("_i", F.inline(F.array(*map(item, columns)))).where("v is not null")
    own = ordered_counts(long_form(df, columns)).select("column", "v", (F.col("before") + (F.col("n") + 1) / 2.0).alias("_r"))
    return long.join(own, ["column", "v"]).groupBy("_i").agg(*[F.max(F.when(F.col("column") == c, F.col("_r"))).alias(c) for c in columns]).drop("_i")


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return spearman_matrix(df.select(*columns), columns).select("a", "b", "r")


def high_pairs(pairs: DataFrame, above: float = 0.9, nulls_first: bool = False) -> DataFrame:
    """Pairs of |r| above the bound, largest first."""
    size = F.abs("r")
    return pairs.where(size > above).orderBy(size.desc_nulls_first() if nulls_first else size.desc_nulls_last(), "a", "b")


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson and Spearman correlation of each column with the target over their complete pairs.

    The ranks are within the pairs of each column, found by value, so no task orders a column.
    """
    t = F.col(target).cast("double")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), t.alias("y")) for c in columns]))).where("x is not null and y is not null")
    rank = lambda v, out: ordered_counts(long.select("column", F.col(v).alias("v"))).select("column", F.col("v").alias(v), (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))
    w = long.join(rank("x", "rx"), ["column", "x"]).join(rank("y", "ry"), ["column", "y"])
    return w.groupBy("column").agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("pearson"), safe_corr(F.col("rx"), F.col("ry")).alias("spearman"))


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of a seeded hash of all their columns: the same rows for the same table, however it is partitioned."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])).limit(n)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, list[str]]:
    """Pearson's matrix of the rows complete in all columns that have values; returns it with those columns.

    The sums come from the executors' Gram blocks: one small matrix a partition, not one
    expression a pair, so several hundred columns are fine.
    """
    some = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    used = [c for c in columns if some[c]]
    k = len(used)

    def gram(frames):
        total = np.zeros((k + 1, k + 1))
        for pdf in frames:
            x = np.c_[np.ones(len(pdf)), pdf.to_numpy(float)]
            total += x.T @ x
        import pandas as pd

        yield pd.DataFrame({"row": np.arange(k + 1), "sums": list(total)})

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in used]).dropna().mapInPandas(gram, "row int, sums array<double>")
    sums = rows.groupBy("row").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(k + 1)]).alias("s")).collect()  # k + 1 rows
    g = np.zeros((k + 1, k + 1))
    for r in sums:
        g[r["row"]] = r["s"]
    n = max(g[0, 0], 1.0)
    cov = g[1:, 1:] / n - np.outer(g[0, 1:], g[0, 1:]) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    ok = sd > 1e-12 * np.maximum(1, np.abs(g[0, 1:] / n))
    return cov[np.ix_(ok, ok)] / np.outer(sd[ok], sd[ok]), [c for c, o in zip(used, ok) if o]


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and vif = 1 / (1 - R squared), the diagonal of the inverse correlation matrix; infinite if singular.

    Columns without values or variance are left out first, so they don't empty the complete rows.
    """
    r, used = correlation_matrix(df, columns)
    vif = []
    for i in range(len(used)):
        others = [j for j in range(len(used)) if j != i]
        r2 = float(r[i, others] @ np.linalg.lstsq(r[np.ix_(others, others)], r[others, i], rcond=None)[0]) if others else 0.0
        vif.append(float("inf") if r2 >= 1 - 1e-10 else 1 / (1 - r2))
    return df.sparkSession.createDataFrame(list(zip(used, vif)), "column string, vif double")


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information, in nats, of each column and the target, both in equal-width bins; nulls are a bin of their own.

    A plug-in estimate on bins, not a nearest-neighbour one.
    """
    every = [*columns, target]
    n, *_, lows, highs = wide.moments(df, every)
    ends = {c: (float(a), float(b)) if m else (None, None) for c, m, a, b in zip(every, n, lows, highs)}

    def bin_(c: str) -> Column:
        low, high = ends[c]
        if low is None or low == high:
            return F.when(F.col(c).isNull(), -1).otherwise(0)
        return F.coalesce(F.least(F.lit(bins - 1), F.floor((F.col(c).cast("double") - low) / (high - low) * bins)).cast("int"), F.lit(-1))

    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), bin_(c).alias("x"), bin_(target).alias("y")) for c in columns])))
    cells = long.groupBy("column", "x", "y").agg(F.count("*").cast("double").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy("column", *k))
    return cells.withColumns({"nx": by("x"), "ny": by("y"), "all": by()}).groupBy("column").agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("mi"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, low, high and n of equal-width bins."""
    ends = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if ends[0] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (ends[1] - ends[0]) / bins or 1.0
    b = F.least(F.lit(bins - 1), F.floor((F.col(column).cast("double") - ends[0]) / width)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(ends[0]) + F.col("bin") * width).alias("low"), (F.lit(ends[0]) + (F.col("bin") + 1) * width).alias("high"), "n")
