"""Errors of predictions, and chronological splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions.scoring import BUCKETS, outcome_bucket

from .explore import average_rank, safe_corr

SMALLEST = 1e-9
#: First years of the training seasons, validation and test (fixed values).
SPLITS = {**{y: "train" for y in range(2016, 2024)}, 2024: "validation", 2025: "test"}


def split_of(start_year: Column, splits: Mapping[int, str] = SPLITS) -> Column:
    """train, validation or test by season; an unknown one raises when it is read."""
    out = F.raise_error(F.concat(F.lit("no split for season "), F.coalesce(start_year.cast("string"), F.lit("null"))))
    for year, name in splits.items():
        out = F.when(start_year == year, name).otherwise(out)
    return out


def complete(y: Column, p: Column) -> Column:
    """Whether both are numbers: neither null nor NaN."""
    return y.isNotNull() & p.isNotNull() & ~F.isnan(y.cast("double")) & ~F.isnan(p.cast("double"))


def metrics(y: Column, p: Column) -> list[Column]:
    """n, mae and rmse of the complete pairs."""
    d = F.when(complete(y, p), y.cast("double") - p.cast("double"))
    return [F.count(d).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse")]


def deviance(y: Column, p: Column) -> Column:
    """Mean Poisson deviance, predictions clipped to a small positive number, y ln y being 0 at 0."""
    ok = complete(y, p)
    a, b = y.cast("double"), F.greatest(p.cast("double"), F.lit(SMALLEST))
    term = F.when(a > 0, a * F.ln(F.greatest(a, F.lit(SMALLEST)) / b)).otherwise(0.0) - (a - b)
    return (2 * F.avg(F.when(ok, term))).alias("deviance")


def bucket_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Errors over all rows and in each bucket of the realised total; an empty bucket has n = 0."""
    spark = df.sparkSession
    y, p = F.col(actual), F.col(predicted)
    rows = df.select(F.inline(F.array(*[F.struct(b.alias("bucket"), y.alias("y"), p.alias("p")) for b in (F.lit("overall"), outcome_bucket(y))])))
    found = rows.groupBy("bucket").agg(*metrics(F.col("y"), F.col("p")))
    every = spark.createDataFrame([("overall",), *[(b,) for b in BUCKETS]], "bucket string")
    return every.join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rank_correlation(df: DataFrame, block: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Spearman's correlation within each block; null for fewer than two pairs or a constant side."""
    rows = df.where(complete(F.col(actual), F.col(predicted)))
    r = rows.withColumns({"_a": average_rank(actual, *block), "_p": average_rank(predicted, *block)})
    return r.groupBy(*block).agg(F.count("*").alias("n"), safe_corr(F.col("_a"), F.col("_p")).alias("spearman"))


def residuals(df: DataFrame, by: Sequence[str], value: str, published: str) -> DataFrame:
    """Rows, exact ones, and mean, deviation, mean and greatest size of value - published; rows without either are left out."""
    d = (F.col(value) - F.col(published)).cast("double")
    rows = df.where(d.isNotNull()).withColumn("_d", d)
    r = F.col("_d")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(r == 0).alias("exact"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.avg(F.abs(r)).alias("mean_abs"), F.max(F.abs(r)).alias("worst"))
