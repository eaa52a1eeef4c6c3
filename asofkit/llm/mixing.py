"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table

#: A Poisson count of a larger mean is drawn as the sum of several with at most this mean each.
LARGEST_MEAN = 32.0
SEED = "mix-1"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 48 bits of the md5 of the parts."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as far as doubles tell them from 1; mean is at most LARGEST_MEAN."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    p0 = F.exp(-mean)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]


def rates(docs: DataFrame, source: Column, weights: Mapping[str | None, float] | None, power: float, epochs: float) -> DataFrame:
    """source, rate, parts and cdf. Sources outside ``weights`` have weight 0 if any are given."""
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long")
    sizes = materialise(docs.select(source.alias("source"), size.alias("n")).groupBy("source").agg(F.sum("n").alias("bytes")), "source-sizes")
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for s, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(weight)
    total, whole = sizes.agg(F.sum("bytes"), F.sum(weight)).first()
    rate = weight / F.lit(whole or 1.0) * F.lit(float(total or 0) * epochs) / F.col("bytes")
    with_rate = sizes.select("source", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int"))
    return with_rate.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def replicate(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, epochs: float = 1.0
) -> tuple[DataFrame, dict[str, str]]:
    """Repeat each document by a Poisson count so that sources reach their target shares of the bytes.

    The target of a source is its entry in ``weights``, or without these its bytes to the
    ``power``. Its mean repetition rate is target share * ``epochs`` * all bytes / its bytes; a
    document's count is the inverse of that Poisson distribution at a number hashed from its id.
    Copies are dealt to partitions by a hash of id and copy, and ordered by it within them, which
    is one global shuffle in random order. A rare source's high rate is drawn as a sum of counts.

    Bytes are UTF-8 bytes + 1, so null and empty texts take part. A null source is a source of its
    own. Documents of one id (null too) get one count. An empty table gives an empty result.
    Returns the documents with four columns more, whose names, kept clear of the given ones, are
    the values of the second result: rate, copies, copy (from 1), shuffle_key.
    """
    names: dict[str, str] = {}
    out = docs
    for c in ("rate", "copies", "copy", "shuffle_key", "mix_source", "mix_parts", "mix_cdf"):
        names[c] = fresh(out, c)
        out = out.withColumn(names[c], F.lit(None))
    table_ = rates(docs, F.col("source").cast("string"), weights, power, epochs).select(
        F.col("source").alias(names["mix_source"]), F.col("rate").alias(names["rate"]), F.col("parts").alias(names["mix_parts"]), F.col("cdf").alias(names["mix_cdf"])
    )
    # An equality join on a value that stands for null too; AQE splits a source that is hot, or
    # broadcasts the rates if their measured size is below its threshold.
    joined = docs.join(table_, F.col("source").cast("string").eqNullSafe(F.col(names["mix_source"])))
    parts, cdf = F.col(names["mix_parts"]), F.col(names["mix_cdf"])
    # The number of CDF values at or below u.
    draw = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform("count", F.col("doc_id"), j)))
    count = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, j: a + draw(j))
    counted = joined.withColumn(names["copies"], count).drop(names["mix_source"], names["mix_parts"], names["mix_cdf"])
    copied = counted.where(F.col(names["copies"]) > 0).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(names["copy"])).cast("binary"))
    keyed = copied.withColumn(names["shuffle_key"], key)
    return keyed.repartition(names["shuffle_key"]).sortWithinPartitions(names["shuffle_key"]), names


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = replicate(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", "copies", "copy", F.round("rate", 9).alias("rate"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"), "shuffle_key"
    )


OP3_SQL = """
WITH sizes AS (
  SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS DOUBLE) AS b FROM documents GROUP BY source
), total AS (
  SELECT sum(b) AS b, sum(sqrt(b)) AS w FROM sizes
), rates AS (
  SELECT s.source, sqrt(s.b) / t.w * t.b / s.b AS rate,
         CAST(greatest(1, ceil(sqrt(s.b) / t.w * t.b / s.b / 32)) AS INTEGER) AS parts
  FROM sizes s, total t
), probs AS (
  SELECT source, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS p
  FROM (SELECT source, rate, parts, unnest(range(0, CAST(ceil(rate / parts + 12 * sqrt(rate / parts) + 20) AS BIGINT) + 1)) AS k FROM rates)
), cdf AS (
  SELECT source, list(c ORDER BY k) AS cs FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM probs) GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.source, r.rate, md5(coalesce(d.text, '')) AS text_md5,
    list_sum(list_transform(range(1, r.parts + 1), lambda j: len(list_filter(c.cs, lambda x:
      x <= CAST('0x' || substr(md5('mix-1:count:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(j AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0)))) AS n
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
), copied AS (
  SELECT doc_id, source, CAST(n AS INTEGER) AS copies, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INTEGER) AS copy, round(rate, 9) AS rate, text_md5
  FROM drawn
)
SELECT *, md5('mix-1:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy AS VARCHAR)) AS shuffle_key FROM copied
"""
