"""Windows over keys of any size: large keys are cut into ranges, and what lies before a range is carried into it.

A window brings all rows of its key to one task. Here a key with more than a number of rows is cut
into ranges of its order, each of which is a window of its own. Two things then reach over the edges:
totals of all earlier ranges (for frames without a start), and the last rows before a range
(for frames of a number of rows). Both come from tables of a few rows a range.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key from which it is cut, and of a range, about.
RANGE_ROWS = 1_000_000
#: Ranges of a key at most, as their edges are taken in one row; a larger key has longer ranges.
MOST_RANGES = 10_000


def as_number(df: DataFrame, column: str) -> Column:
    """A date, a time or a number as a double in the same order."""
    kind, c = df.schema[column].dataType.typeName(), F.col(f"`{column}`")
    if kind in ("string", "binary", "struct", "array", "map"):
        raise TypeError(f"{column} must be a number, a date or a time to cut large keys, not {kind}")
    return (F.unix_date(c) if kind == "date" else F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c).cast("double")


def plus(a: Column, b: Column) -> Column:
    """The sum of what isn't null, null if nothing is."""
    return F.coalesce(a + b, a, b)


class Cut:
    """The rows of ``df`` with _range, the number of their range within their key.

    ``at`` is the first column of the order; rows that are equal in it stay in one range. ``by`` are
    the columns by which windows are to be partitioned. ``large`` says whether any key is cut; if
    not, there is one range, 0, and nothing to carry.
    """

    def __init__(self, df: DataFrame, key: Sequence[str], at: str, rows: int | None = None):
        rows = rows or RANGE_ROWS
        self.columns, self.by = df.columns, [*key, "_range"]
        whole = F.struct(*[F.col(f"`{k}`") for k in key], F.lit(0).alias("_all"))  # nulls within equal each other
        sizes = df.groupBy(whole.alias("_of")).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
        most = sizes.agg(F.max("_n")).first()[0]
        self.large = most is not None
        if not self.large:
            self.rows = df.withColumn("_range", F.lit(0))
            return
        parts = min(MOST_RANGES, math.ceil(most / rows))
        keyed = df.withColumn("_key", whole).withColumn("_at", as_number(df, at))
        # Large keys are at most all rows / ``rows``, so these tables are small.
        hot = keyed.select("_key", "_at").join(F.broadcast(sizes), F.col("_key") == F.col("_of"))
        edges = F.percentile_approx("_at", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts))
        found = hot.groupBy("_of").agg(edges.alias("_edges"), F.max(F.floor(F.lit(parts * rows) / F.col("_n"))).alias("_step"))
        some = F.array_distinct(F.filter("_edges", lambda x, i: (i + 1) % F.greatest(F.col("_step"), F.lit(1)) == 0))  # smaller keys have fewer edges
        place = F.size(F.filter("_edges", lambda x: x <= F.col("_at")))
        joined = keyed.join(F.broadcast(found.select("_of", some.alias("_edges"))), F.col("_key") == F.col("_of"), "left")
        self.rows = joined.withColumn("_range", F.when(F.col("_of").isNotNull(), place).otherwise(0)).withColumn("_large", F.col("_of").isNotNull()).drop("_of", "_edges", "_at")

    def _per_range(self, made: Mapping[str, Column]) -> DataFrame:
        return self.rows.where("_large").groupBy("_key", "_range").agg(*[c.alias(n) for n, c in made.items()])

    def carry(self, rows: DataFrame, made: Mapping[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
        """``rows`` with totals of all earlier ranges of their key, null in the first one.

        ``made`` has for each name an aggregate of a range's rows, and the function that merges
        such aggregates, in the order of ranges.
        """
        before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        totals = self._per_range({n: c for n, (c, _) in made.items()})
        totals = totals.select(F.col("_key").alias("_of"), F.col("_range").alias("_at"), *[merge(n).over(before).alias(n) for n, (_, merge) in made.items()])
        return rows.join(F.broadcast(totals), (F.col("_key") == F.col("_of")) & (F.col("_range") == F.col("_at")), "left").drop("_of", "_at")

    def with_last(self, n: int, order: Sequence[str], where: Column | None = None) -> DataFrame:
        """The rows, and with _halo true copies of the last ``n`` ones (of those that ``where`` allows) before each range."""
        own = self.rows.withColumn("_halo", F.lit(False))
        if not self.large:
            return own
        of_key = Window.partitionBy("_key").orderBy("_range")
        kept = F.lit(1) if where is None else F.when(where, 1)
        ranges = self._per_range({"_kept": F.count(kept)}).withColumn("_i", F.row_number().over(of_key)).withColumn("_upto", F.sum("_kept").over(of_key.rowsBetween(Window.unboundedPreceding, 0)))
        last = self.rows.where("_large") if where is None else self.rows.where(F.col("_large") & where)
        backward = Window.partitionBy("_key", "_range").orderBy(*[F.desc(f"`{c}`") for c in order])
        last = last.withColumn("_back", F.row_number().over(backward)).where(F.col("_back") <= n)
        mine = ranges.select(F.col("_key").alias("_of"), F.col("_range").alias("_at"), "_i", "_upto")
        last = last.join(F.broadcast(mine), (F.col("_key") == F.col("_of")) & (F.col("_range") == F.col("_at"))).drop("_of", "_at", "_range")
        # A row belongs to all later ranges that begin less than n rows after it. Where a range has none
        # that ``where`` allows, the next ones are reached too, so all later ranges are looked at, up to the first beyond.
        ahead = ranges.select(F.col("_key").alias("_of"), "_range", F.col("_i").alias("_to"), (F.col("_upto") - F.col("_kept")).alias("_start"))
        place = F.col("_upto") - F.col("_back") + 1
        copies = last.join(F.broadcast(ahead), (F.col("_key") == F.col("_of")) & (F.col("_to") > F.col("_i")) & (F.col("_start") < place + n)).drop("_of", "_to", "_start", "_i", "_upto", "_back")
        return own.unionByName(copies.withColumn("_halo", F.lit(True)))

    def done(self, rows: DataFrame, *made: str) -> DataFrame:
        """The given columns and those that were made."""
        return rows.select(*[F.col(f"`{c}`") for c in (*self.columns, *made)])
