"""Windows over large keys give what they give when a key is one task's."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from asofkit.operators import pit
from asofkit.operators.ranges import Cut

ROWS = 40


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with half of the rows, a null key, blocks of many rows, nulls in every value, and unequal times."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        k = "hot" if i % 2 else rng.choice(["a", "b", None])
        block = rng.randrange(12) if rng.random() < 0.3 else rng.randrange(300)
        stat = rng.randrange(50) if rng.random() < 0.6 and not 100 < block < 180 else None  # a run without any value
        rows.append((k, block, i, stat, float(rng.randrange(90)) if rng.random() < 0.8 else None, rng.choice([True, False, None])))
    return spark.createDataFrame(rows, "k string, block int, f int, stat int, minutes double, obs boolean").cache()


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def both(f):
    cut, one = f(ROWS), f(10**9)
    assert cut.columns == one.columns
    got = rows(cut)
    assert got == rows(one)
    return got


def test_ranges_are_disjoint_and_of_a_size(skewed):
    cut = Cut(skewed, ["k"], "block", ROWS)
    found = cut.rows.groupBy("k", "_range").agg(F.count("*").alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi"), F.countDistinct("block").alias("blocks")).orderBy("k", "lo").collect()
    assert cut.large and sum(r["n"] for r in found) == 900 and len(found) > 15
    assert all(r["n"] <= 2 * ROWS or r["blocks"] <= 2 for r in found)
    assert all(a["hi"] < b["lo"] for a, b in zip(found, found[1:]) if a["k"] == b["k"])
    assert not Cut(skewed, ["k"], "block").large


def test_trailing(skewed):
    both(lambda n: pit.trailing(skewed, ["k"], "block", ["f"], ["stat"], "minutes", windows=(3, 10, 60), masks={"stat": "obs"}, range_rows=n))
    both(lambda n: pit.trailing(skewed, [], "block", ["f"], ["stat"], "minutes", windows=(), range_rows=n))
    both(lambda n: pit.trailing(skewed, ["k"], "block", ["f"], ["stat", "minutes"], "minutes", windows=(5,), to_date=False, range_rows=n))


def test_trailing_mean(skewed):
    both(lambda n: pit.trailing_mean(skewed, ["k"], "block", ["f"], "stat", 7, range_rows=n))


def test_carry_forward(skewed):
    both(lambda n: pit.carry_forward(skewed, ["k"], ["block", "f"], "stat", "header", "section", range_rows=n))


def test_overlaps(skewed):
    w = skewed.select("k", "f", F.col("block").alias("a"), (F.col("block") + F.coalesce("stat", F.lit(0)) / 10).alias("b"))
    assert both(lambda n: pit.overlaps(w, "a", "b", ["k"], range_rows=n))
    assert both(lambda n: pit.overlaps(w, "a", "b", range_rows=n))  # the whole table is one group


@pytest.mark.parametrize("kind", ["date", "timestamp", "int"])
def test_asof(spark, skewed, kind):
    at = {"date": F.date_add(F.lit(date(2024, 1, 1)), F.col("block")), "timestamp": F.lit(datetime(2024, 1, 1)) + F.make_interval(hours=F.col("block")), "int": F.col("block")}[kind]
    left = skewed.where("f % 3 = 0").select("k", "f", at.alias("t"))
    right = skewed.where("f % 3 > 0").select("k", at.alias("at"), F.col("f").alias("g"), "stat")
    got = both(lambda n: pit.asof_strict(left, right, "k", "t", "at", ["at", "g", "stat"], tie=["g"], range_rows=n))
    assert any(r[3] is not None for r in got)


def test_one_time_for_all_rows_stays_one_range(spark):
    df = spark.range(300).selectExpr("'x' AS k", "1 AS block", "id AS f", "1 AS stat", "1.0 AS minutes")
    assert pit.trailing(df, ["k"], "block", ["f"], ["stat"], "minutes", range_rows=ROWS).where("stat_sum_to_date is not null").count() == 0
    with pytest.raises(TypeError):
        pit.overlaps(df, "k", "k", range_rows=ROWS)


def test_empty(spark, skewed):
    none = skewed.where("1 = 0")
    assert pit.trailing_mean(none, ["k"], "block", ["f"], "stat", range_rows=1).count() == 0
    assert pit.overlaps(none, "block", "f", range_rows=1).count() == 0
