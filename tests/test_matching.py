"""Entity matching over whole tables, where tokens are shared by many names."""

import duckdb
import pytest
from pyspark.sql import functions as F

from asofkit.operators import identity
from asofkit.plans import registry

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["match_multi_pass", "match_token_subsequence", "match_token_overlap", "unmapped_source_names", "club_names", "external_names"])
def test_all_rows_equal_the_sql_and_are_some(spark, name):
    c = duckdb.connect()
    for t in ("customer", "supplier"):
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    want = c.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got


def test_team_crosswalk_refuses_two_names(spark):
    rows = [("2020-21", 1, 10, "A"), ("2021-22", 2, 10, None), ("2021-22", 3, 11, "B")]
    df = spark.createDataFrame(rows, "season string, team_id long, code long, name string")
    assert sorted(map(tuple, identity.team_crosswalk(df).collect())) == [("2020-21", 1, 10, "A"), ("2021-22", 2, 10, "A"), ("2021-22", 3, 11, "B")]
    for more in (("2020-21", 1, 10, "C"), ("2020-21", 1, 12, "A")):
        with pytest.raises(Exception, match="more than one"):
            identity.team_crosswalk(df.union(spark.createDataFrame([more], df.schema))).collect()


def test_collected_names_and_odd_variants(spark):
    df = spark.createDataFrame([("x", "y"), ("x", None)], "home string, away string")
    assert sorted(map(tuple, identity.collect_names({"s": (df, ["home", "away"])}).collect())) == [("s", "x"), ("s", "y")]
    cross = spark.createDataFrame([(1, ["jo smith", "jo jones"]), (2, ["al ray", "bo dee"])], "code int, folded array<string>")
    assert [r["code"] for r in identity.odd_variants(cross, "folded").collect()] == [2]
    pairs = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "a int, b int")
    assert identity.one_to_one(pairs, "a", "b").count() == 2


def test_shared_tokens_make_no_product_of_pairs(spark, monkeypatch):
    n, made = 600, []
    unique = identity._unique
    monkeypatch.setattr(identity, "_unique", lambda pairs, *a: made.append(pairs.count()) or unique(pairs, *a))
    left = spark.range(n).select(F.col("id").alias("l"), F.concat(F.lit("n"), "id", F.lit(" hot")).alias("name"))
    right = spark.range(n).select(F.col("id").alias("r"), F.concat(F.lit("n"), "id", F.lit(" mid hot")).alias("name"))
    out = identity.match_names(left, right, "l", "r", "name", passes=(2, 4)).collect()
    assert sorted(map(tuple, out)) == [(i, i, 4) for i in range(n)]
    assert identity.token_overlap(left, right, "l", "r", "name").count() == 0
    assert max(made) <= 2 * n
