"""Gates on groups without windows, and partitions of several files."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from asofkit.operators import gates
from asofkit.sources import writers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gates_on_groups(spark):
    rows = [("a", 1, True, 5), ("a", 1, True, 6), ("a", 2, None, 6), ("b", 3, False, 5), ("b", 4, True, 7), (None, 5, None, 8), (None, 5, None, None), ("c", 6, True, 5), ("c", 7, True, 6)]
    df = spark.createDataFrame(rows, "k string, id int, f boolean, t int")
    set_ = [gates.unique_key("k", "id"), gates.unique_key("id"), gates.constant_within("f", "k"), gates.exactly_distinct("t", 2, "k"), gates.not_null("k"), gates.exactly_distinct("k", 1, "k")]
    report = gates.report(df, set_)
    got = {r["gate"]: (r["severity"], r["violations"]) for r in report.collect()}
    assert {g: n for g, (_, n) in got.items()} == {"unique_key(k,id)": 4, "unique_key(id)": 4, "constant_within(f)": 5, "exactly_distinct(t,2)": 2, "not_null(k)": 2, "exactly_distinct(k,1)": 2}
    assert "Window" not in plan(report)
    found = {v.gate: v for v in gates.run_gates(df, set_, sample=3)}
    assert found["unique_key(k,id)"].sample == [{"k": None, "id": 5}, {"k": None, "id": 5}, {"k": "a", "id": 1}]
    assert [r["k"] for r in found["constant_within(f)"].sample] == ["a", "b", "a"] and len(found["exactly_distinct(t,2)"].sample) == 2
    assert gates.run_gates(df.where("1 = 0"), set_) == []


def test_a_group_of_most_rows_is_counted_in_parts(spark):
    df = spark.range(200_000, numPartitions=8).selectExpr("if(id % 10 < 9, 'hot', concat('k', id % 50)) AS k", "id", "id = 77 AS f")
    report = gates.report(df, [gates.constant_within("f", "k"), gates.unique_key("k", "id")])
    assert {r["violations"] for r in report.collect()} == {180_000, 0}
    assert "partial_count" in report._jdf.queryExecution().executedPlan().toString()


def test_a_partition_has_disjoint_sorted_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("if(id % 10 = 0, 'old', 'new') AS season", "(id * 37) % 1000 AS key", "id")
    writers.write_partitions(df, f"{tmp_path}/t", ["season"], ["key"], file_rows=200)
    for season, rows in (("old", 100), ("new", 900)):
        files = sorted((tmp_path / "t" / f"season={season}").glob("*.parquet"))
        keys = [pq.read_table(f, partitioning=None).column("key").to_pylist() for f in files]
        assert sum(map(len, keys)) == rows and all(k == sorted(k) for k in keys)
        ends = sorted((k[0], k[-1]) for k in keys)
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
        assert len(files) >= (4 if season == "new" else 1)
    writers.write_partitions(df.where("season = 'old'").limit(3), f"{tmp_path}/t", ["season"], ["key"])
    assert {r["season"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/t").groupBy("season").count().collect()} == {"old": 3, "new": 900}
    writers.write_partitions(df.where("1 = 0"), f"{tmp_path}/t", ["season"], ["key"])
    assert spark.read.parquet(f"{tmp_path}/t").where(F.col("season") == "new").count() == 900
