"""Queries of the quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.operators import facts, gates
from asofkit.session import load

from .registry import query


@query("SELECT o_custkey, month, count(*) AS n FROM (SELECT o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month FROM orders) GROUP BY ALL HAVING count(*) > 1")
def gate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month"))
    return facts.duplicates(o, ["o_custkey", "month"]).groupBy("o_custkey", "month").agg(F.count("*").alias("n"))


@query("""SELECT 'not_null(x)' AS gate, 'block' AS severity, count(*) FILTER (l_orderkey % 13 = 0) AS violations FROM lineitem
UNION ALL SELECT 'in_range(l_discount,0.02,0.08)', 'block', count(*) FILTER (l_discount < 0.02 OR l_discount > 0.08) FROM lineitem
UNION ALL SELECT 'in_range(x,0,None)', 'block', count(*) FILTER (l_orderkey % 13 <> 0 AND l_quantity - 10 < 0) FROM lineitem
UNION ALL SELECT 'enum_values(l_returnflag)', 'block', count(*) FILTER (l_returnflag NOT IN ('A', 'R')) FROM lineitem""")
def gate_range_enum_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem").withColumn("x", F.when(F.col("l_orderkey") % 13 != 0, F.col("l_quantity") - 10))
    return gates.report(d, [gates.not_null("x"), gates.in_range("l_discount", 0.02, 0.08), gates.non_negative("x"), gates.enum_values("l_returnflag", ["A", "R"])])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 50 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def gate_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("o_custkey"))
    return gates.orphans(o, load(spark, sf_dir, "customer").where("c_custkey % 7 <> 0"), "o_custkey", "c_custkey")


@query("""SELECT 'different(s,p)' AS gate, 'block' AS severity, count(*) FILTER (l_suppkey % 20 = l_partkey % 20) AS violations FROM lineitem
UNION ALL SELECT 'implies_zero(m,q)', 'block', count(*) FILTER (l_orderkey % 5 = 0 AND l_quantity > 0) FROM lineitem
UNION ALL SELECT 'within(q,low,high)', 'block', count(*) FILTER (l_quantity < 5 OR l_quantity > 40) FROM lineitem
UNION ALL SELECT 'dc', 'warn', count(*) FILTER (l_linenumber <> l_orderkey % 8) FROM lineitem
UNION ALL SELECT 'constant_within(f)', 'block', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS f FROM lineitem) GROUP BY l_orderkey HAVING count(DISTINCT f) + max(CAST(f IS NULL AS INTEGER)) > 1))
UNION ALL SELECT 'exactly_distinct(s,2)', 'block', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey % 20) <> 2))""")
def gate_cross_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey % 20 AS s", "l_partkey % 20 AS p", "l_orderkey % 5 AS m", "l_quantity AS q", "5D AS low", "40D AS high",
        "CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS f",
    )
    return gates.report(
        d,
        [
            gates.different("s", "p"), gates.implies_zero("m", "q"), gates.within("q", "low", "high"),
            gates.formula("dc", "l_linenumber", F.col("l_orderkey") % 8, ["l_orderkey"]),
            gates.constant_within("f", "l_orderkey"), gates.exactly_distinct("s", 2, "l_orderkey"),
        ],
    )


@query("""SELECT 'unique_key(o_orderkey)' AS gate, 'block' AS severity, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'unique_key(o_custkey,o_orderpriority)', 'block', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1))
UNION ALL SELECT 'not_null(o_orderkey,o_orderdate)', 'block', count(*) FILTER (o_orderkey IS NULL OR o_orderdate IS NULL) FROM orders
UNION ALL SELECT 'enum_values(o_orderstatus)', 'block', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders""")
def gate_report_onepass(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_ = [gates.unique_key("o_orderkey"), gates.unique_key("o_custkey", "o_orderpriority"), gates.not_null("o_orderkey", "o_orderdate"), gates.enum_values("o_orderstatus", ["O", "F"])]
    return gates.report(load(spark, sf_dir, "orders"), set_)
