"""Queries of staging and of the fact builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions.text import match_date
from asofkit.operators import facts
from asofkit.schema import ColumnSpec, TableSpec, stage
from asofkit.session import load

from .registry import query, rows


@query("SELECT l_orderkey, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_returnflag = 'R'")
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.where((F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))) & (F.col("l_returnflag") == "R")).select("l_orderkey", F.round("l_extendedprice", 4).alias("l_extendedprice"))


#: Values as a text file would bring them, some of them not numbers.
RAW = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN concat(o_orderpriority, 'x') ELSE CAST(o_custkey AS VARCHAR(20)) END AS who, CASE WHEN o_orderkey % 3 = 0 THEN 'True' WHEN o_orderkey % 3 = 1 THEN 'no number' ELSE 'false' END AS flag FROM orders"
SPEC = TableSpec("orders", (ColumnSpec("order_id", "id", "bigint"), ColumnSpec("customer", "who", "bigint"), ColumnSpec("done", "flag", "boolean")), key=("order_id",))


@query(f"SELECT '1998-99' AS season, CAST(id AS BIGINT) AS order_id, TRY_CAST(who AS BIGINT) AS customer, TRY_CAST(flag AS BOOLEAN) AS done FROM ({RAW})")
def stage_lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(rows(spark, sf_dir, RAW), SPEC, season="1998-99")[0]


@query(f"SELECT CAST(id AS BIGINT) AS order_id, TRY_CAST(who AS BIGINT) AS customer, CAST(NULL AS DOUBLE) AS expected FROM ({RAW})")
def stage_missing_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = TableSpec("orders", (*SPEC.columns[:2], ColumnSpec("expected", "xg", "double", required=False)), drop=frozenset({"flag"}))
    return stage(rows(spark, sf_dir, RAW), spec)[0]


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


DATES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN concat(CAST(day(o_orderdate) AS VARCHAR(4)), '/', CAST(month(o_orderdate) AS VARCHAR(4)), '/', CAST(year(o_orderdate) AS VARCHAR(4)))
 WHEN o_orderkey % 4 = 1 THEN concat(CAST(day(o_orderdate) AS VARCHAR(4)), '/', CAST(month(o_orderdate) AS VARCHAR(4)), '/', substr(CAST(year(o_orderdate) + 20 AS VARCHAR(4)), 3, 2))
 WHEN o_orderkey % 4 = 2 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) ELSE 'soon' END AS text, o_orderdate AS t FROM orders"""


@query(f"SELECT id, CASE id % 4 WHEN 0 THEN strftime(t, '%Y-%m-%d') WHEN 1 THEN CAST(make_date(year(t) + 20, month(t), day(t)) AS VARCHAR) WHEN 2 THEN strftime(t, '%Y-%m-%d') END AS date FROM ({DATES})")
def multi_format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, DATES).select("id", F.date_format(match_date(F.col("text")), "yyyy-MM-dd").alias("date"))


#: Lines as matches with two teams each, told by one side only.
SIDES = "SELECT l_orderkey AS fixture, l_linenumber AS player, CAST((l_orderkey + l_linenumber % 2) % 20 AS BIGINT) AS opponent, l_linenumber % 2 = 0 AS was_home, l_partkey % 5 AS goals FROM lineitem"


@query(f"""WITH s AS ({SIDES}), p AS (SELECT fixture, list_sort(list_distinct(list(opponent))) AS pair FROM s GROUP BY fixture)
SELECT fixture, player, CASE WHEN len(pair) = 2 THEN CASE WHEN pair[1] = opponent THEN pair[2] ELSE pair[1] END END AS team, count(*) AS n FROM s JOIN p USING (fixture) GROUP BY ALL""")
def pair_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts.complete_pair(rows(spark, sf_dir, SIDES), ["fixture"], "opponent", "team")
    return out.groupBy("fixture", "player", "team").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS gw FROM orders),
m AS (SELECT o_custkey, o_orderpriority, max(gw) AS last FROM v GROUP BY ALL)
SELECT v.o_orderkey, v.gw FROM v JOIN m USING (o_custkey, o_orderpriority) WHERE v.gw IS NULL OR v.gw = m.last""")
def keep_latest_postponed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "orders").withColumn("gw", F.when(F.col("o_orderkey") % 11 != 0, F.month("o_orderdate")))
    return facts.keep_latest(v, ["o_custkey", "o_orderpriority"], "gw").select("o_orderkey", "gw")


@query(f"""WITH s AS ({SIDES}), h AS (SELECT fixture, max(opponent) AS o, max(goals) AS g FROM s WHERE was_home GROUP BY fixture), a AS (SELECT fixture, max(opponent) AS o, max(goals) AS g FROM s WHERE NOT was_home GROUP BY fixture)
SELECT fixture, h.o AS home_opponent, a.o AS away_opponent, h.g AS home_goals, a.g AS away_goals FROM h FULL JOIN a USING (fixture)""")
def full_outer_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.two_sides(rows(spark, sf_dir, SIDES), ["fixture"], "was_home", ["opponent", "goals"])


ODDS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 <> 0 THEN 1 + l_discount * 10 END AS a, CAST(l_quantity AS DOUBLE) AS b, 1 + l_tax * 20 AS c FROM lineitem"


@query(f"""SELECT l_orderkey, l_linenumber, round(1 / a / (1 / a + 1 / b + 1 / c), 6) AS p_a, round(1 / b / (1 / a + 1 / b + 1 / c), 6) AS p_b, round(1 / c / (1 / a + 1 / b + 1 / c), 6) AS p_c
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN a END AS a, CASE WHEN ok THEN b END AS b, CASE WHEN ok THEN c END AS c FROM (SELECT *, a IS NOT NULL AND a <> 0 AND b <> 0 AND c <> 0 AS ok FROM ({ODDS})))""")
def devig_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.devig([F.col("a"), F.col("b"), F.col("c")])
    return rows(spark, sf_dir, ODDS).select("l_orderkey", "l_linenumber", *[F.round(x, 6).alias(n) for x, n in zip(p, ("p_a", "p_b", "p_c"))])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL), r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS n, max(votes) OVER (PARTITION BY user_id) AS top FROM c),
t AS (SELECT user_id, count(*) FILTER (votes = top) > 1 AS tied FROM r GROUP BY user_id)
SELECT r.user_id, r.event_type, r.votes, t.tied FROM r JOIN t USING (user_id) WHERE n = 1""")
def vote_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.vote(load(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.dedupe_last(load(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL AS price FROM customer UNION ALL BY NAME SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part")
def diagonal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


ALIASES = "SELECT p_partkey AS id, concat(p_brand, ' ; ', p_type, ';; ', p_name) AS cell FROM part"


@query(f"SELECT id, trim(a) AS alias FROM (SELECT id, unnest(string_split(cell, ';')) AS a FROM ({ALIASES})) WHERE trim(a) <> ''")
def alias_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.explode_aliases(rows(spark, sf_dir, ALIASES), "cell", "alias").select("id", "alias")


@query("""WITH m AS (SELECT l_orderkey AS id, CAST(l_suppkey % 20 AS BIGINT) AS h, CAST(l_partkey % 20 AS BIGINT) AS a, l_quantity AS oh, l_tax AS oa FROM lineitem WHERE l_linenumber = 1)
SELECT id, h AS team, a AS opponent, true AS was_home, oh AS own_0, oa AS other_0 FROM m UNION ALL SELECT id, a, h, false, oa, oh FROM m""")
def odds_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").selectExpr("l_orderkey AS id", "l_suppkey % 20 AS h", "l_partkey % 20 AS a", "l_quantity AS oh", "l_tax AS oa")
    return facts.either_side(m, "h", "a", [("oh", "oa")]).drop("oh", "oa")


@query("""WITH o AS (SELECT o_orderkey AS ours, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 END AS g FROM orders),
t AS (SELECT o_orderkey AS theirs, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 10 END AS g FROM orders)
SELECT ours, theirs FROM o JOIN t ON o.d = t.d AND o.g IS NOT DISTINCT FROM t.g""")
def null_safe_score_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    side = lambda n, k: o.select(F.col("o_orderkey").alias(n), F.to_date("o_orderdate").alias("d"), F.when(F.col(k) % 3 != 0, F.col(k) % 10).alias("g"))
    return facts.match_ids(side("ours", "o_orderkey"), side("theirs", "o_custkey"), "d", ["g"], "ours", "theirs")


@query("SELECT DISTINCT event_type, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def full_row_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").cast("string").alias("day")).dropDuplicates()
