"""Queries of names, captures and the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions import text
from asofkit.operators import facts, identity
from asofkit.session import load
from asofkit.sources import files

from . import build, staging
from .registry import query, rows


@query("SELECT o_orderkey AS id, printf('%d-%02d', year(o_orderdate), (year(o_orderdate) + 1) % 100) AS season, CAST(year(o_orderdate) AS INTEGER) AS start FROM orders")
def season_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.season_of(F.year("o_orderdate")).alias("season"))
    return named.withColumn("start", text.start_year(F.col("season")))


ACCENTED = "SELECT c_custkey AS id, concat('Zoë O’Brien-', c_name, '  Ñandú &amp; Çelik') AS name FROM customer"


@query(f"SELECT id, replace(replace(replace(lower(strip_accents(replace(name, '’', ''))), '-', ' '), '  ', ' '), '&amp;', '&') AS name FROM ({ACCENTED})")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, ACCENTED).select("id", text.folded("name").alias("name"))


CLUBS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Spurs F.C.' WHEN 1 THEN 'Brighton & Hove Albion' WHEN 2 THEN 'Man Utd' ELSE concat(c_name, ' AFC') END AS name FROM customer"


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'tottenham hotspur' WHEN 1 THEN 'brighton and hove albion' WHEN 2 THEN 'manchester united' ELSE lower(c_name) END AS club FROM customer")
def club_names_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, CLUBS).select("id", text.full_club(F.col("name")).alias("club"))


@query("SELECT c_name AS name FROM customer INTERSECT SELECT c_name FROM customer WHERE c_custkey % 3 = 0")
def names_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    known = c.where("c_custkey % 3 = 0").select(F.array(F.lit("other"), "name").alias("aliases"))
    return identity.mapped_names(c.unionByName(c), known, "name", "aliases")


@query("SELECT DISTINCT c_name AS name FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 3 = 0)")
def names_not_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    known = c.where("c_custkey % 3 = 0").select(F.array(F.lit("other"), "name").alias("aliases"))
    return identity.unmapped_names(c, known, "name", "aliases")


@query("SELECT 'a' AS source, c_name AS name FROM customer UNION SELECT 'a', c_mktsegment FROM customer UNION SELECT 'b', p_brand FROM part")
def collected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.collect_names({"a": (load(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"]), "b": (load(spark, sf_dir, "part"), ["p_brand"])})


TEAMS = """SELECT '2020-21' AS season, c_custkey AS team_id, c_custkey + 1000 AS code, c_name AS name FROM customer
 UNION ALL SELECT '2021-22' AS season, c_custkey AS team_id, c_custkey + 1000 AS code, CASE WHEN c_custkey % 3 <> 0 THEN concat(c_name, ' new') END AS name FROM customer"""


@query(f"""WITH t AS ({TEAMS}), l AS (SELECT code, arg_max(name, season) FILTER (name IS NOT NULL) AS latest FROM t GROUP BY code)
SELECT season, team_id, code AS team_code, coalesce(name, latest) AS team_name FROM t JOIN l USING (code)""")
def team_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.team_crosswalk(rows(spark, sf_dir, TEAMS)).select("season", "team_id", "team_code", "team_name")


CAPTURED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '2001-02-03' END AS given, concat(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), 'T09-30-00Z') AS as_of FROM orders"""


@query(f"SELECT id, coalesce(given, substr(as_of, 1, 10)) AS date FROM ({CAPTURED})")
def rating_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, CAPTURED).select("id", files.rating_date("given", "as_of").cast("string").alias("date"))


@query("SELECT l_orderkey AS entry, CAST(l_orderkey % 38 AS BIGINT) AS event, 'then' AS fetched_at, l_orderkey % 5 = 0 AS contaminated, l_linenumber AS place, l_partkey AS element FROM lineitem")
def exploded_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.collect_list(F.struct(F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("element")))
    records = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entry")).agg(own.alias("picks"))
    late = F.when(F.col("entry") % 5 == 0, True).alias("contaminated")
    return files.picks(records.select("entry", (F.col("entry") % 38).alias("event"), F.lit("then").alias("fetched_at"), late, F.struct("picks").alias("payload")))


@query("SELECT o_orderkey, k.c_custkey, c_acctbal FROM (SELECT o_orderkey, o_custkey AS c_custkey FROM orders) k LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON c.c_custkey = k.c_custkey")
def context_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    out = facts.context_of(fixtures, load(spark, sf_dir, "customer").where("c_custkey % 4 <> 0"), ["c_custkey"], ["c_acctbal"])
    return out.select("o_orderkey", "c_custkey", "c_acctbal")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value NULLS LAST, event_id) AS n FROM events) WHERE n = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.dedupe_first(load(spark, sf_dir, "events"), ["user_id", "event_type"], ["value", "event_id"]).select("user_id", "event_type", "event_id")


_KEY = "season, fixture_id, player_id"
#: Lines as players' rows of fixtures; the optional columns are partly absent.
STATS = f"""SELECT CASE WHEN l_orderkey % 2 = 0 THEN '2020-21' ELSE '2021-22' END AS season, l_orderkey AS fixture_id, l_linenumber AS player_id, CAST((l_orderkey + l_linenumber % 2) % 20 AS BIGINT) AS opponent_team,
 l_linenumber % 2 = 0 AS was_home, CASE WHEN l_orderkey % 9 <> 0 THEN concat(substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10), ' 15:00:00') ELSE 'later' END AS kickoff_time, CAST(l_orderkey % 38 AS BIGINT) AS event,
 CASE l_linenumber % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS position, CAST(l_partkey % 91 AS BIGINT) AS minutes, {", ".join(f"CAST(l_partkey % {i + 2} AS BIGINT) AS {c}" for i, c in enumerate(build.CORE))},
 CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_suppkey % 12 AS BIGINT) END AS clearances_blocks_interceptions, CAST(l_suppkey % 7 AS BIGINT) AS tackles, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_suppkey % 9 AS BIGINT) END AS recoveries,
 CAST(l_orderkey % 6 AS BIGINT) AS team_h_score, CAST(l_orderkey % 4 AS BIGINT) AS team_a_score FROM lineitem"""
_CODES = f"SELECT DISTINCT season, opponent_team AS team_id, opponent_team + 100 AS code FROM ({STATS}) WHERE opponent_team < 18"


@query(f"""WITH s AS ({STATS}), p AS (SELECT season, fixture_id, list_sort(list_distinct(list(opponent_team))) AS pair FROM s GROUP BY ALL),
t AS (SELECT s.*, CASE WHEN len(pair) = 2 THEN CASE WHEN pair[1] = opponent_team THEN pair[2] ELSE pair[1] END END AS team_id FROM s JOIN p USING (season, fixture_id)), c AS ({_CODES})
SELECT {', '.join(f't.{k}' for k in _KEY.split(', '))}, t.team_id, x.code AS team_code, opponent_team AS opponent_team_id, y.code AS opponent_team_code, was_home, CAST(epoch(TRY_CAST(kickoff_time AS TIMESTAMP)) AS BIGINT) AS kickoff_s, event, position, minutes, saves,
 clearances_blocks_interceptions AS cbi, CAST(NULL AS BIGINT) AS fouls, true AS obs_defensive, false AS obs_expected, false AS obs_starts
 FROM t LEFT JOIN c x ON x.season = t.season AND x.team_id = t.team_id LEFT JOIN c y ON y.season = t.season AND y.team_id = t.opponent_team""")
def player_fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = build.player_facts(rows(spark, sf_dir, STATS), rows(spark, sf_dir, _CODES)).withColumn("kickoff_s", F.unix_timestamp("kickoff_time"))
    return out.select(
        *_KEY.split(", "), "team_id", "team_code", "opponent_team_id", "opponent_team_code", "was_home", "kickoff_s", "event", "position", "minutes", "saves", "cbi", "fouls", "obs_defensive", "obs_expected", "obs_starts"
    )


@query(f"""SELECT season, fixture_id, min(event) AS event, min(kickoff_time) AS kickoff_time, min(team_h_score) AS team_h_score, min(team_a_score) AS team_a_score, max(opponent_team) FILTER (NOT was_home) AS team_h,
 max(opponent_team) FILTER (was_home) AS team_a, max(minutes) > 0 AS finished FROM ({STATS}) GROUP BY season, fixture_id""")
def implied_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.fixtures_from_stats(rows(spark, sf_dir, STATS))


@query(f"""SELECT {_KEY}, CAST(clearances_blocks_interceptions + tackles + CASE WHEN position = 'DEF' THEN 0 ELSE recoveries END AS DOUBLE) AS label_defensive_contribution FROM ({STATS})
 WHERE season = '2020-21' AND position <> 'GK' AND clearances_blocks_interceptions IS NOT NULL AND recoveries IS NOT NULL""")
def derived_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = rows(spark, sf_dir, STATS).withColumnRenamed("clearances_blocks_interceptions", "cbi")
    return staging.derived_contribution(stats, ["2020-21"])
