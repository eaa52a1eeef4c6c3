"""Queries of entity matching, crosswalks, and of the schedule parser's carry-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions.text import folded, full_club
from asofkit.operators import identity, pit
from asofkit.session import load

from .registry import query, rows

#: Names by season, some of which change.
SPELLINGS = "SELECT o_custkey % 200 AS code, CAST(year(o_orderdate) AS INTEGER) AS season, concat('Name ', CAST(o_custkey % 200 AS VARCHAR(9)), CASE WHEN o_orderkey % 5 = 0 AND year(o_orderdate) > 1997 THEN ' Junior' ELSE '' END) AS name FROM orders"


@query(f"""WITH s AS (SELECT DISTINCT * FROM ({SPELLINGS})), f AS (SELECT code, name, min(season) AS first FROM s GROUP BY ALL)
SELECT s.code, min(s.season) AS first_season, max(s.season) AS last_season, arg_max(s.name, (s.season, s.name)) AS name,
 (SELECT string_agg(f.name, '; ' ORDER BY f.first, f.name) FROM f WHERE f.code = s.code) AS name_variants, CAST((SELECT count(*) FROM f WHERE f.code = s.code) AS INTEGER) AS n_names FROM s GROUP BY s.code""")
def crosswalk_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identity.canonical(rows(spark, sf_dir, SPELLINGS), "code", "name", "season")
    return out.withColumn("name_variants", F.array_join("name_variants", "; "))


#: Two lists of names that agree in different ways.
LEFT = "SELECT c_custkey AS id, concat('ana', CAST(c_custkey % 40 AS VARCHAR(9)), ' ', lower(c_mktsegment), ' b', CAST(c_custkey AS VARCHAR(9))) AS name FROM customer"
RIGHT = """SELECT c_custkey AS other, CASE c_custkey % 4 WHEN 0 THEN concat('ana', CAST(c_custkey % 40 AS VARCHAR(9)), ' ', lower(c_mktsegment), ' b', CAST(c_custkey AS VARCHAR(9)))
 WHEN 1 THEN concat('anton b', CAST(c_custkey AS VARCHAR(9))) WHEN 2 THEN concat('b', CAST(c_custkey AS VARCHAR(9)), ' ', lower(c_mktsegment), ' ana', CAST(c_custkey % 40 AS VARCHAR(9)))
 ELSE 'nobody' END AS name FROM customer"""


@query(f"""WITH l AS ({LEFT}), r AS ({RIGHT}),
a AS (SELECT id, min(other) AS other FROM l JOIN r ON l.name = r.name GROUP BY id HAVING count(DISTINCT other) = 1),
b AS (SELECT id, min(other) AS other FROM l JOIN r ON string_split(l.name, ' ')[-1] = string_split(r.name, ' ')[-1] AND substr(l.name, 1, 1) = substr(r.name, 1, 1)
  WHERE id NOT IN (SELECT id FROM a) GROUP BY id HAVING count(DISTINCT other) = 1),
c AS (SELECT id, min(other) AS other FROM l JOIN r ON list_sort(string_split(l.name, ' ')) = list_sort(string_split(r.name, ' '))
  WHERE id NOT IN (SELECT id FROM a UNION ALL SELECT id FROM b) GROUP BY id HAVING count(DISTINCT other) = 1)
SELECT id, other, 1 AS match_pass FROM a UNION ALL SELECT id, other, 2 FROM b UNION ALL SELECT id, other, 3 FROM c""")
def match_multi_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold_ = lambda d: d.withColumn("name", folded("name"))
    return identity.match_names(fold_(rows(spark, sf_dir, LEFT)), fold_(rows(spark, sf_dir, RIGHT)), "id", "other", "name", passes=(1, 2, 3))


SHORT = "SELECT c_custkey AS id, concat('ana', CAST(c_custkey AS VARCHAR(9)), ' b', CAST(c_custkey % 7 AS VARCHAR(9))) AS name FROM customer"
LONG = "SELECT c_custkey AS other, concat('ana', CAST(c_custkey AS VARCHAR(9)), ' ', lower(c_mktsegment), ' b', CAST(c_custkey % 14 AS VARCHAR(9))) AS name FROM customer"


@query(f"""WITH l AS ({SHORT}), r AS ({LONG})
SELECT id, min(other) AS other, 4 AS match_pass FROM l JOIN r ON string_split(l.name, ' ')[1] = string_split(r.name, ' ')[1] AND string_split(l.name, ' ')[2] = string_split(r.name, ' ')[3] GROUP BY id HAVING count(DISTINCT other) = 1""")
def match_token_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.match_names(rows(spark, sf_dir, SHORT), rows(spark, sf_dir, LONG), "id", "other", "name", passes=(4,))


#: Every second name shares its first word with one name at most; the others share theirs with many.
ONE = "SELECT c_custkey AS id, concat('ana', CAST(c_custkey AS VARCHAR(9)), CASE WHEN c_custkey % 2 = 0 THEN ' solo' ELSE concat(' b', CAST(c_custkey % 7 AS VARCHAR(9))) END) AS name FROM customer"
OTHER = "SELECT c_custkey AS other, CASE WHEN c_custkey % 5 = 0 THEN concat('b', CAST(c_custkey % 7 AS VARCHAR(9)), ' x') ELSE concat('zed ana', CAST(c_custkey AS VARCHAR(9))) END AS name FROM customer"


@query(f"""WITH l AS (SELECT id, unnest(list_distinct(string_split(name, ' '))) AS w FROM ({ONE})), r AS (SELECT other, unnest(list_distinct(string_split(name, ' '))) AS w FROM ({OTHER})),
k AS (SELECT w, min(other) AS lo, max(other) AS hi FROM r GROUP BY w)
SELECT id, min(lo) AS other FROM l JOIN k USING (w) GROUP BY id HAVING min(lo) = max(hi)""")
def match_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.token_overlap(rows(spark, sf_dir, ONE), rows(spark, sf_dir, OTHER), "id", "other", "name")


@query("""SELECT DISTINCT s_name AS name FROM supplier WHERE s_name NOT IN (SELECT replace(c_name, 'Customer', 'Supplier') FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'nobody')""")
def unmapped_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.array(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), F.lit("nobody")).alias("aliases"))
    return identity.unmapped_names(load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), known, "name", "aliases")


#: Club names as different sources write them; the number makes a club of each customer.
CLUBS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Man Utd' WHEN 1 THEN 'Brighton & Hove Albion F.C.' WHEN 2 THEN 'Stoke-on-Trent AFC' ELSE concat('Club ', CAST(c_custkey AS VARCHAR(9)), ' cf') END AS name FROM customer"


@query(f"SELECT id, CASE id % 4 WHEN 0 THEN 'manchester united' WHEN 1 THEN 'brighton and hove albion' WHEN 2 THEN 'stoke on trent' ELSE concat('club ', CAST(id AS VARCHAR)) END AS club FROM ({CLUBS})")
def club_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, CLUBS).select("id", full_club(F.col("name")).alias("club"))


@query("""SELECT c_custkey AS team_code, concat('team ', CAST(c_custkey AS VARCHAR)) AS team_name, concat('t', CAST(c_custkey AS VARCHAR), ' united') AS alpha,
 CASE WHEN c_custkey % 3 = 0 THEN concat('kept ', CAST(c_custkey AS VARCHAR)) ELSE '' END AS beta FROM customer""")
def external_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team_code"), F.concat(F.lit("team "), F.col("c_custkey").cast("string")).alias("team_name"))
    full = c.withColumn("team_name", F.concat(F.lit("t"), F.col("team_code").cast("string"), F.lit(" city")))
    names = c.select(F.lit("alpha").alias("source"), F.concat(F.lit("t"), F.col("team_code").cast("string"), F.lit(" united")).alias("name"))
    draft = identity.draft_external_names(full, names, ["alpha", "beta"]).drop("team_name").join(c, "team_code").select("team_code", "team_name", "alpha", "beta")
    kept = c.where("team_code % 3 = 0").select("team_code", "team_name", F.array().cast("array<string>").alias("alpha"), F.array(F.concat(F.lit("kept "), F.col("team_code").cast("string"))).alias("beta"))
    out = identity.refresh_external_names(kept, draft, ["alpha", "beta"])
    return out.select("team_code", "team_name", F.array_join("alpha", "; ").alias("alpha"), F.array_join("beta", "; ").alias("beta"))


@query("""WITH e AS (SELECT c_custkey AS code, concat('kept ', c_name) AS name FROM customer WHERE c_custkey % 3 = 0), d AS (SELECT c_custkey AS code, c_name AS name FROM customer)
SELECT * FROM e UNION ALL SELECT * FROM d WHERE code NOT IN (SELECT code FROM e)""")
def never_clobber_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    return identity.merge_keeping(c.where("code % 3 = 0").withColumn("name", F.concat(F.lit("kept "), "name")), c, "code")


@query("SELECT o_custkey, round(sum(o_totalprice), 4) AS o_totalprice FROM orders WHERE o_totalprice > 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0) GROUP BY o_custkey")
def anti_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return identity.unmapped(load(spark, sf_dir, "orders"), known, "o_custkey", "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT user_id, arg_min(event_type, (ts, event_type)) AS event_type, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s FROM events WHERE event_type <> 'error' GROUP BY user_id")
def first_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return identity.first_resolved(e, "user_id", "event_type", "ts").select("user_id", "event_type", F.unix_seconds("ts").alias("first_s"))


@query("""WITH s AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN round(value, 6) END AS head, CAST(month(ts) * 100 + day(ts) AS BIGINT) AS md FROM events)
SELECT event_id, (SELECT arg_max(h.head, (h.ts, h.event_id)) FROM s h WHERE h.user_id = s.user_id AND h.head IS NOT NULL AND (h.ts, h.event_id) <= (s.ts, s.event_id)) AS header,
(SELECT count(*) FROM s a WHERE a.user_id = s.user_id AND a.head IS NOT NULL AND (a.ts, a.event_id) <= (s.ts, s.event_id)) AS section FROM s""")
def carry_forward_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("head", F.when(F.col("event_type") == "purchase", F.round("value", 6)))
    return pit.carry_forward(e, ["user_id"], ["ts", "event_id"], "head", "header", "section").select("event_id", "header", "section")
