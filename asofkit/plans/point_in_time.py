"""Queries of the point-in-time operators, over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.operators import pit
from asofkit.session import load, shared_folder
from asofkit.streaming import snapshots

from .registry import query, rows

#: Orders as fixtures of customers, blocked by month; some values are made null and some masked.
FIXTURES = """
SELECT o_custkey AS player, o_orderkey AS fixture, o_orderdate AS kickoff,
       year(o_orderdate) * 12 + month(o_orderdate) AS block, year(o_orderdate) AS season,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS stat,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 97 AS DOUBLE) END AS minutes,
       o_orderpriority <> '5-LOW' AS obs
FROM orders
"""
#: Each fixture with its key's earlier ones, the latest first.
HISTORY = f"""
WITH f AS ({FIXTURES}), h AS (
  SELECT r.fixture AS rf, h.stat, h.minutes, h.obs,
         row_number() OVER (PARTITION BY r.fixture ORDER BY h.block DESC, h.kickoff DESC, h.fixture DESC) AS n
  FROM f r JOIN f h ON r.player = h.player AND h.block < r.block
)
"""


def _made(df: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = ("player", "fixture")) -> DataFrame:
    # Rates are moved off exact halves, so that both engines round them alike.
    shift = lambda c: F.col(c) + 0.00000123 if "per90" in c else F.col(c)
    return df.select(*keep, *[F.round(shift(c), 4).alias(n) for n, c in columns.items()])


@query(f"""{HISTORY}
SELECT f.player, f.fixture,
  round(sum(h.stat) FILTER (n <= 3), 4) AS sum_3, round(CASE WHEN sum(h.minutes) FILTER (n <= 3) > 0 THEN sum(h.stat) FILTER (n <= 3) / sum(h.minutes) FILTER (n <= 3) * 90 END + 0.00000123, 4) AS per90_3,
  round(sum(h.stat) FILTER (n <= 5), 4) AS sum_5, round(CASE WHEN sum(h.minutes) FILTER (n <= 5) > 0 THEN sum(h.stat) FILTER (n <= 5) / sum(h.minutes) FILTER (n <= 5) * 90 END + 0.00000123, 4) AS per90_5
FROM f LEFT JOIN h ON h.rf = f.fixture GROUP BY f.player, f.fixture""")
def rolling_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.trailing(rows(spark, sf_dir, FIXTURES), ["player"], "block", ["kickoff", "fixture"], ["stat"], "minutes", windows=(3, 5), to_date=False)
    return _made(out, {"sum_3": "stat_sum_last_3", "per90_3": "stat_per90_last_3", "sum_5": "stat_sum_last_5", "per90_5": "stat_per90_last_5"})


@query(f"""{HISTORY}
SELECT f.player, f.fixture, round(sum(h.stat) FILTER (n <= 5 AND h.obs), 4) AS sum_5,
  round(CASE WHEN sum(h.minutes) FILTER (n <= 5 AND h.obs) > 0 THEN sum(h.stat) FILTER (n <= 5 AND h.obs) / sum(h.minutes) FILTER (n <= 5 AND h.obs) * 90 END + 0.00000123, 4) AS per90_5,
  count(*) FILTER (n <= 5 AND NOT h.obs) AS masked_5
FROM f LEFT JOIN h ON h.rf = f.fixture GROUP BY f.player, f.fixture""")
def rolling_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.trailing(rows(spark, sf_dir, FIXTURES), ["player"], "block", ["kickoff", "fixture"], ["stat"], "minutes", windows=(5,), masks={"stat": "obs"}, to_date=False)
    return _made(out, {"sum_5": "stat_sum_last_5", "per90_5": "stat_per90_last_5"}, ("player", "fixture", F.col("stat_masked_last_5").alias("masked_5")))


@query(f"""WITH f AS ({FIXTURES})
SELECT f.player, f.fixture, round(sum(h.stat), 4) AS sum_to_date, round(CASE WHEN sum(h.minutes) > 0 THEN sum(h.stat) / sum(h.minutes) * 90 END + 0.00000123, 4) AS per90_to_date
FROM f LEFT JOIN f h ON h.player = f.player AND h.season = f.season AND h.block < f.block GROUP BY f.player, f.fixture""")
def season_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.trailing(rows(spark, sf_dir, FIXTURES), ["player", "season"], "block", ["kickoff", "fixture"], ["stat"], "minutes", windows=())
    return _made(out, {"sum_to_date": "stat_sum_to_date", "per90_to_date": "stat_per90_to_date"})


@query(f"""WITH f AS ({FIXTURES}), p AS (
  SELECT player, season + 1 AS season, sum(stat) AS s, sum(minutes) AS m, count(*) FILTER (NOT obs) AS masked, sum(stat) FILTER (obs) AS so FROM f GROUP BY ALL)
SELECT f.player, f.fixture, round(p.so, 4) AS sum_last_season, coalesce(p.masked, 0) AS masked_last_season FROM f LEFT JOIN p USING (player, season)""")
def last_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.previous_season(rows(spark, sf_dir, FIXTURES), ["player"], "season", ["stat"], "minutes", masks={"stat": "obs"})
    return _made(out, {"sum_last_season": "stat_sum_last_season"}, ("player", "fixture", F.col("stat_masked_last_season").alias("masked_last_season")))


@query(f"""WITH f AS ({FIXTURES}), h AS (
  SELECT r.fixture AS rf, h.stat, row_number() OVER (PARTITION BY r.fixture ORDER BY h.block DESC, h.kickoff DESC, h.fixture DESC) AS n
  FROM f r JOIN f h ON r.player = h.player AND r.season = h.season AND h.block < r.block WHERE h.stat IS NOT NULL)
SELECT f.player, f.fixture, round(avg(h.stat) FILTER (n <= 5), 4) AS prediction FROM f LEFT JOIN h ON h.rf = f.fixture GROUP BY ALL""")
def naive_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(pit.trailing_mean(rows(spark, sf_dir, FIXTURES), ["player", "season"], "block", ["kickoff", "fixture"], "stat"), {"prediction": "prediction"})


#: Daily mean values of users as ratings; every fifth one is null.
RATINGS = "SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN (user_id + day(ts)) % 5 <> 0 THEN round(avg(value), 6) END AS rating FROM events GROUP BY user_id, CAST(ts AS DATE), (user_id + day(ts)) % 5"


@query(f"""WITH r AS ({RATINGS}), e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events), j AS (
  SELECT e.event_id, e.user_id, r.day AS rating_day, r.rating, row_number() OVER (PARTITION BY e.event_id ORDER BY r.day DESC) AS n
  FROM e LEFT JOIN r ON r.user_id = e.user_id AND r.day < e.day)
SELECT event_id, user_id, CAST(rating_day AS VARCHAR) AS rating_day, round(rating, 5) AS rating FROM j WHERE n = 1""")
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("on_day"))
    r = rows(spark, sf_dir, RATINGS)
    out = pit.asof_strict(e, r, "user_id", "on_day", "day", ["day", "rating"])
    return out.select("event_id", "user_id", F.col("day").cast("string").alias("rating_day"), F.round("rating", 5).alias("rating"))


@query("""WITH s AS (SELECT o.o_custkey AS k, CAST(l.l_shipdate AS DATE) AS d FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_linenumber = 1),
a AS (SELECT r.o_orderkey AS fixture, n, count(h.o_orderkey) AS c FROM orders r CROSS JOIN (SELECT unnest([7, 14, 28]) AS n)
  LEFT JOIN orders h ON h.o_custkey = r.o_custkey AND h.o_orderdate < r.o_orderdate AND h.o_orderdate >= r.o_orderdate - to_days(CAST(n AS INTEGER)) GROUP BY ALL),
b AS (SELECT r.o_orderkey AS fixture, n, count(s.d) AS c FROM orders r CROSS JOIN (SELECT unnest([7, 14, 28]) AS n)
  LEFT JOIN s ON s.k = r.o_custkey AND s.d < CAST(r.o_orderdate AS DATE) AND s.d >= CAST(r.o_orderdate AS DATE) - CAST(n AS INTEGER) GROUP BY ALL)
SELECT a.fixture, sum(a.c + b.c) FILTER (a.n = 7)::BIGINT AS count_7, sum(a.c + b.c) FILTER (a.n = 14)::BIGINT AS count_14, sum(a.c + b.c) FILTER (a.n = 28)::BIGINT AS count_28
FROM a JOIN b USING (fixture, n) GROUP BY a.fixture""")
def range_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fixture"), "o_custkey", "o_orderdate")
    ships = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(o.select(F.col("fixture").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    second = ships.select("o_custkey", F.to_date("l_shipdate").alias("date"))
    return pit.range_counts(o, second, "o_custkey", "o_orderdate", (7, 14, 28)).select("fixture", "count_7", "count_14", "count_28")


@query("""WITH a AS (SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS block FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00'),
b AS (SELECT block, min(ts) AS t FROM a WHERE block IS NOT NULL GROUP BY block ORDER BY t, block LIMIT 3)
SELECT a.event_id, CAST(a.block AS VARCHAR) AS block FROM a WHERE block IN (SELECT block FROM b)""")
def horizon_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") != "error", F.to_date("ts")).alias("block"))
    return pit.horizon(e, "ts", "block", "2024-01-10 12:00:00", 3).select("event_id", F.col("block").cast("string").alias("block"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN event_type <> 'view' THEN event_type END AS team, event_id FROM events),
one AS (SELECT user_id, max(team) AS t FROM e WHERE CAST(ts AS DATE) = DATE '2024-01-16' GROUP BY user_id),
two AS (SELECT user_id, arg_max(team, (ts, team)) AS t FROM e WHERE ts < TIMESTAMP '2024-01-16 00:00:00' AND team IS NOT NULL GROUP BY user_id),
p AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS t FROM customer)
SELECT p.user_id, coalesce(one.t, two.t, p.t) AS team, CASE WHEN one.t IS NOT NULL THEN 1 WHEN two.t IS NOT NULL THEN 2 WHEN p.t IS NOT NULL THEN 3 ELSE 0 END AS level
FROM p LEFT JOIN one USING (user_id) LEFT JOIN two USING (user_id)""")
def entity_resolution_3level(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")).alias("team"))
    players = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("team"))
    return pit.resolve_three(players, e.where("date(ts) = '2024-01-16'"), e, "user_id", "team", "ts", "2024-01-16 00:00:00")


@query("""SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s, CAST(floor(epoch(min(ts))) AS BIGINT) - 3600 AS deadline_s
FROM events GROUP BY ALL""")
def block_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "ts")
    d = pit.deadlines(e, ["event_type", "day"], "ts")
    s = lambda c: F.unix_seconds(c)
    return d.select("event_type", F.col("day").cast("string").alias("day"), s("first_time").alias("first_s"), s("last_time").alias("last_s"), s("deadline").alias("deadline_s"))


@query("""WITH w AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) + INTERVAL 30 HOUR AS b FROM events GROUP BY ALL)
SELECT w.user_id, CAST(w.day AS VARCHAR) AS day, CAST(floor(epoch(max(v.b))) AS BIGINT) AS latest_s FROM w JOIN w v ON v.user_id = w.user_id AND (v.a, v.b) < (w.a, w.b)
GROUP BY w.user_id, w.day, w.a HAVING w.a <= max(v.b)""")
def overlap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    w = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("a"), (F.max("ts") + F.expr("INTERVAL 30 HOUR")).alias("b"))
    return pit.overlaps(w, "a", "b", ["user_id"]).select("user_id", F.col("day").cast("string").alias("day"), F.unix_seconds("latest_end").alias("latest_s"))


@query("""WITH h AS (
  SELECT o_custkey AS player, o_totalprice AS stat, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
a AS (SELECT o_orderkey AS fixture, o_custkey AS player, o_orderdate AS t, o_totalprice AS label FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-04-01')
SELECT a.fixture, a.player, round(sum(h.stat) FILTER (n <= 3), 4) AS sum_3, round(sum(h.stat), 4) AS sum_all, n.n_regionkey AS region, any_value(a.label) AS label
FROM a LEFT JOIN h USING (player) JOIN customer c ON c.c_custkey = a.player LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY a.fixture, a.player, n.n_regionkey""")
def pit_feature_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the fixtures in a horizon from what was known at a cut-off; labels aren't gated by it."""
    as_of = F.lit("1998-01-01").cast("timestamp")
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("fixture"), F.col("o_orderdate").alias("kickoff"), F.col("o_totalprice").alias("stat"))
    ahead = o.where((F.col("kickoff") >= as_of) & (F.col("kickoff") < F.lit("1998-04-01").cast("timestamp")))
    # One row a player stands for the cut-off; its block comes after all history.
    asked = ahead.select("player").distinct().select("player", F.lit(None).cast("long").alias("fixture"), as_of.alias("kickoff"), F.lit(None).cast("double").alias("stat"), F.lit(1).alias("block"))
    past = o.where(F.col("kickoff") < as_of).withColumn("block", F.lit(0))
    found = pit.trailing(past.unionByName(asked).withColumn("minutes", F.lit(1)), ["player"], "block", ["kickoff", "fixture"], ["stat"], "minutes", windows=(3,)).where("block = 1")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), "c_nationkey").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    out = ahead.join(found.select("player", "stat_sum_last_3", "stat_sum_to_date"), "player", "left").join(c.select("player", "n_regionkey"), "player")
    return out.select("fixture", "player", F.round("stat_sum_last_3", 4).alias("sum_3"), F.round("stat_sum_to_date", 4).alias("sum_all"), F.col("n_regionkey").alias("region"), F.col("stat").alias("label"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(round(value, 6), (ts, event_id)) AS value FROM events GROUP BY user_id""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.latest(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"]).withColumn("value", F.round("value", 6))


@query("""SELECT DISTINCT user_id, CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS as_of_s, event_type FROM events""")
def streamed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of hourly snapshots, each different one once."""
    path = shared_folder(spark, "snapshots")
    events = load(spark, sf_dir, "events")
    # As a pattern, since a stream takes a table of one file by its name only so.
    raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    stream = raw.select("user_id", F.date_trunc("hour", F.col("ts").cast(events.schema["ts"].dataType)).alias("as_of_ts"), "event_type")
    snapshots.write_history(stream, f"{path}/history", f"{path}/checkpoint", ["user_id"]).awaitTermination()
    return snapshots.history(spark, f"{path}/history").select("user_id", F.unix_seconds("as_of_ts").alias("as_of_s"), "event_type")
