"""Queries of the rule engine, over rows of actions derived from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofkit.functions import scoring as rules
from asofkit.operators import evaluate

from .registry import query, rows

ACTIONS = """
SELECT l_orderkey AS fixture, l_linenumber AS player, l_partkey AS pkey, l_suppkey AS skey, 2023 + l_orderkey % 4 AS season,
  CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS position,
  (l_orderkey * 7 + l_linenumber * 13) % 96 AS minutes, l_partkey % 3 AS goals, l_suppkey % 3 AS assists, l_partkey % 4 AS conceded, l_suppkey % 8 AS saves,
  l_partkey % 2 AS penalties_saved, l_suppkey % 2 AS penalties_missed, l_orderkey % 2 AS yellow_cards, l_orderkey % 3 AS red_cards, l_partkey % 5 AS own_goals,
  CASE WHEN l_orderkey % 10 <> 0 THEN l_partkey % 9 END AS clearances, CASE WHEN l_orderkey % 10 <> 0 THEN l_suppkey % 7 END AS tackles,
  CASE WHEN l_orderkey % 10 <> 0 THEN l_orderkey % 6 END AS recoveries, (l_partkey + l_orderkey) % 4 AS bonus
FROM lineitem
"""
NAMES = ("position", "minutes", "goals", "assists", "conceded", "saves", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "own_goals", "clearances", "tackles", "recoveries", "bonus")
TERM_SQL = {
    "appearance": "CASE WHEN minutes <= 0 THEN 0 WHEN minutes < 60 THEN 1 ELSE 2 END",
    "goals": "goals * CASE position WHEN 'GK' THEN 6 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END",
    "assists": "assists * 3",
    "clean_sheet": "CASE WHEN minutes >= 60 AND conceded = 0 THEN CASE position WHEN 'GK' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END ELSE 0 END",
    "goals_conceded": "CASE WHEN position IN ('GK', 'DEF') AND minutes > 0 THEN -(conceded // 2) ELSE 0 END",
    "saves": "saves // 3",
    "penalties_saved": "penalties_saved * 5",
    "penalties_missed": "penalties_missed * -2",
    "yellow_cards": "-yellow_cards",
    "red_cards": "red_cards * -3",
    "own_goals": "own_goals * -2",
    "defensive_contribution": "CASE WHEN position = 'DEF' AND coalesce(clearances, 0) + coalesce(tackles, 0) >= 10 THEN 2 WHEN position IN ('MID', 'FWD') AND coalesce(clearances, 0) + coalesce(tackles, 0) + coalesce(recoveries, 0) >= 12 THEN 2 ELSE 0 END",
    "bonus": "bonus",
}
TOTAL_SQL = " + ".join(f"({x})" for x in TERM_SQL.values())
OLD_SQL = " + ".join(f"({x})" for n, x in TERM_SQL.items() if n != "defensive_contribution")


def _row() -> dict:
    return {n: F.col(n) for n in NAMES}


def _total(name):
    items = list(rules.terms(name, _row()).values())
    return sum(items[1:], items[0])


@query(f"SELECT fixture, player, {', '.join(f'CAST({x} AS BIGINT) AS t_{n}' for n, x in TERM_SQL.items())} FROM ({ACTIONS})")
def score_itemised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, ACTIONS).select("fixture", "player", *[c.cast("long").alias(f"t_{n}") for n, c in rules.terms("2025-26", _row()).items()])


@query(f"SELECT fixture, player, CASE WHEN season < 2025 THEN 'legacy' WHEN season = 2025 THEN '2025-26' ELSE '2026-27' END AS rules, CAST(CASE WHEN season < 2025 THEN {OLD_SQL} ELSE {TOTAL_SQL} END AS BIGINT) AS total FROM ({ACTIONS})")
def score_rulesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = rules.ruleset_of(F.col("season"))
    return rows(spark, sf_dir, ACTIONS).select("fixture", "player", name.alias("rules"), _total(name).cast("long").alias("total"))


@query(f"""SELECT season, count(*) AS n, count(*) FILTER (total <> published) AS different, CAST(sum(total - published) AS BIGINT) AS residual
FROM (SELECT season, {TOTAL_SQL} AS total, {OLD_SQL} + fixture % 2 AS published FROM ({ACTIONS})) GROUP BY season""")
def reconcile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, ACTIONS).select("season", _total("2025-26").alias("total"), (_total("legacy") + F.col("fixture") % 2).alias("published"))
    diff = F.col("total") - F.col("published")
    return d.groupBy("season").agg(F.count("*").alias("n"), F.count_if(diff != 0).alias("different"), F.sum(diff).alias("residual"))


@query(f"""SELECT position, count(*) AS n, count(*) FILTER (d = 0) AS exact, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(avg(abs(d)), 6) AS mean_abs, CAST(max(abs(d)) AS BIGINT) AS worst
FROM (SELECT position, CAST({TOTAL_SQL} - ({OLD_SQL} + fixture % 2) AS DOUBLE) AS d FROM ({ACTIONS})) GROUP BY position""")
def residual_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far reconstructed totals are from published ones."""
    d = rows(spark, sf_dir, ACTIONS).withColumns({"total": _total("2025-26"), "published": _total("legacy") + F.col("fixture") % 2})
    found = evaluate.residuals(d, ["position"], "total", "published")
    return found.select("position", "n", "exact", *[F.round(c, 6).alias(c) for c in ("mean", "std", "mean_abs")], F.col("worst").cast("long").alias("worst"))


@query(f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN t <= 0 THEN 'zeros' WHEN t <= 3 THEN 'blanks' WHEN t <= 8 THEN 'tickers' ELSE 'haulers' END AS bucket FROM (SELECT {TOTAL_SQL} AS t FROM ({ACTIONS}))) GROUP BY bucket""")
def outcome_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, ACTIONS).groupBy(rules.outcome_bucket(_total("2025-26")).alias("bucket")).agg(F.count("*").alias("n"))


_ID = "fixture, player, pkey, skey"


@query(f"""WITH s AS (SELECT {_ID}, {OLD_SQL} AS a, {TOTAL_SQL} AS b FROM ({ACTIONS})),
x AS (SELECT {_ID} FROM (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY a DESC, player, pkey, skey) AS n FROM s) WHERE n <= 3),
y AS (SELECT {_ID} FROM (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY b DESC, player, pkey, skey) AS n FROM s) WHERE n <= 3)
SELECT {_ID}, true AS old_top, false AS new_top FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT {_ID}, false, true FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")
def bonus_top3_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _ID.split(", ")
    s = rows(spark, sf_dir, ACTIONS).select(*keys, _total("legacy").alias("a"), _total("2025-26").alias("b"))
    rank = lambda c: F.row_number().over(Window.partitionBy("fixture").orderBy(F.desc(c), *keys[1:])) <= 3
    tops = s.withColumns({"old_top": rank("a"), "new_top": rank("b")})
    return tops.where("old_top <> new_top").select(*keys, "old_top", "new_top")


_BONUS = {n: f"(fixture * {i + 3} + player * {i + 1}) % {i % 4 + 2}" for i, n in enumerate([*rules.BONUS_WEIGHTS, "attempted_passes", "completed_passes"])}
_BONUS |= {"attempted_passes": "(fixture * 31 + player) % 80", "completed_passes": "((fixture * 31 + player) % 80) * (50 + fixture % 51) // 100"}
BONUS_ROWS = f"SELECT fixture, player, position, minutes, goals, conceded, coalesce(clearances, 0) AS clearances, coalesce(recoveries, 0) AS recoveries, {', '.join(f'{x} AS {n}' for n, x in _BONUS.items())} FROM ({ACTIONS})"


@query(f"""SELECT fixture, player, CAST(CASE WHEN minutes >= 60 THEN 6 WHEN minutes >= 1 THEN 3 ELSE 0 END + goals * CASE WHEN position IN ('GK', 'DEF') THEN 12 WHEN position = 'MID' THEN 18 ELSE 24 END
 + CASE WHEN attempted_passes < 30 THEN 0 WHEN completed_passes / attempted_passes * 100 >= 90 THEN 6 WHEN completed_passes / attempted_passes * 100 >= 80 THEN 4 WHEN completed_passes / attempted_passes * 100 >= 70 THEN 2 ELSE 0 END
 + CASE WHEN position IN ('GK', 'DEF') AND minutes >= 60 AND conceded = 0 THEN 12 ELSE 0 END - CASE WHEN position IN ('GK', 'DEF') THEN 4 * conceded ELSE 0 END
 + clearances // 3 + recoveries // 3 + {' + '.join(f'({w}) * {n}' for n, w in rules.BONUS_WEIGHTS.items())} AS BIGINT) AS score FROM ({BONUS_ROWS})""")
def bonus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, BONUS_ROWS.replace("//", "div"))
    return d.select("fixture", "player", rules.bonus_score({c: F.col(c) for c in d.columns}).cast("long").alias("score"))


PREDICTED = f"SELECT fixture, player, position, CAST(minutes AS DOUBLE) - 5 AS minutes, CAST(goals AS DOUBLE) / 3 AS goals, CAST(assists AS DOUBLE) / 3 AS assists, CASE WHEN fixture % 8 <> 0 THEN CAST(conceded AS DOUBLE) / 2 END AS conceded, CAST(saves AS DOUBLE) / 2 AS saves, CAST(penalties_saved AS DOUBLE) / 4 AS penalties_saved, CAST(penalties_missed AS DOUBLE) / 4 AS penalties_missed, CAST(yellow_cards AS DOUBLE) / 5 AS yellow_cards, CAST(red_cards AS DOUBLE) / 5 AS red_cards, CAST(own_goals AS DOUBLE) / 5 AS own_goals, CASE WHEN fixture % 3 <> 0 THEN 14.0 * (player % 2) END AS contribution FROM ({ACTIONS})"
_P = {
    **TERM_SQL,
    "goals_conceded": "CASE WHEN position IN ('GK', 'DEF') AND minutes > 0 THEN -floor(conceded / 2) ELSE 0 END",
    "saves": "floor(saves / 3)",
    "defensive_contribution": "CASE WHEN position = 'DEF' AND coalesce(contribution, 0) >= 10 THEN 2 WHEN position IN ('MID', 'FWD') AND coalesce(contribution, 0) >= 12 THEN 2 ELSE 0 END",
    "bonus": "0",
}


@query(f"SELECT fixture, player, CASE WHEN conceded IS NOT NULL THEN round({' + '.join(f'({x})' for x in _P.values())}, 6) + 0.0 END AS points FROM (SELECT * REPLACE (greatest(minutes, 0) AS minutes) FROM ({PREDICTED}))")
def score_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, PREDICTED)
    d = d.select("fixture", "player", "position", *[F.col(c).cast("double").alias(c) for c in d.columns[3:]])
    p = rules.predicted_points("2025-26", {c: F.col(c) for c in d.columns})
    return d.select("fixture", "player", F.when(F.col("conceded").isNotNull(), F.round(p, 6) + 0.0).alias("points"))
