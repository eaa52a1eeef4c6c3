"""Staging of merged statistics, derived teams, features for a cut-off, and the era experiment."""

import io
import tarfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from asofkit.plans import build, staging
from asofkit.sources import files

from .test_operators import player_rows


def test_merged_rows_are_dropped_and_counted(spark):
    rows = [(1, 10, 5, 0, "GKP"), (1, 10, 9, 90, "GKP"), (2, 10, 5, 90, "MID"), (2, 10, 5, 90, "MID"), (3, 11, 5, 0, "AM"), (4, 11, None, 3, None)]
    raw = spark.createDataFrame(rows, "element long, fixture long, GW long, minutes long, position string")
    out, dropped = staging.stage_merged(raw)
    assert sorted((r["element"], r["GW"], r["position"]) for r in out.collect()) == [(1, 9, "GK"), (2, 5, "MID"), (4, None, None)]
    assert dropped == staging.Dropped(1, 1, 1)
    with pytest.raises(ValueError, match="have minutes"):
        staging.stage_merged(raw.withColumn("minutes", F.lit(9)))
    players = spark.createDataFrame([(1, 1, 7, "c1")], "id long, element_type long, team long, code string")
    joined, _ = staging.stage_merged(raw.drop("position").where("element = 1"), players)
    assert joined.select("position", "team_id", "player_code").collect() == [("GK", 7, "c1")]
    with pytest.raises(ValueError, match="no position"):
        staging.stage_merged(raw.drop("position"))


def test_teams_by_votes(spark):
    ours = spark.createDataFrame([(date(2024, 1, d), d, 0 if d < 3 else None, 1, 2) for d in (1, 2, 3)], "match_date date, home_score int, away_score int, team_h long, team_a long")
    theirs = spark.createDataFrame([(date(2024, 1, d), d, 0 if d < 3 else None, "A", "B") for d in (1, 2, 3)], "match_date date, home_score int, away_score int, home_team string, away_team string")
    assert sorted(tuple(r) for r in staging.derive_teams(ours, theirs, 2).collect()) == [(1, "A", 3), (2, "B", 3)]
    with pytest.raises(ValueError, match="one-to-one"):
        staging.derive_teams(ours, theirs, 20)


def test_features_as_of_do_not_leak(spark):
    teams = spark.createDataFrame([(s, t, t * 10) for s in ("2023-24", "2024-25") for t in (1, 2)], "season string, team_id long, code long")
    player = build.player_facts(player_rows(spark), teams)
    fixtures = player.where("season = '2024-25' and player_id = 1").select("season", "fixture_id", "event", "kickoff_time", F.lit(1).cast("long").alias("team_h"), F.lit(2).cast("long").alias("team_a")).distinct()
    registered = spark.createDataFrame([(p, f"c{p}", "MID", 1 if p < 3 else 2, datetime(2024, 1, 1)) for p in (1, 2, 3)], "player_id long, player_code string, position string, team_id long, as_of_ts timestamp")
    team = spark.createDataFrame([], "season string, fixture_id long, team_id long, " + ", ".join(f"{c} double" for c in build.CONTEXT))
    at = "2024-03-01 00:00:00"
    whole = staging.features_as_of(player, fixtures, registered, team, at, 1)
    row = whole.where("player_id = 2").first()
    assert whole.count() == 3 and (row["event"], row["goals_scored_sum_last_3"], row["goals_scored_sum_last_season"], row["label_goals_scored"]) == (2, 4, 8, 2)
    names = [c for c in whole.columns if not c.startswith("label_")]
    changed = player.withColumn("goals_scored", F.when(F.col("kickoff_time") >= at, 99).otherwise(F.col("goals_scored")))
    assert sorted(map(str, whole.select(names).collect())) == sorted(map(str, staging.features_as_of(changed, fixtures, registered, team, at, 1).select(names).collect()))


def test_fixtures_from_stats(spark):
    raw = player_rows(spark).withColumns({"team_h_score": F.lit(1), "team_a_score": F.lit(0)})
    r = build.fixtures_from_stats(raw).where("season = '2024-25' and fixture_id = 0").first()
    assert (r["team_h"], r["team_a"], r["finished"], r["team_h_score"]) == (1, 2, True, 1)


def test_derived_contribution_and_masks(spark):
    df = spark.createDataFrame([("2016-17", 1, 1, "DEF", 4, 3, 9), ("2016-17", 1, 2, "MID", 4, 3, 9), ("2016-17", 1, 3, "GK", 4, 3, 9), ("2016-17", 1, 4, "FWD", None, 3, 9)], "season string, fixture_id long, player_id long, position string, cbi long, tackles long, recoveries long")
    assert sorted((r["player_id"], r["label_defensive_contribution"]) for r in staging.derived_contribution(df, ["2016-17"]).collect()) == [(1, 7.0), (2, 16.0)]
    assert len(staging.masked_features()) == 23 * 2 * 5 and set(staging.masked_features()) < set(build.feature_names())


def test_archive(tmp_path):
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as tar:
        for name in ("repo/data/2016-17/gws/all.csv", "repo/data/2017-18/other.csv"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"ok"))
    assert files.extract_seasons(str(tmp_path / "a.tgz"), ["2016-17", "2017-18"], ["gws/all.csv"]) == {"2016-17": {"gws/all.csv": b"ok"}, "2017-18": {}}
    with pytest.raises(FileNotFoundError):
        files.extract_seasons(str(tmp_path / "a.tgz"), ["2018-19"], [])
