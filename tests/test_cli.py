"""All commands, one after another, on a small folder of raw captures."""

import io

import pandas as pd
from pyspark.sql import functions as F

from asofkit import cli
from asofkit.plans import build, raw_tables
from asofkit.sources import captures, contracts, writers

SEASONS = ("2023-24", "2024-25")
AS_OF = "2025-06-01T00-00-00Z"


def csv(rows):
    out = io.StringIO()
    pd.DataFrame(rows).to_csv(out, index=False)
    return out.getvalue().encode()


def raw_folder(root):
    import json

    put = lambda folder, body, kind="json", meta=None: writers.write_raw(root / "raw" / folder, AS_OF, body, meta or {"source": "s"}, kind)
    for s in SEASONS:
        year, rows = int(s[:4]), []
        for e in range(1, 7):
            for p in range(1, 9):
                home = p <= 4
                plays = (p + e) % 4 > 0
                goals = (p * e + year) % 3 * plays
                rows.append(
                    dict(name=f"P {p}", element=p, fixture=e, GW=e, round=e, kickoff_time=f"{year}-{8 + e // 3:02d}-{1 + 7 * (e % 3):02d}T15:00:00Z", was_home=home, opponent_team=2 if home else 1, minutes=90 * plays,
                         team_h_score=1, team_a_score=0, position=("GKP", "DEF", "MID", "FWD")[p % 4], team="x", starts=1, goals_scored=goals, assists=goals % 2, goals_conceded=1, own_goals=0, penalties_saved=0,
                         penalties_missed=0, yellow_cards=p % 2 * plays, red_cards=0, saves=p % 4 * plays, bonus=goals, bps=20, total_points=(2 + 4 * goals) * plays, expected_goals=0.1 * goals, expected_assists=0.1, expected_goal_involvements=0.2,
                         expected_goals_conceded=1.0, value=50, xP=1.0)
                )
        rows.append({**rows[0], "element": 99, "position": "AM", "minutes": 0})
        put(f"archive/merged/{s}", csv(rows), "csv")
        put(f"archive/players/{s}", csv([{"id": p, "element_type": 1 + p % 4, "team": 1 if p <= 4 else 2, "code": 100 + p} for p in range(1, 9)]), "csv")
        players = [dict.fromkeys([c.source for c in contracts.PLAYERS.columns if c.required], 0) | {"id": p, "code": 100 + p, "team": 1 if p <= 4 else 2, "element_type": 1 + (p - 1) % 4, "first_name": "P", "second_name": f"Q{p}", "odd": 1} for p in range(1, 9)]
        teams = [{"id": 1, "code": 11, "name": "Man City", "short_name": "MCI", "form": None}, {"id": 2, "code": 12, "name": "Spurs", "short_name": "TOT", "form": None}]
        events = [{"id": 1, "name": "one", "deadline_time": "2024-08-01", "finished": True, "is_current": False, "is_next": False, "is_previous": True}]
        put(f"game/bootstrap/{s}", json.dumps({"elements": players, "teams": teams, "events": events}).encode())
        fixtures = [{"id": e, "code": e, "event": e, "kickoff_time": f"{year}-{8 + e // 3:02d}-{1 + 7 * (e % 3):02d}T15:00:00Z", "team_h": 1, "team_a": 2, "finished": e < 6, "stats": []} for e in range(1, 7)]
        put(f"game/fixtures/{s}", json.dumps(fixtures).encode())
        rated = [{"Rank": 1, "Club": c, "Country": "ENG", "Level": 1, "Elo": elo, "From": f"{year}-07-01", "To": f"{year}-08-01"} for c, elo in (("Manchester City", 1900.0), ("Tottenham", 1700.0))]
        put(f"ratings/daily/{s}", csv(rated), "csv", {"source": "ratings", "params": {"date": f"{year}-07-30"}})
        put(f"matches/results/{s}", csv([{"Date": f"08/08/{year}", "HomeTeam": "Man City", "AwayTeam": "Tottenham", "FTHG": 1, "FTAG": 0, "FTR": "H", "B365H": 2.0, "B365D": 4.0, "B365A": 4.0}]), "csv")
    put("schedules/cup/2024-25", "\u25aa Final\nSat Aug 3 2024\n Man City (ENG) v Spurs (ENG)\n".encode(), "txt")
    league = {"players": [], "dates": [{"id": "5", "isResult": True, "h": {"title": "A"}, "a": {"title": "B"}, "goals": {"h": "1", "a": "2"}, "xG": {"h": "0.5", "a": "1.5"}, "datetime": "2024-08-03"}]}
    league["players"] = [dict.fromkeys([c.source for c in contracts.CENTRE_PLAYERS.columns], "1")]
    put("centre/league/2024-25", json.dumps(league).encode())
    player = dict.fromkeys([c.source for c in contracts.CENTRE_ROSTERS.columns if c.source not in ("match_id", "side")], "7")
    writers.write_chunk(root / "raw/centre/match/2024-25", 0, [{"match_id": 5, "rosters": {"h": {"1": player}, "a": {"2": player}}}])
    squad = {"entry": 3, "event": 1, "fetched_at": "t", "contaminated": True, "payload": {"picks": [{"element": 4, "position": 1, "multiplier": 2, "is_captain": True, "is_vice_captain": False}]}}
    writers.write_chunk(root / "raw/game/picks/2024-25/elite/event=1", 0, [squad])


def test_all_commands(spark, tmp_path, capsys):
    raw_folder(tmp_path)
    run = lambda *a: cli.main(["--root", str(tmp_path), *a])
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}")
    for s in SEASONS:
        assert run("stage", "--season", s) == 0
    said = capsys.readouterr().out
    assert "unknown columns ['odd']" in said and "left out 1 managers" in said and "scheduled_fixtures: nothing staged" in said
    assert read("staged/players").count() == 16 and read("staged/price_snapshots").select("as_of_ts").distinct().count() == 1
    pick = read("staged/manager_picks").first()
    assert (pick["cohort"], pick["player_id"], pick["contaminated"]) == ("elite", 4, True)
    match = read("staged/centre_fixtures").first()
    assert (match["home_team"], match["away_goals"], match["home_xg"]) == ("A", 2, 0.5) and read("staged/centre_player_match").count() == 2
    assert str(read("staged/ratings").where("season = '2024-25'").first()["as_of_date"]) == "2024-07-30"
    assert run("crosswalk", "validate") == 1 and run("crosswalk", "refresh") == 0 and run("crosswalk", "validate") == 0
    assert run("facts") == 0
    team = {(r["season"], r["fixture_id"], r["team_id"]): r for r in read("facts/team_fixture").collect()}
    first = team[("2024-25", 1, 1)]
    assert len(team) == 24 and (first["elo_rating"], first["opponent_elo_rating"], first["odds_win_prob"], first["fixture_count_prior_7_days"]) == (1900.0, 1700.0, 0.5, 1)
    assert run("check") == 0 and run("check", "--layer", "staged") == 0 and run("check", "--layer", "other") == 2
    bad = read("staged/ratings").withColumn("valid_to", F.col("valid_from")).unionByName(read("staged/ratings"))
    bad.coalesce(1).write.partitionBy("season").parquet(f"{tmp_path}/bad/staged/ratings")
    capsys.readouterr()
    assert cli.main(["--root", f"{tmp_path}/bad", "check", "--layer", "facts"]) == 0 and cli.main(["--root", f"{tmp_path}/bad", "check"]) == cli.GATE_FAILED
    said = capsys.readouterr().out
    assert "ratings: block unique_key(season,as_of_date,club): 8 rows" in said and "ratings: block within(as_of_date,valid_from,valid_to): 4 rows" in said
    assert run("dataset") == 0 and run("features", "--as-of", "2024-09-20 00:00:00", "--horizon", "1") == 0
    ahead = read("features/as_of=2024-09-20-00-00-00")
    assert ahead.count() == 8 and ahead.where("season = '2024-25' and event = 6 and minutes_sum_to_date > 0").count() == 8
    # The reports on a few of the features, as 463 columns take minutes here.
    few = ["goals_scored_sum_last_5", "minutes_sum_to_date", "expected_goals_sum_last_3", "elo_rating", "odds_win_prob"]
    whole = read("training")
    whole.select(*[c for c in whole.columns if c in few or c not in build.feature_names()]).write.partitionBy("season").parquet(f"{tmp_path}/few/training")
    capsys.readouterr()
    for command, titles in ((["eda"], ("High Spearman pairs", "Variance inflation", "Sample")), (["baseline", "--component", "goals_scored"], ("Fitted goals_scored", "System points", "Order by event"))):
        assert cli.main(["--root", f"{tmp_path}/few", *command]) == 0
        said = capsys.readouterr().out
        assert all(f"## {t}" in said for t in titles) and (tmp_path / f"few/reports/{command[0]}.md").read_text() in said


def test_sources_without_captures_say_so(spark, tmp_path):
    for name, source in raw_tables.SOURCES.items():
        assert all(x.rows is None for x in source(spark, str(tmp_path), "2024-25")), name
    assert captures.Outcome(1, 1, 0).complete
