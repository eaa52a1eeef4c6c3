"""Building the domain tables: player and team facts, points, features and the training matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions import scoring
from asofkit.functions.text import start_year
from asofkit.operators import facts, pit

# Fixed column lists of the player facts.
CORE = ("goals_scored", "assists", "goals_conceded", "own_goals", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "saves")
UNMASKED = ("minutes", "starts", *CORE)
MASKED = {
    "obs_defensive": ("cbi", "tackles", "recoveries", "defensive_contribution"),
    "obs_bps_inputs": (
        "attempted_passes", "completed_passes", "key_passes", "big_chances_created", "big_chances_missed", "open_play_crosses", "dribbles", "tackled",
        "fouls", "offside", "target_missed", "errors_leading_to_goal", "errors_leading_to_goal_attempt", "penalties_conceded", "winning_goals",
    ),
    "obs_expected": ("expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded"),
}
PLAYER_KEY = ("season", "fixture_id", "player_id")
TEAM_KEY = ("season", "fixture_id", "team_id")
DAYS = (7, 14, 28)
CONTEXT = ("elo_rating", "opponent_elo_rating", *(f"fixture_count_prior_{n}_days" for n in DAYS), "odds_win_prob", "odds_draw_prob", "odds_loss_prob")
LABELS = {n: n for n in ("minutes", "goals_scored", "assists", "goals_conceded", "defensive_contribution", "saves", "yellow_cards", "red_cards", "penalties_saved", "penalties_missed", "own_goals")} | {
    "bonus": "bonus_published", "total_points": "total_points_published",
}


def player_facts(stats: DataFrame, teams: DataFrame | None) -> DataFrame:
    """One row for each season, fixture and player, in the order and types of the contract.

    The own team is the one of the fixture's two opponents that isn't the row's, whatever came as
    its team. Absent optional columns are typed nulls, and each group's mask says whether any of
    its columns has a value. Without teams, codes are null.
    """
    types = dict.fromkeys((*MASKED["obs_defensive"], *MASKED["obs_bps_inputs"], "starts", "bonus_published", "bps_published", "total_points_published"), "bigint")
    types |= dict.fromkeys(MASKED["obs_expected"], "double") | {"player_code": "string"}
    out = stats.withColumnsRenamed({"opponent_team": "opponent_team_id", "clearances_blocks_interceptions": "cbi"}).drop("team_id")
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in out.columns})
    out = facts.complete_pair(out, ["season", "fixture_id"], "opponent_team_id", "team_id")
    if teams is None:
        out = out.withColumns({c: F.lit(None).cast("bigint") for c in ("team_code", "opponent_team_code")})
    else:
        t = teams.select("season", "team_id", F.col("code").alias("team_code"))
        out = out.join(t, ["season", "team_id"], "left").join(t.withColumnsRenamed({"team_id": "opponent_team_id", "team_code": "opponent_team_code"}), ["season", "opponent_team_id"], "left")
    masks = {m: F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull() for m, cols in MASKED.items()}
    out = out.withColumns({"kickoff_time": F.try_to_timestamp("kickoff_time"), **masks, "obs_starts": F.col("starts").isNotNull()})
    columns = ("season", "fixture_id", "player_id", "player_code", "team_id", "team_code", "opponent_team_id", "opponent_team_code", "was_home", "kickoff_time", "event", "position")
    return out.select(
        *columns, "minutes", "starts", *CORE, *(c for cols in MASKED.values() for c in cols),
        "total_points_published", "bonus_published", "bps_published", *MASKED, "obs_starts",
    )


def checked_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same rows; a key that occurs twice raises when they are read."""
    n = F.count("*").over(Window.partitionBy(*key))
    bad = F.raise_error(F.concat(F.lit(f"key {tuple(key)} is not unique: "), F.to_json(F.struct(*key)))).cast("boolean")
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, bad).otherwise(F.lit(True))).drop("_n")


def fixtures_from_stats(stats: DataFrame) -> DataFrame:
    """The fixtures that player rows imply: sides, time, event, scores and whether they were played."""
    sides = facts.two_sides(stats, ["season", "fixture_id"], "was_home", ["opponent_team"])
    rest = stats.groupBy("season", "fixture_id").agg(
        F.min("event").alias("event"), F.min("kickoff_time").alias("kickoff_time"), F.min("team_h_score").alias("team_h_score"), F.min("team_a_score").alias("team_a_score"),
        F.max("minutes").alias("_m"),
    )
    named = sides.select("season", "fixture_id", F.col("away_opponent_team").alias("team_h"), F.col("home_opponent_team").alias("team_a"))
    return rest.join(named, ["season", "fixture_id"]).withColumn("finished", F.col("_m") > 0).drop("_m")


def team_facts(fixtures: DataFrame, ratings: DataFrame, odds: DataFrame, others: DataFrame) -> DataFrame:
    """One row a team and fixture: ratings before the day, prior fixture counts, and outcome probabilities.

    fixtures: season, fixture_id, team_h, team_a (codes), kickoff_time. ratings: team, as_of_date,
    elo. odds: season, home, away, match_date, odds_h, odds_d, odds_a; either orientation of the
    two teams on the day matches. others: team, date of a second calendar.
    """
    sides = facts.either_side(fixtures.select("season", "fixture_id", "kickoff_time", "team_h", "team_a"), "team_h", "team_a", [])
    sides = sides.withColumn("match_date", F.to_date("kickoff_time"))
    rated = sides
    for who, name in (("team", "elo_rating"), ("opponent", "opponent_elo_rating")):
        rated = pit.asof_strict(rated, ratings.withColumnRenamed("team", who), who, "match_date", "as_of_date", ["elo"]).withColumnRenamed("elo", name)
    counted = pit.range_counts(rated, others, "team", "kickoff_time", DAYS).withColumnsRenamed({f"count_{n}": f"fixture_count_prior_{n}_days" for n in DAYS})
    win, draw, loss = facts.devig([F.col("own_0"), F.col("odds_d"), F.col("other_0")])
    row = ["row"] if "row" in odds.columns else []
    priced = facts.either_side(odds.select("season", "home", "away", "match_date", "odds_h", "odds_d", "odds_a", *row), "home", "away", [("odds_h", "odds_a")])
    priced = priced.withColumns({"odds_h": F.col("own_0"), "odds_a": F.col("other_0")})
    priced = priced.select("season", "team", "opponent", "match_date", "odds_h", "odds_d", "odds_a", *row, win.alias("odds_win_prob"), draw.alias("odds_draw_prob"), loss.alias("odds_loss_prob"))
    # Of several prices of one match the first by ``row`` counts, or else the one of the lowest odds.
    first = ["row"] if "row" in odds.columns else ["odds_h", "odds_d", "odds_a"]
    priced = facts.dedupe_first(priced, ["season", "team", "opponent", "match_date"], first)
    out = counted.join(priced, ["season", "team", "opponent", "match_date"], "left")
    return out.withColumnsRenamed({"team": "team_id", "opponent": "opponent_team_id"}).select(*TEAM_KEY, "opponent_team_id", "was_home", *CONTEXT)


def points(player: DataFrame, rules: str) -> DataFrame:
    """The thirteen points terms of each row, their total, and the published total; negative minutes raise when they are read."""
    bad = F.raise_error(F.concat(F.lit("negative minutes: "), F.to_json(F.struct(*PLAYER_KEY)))).cast("bigint")
    minutes = F.when(F.col("minutes") < 0, bad).otherwise(F.col("minutes"))
    row: dict[str, Column] = {
        "position": F.col("position"), "minutes": minutes, "goals": F.col("goals_scored"), "assists": F.col("assists"), "conceded": F.col("goals_conceded"),
        "clearances": F.col("cbi"), "tackles": F.col("tackles"), "recoveries": F.col("recoveries"), "bonus": F.col("bonus_published"),
        **{c: F.col(c) for c in ("saves", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "own_goals")},
    }
    items = scoring.terms(rules, row)
    return player.select(*PLAYER_KEY, *[c.cast("long").alias(f"points_{n}") for n, c in items.items()], "total_points_published").withColumn(
        "total_points", sum((F.col(f"points_{n}") for n in list(items)[1:]), F.col(f"points_{next(iter(items))}"))
    )


def feature_names() -> list[str]:
    """The 455 names of the trailing features and the 8 of the team's context."""
    frames = [f"last_{n}" for n in pit.WINDOWS] + ["to_date", "last_season"]
    names = [f"{s}_{kind}_{f}" for f in frames for s in UNMASKED for kind in ("sum", "per90")]
    names += [f"{s}_{kind}_{f}" for f in frames for cols in MASKED.values() for s in cols for kind in ("sum", "per90", "masked")]
    return [*names, *CONTEXT]


def rolling_features(player: DataFrame, entity: str = "player_code", span_seasons: bool = False) -> DataFrame:
    """Player facts with all trailing features, blocked by event so that nothing of it reaches its own rows.

    ``entity`` should be stable across seasons; a number given anew each season would bring
    another player's last season. With ``span_seasons`` the last-N windows look into earlier ones.
    """
    masks = {c: m for m, cols in MASKED.items() for c in cols}
    stats = [*UNMASKED, *masks]
    df = player.withColumn("_year", start_year(F.col("season"))).withColumn("_block", F.col("_year") * 1000 + F.col("event"))
    df = df.withColumn("_minutes", F.col("minutes"))
    key = [entity] if span_seasons else [entity, "_year"]
    out = pit.trailing(df, key, "_block", ["kickoff_time", "fixture_id"], stats, "_minutes", masks=masks, to_date=not span_seasons)
    if span_seasons:
        out = pit.trailing(out, [entity, "_year"], "_block", ["kickoff_time", "fixture_id"], stats, "_minutes", windows=(), masks=masks)
    return pit.previous_season(out, [entity], "_year", stats, "_minutes", masks).drop("_year", "_block", "_minutes")


def training_matrix(player: DataFrame, team: DataFrame, entity: str = "player_code", span_seasons: bool = False) -> DataFrame:
    """Identity, masks, features and labels of every player and fixture that has an event and a time."""
    rows = player.where(F.col("event").isNotNull() & F.col("kickoff_time").isNotNull())
    wide = rolling_features(rows, entity, span_seasons)
    wide = facts.context_of(wide, team, TEAM_KEY, CONTEXT)
    identity = ("season", "event", "fixture_id", "player_id", "player_code", "position", "was_home", "team_code", "opponent_team_code")
    return wide.select(*identity, *MASKED, "obs_starts", *feature_names(), *[F.col(c).alias(f"label_{n}") for n, c in LABELS.items()])
