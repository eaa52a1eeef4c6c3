"""Staging of merged statistics, teams derived from matches, features for a cut-off, and experiments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.operators import evaluate, facts, models, pit

from . import build

# Fixed codes of the game's positions.
POSITION_OF = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}
POSITION_ALIASES = {"GKP": "GK"}
MANAGER = "AM"


@dataclass(frozen=True)
class Dropped:
    managers: int
    duplicates: int
    postponed: int


def position_of(code: Column) -> Column:
    """The position of a numeric code; another code is null."""
    out = F.lit(None).cast("string")
    for k, v in POSITION_OF.items():
        out = F.when(code.try_cast("int") == k, v).otherwise(out)
    return out


def stage_merged(raw: DataFrame, players: DataFrame | None = None) -> tuple[DataFrame, Dropped]:
    """Rows of all events of a season, without managers, exact copies, and placeholders of postponed fixtures.

    ``players`` (id, element_type, team, code) supplies what early files lack: position and team,
    and the stable code; a file with neither position nor players is an error. A placeholder
    with minutes is a conflict that raises. Each kind of dropped row is counted.
    """
    out = raw
    if players is None:
        if "position" not in raw.columns:
            raise ValueError("the file has no position and no players were given")
    else:
        own = "position" in raw.columns
        look = players.select(F.col("id").try_cast("bigint").alias("_id"), position_of(F.col("element_type")).alias("_position"), F.col("team").try_cast("bigint").alias("_team"), F.col("code").cast("string").alias("player_code"))
        out = out.join(look, F.col("element") == F.col("_id"), "left")
        out = out.drop("_id", "_position", "_team") if own else out.drop("_id").withColumnsRenamed({"_position": "position", "_team": "team_id"})
    for alias, name in POSITION_ALIASES.items():
        out = out.withColumn("position", F.when(F.col("position") == alias, name).otherwise(F.col("position")))
    managers = out.where(F.col("position") == MANAGER).count()
    out = out.where(F.col("position").isNull() | (F.col("position") != MANAGER))
    before = out.count()
    out = out.dropDuplicates()
    single = out.count()
    kept = facts.keep_latest(out, ["element", "fixture"], "GW")
    stale = out.exceptAll(kept)
    if (n := stale.where("minutes > 0").count()) > 0:
        raise ValueError(f"{n} rows of postponed fixtures have minutes; they need a decision")
    return kept, Dropped(managers, before - single, single - kept.count())


def derive_teams(ours: DataFrame, theirs: DataFrame, expected: int = 20) -> DataFrame:
    """team_id and name by votes of matches that share date and scores; raises unless it is one to one and complete.

    ours: match_date, home_score, away_score, team_h, team_a. theirs: match_date, home_score,
    away_score, home_team, away_team.
    """
    pairs = facts.match_scores(ours.alias("o"), theirs.alias("t"), "match_date", ["home_score", "away_score"])
    votes = pairs.select(F.inline(F.array(*[F.struct(F.col(t).alias("team_id"), F.col(n).alias("name")) for t, n in (("team_h", "home_team"), ("team_a", "away_team"))])))
    found = facts.vote(votes, ["team_id"], "name")
    n, names, tied = found.agg(F.count("*"), F.count_distinct("name"), F.count_if("tied")).first()
    if tied or n != expected or names != n:
        raise ValueError(f"no one-to-one mapping: {n} teams, {names} names, {tied} ties; {expected} expected")
    return found.select("team_id", "name", "votes")


def features_as_of(player: DataFrame, fixtures: DataFrame, registered: DataFrame, team: DataFrame, as_of: str, events: int, season: str | None = None) -> DataFrame:
    """Features of every registered player for every fixture of their team in the first events after a cut-off.

    History is what kicked off before ``as_of``; the team is resolved by the fixture's own fact,
    else the latest earlier one, else the registration as of then. The team's context of the
    target fixture is read as it is, and labels aren't gated by the cut-off. ``season`` is that of
    the fixtures and registrations (those without a season column are taken to be of it); numbers
    of teams and events begin anew in each, so they are never compared across seasons.
    """
    cut = F.lit(as_of).cast("timestamp")
    if season is not None:
        fixtures = fixtures.where(F.col("season") == season)
        registered = registered.where(F.col("season") == season) if "season" in registered.columns else registered
    ahead = pit.horizon(fixtures, "kickoff_time", "event", as_of, events)
    known = player.where(F.col("kickoff_time") < cut)
    roster = registered.where(F.col("as_of_ts") <= cut).groupBy("player_id").agg(F.max_by(F.struct("player_code", "position", "team_id"), "as_of_ts").alias("_r")).select("player_id", "_r.*")
    now = player.where(F.col("season") == season) if season is not None else player
    exact = now.join(ahead.select("season", "fixture_id"), ["season", "fixture_id"], "left_semi")
    earlier = known.where(F.col("season") == season) if season is not None else known
    resolved = pit.resolve_three(roster, exact, earlier, "player_id", "team_id", "kickoff_time", as_of)
    sides = facts.either_side(ahead.select("season", "fixture_id", "event", "kickoff_time", "team_h", "team_a"), "team_h", "team_a", [])
    target = resolved.join(sides.withColumnsRenamed({"team": "team_id", "opponent": "opponent_team_id"}), "team_id")
    # All targets share the history before the cut-off: they stand in one block after it.
    event, of_season = ahead.agg(F.min("event"), F.min("season")).first()
    asked = target.select("player_id", "player_code").distinct().select("player_id", "player_code", F.lit(of_season).cast("string").alias("season"), F.lit(event).cast("bigint").alias("event"), cut.alias("kickoff_time"), F.lit(-1).cast("bigint").alias("fixture_id"))
    history = known.unionByName(asked, allowMissingColumns=True)
    wide = build.rolling_features(history).where("fixture_id = -1")
    names = [n for n in build.feature_names() if n not in build.CONTEXT]
    out = target.join(wide.select("player_id", *names), "player_id", "left")
    out = facts.context_of(out, team, build.TEAM_KEY, build.CONTEXT)
    labels = player.select(*build.PLAYER_KEY, *[F.col(c).alias(f"label_{n}") for n, c in build.LABELS.items()])
    return out.join(labels, list(build.PLAYER_KEY), "left")


def derived_contribution(player: DataFrame, seasons: Sequence[str]) -> DataFrame:
    """The defensive contribution of outfield players from its counts, where all of these are known."""
    rows = player.where(F.col("season").isin(*seasons) & F.col("position").isin("DEF", "MID", "FWD")).dropna(subset=["cbi", "tackles", "recoveries"])
    value = F.col("cbi") + F.col("tackles") + F.when(F.col("position") == "DEF", 0).otherwise(F.col("recoveries"))
    return rows.select(*build.PLAYER_KEY, value.cast("double").alias("label_defensive_contribution"))


def era_report(matrix: DataFrame, player: DataFrame, fit_on: Sequence[str], test_on: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Errors, on a later era, of contribution models fitted on an earlier one, beside the trailing mean's; both on the same rows."""
    key = list(build.PLAYER_KEY)
    label = derived_contribution(player, [*fit_on, *test_on])
    rows = matrix.drop("label_defensive_contribution").join(label, key)
    train = rows.where(F.col("season").isin(*fit_on))
    positions = [r[0] for r in train.select("position").distinct().collect()]  # three
    fitted = {p: models.fit_poisson(train.where(F.col("position") == p), features, "label_defensive_contribution") for p in positions}
    both = pit.trailing_mean(rows, ["season", "player_code"], "event", ["fixture_id"], "label_defensive_contribution", out="naive").where(F.col("season").isin(*test_on))
    both = both.withColumn("model", models.by_segment(both, "position", fitted)).dropna(subset=["model", "naive"])
    y = F.col("label_defensive_contribution")
    parts = [both.agg(*evaluate.metrics(y, F.col(m)), evaluate.deviance(y, F.col(m))).select(F.lit(m).alias("predictor"), "*") for m in ("model", "naive")]
    return parts[0].unionByName(parts[1])


def masked_features() -> dict[str, str]:
    """The sums and rates of masked columns, each with its mask; counts of masked rows are always known."""
    frames = [f"last_{n}" for n in pit.WINDOWS] + ["to_date", "last_season"]
    return {f"{c}_{kind}_{f}": m for m, cols in build.MASKED.items() for c in cols for f in frames for kind in ("sum", "per90")}
