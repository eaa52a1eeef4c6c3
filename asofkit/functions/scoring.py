"""An itemised rule engine as columns, so that it stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the points rules, by position.
POSITIONS = ("GK", "DEF", "MID", "FWD")
GOAL = {"GK": 6, "DEF": 6, "MID": 5, "FWD": 4}
CLEAN_SHEET = {"GK": 4, "DEF": 4, "MID": 1, "FWD": 0}
FULL_APPEARANCE = 60
DEFENDER_ACTIONS, OTHER_ACTIONS, ACTION_POINTS = 10, 12, 2

TERMS = (
    "appearance", "goals", "assists", "clean_sheet", "goals_conceded", "saves", "penalties_saved",
    "penalties_missed", "yellow_cards", "red_cards", "own_goals", "defensive_contribution", "bonus",
)


@dataclass(frozen=True)
class Rules:
    name: str
    defensive_contribution: bool


RULESETS = {r.name: r for r in (Rules("legacy", False), Rules("2025-26", True), Rules("2026-27", True))}


def ruleset(name: str) -> Rules:
    if name not in RULESETS:
        raise KeyError(f"no rules named {name!r}; there are {sorted(RULESETS)}")
    return RULESETS[name]


def ruleset_of(start_year: Column) -> Column:
    return F.when(start_year < 2025, "legacy").when(start_year == 2025, "2025-26").otherwise("2026-27")


def _by_position(position: Column, points: Mapping[str, int]) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown position: "), F.coalesce(position, F.lit("null")))).cast("int")
    for p in reversed(POSITIONS):
        out = F.when(position == p, points[p]).otherwise(out)
    return out


def terms(rules: str | Column, row: Mapping[str, Column]) -> dict[str, Column]:
    """The thirteen points terms of a row; ``rules`` may be a column of ruleset names.

    Values may be counts or predicted means: floor divisions floor, a clean sheet needs exactly 0
    conceded, and any minutes above 0 earn an appearance. Missing defensive counts are 0.
    """
    position, minutes = row["position"], row["minutes"]
    zero = F.lit(0)
    actions = F.coalesce(row["clearances"], zero) + F.coalesce(row["tackles"], zero)
    wide = actions + F.coalesce(row["recoveries"], zero)
    contribution = (
        F.when((position == "DEF") & (actions >= DEFENDER_ACTIONS), ACTION_POINTS)
        .when(position.isin("MID", "FWD") & (wide >= OTHER_ACTIONS), ACTION_POINTS)
        .otherwise(0)
    )
    if isinstance(rules, str):
        contribution = contribution if ruleset(rules).defensive_contribution else zero
    else:
        contribution = F.when(rules.isin(*[n for n, r in RULESETS.items() if r.defensive_contribution]), contribution).otherwise(0)
    half = lambda c, n: F.floor(c / n)
    return {
        "appearance": F.when(minutes <= 0, 0).when(minutes >= FULL_APPEARANCE, 2).otherwise(1),
        "goals": _by_position(position, GOAL) * row["goals"],
        "assists": 3 * row["assists"],
        "clean_sheet": F.when((minutes >= FULL_APPEARANCE) & (row["conceded"] == 0), _by_position(position, CLEAN_SHEET)).otherwise(0),
        "goals_conceded": F.when(position.isin("GK", "DEF") & (minutes > 0), -half(row["conceded"], 2)).otherwise(0),
        "saves": half(row["saves"], 3),
        "penalties_saved": 5 * row["penalties_saved"],
        "penalties_missed": -2 * row["penalties_missed"],
        "yellow_cards": -row["yellow_cards"],
        "red_cards": -3 * row["red_cards"],
        "own_goals": -2 * row["own_goals"],
        "defensive_contribution": contribution,
        "bonus": row["bonus"],
    }


def outcome_bucket(total: Column) -> Column:
    return F.when(total <= 0, "zeros").when(total <= 3, "blanks").when(total <= 8, "tickers").when(total > 8, "haulers")


BUCKETS = ("zeros", "blanks", "tickers", "haulers")

# Fixed values of the bonus-score formula: weight of each counted action.
BONUS_WEIGHTS = {
    "assists": 9, "saves": 2, "penalties_saved": 7, "key_passes": 1, "big_chances_created": 3, "open_play_crosses": 1, "tackles": 2,
    "dribbles": 1, "winning_goals": 3, "penalties_conceded": -3, "penalties_missed": -6, "yellow_cards": -3, "red_cards": -9,
    "own_goals": -6, "big_chances_missed": -3, "errors_leading_to_goal": -3, "errors_leading_to_goal_attempt": -1, "offside": -1, "fouls": -1,
}
BONUS_GOAL = {"GK": 12, "DEF": 12, "MID": 18, "FWD": 24}
BONUS_PASSING = ((90, 6), (80, 4), (70, 2))
LEAST_PASSES = 30


def bonus_score(row: Mapping[str, Column]) -> Column:
    """The observed part of the bonus score: weighted actions, goals by position, and bands of minutes and passing."""
    position, minutes, conceded = row["position"], row["minutes"], row["conceded"]
    back = position.isin("GK", "DEF")
    accuracy = F.when(row["attempted_passes"] >= LEAST_PASSES, row["completed_passes"] / row["attempted_passes"] * 100)
    passing = F.lit(0)
    for least, points in reversed(BONUS_PASSING):
        passing = F.when(accuracy >= least, points).otherwise(passing)
    total = F.when(minutes >= FULL_APPEARANCE, 6).when(minutes >= 1, 3).otherwise(0) + _by_position(position, BONUS_GOAL) * row["goals"] + passing
    total += F.when(back & (minutes >= FULL_APPEARANCE) & (conceded == 0), 12).otherwise(0) + F.when(back, -4 * conceded).otherwise(0)
    total += F.floor(row["clearances"] / 3) + F.floor(row["recoveries"] / 3)
    for name, weight in BONUS_WEIGHTS.items():
        total += weight * row[name]
    return total


def predicted_points(rules: str | Column, row: Mapping[str, Column]) -> Column:
    """Points of predicted components through the same rules, null if any of them is null.

    Negative minutes count as 0, the predicted defensive contribution stands for all defensive
    actions, and one that no model gives counts as 0. As the rules floor, predictions lose their
    fractions and a positive conceded mean never earns a clean sheet.
    """
    full = dict(row)
    full["minutes"] = F.greatest(F.lit(0.0), F.nanvl(row["minutes"], F.lit(None).cast("double")))
    full["clearances"] = F.coalesce(F.nanvl(row["contribution"], F.lit(None).cast("double")), F.lit(0.0))
    full["tackles"] = full["recoveries"] = F.lit(0.0)
    full.setdefault("bonus", F.lit(0.0))
    items = list(terms(rules, full).values())
    return sum(items[1:], items[0])
