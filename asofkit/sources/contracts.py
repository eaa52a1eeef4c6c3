"""The declared contracts of all staged tables."""

from __future__ import annotations

from asofkit.schema import ColumnSpec, TableSpec


def contract(table: str, key: str, columns: str, encoding: str = "utf-8", drop: str = "") -> TableSpec:
    """A contract from text. A column is ``name[=source]:type[?][@group]``; ``?`` marks an optional one."""
    made = []
    for c in columns.split():
        head, _, group = c.partition("@")
        optional = head.endswith("?")
        names, type_ = head.rstrip("?").split(":")
        name, _, source = names.partition("=")
        made.append(ColumnSpec(name, source or name, type_, not optional, group))
    return TableSpec(table, tuple(made), tuple(key.split()), encoding, frozenset(drop.split()))


# Fixed names of the sources' fields.
_EXPECTED = "expected_goals:double?@expected expected_assists:double?@expected expected_goal_involvements:double?@expected expected_goals_conceded:double?@expected"
_DEFENCE = "clearances_blocks_interceptions:bigint?@defensive tackles:bigint?@defensive recoveries:bigint?@defensive"
_CONTRIBUTION = "defensive_contribution:bigint?@defensive"

PLAYERS = contract(
    "players", "player_id",
    f"""player_id=id:bigint code:bigint team_id=team:bigint element_type:bigint first_name:string second_name:string web_name:string status:string now_cost:bigint
    selected_by_percent:double news:string? chance_of_playing_next_round:bigint? total_points:bigint minutes:bigint goals_scored:bigint assists:bigint clean_sheets:bigint
    goals_conceded:bigint own_goals:bigint penalties_saved:bigint penalties_missed:bigint yellow_cards:bigint red_cards:bigint saves:bigint bonus:bigint bps:bigint
    starts:bigint?@expected {_EXPECTED} {_DEFENCE} {_CONTRIBUTION}""",
    drop="ep_next ep_this form value_form value_season",
)
TEAMS = contract("teams", "team_id", "team_id=id:bigint code:bigint name:string short_name:string strength:bigint?", drop="form")
EVENTS = contract("events", "event", "event=id:bigint name:string deadline_time:string finished:boolean is_current:boolean is_next:boolean is_previous:boolean average_entry_score:bigint?")
FIXTURES = contract(
    "fixtures", "fixture_id",
    "fixture_id=id:bigint code:bigint event:bigint? kickoff_time:string? team_h:bigint team_a:bigint team_h_score:bigint? team_a_score:bigint? finished:boolean minutes:bigint?",
    drop="stats",
)
PRICES = contract("price_snapshots", "player_id", "player_id=id:bigint now_cost:bigint cost_change_event:bigint? selected_by_percent:double transfers_in_event:bigint? transfers_out_event:bigint?")
AVAILABILITY = contract("availability_snapshots", "player_id", "player_id=id:bigint status:string news:string? chance_of_playing_next_round:bigint?")
ENTRIES = contract(
    "entry_snapshots", "entry_id",
    "entry_id=id:bigint summary_overall_points:bigint? summary_overall_rank:bigint? summary_event_points:bigint? last_deadline_bank:bigint? last_deadline_value:bigint? last_deadline_total_transfers:bigint?",
)
PICKS = contract(
    "manager_picks", "event entry_id player_id",
    "entry_id=entry:bigint event:bigint player_id=element:bigint position:bigint? multiplier:bigint? is_captain:boolean? is_vice_captain:boolean?", drop="fetched_at contaminated",
)
RATINGS = contract("ratings", "club", "rank=Rank:bigint club=Club:string country=Country:string level=Level:bigint elo=Elo:double valid_from=From:string valid_to=To:string")
MATCHES = contract(
    "matches_and_odds", "match_date home_team away_team",
    """match_date=Date:string home_team=HomeTeam:string away_team=AwayTeam:string full_time_home_goals=FTHG:bigint full_time_away_goals=FTAG:bigint full_time_result=FTR:string
    bet365_home_odds=B365H:double? bet365_draw_odds=B365D:double? bet365_away_odds=B365A:double?""",
    encoding="utf-8-sig",
)
SCHEDULED = contract(
    "scheduled_fixtures", "competition match_date home_team away_team",
    "match_date:date round:string home_team:string home_country:string away_team:string away_country:string competition:string", drop="file n",
)
CENTRE_PLAYERS = contract(
    "centre_players_season", "player_id",
    """player_id=id:bigint player_name:string team_title:string position:string games:bigint minutes=time:bigint goals:bigint xg=xG:double assists:bigint xa=xA:double shots:bigint
    key_passes:bigint yellow_cards:bigint red_cards:bigint non_penalty_goals=npg:bigint non_penalty_xg=npxG:double xg_chain=xGChain:double xg_buildup=xGBuildup:double""",
)
CENTRE_FIXTURES = contract(
    "centre_fixtures", "match_id",
    "match_id=id:bigint is_result=isResult:boolean datetime:string home_team:string away_team:string home_goals:bigint? away_goals:bigint? home_xg:double? away_xg:double?",
    drop="h a goals xG forecast",
)
CENTRE_ROSTERS = contract(
    "centre_player_match", "match_id player_id",
    """match_id:bigint side:string player_id:bigint player_name=player:string team_id:bigint position:string minutes=time:bigint goals:bigint own_goals:bigint shots:bigint xg=xG:double
    assists:bigint xa=xA:double key_passes:bigint yellow_card:bigint red_card:bigint xg_chain=xGChain:double xg_buildup=xGBuildup:double""",
    drop="id roster_id",
)

# The merged statistics changed over the years; a season that isn't named here must be looked at first.
ERAS = {
    "2016-17": "E1", "2017-18": "E1", "2018-19": "E2", "2019-20": "E3", "2020-21": "E4", "2021-22": "E4", "2022-23": "E5", "2023-24": "E5", "2024-25": "E6", "2025-26": "E7",
}
_CONTEXT = """player_name=name:string player_id=element:bigint fixture_id=fixture:bigint event=GW:bigint round:bigint? kickoff_time:string was_home:boolean opponent_team:bigint minutes:bigint
    team_h_score:bigint? team_a_score:bigint?"""
_STATS = "goals_scored:bigint assists:bigint goals_conceded:bigint own_goals:bigint penalties_saved:bigint penalties_missed:bigint yellow_cards:bigint red_cards:bigint saves:bigint"
_PUBLISHED = "bonus_published=bonus:bigint bps_published=bps:bigint total_points_published=total_points:bigint"
_INPUTS = """attempted_passes:bigint? completed_passes:bigint? key_passes:bigint? big_chances_created:bigint? big_chances_missed:bigint? open_play_crosses:bigint? dribbles:bigint? tackled:bigint?
    fouls:bigint? offside:bigint? target_missed:bigint? errors_leading_to_goal:bigint? errors_leading_to_goal_attempt:bigint? penalties_conceded:bigint? winning_goals:bigint?"""
_LOOKED_UP, _OWN = "position:string? team_id:bigint? player_code:string?", "position:string team:string player_code:string?"
_UNUSED = "value selected transfers_in transfers_out transfers_balance creativity influence threat ict_index clean_sheets"
_EARLY, _MANAGERS = "id ea_index loaned_in loaned_out kickoff_time_formatted", "modified mng_clean_sheets mng_draw mng_goals_scored mng_loss mng_underdog_draw mng_underdog_win mng_win"


def _merged(columns: str, drop: str, encoding: str = "utf-8") -> TableSpec:
    return contract("player_fixture_stats", "player_id fixture_id", f"{_CONTEXT} {columns}", encoding, f"{_UNUSED} {drop}")


_E1 = _merged(f"{_LOOKED_UP} {_STATS} {_PUBLISHED} {_DEFENCE} {_INPUTS}", _EARLY, "cp1252")
_E5 = f"{_OWN} starts:bigint? {_STATS} {_PUBLISHED} {_EXPECTED}"
MERGED = {
    "E1": _E1,
    "E2": _E1,
    "E3": _merged(f"{_LOOKED_UP} {_STATS} {_PUBLISHED}", ""),
    "E4": _merged(f"{_OWN} {_STATS} {_PUBLISHED}", "xP"),
    "E5": _merged(_E5, "xP"),
    "E6": _merged(_E5, f"xP {_MANAGERS}"),
    "E7": _merged(f"{_E5} {_DEFENCE} {_CONTRIBUTION}", f"xP {_MANAGERS}"),
}
#: Eras whose files lack position and team; both come from the season's list of players.
NEED_PLAYERS = ("E1", "E2", "E3")


def merged_for(season: str) -> tuple[str, TableSpec]:
    """The era of a season's merged statistics and its contract; an unknown season raises."""
    if season not in ERAS:
        raise KeyError(f"the layout of season {season} isn't known")
    return ERAS[season], MERGED[ERAS[season]]
