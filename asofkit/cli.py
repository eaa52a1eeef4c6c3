"""Command line: stage raw captures, build tables, features and reports.

A data folder holds raw/<source>/<endpoint>/<season>, staged/<table>, crosswalks, facts/<table> and reports. A missing input is a normal state
for facts and features (exit 0 with a message); ``dataset`` and what builds on it need theirs.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections import Counter
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions import scoring
from asofkit.functions.text import folded, match_date
from asofkit.operators import evaluate, explore, gates, identity, models, pit
from asofkit.plans import build, raw_tables, staging
from asofkit.session import session
from asofkit.sources import captures, contracts, files
from asofkit.sources.fetch import FAILURE, GATE_FAILED, SUCCESS, USAGE, Fetcher, FetchError, game_endpoints, open_event, rating_endpoint
from asofkit.sources.writers import section, write_crosswalk, write_partitions, write_table

VERSION = "0.1.0"
#: Cohorts of which squads are captured, and the first event at which each can be; the best have no ranking before one event is scored.
COHORTS = {"self": 1, "mini": 1, "elite": 2}
#: The league that holds everyone (a fixed value).
OVERALL = 314


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def stage(spark: SparkSession, root: str, season: str, sources: list[str]) -> int:
    """All tables that the captures of a season give; what isn't there yet is said and left out."""
    for name in sources or raw_tables.SOURCES:
        for line in raw_tables.SOURCES[name](spark, root, season):
            print(line)
    return SUCCESS


NAMED = {"ratings": ["club"], "matches_and_odds": ["home_team", "away_team"], "scheduled_fixtures": ["home_team", "away_team"]}


def crosswalk(spark: SparkSession, root: str, action: str) -> int:
    """``refresh`` drafts clubs' names in other sources and players' codes; ``validate`` lists what isn't mapped.

    A filled cell is never changed, and unmapped names make the exit code 13.
    """
    teams, path = _read(spark, f"{root}/staged/teams"), f"{root}/crosswalks/team_names"
    tables = {n: (t, c) for n, c in NAMED.items() if (t := _read(spark, f"{root}/staged/{n}")) is not None}
    if teams is None or not tables:
        print("no teams or no other source is staged")
        return SUCCESS
    names = identity.collect_names(tables)
    known = _team_names(spark, root)
    if action == "refresh":
        latest = identity.team_crosswalk(teams).groupBy("team_code").agg(F.max_by("team_name", "season").alias("team_name"))
        out = identity.draft_external_names(latest, names, list(NAMED))
        if known is not None:
            out = identity.refresh_external_names(known, out, list(NAMED))
        rows = out.orderBy("team_code").collect()  # one row a club; read before its file is replaced
        write_crosswalk(spark.createDataFrame(rows, out.schema), path, ["team_code"])
        listed = _read(spark, f"{root}/staged/players")
        if listed is not None:
            name = F.concat_ws(" ", "first_name", "second_name")
            players = identity.canonical(listed.select("code", "season", folded(name).alias("name")), "code", "name", "season")
            write_crosswalk(players, f"{root}/crosswalks/players", ["code"])
            for r in identity.odd_variants(players, "name_variants").orderBy("code").collect():
                print(f"player {r['code']} had names without a word in common: {r['name_variants']}")
        return SUCCESS
    if known is None:
        print("no crosswalk of club names", file=sys.stderr)
        return FAILURE
    lost = 0
    for source in tables:
        for r in identity.unmapped_names(names.where(F.col("source") == source), known, "name", source).orderBy("name").collect():
            print(f"{source}: {r['name']} belongs to no club")
            lost += 1
    return GATE_FAILED if lost else SUCCESS


def _team_names(spark: SparkSession, root: str) -> DataFrame | None:
    """The crosswalk of club names with arrays of aliases; None if there is none."""
    head = "team_code long, team_name string, " + ", ".join(f"{n} string" for n in NAMED)
    if "team_names" not in files.names(spark, f"{root}/crosswalks"):
        return None
    df = spark.read.schema(head).csv(f"{root}/crosswalks/team_names", header=True)
    return df.select("team_code", "team_name", *[F.filter(F.split(F.coalesce(n, F.lit("")), r";\s*"), lambda x: x != "").alias(n) for n in NAMED])


def _calendar(spark: SparkSession, root: str, stats: DataFrame, teams: DataFrame) -> DataFrame:
    """Team facts of all seasons with teams: staged fixtures, or those that the statistics imply."""
    wanted = ("season", "fixture_id", "team_h", "team_a", "kickoff_time")
    time = lambda df: df.withColumn("kickoff_time", F.try_to_timestamp(F.col("kickoff_time").cast("string"))).select(*wanted)
    fixtures, staged = time(build.fixtures_from_stats(stats)), _read(spark, f"{root}/staged/fixtures")
    if staged is not None:
        fixtures = time(staged).unionByName(fixtures.join(staged.select("season").distinct(), "season", "left_anti"))
    code = teams.select("season", "team_id", F.col("code").alias("_code"))
    for side in ("team_h", "team_a"):
        fixtures = fixtures.join(code.withColumnsRenamed({"team_id": side, "_code": f"{side}_code"}), ["season", side])
    fixtures = fixtures.select("season", "fixture_id", F.col("team_h_code").alias("team_h"), F.col("team_a_code").alias("team_a"), "kickoff_time")
    names = _team_names(spark, root)

    def of(table: str, schema: str, make) -> DataFrame:
        df = _read(spark, f"{root}/staged/{table}")
        if df is None or names is None:
            return spark.createDataFrame([], schema)
        return make(df, names.select("team_code", F.explode(table).alias("_name")))

    def teamed(df: DataFrame, alias: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(alias.withColumnsRenamed({"_name": column, "team_code": out}), column)

    ratings = of("ratings", "team long, as_of_date date, elo double", lambda d, a: teamed(d, a, "club", "team").select("team", "as_of_date", "elo"))
    odds = of(
        "matches_and_odds", "season string, home long, away long, match_date date, odds_h double, odds_d double, odds_a double",
        lambda d, a: teamed(teamed(d, a, "home_team", "home"), a, "away_team", "away").select(
            "season", "home", "away", match_date(F.col("match_date")).alias("match_date"), F.col("bet365_home_odds").alias("odds_h"), F.col("bet365_draw_odds").alias("odds_d"), F.col("bet365_away_odds").alias("odds_a")
        ),
    )
    others = of(
        "scheduled_fixtures", "team long, date date",
        lambda d, a: teamed(d, a, "home_team", "team").select("team", F.col("match_date").alias("date")).unionByName(teamed(d, a, "away_team", "team").select("team", F.col("match_date").alias("date"))),
    )
    found = build.team_facts(fixtures, ratings, odds, others).withColumnsRenamed({"team_id": "_team", "opponent_team_id": "_opponent"})
    back = lambda df, column, out: df.join(code.withColumnsRenamed({"_code": column, "team_id": out}), ["season", column])
    return back(back(found, "_team", "team_id"), "_opponent", "opponent_team_id").select(*build.TEAM_KEY, "opponent_team_id", "was_home", *build.CONTEXT)


def facts(spark: SparkSession, root: str, rules: str) -> int:
    """Player facts, the teams' calendar with its context, and points."""
    stats, teams = _read(spark, f"{root}/staged/player_fixture_stats"), _read(spark, f"{root}/staged/teams")
    if stats is None:
        print("no player statistics are staged")
        return SUCCESS
    player = build.checked_unique(build.player_facts(stats, teams), build.PLAYER_KEY)
    write_partitions(player, f"{root}/facts/player_fixture", ["season"], build.PLAYER_KEY)
    if teams is None:
        print("no teams are staged, so there is no calendar of teams")
    else:
        calendar = build.checked_unique(_calendar(spark, root, stats, teams), build.TEAM_KEY)
        write_partitions(calendar, f"{root}/facts/team_fixture", ["season"], build.TEAM_KEY)
    player = spark.read.parquet(f"{root}/facts/player_fixture")
    scored = build.points(player, rules).withColumn("rules", F.lit(rules))
    write_partitions(scored, f"{root}/facts/points", ["rules", "season"], build.PLAYER_KEY)
    return SUCCESS


#: First and last day of a season's fixtures, as text that orders like the days.
def _window(df: DataFrame) -> DataFrame:
    start = F.substring("season", 1, 4).cast("int")
    return df.withColumns({"_from": F.make_timestamp(start, F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), "_to": F.make_timestamp(start + 1, F.lit(8), F.lit(31), F.lit(0), F.lit(0), F.lit(0))})


def gate_sets() -> dict[str, list[gates.Gate]]:
    """The gates of every fact table."""
    known = F.when(F.col("position") != "GK", F.col("cbi") + F.col("tackles") + F.when(F.col("position") == "DEF", 0).otherwise(F.col("recoveries")))  # keepers have no such points
    return {
        "player_fixture": [
            gates.unique_key(*build.PLAYER_KEY), gates.not_null("season", "fixture_id", "player_id"), gates.not_null("team_id"), gates.in_range("minutes", 0, 120), gates.different("team_id", "opponent_team_id"),
            gates.enum_values("position", ["GK", "DEF", "MID", "FWD"]), gates.within("kickoff_time", "_from", "_to"),
            gates.formula("contribution is the sum of its parts", "defensive_contribution", known, ("cbi", "tackles", "recoveries", "position")),
            *[gates.non_negative(c) for c in build.CORE], *[gates.constant_within(m, "season") for m in (*build.MASKED, "obs_starts")],
            gates.exactly_distinct("opponent_team_id", 2, "season", "fixture_id"),
        ],
        "team_fixture": [
            gates.unique_key(*build.TEAM_KEY), gates.not_null(*build.TEAM_KEY), gates.different("team_id", "opponent_team_id"),
            *[gates.in_range(f"odds_{o}_prob", 0, 1) for o in ("win", "draw", "loss")], *[gates.non_negative(f"fixture_count_prior_{n}_days") for n in build.DAYS],
        ],
        "points": [gates.unique_key("rules", *build.PLAYER_KEY), gates.not_null("total_points"), gates.implies_zero("minutes", "total_points")],
    }


def staged_gate_sets() -> dict[str, list[gates.Gate]]:
    """The gates of the staged tables; a season is part of each key, as all seasons lie in one table."""
    key = lambda *c: gates.unique_key("season", *c)
    return {
        "players": [key("player_id"), gates.enum_values("element_type", [1, 2, 3, 4]), gates.non_negative("now_cost"), gates.non_negative("minutes")],
        "teams": [key("team_id")],
        "events": [key("event")],
        "fixtures": [key("fixture_id"), gates.in_range("minutes", 0, 120)],
        "price_snapshots": [key("player_id", "as_of_ts")],
        "availability_snapshots": [key("player_id", "as_of_ts")],
        "entry_snapshots": [key("entry_id", "as_of_ts")],
        "player_fixture_stats": [key("player_id", "fixture_id"), gates.in_range("minutes", 0, 120), gates.non_negative("goals_scored")],
        "ratings": [key("as_of_date", "club"), gates.within("as_of_date", "valid_from", "valid_to")],
    }


def _print(table: str, found: list[gates.Violation]) -> bool:
    for v in found:
        print(f"{table}: {v.severity} {v.gate}: {v.rows} rows {v.detail} {v.sample}")
    return any(v.severity == "block" for v in found)


def check(spark: SparkSession, root: str, layer: str | None = None) -> int:
    """All gates of all tables of a layer (both, if none is named) and their references; a blocking violation is exit code 13."""
    failed = False
    if layer in (None, "staged"):
        for table, set_ in staged_gate_sets().items():
            failed |= _print(table, gates.run_gates(_read(spark, f"{root}/staged/{table}"), set_))
    if layer in (None, "facts"):
        failed |= _check_facts(spark, root)
    return GATE_FAILED if failed else SUCCESS


def _check_facts(spark: SparkSession, root: str) -> bool:
    tables = {t: _read(spark, f"{root}/facts/{t}") for t in gate_sets()}
    player, points = tables["player_fixture"], tables["points"]
    if player is not None and points is not None:
        tables["points"] = points.join(player.select(*build.PLAYER_KEY, "minutes"), list(build.PLAYER_KEY), "left")
    tables["player_fixture"] = None if player is None else _window(player)
    failed = False
    for table, set_ in gate_sets().items():
        failed |= _print(table, gates.run_gates(tables[table], set_))
    teams = _read(spark, f"{root}/staged/teams")
    if player is not None and teams is not None:
        key = lambda t: F.concat_ws("/", "season", F.col(t).cast("string"))
        lost = gates.orphans(player.withColumn("_team", F.when(F.col("team_id").isNotNull(), key("team_id"))), teams.withColumn("_key", key("team_id")), "_team", "_key").count()
        if lost:
            print(f"player_fixture: block team_id is a team of the season: {lost} rows")
            failed = True
    return failed


def _matrix(spark: SparkSession, root: str) -> DataFrame:
    player, team = _read(spark, f"{root}/facts/player_fixture"), _read(spark, f"{root}/facts/team_fixture")
    if player is None or team is None:
        raise FileNotFoundError(f"{root}/facts: player_fixture and team_fixture are needed")
    return build.training_matrix(player, team)


def dataset(spark: SparkSession, root: str) -> int:
    write_partitions(_matrix(spark, root), f"{root}/training", ["season"], ("event", "player_id", "fixture_id"))
    return SUCCESS


def features(spark: SparkSession, root: str, as_of: str, events: int, season: str | None) -> int:
    """The features of all registered players for their fixtures ahead, written to features/as_of=..."""
    need = {n: _read(spark, f"{root}/{n}") for n in ("staged/fixtures", "staged/players", "facts/player_fixture", "facts/team_fixture")}
    if lost := [n for n, df in need.items() if df is None]:
        print(f"not there yet: {', '.join(lost)}")
        return SUCCESS
    fixtures, listed, player, team = need.values()
    season = season or fixtures.agg(F.max("season")).first()[0]
    fixtures = fixtures.withColumn("kickoff_time", F.try_to_timestamp("kickoff_time"))
    known = player.where("kickoff_time is not null and event is not null")
    registered = listed.select("season", "player_id", F.col("code").cast("string").alias("player_code"), staging.position_of(F.col("element_type")).alias("position"), "team_id", F.lit("1970-01-01").cast("timestamp").alias("as_of_ts"))
    out = staging.features_as_of(known, fixtures, registered, team, as_of, events, season)
    name = re.sub(r"[^0-9A-Za-z]+", "-", as_of)
    write_table(out, f"{root}/features/as_of={name}", ["event", "fixture_id", "player_id"])
    print(f"{spark.read.parquet(f'{root}/features/as_of={name}').count()} rows of features")
    return SUCCESS


CURATED = ("minutes_sum_last_5", "goals_scored_sum_last_5", "assists_sum_last_5", "saves_sum_last_5", "minutes_sum_to_date", "goals_scored_sum_to_date", "elo_rating", "opponent_elo_rating", "odds_win_prob", "odds_loss_prob")


def eda(spark: SparkSession, root: str) -> int:
    """Every exploratory report of the training split as one Markdown document, also written to reports/eda.md."""
    df = spark.read.parquet(f"{root}/training").where(evaluate.split_of(F.col("season").substr(1, 4).cast("int")) == "train")
    kinds = explore.classify(df, identity=("season", "event", "fixture_id", "player_id", "player_code", "position", "team_code", "opponent_team_code"))
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    labels = [c for c, k in kinds.items() if k == "label"]
    some = models.usable(df, numeric)
    target = "label_total_points"
    kind = spark.createDataFrame(sorted(Counter(kinds.values()).items()), "kind string, columns long")
    pairs = explore.pearson_matrix(df, some)
    ranks = explore.spearman_matrix(df.select(*some), some)
    curated = [c for c in CURATED if c in some]
    shape = explore.shape(df, numeric)
    reports = [
        ("Columns", kind),
        ("Missing", explore.missing(df, numeric).orderBy(F.desc("share"), "column")),
        *[(f"Missing where {m} holds", explore.missing(df, cs, m).orderBy("column")) for m in build.MASKED if (cs := [c for c, of in staging.masked_features().items() if of == m and c in df.columns])],
        ("Missing by season", explore.missing_by(df, numeric, "season").where("nulls > 0").orderBy(F.desc("share"), "column", "season")),
        ("Cardinality", explore.cardinality(df, df.columns).orderBy(F.desc("n_unique"), "column")),
        ("Shape", shape),
        ("Near-zero variance", shape.where("near_zero").select("column", "variance")),
        ("Outliers", explore.outliers(df, some)),
        ("High Pearson pairs", explore.high_pairs(pairs)),
        ("High Spearman pairs", explore.high_pairs(ranks)),
        ("Variance inflation", explore.variance_inflation(df, curated) if curated else None),
        ("Mutual information with the target", explore.mutual_information(df, some, target).orderBy(F.desc("mi"), "column")),
        ("Correlation with the target", explore.target_correlation(df, some, target).orderBy(F.abs("pearson").desc_nulls_last(), "column")),
        ("Features by band of the target", explore.target_bands(df, curated, scoring.outcome_bucket(F.col(target))).orderBy("column", "band") if curated else None),
        *[(f"Distribution of {c}", explore.histogram(df, c, 10).orderBy("bin")) for c in labels],
        ("Sample", explore.sample(df.select("season", "event", "player_id", *labels), 10)),
    ]
    return _report(root, "eda", reports)


#: Rows of a report's section at most; the section says how many there are.
TOP = 500


def _report(root: str, name: str, reports: list) -> int:
    text = "".join(f"## {title}\n\n{section(report, TOP)}\n" for title, report in reports if report is not None)
    print(text)
    out = Path(root) / "reports" / f"{name}.md"
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(text)
    return SUCCESS


#: What each label is called among the components of predicted points.
COMPONENTS = {
    "goals_scored": "goals", "assists": "assists", "goals_conceded": "conceded", "saves": "saves", "penalties_saved": "penalties_saved", "penalties_missed": "penalties_missed",
    "yellow_cards": "yellow_cards", "red_cards": "red_cards", "own_goals": "own_goals", "defensive_contribution": "contribution", "bonus": "bonus",
}


def baseline(spark: SparkSession, root: str, rules: str, components: list[str]) -> int:
    """Naive and fitted baselines by position, on the validation split: errors of minutes and of every component, of points, and their order.

    Minutes are fitted by ridge regression, each component by a Poisson regression on those who
    played; two stages and the rules make points of them.
    """
    df = spark.read.parquet(f"{root}/training").withColumn("start", F.col("season").substr(1, 4).cast("int")).withColumn("split", evaluate.split_of(F.col("start")))
    naive = pit.trailing_mean(df, ["season", "player_code"], "event", ["fixture_id"], "label_total_points").where("split = 'validation'")
    train, valid = df.where("split = 'train'"), df.where("split = 'validation'")
    usable = models.usable(train, [c for c in build.feature_names() if c in df.columns], [c for c in build.feature_names() if "_masked_" in c])
    positions = [r[0] for r in train.where("position is not null").select("position").distinct().orderBy("position").collect()]  # four
    of = lambda p: train.where(F.col("position") == p)
    made = {"minutes": models.by_segment(df, "position", {p: models.fit_ridge(of(p), usable, "label_minutes") for p in positions})}
    for c in components:
        fitted = {p: models.fit_poisson(of(p).where("label_minutes > 0"), usable, f"label_{c}") for p in positions}
        made[c] = models.two_stage(F.col("p_minutes"), models.by_segment(df, "position", fitted))
    scored = valid.withColumn("p_minutes", made.pop("minutes")).withColumns({f"p_{c}": v for c, v in made.items()})
    reports = [("Naive points", evaluate.bucket_report(naive, "label_total_points", "prediction"))]
    y = lambda c: F.col(f"label_{c}")
    for c in ("minutes", *components):
        reports.append((f"Fitted {c}", scored.groupBy("position").agg(*evaluate.metrics(y(c), F.col(f"p_{c}")), *([evaluate.deviance(y(c), F.col(f"p_{c}"))] if c != "minutes" else [])).orderBy("position")))
    zero = F.lit(0.0)
    row = {"position": F.col("position"), "minutes": F.col("p_minutes")} | {short: F.coalesce(F.col(f"p_{c}"), zero) if c in components else zero for c, short in COMPONENTS.items()}
    total = scored.withColumn("points", scoring.predicted_points(rules, row))
    reports += [
        ("System points", evaluate.bucket_report(total, "label_total_points", "points")),
        ("Order by event", evaluate.rank_correlation(total, ["season", "event"], "label_total_points", "points").orderBy("season", "event")),
    ]
    return _report(root, "baseline", reports)


def _seasons(first: str, last: str) -> list[str]:
    """The seasons of known layout in a range; none is a mistake of the caller's."""
    found = sorted(s for s in contracts.ERAS if first <= s <= last)
    if not found:
        raise ValueError(f"no season of a known layout from {first} to {last}")
    return found


def ingest(root: Path, fetcher: Fetcher, url: str, season: str, endpoints: list[str]) -> int:
    """The routine captures of a season; what hasn't changed isn't stored again."""
    for name, new in captures.ingest(fetcher, root, url, season, endpoints or ("bootstrap", "fixtures")).items():
        print(f"{name}: {'new' if new else 'unchanged'}")
    return SUCCESS


def discover_league(fetcher: Fetcher, url: str, entry: int) -> int:
    found = captures.private_leagues(fetcher, url, entry)
    for number, name in found:
        print(f"{number}: {name}")
    if not found:
        print(f"entry {entry} is in no private league", file=sys.stderr)
    return SUCCESS if found else FAILURE


def capture_ownership(root: Path, fetcher: Fetcher, a: argparse.Namespace, now: datetime) -> int:
    """The squads of one cohort or all, each for its open event; an unfinished capture is taken up again."""
    events = json.loads(game_endpoints(a.url)["bootstrap"].fetch(fetcher))["events"]
    failed = False
    for cohort in COHORTS if a.cohort == "all" else [a.cohort]:
        event = a.event or open_event(events, now, captures.captured_events(root, a.season, cohort), COHORTS[cohort])
        if event is None:
            print(f"{cohort}: no event is open")
            continue
        league = a.league
        if cohort == "mini" and league is None and a.entry is not None:
            league = next((n for n, _ in captures.private_leagues(fetcher, a.url, a.entry)), None)
        if cohort == "self" and a.entry is None or cohort == "mini" and league is None:
            if a.cohort != "all":
                raise ValueError(f"{cohort} needs --{'entry' if cohort == 'self' else 'league or --entry'}")
            print(f"{cohort}: not configured")
            continue
        if a.dry_run:
            print(f"{cohort}: would capture event {event}")
            continue
        entries = [a.entry] if cohort == "self" else captures.league_entries(fetcher, a.url, league) if cohort == "mini" else captures.league_entries(fetcher, a.url, OVERALL, a.top)
        out = captures.ownership(fetcher, root, a.url, a.season, event, cohort, entries[: a.limit], whole=a.limit is None)
        print(f"{cohort}: event {event}, {out.asked} entries, {out.skipped} there, {out.written} chunks written, failed {list(out.failed)}")
        failed |= not out.complete
    return FAILURE if failed else SUCCESS


def backfill_elo(spark: SparkSession, root: Path, fetcher: Fetcher, a: argparse.Namespace) -> int:
    """The ratings of every day before a match of the seasons, then staged; a run goes on where the last one stopped."""
    facts_of = _read(spark, f"{root}/facts/player_fixture")
    if facts_of is None:
        raise FileNotFoundError("facts/player_fixture isn't built, and says which days need ratings")
    left, failed = a.limit, False
    for season in _seasons(a.first, a.last):
        played = facts_of.where((F.col("season") == season) & F.col("kickoff_time").isNotNull()).select(F.to_date("kickoff_time").alias("d")).distinct()
        dates = captures.rating_dates([r["d"] for r in played.collect()])  # a season's days
        have = captures.captured_dates(root / "raw" / "ratings" / "daily" / season)
        if a.dry_run or not dates:
            print(f"{season}: {len(dates)} days, {len(have & set(dates))} there")
            continue
        out = captures.backfill_ratings(fetcher, root, rating_endpoint(a.url), season, dates, left)
        left = None if left is None else left - out.written - len(out.failed)
        print(f"{season}: {out.written} written, {out.skipped} there, failed {[str(d) for d in out.failed]}")
        failed |= not out.complete
        for line in raw_tables.SOURCES["ratings"](spark, str(root), season):
            print(line)
    return FAILURE if failed else SUCCESS


def backfill(spark: SparkSession, root: Path, fetcher: Fetcher, a: argparse.Namespace) -> int:
    """Past seasons from the archive: fetched, staged, made facts of and checked; the first that fails ends it."""
    for season in _seasons(a.first, a.last):
        if not a.skip_fetch:
            print(f"{season}: {captures.archive(fetcher, root, a.url, season)} new files")
        code = stage(spark, str(root), season, ["archive"]) or facts(spark, str(root), a.rules) or check(spark, str(root))
        if code:
            print(f"{season} isn't sound; stopped here", file=sys.stderr)
            return code
    return SUCCESS


def main(argv: list[str] | None = None, fetcher: Fetcher | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> int:
    p = argparse.ArgumentParser("asofkit")
    p.add_argument("--root", default="data")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("facts").add_argument("--rules", default="2025-26")
    g = sub.add_parser("stage")
    g.add_argument("--season", required=True)
    g.add_argument("--source", action="append", choices=list(raw_tables.SOURCES), default=[])
    sub.add_parser("crosswalk").add_argument("action", choices=("refresh", "validate"))
    b = sub.add_parser("baseline")
    b.add_argument("--rules", default="2025-26")
    b.add_argument("--component", action="append", choices=list(COMPONENTS), default=[])
    f = sub.add_parser("features")
    f.add_argument("--as-of", required=True)
    f.add_argument("--horizon", type=int, default=6)
    f.add_argument("--season")
    sub.add_parser("check").add_argument("--layer", choices=("staged", "facts"))
    for name in ("dataset", "eda"):
        sub.add_parser(name)
    network = {n: sub.add_parser(n) for n in ("ingest", "discover-league", "capture-ownership", "backfill-elo", "backfill")}
    for n, q in network.items():
        q.add_argument("--url", required=n != "backfill", default="", help="where the source answers")
    for n in ("ingest", "capture-ownership"):
        network[n].add_argument("--season", required=True)
    network["ingest"].add_argument("--endpoint", action="append", choices=("bootstrap", "fixtures"), default=[])
    network["discover-league"].add_argument("--entry", type=int, required=True)
    own = network["capture-ownership"]
    own.add_argument("--cohort", choices=(*COHORTS, "all"), default="all")
    for n in ("--event", "--league", "--entry", "--limit"):
        own.add_argument(n, type=int)
    own.add_argument("--top", type=int, default=1000)
    for n in ("backfill-elo", "backfill"):
        network[n].add_argument("--from", dest="first", default=min(contracts.ERAS))
        network[n].add_argument("--to", dest="last", default=max(contracts.ERAS))
    for n in ("capture-ownership", "backfill-elo"):
        network[n].add_argument("--dry-run", action="store_true")
    network["backfill-elo"].add_argument("--limit", type=int)
    network["backfill"].add_argument("--skip-fetch", action="store_true")
    network["backfill"].add_argument("--rules", default="2025-26")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else SUCCESS
    if a.command == "version":
        print(VERSION)
        return SUCCESS
    root = Path(a.root)
    try:
        if a.command in network:
            fetcher = fetcher or Fetcher()
        if a.command == "ingest":
            return ingest(root, fetcher, a.url, a.season, a.endpoint)
        if a.command == "discover-league":
            return discover_league(fetcher, a.url, a.entry)
        if a.command == "capture-ownership":
            return capture_ownership(root, fetcher, a, now())
        spark = session()
        if a.command == "backfill-elo":
            return backfill_elo(spark, root, fetcher, a)
        if a.command == "backfill":
            return backfill(spark, root, fetcher, a)
        if a.command == "facts":
            return facts(spark, a.root, a.rules)
        if a.command == "features":
            return features(spark, a.root, a.as_of, a.horizon, a.season)
        if a.command == "stage":
            return stage(spark, a.root, a.season, a.source)
        if a.command == "crosswalk":
            return crosswalk(spark, a.root, a.action)
        if a.command == "baseline":
            return baseline(spark, a.root, a.rules, a.component or list(COMPONENTS))
        if a.command == "check":
            return check(spark, a.root, a.layer)
        return {"dataset": dataset, "eda": eda}[a.command](spark, a.root)
    except ValueError as e:
        print(e, file=sys.stderr)
        return USAGE
    except FetchError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return FAILURE


if __name__ == "__main__":
    sys.exit(main())
