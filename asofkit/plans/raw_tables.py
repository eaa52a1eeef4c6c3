"""From raw captures to staged tables: one function a source, each table under staged/<table>/season=..."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.schema import StageReport, TableSpec, stage
from asofkit.sources import contracts as C
from asofkit.sources import files, schedule
from asofkit.sources.writers import write_partitions

from . import staging

Lines = list["Staged"]


@dataclass(frozen=True)
class Staged:
    table: str
    rows: int | None  # None: nothing to stage
    note: str = ""

    def __str__(self) -> str:
        return f"{self.table}: {'nothing staged' if self.rows is None else f'{self.rows} rows'}{'; ' if self.note else ''}{self.note}"


def objects(bodies: DataFrame, path: str = "$") -> DataFrame:
    """The JSON objects of a list within each body, one row each, a text column for each key that occurs."""
    made = F.explode(F.from_json(F.get_json_object(F.col("body").cast("string"), path), "array<map<string,string>>")).alias("_o")
    kept = [c for c in bodies.columns if c != "body"]
    rows = bodies.select(*kept, made)
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys("_o"))).distinct().collect())  # the source's field names
    return rows.select(*kept, *[F.col("_o")[k].alias(k) for k in keys if k not in kept])


def _captures(spark: SparkSession, base: str) -> DataFrame:
    """as_of and body of every capture under a folder, checked."""
    return files.read_raw(spark, base).select(F.regexp_extract("path", "as_of=([^/]+)", 1).alias("as_of"), F.col("body"), F.col("meta.params").alias("params"))


def _note(report: StageReport) -> str:
    parts = [f"unknown columns {list(report.unknown)}" if report.unknown else "", f"absent columns {list(report.absent)}" if report.absent else ""]
    return "; ".join(p for p in parts if p)


def _put(root: str, df: DataFrame, spec: TableSpec, note: str = "", more: Sequence[str] = ()) -> Staged:
    key = [*more, *spec.key]
    df = df.persist()  # it is counted and written
    rows = df.count()
    if rows:
        write_partitions(df, f"{root}/staged/{spec.table}", ["season"], key)
    df.unpersist()
    return Staged(spec.table, rows, note)


def _latest(spark: SparkSession, root: str, source: str, endpoint: str, season: str) -> str | None:
    return files.latest_partition(spark, f"{root}/raw/{source}/{endpoint}/{season}")


def game(spark: SparkSession, root: str, season: str) -> Lines:
    """Players, teams, events and fixtures of the latest captures, snapshots of all, entries and picks."""
    out: Lines = []
    latest = _latest(spark, root, "game", "bootstrap", season)
    if latest is None:
        out.append(Staged("players", None, "no bootstrap capture"))
    else:
        body = _captures(spark, latest).select("body")
        for spec, path in ((C.PLAYERS, "$.elements"), (C.TEAMS, "$.teams"), (C.EVENTS, "$.events")):
            df, report = stage(objects(body, path), spec, season=season)
            out.append(_put(root, df, spec, _note(report)))
        every = _captures(spark, f"{root}/raw/game/bootstrap/{season}").select("as_of", "body")
        for spec in (C.PRICES, C.AVAILABILITY):
            raw = objects(every, "$.elements")
            df, _ = stage(raw, TableSpecWith(spec, "as_of"), season=season)
            out.append(_put(root, df.withColumn("as_of_ts", files.as_of_time("as_of")).drop("as_of"), spec, more=["as_of_ts"]))
    latest = _latest(spark, root, "game", "fixtures", season)
    if latest is None:
        out.append(Staged("fixtures", None, "no fixtures capture"))
    else:
        df, report = stage(objects(_captures(spark, latest).select("body")), C.FIXTURES, season=season)
        out.append(_put(root, df, C.FIXTURES, _note(report)))
    base = f"{root}/raw/game/entry/{season}"
    if files.as_of_partitions(spark, base):
        one = _captures(spark, base).select("as_of", F.concat(F.lit("["), F.col("body").cast("string"), F.lit("]")).alias("body"))
        df, _ = stage(objects(one), TableSpecWith(C.ENTRIES, "as_of"), season=season)
        out.append(_put(root, df.withColumn("as_of_ts", files.as_of_time("as_of")).drop("as_of"), C.ENTRIES, more=["as_of_ts"]))
    return out + picks(spark, root, season)


def TableSpecWith(spec: TableSpec, extra: str) -> TableSpec:  # noqa: N802
    """The contract with one text column more in front, which isn't the source's."""
    from asofkit.schema import ColumnSpec

    return TableSpec(spec.table, (ColumnSpec(extra, extra, "string"), *spec.columns), spec.key, spec.encoding, spec.drop)


RECORD = """entry long, event long, fetched_at string, contaminated boolean,
 payload struct<picks:array<struct<element:long,position:long,multiplier:long,is_captain:boolean,is_vice_captain:boolean>>>"""


def picks(spark: SparkSession, root: str, season: str) -> Lines:
    """The picks of all cohorts' chunks; whether a squad was captured too late goes on each of its rows."""
    base, found = f"{root}/raw/game/picks/{season}", []
    for cohort in files.names(spark, base):
        for event in files.names(spark, f"{base}/{cohort}"):
            if files.chunk_ids(spark, f"{base}/{cohort}/{event}"):
                rows = files.picks(files.read_chunks(spark, f"{base}/{cohort}/{event}", RECORD))
                df, _ = stage(rows, C.PICKS, season=season, cohort=cohort)
                late = rows.select("entry", "event", F.col("element").alias("_e"), "contaminated")
                on = (df["entry_id"] == late["entry"]) & (df["event"] == late["event"]) & (df["player_id"] == late["_e"])
                found.append(df.join(late, on, "left").select(*[df[c] for c in df.columns], "contaminated"))
    if not found:
        return []
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return [_put(root, whole, C.PICKS, more=["cohort"])]


def archive(spark: SparkSession, root: str, season: str) -> Lines:
    """The merged statistics of a season, with the stable codes, and where they lack positions and teams, from its list of players."""
    latest = _latest(spark, root, "archive", "merged", season)
    if latest is None:
        return [Staged("player_fixture_stats", None, "no merged statistics")]
    era, spec = C.merged_for(season)
    raw = files.read_csv(spark, f"{latest}/data.csv.gz", spec.encoding)
    listed = _latest(spark, root, "archive", "players", season)
    if listed is None and era in C.NEED_PLAYERS:
        return [Staged(spec.table, None, "its layout needs the list of players")]
    players = None if listed is None else files.read_csv(spark, f"{listed}/data.csv.gz", spec.encoding)
    kept, dropped = staging.stage_merged(raw, players)
    df, report = stage(kept, spec, season=season)
    note = f"left out {dropped.managers} managers, {dropped.duplicates} copies, {dropped.postponed} postponed; {_note(report)}"
    return [_put(root, df, spec, note)]


def ratings(spark: SparkSession, root: str, season: str) -> Lines:
    """Every capture of ratings, each with the date that it was asked for."""
    base = f"{root}/raw/ratings/daily/{season}"
    if not files.as_of_partitions(spark, base):
        return [Staged(C.RATINGS.table, None, "no ratings capture")]
    asked = _captures(spark, base).select("as_of", F.col("params")["date"].alias("date")).select("as_of", files.rating_date("date", "as_of").alias("as_of_date"))
    raw = spark.read.csv(f"{base}/as_of=*/data.csv.gz", header=True).withColumn("as_of", F.regexp_extract(F.col("_metadata.file_path"), "as_of=([^/]+)", 1))
    df, report = stage(raw, TableSpecWith(C.RATINGS, "as_of"), season=season)
    return [_put(root, df.join(asked, "as_of").drop("as_of"), C.RATINGS, _note(report), ["as_of_date"])]


def matches(spark: SparkSession, root: str, season: str) -> Lines:
    latest = _latest(spark, root, "matches", "results", season)
    if latest is None:
        return [Staged(C.MATCHES.table, None, "no results capture")]
    df, report = stage(files.read_csv(spark, f"{latest}/data.csv.gz", C.MATCHES.encoding), C.MATCHES, season=season)
    return [_put(root, df, C.MATCHES, _note(report))]


def schedules(spark: SparkSession, root: str, season: str) -> Lines:
    """The latest schedule of every competition."""
    base, found = f"{root}/raw/schedules", None
    for competition in files.names(spark, base):
        latest = _latest(spark, root, "schedules", competition, season)
        if latest is not None:
            parsed = schedule.parse(schedule.read_lines(spark, f"{latest}/data.txt.gz")).withColumn("competition", F.lit(competition))
            found = parsed if found is None else found.unionByName(parsed)
    if found is None:
        return [Staged(C.SCHEDULED.table, None, "no schedules")]
    return [_put(root, stage(found, C.SCHEDULED, season=season)[0], C.SCHEDULED)]


def centre(spark: SparkSession, root: str, season: str) -> Lines:
    """The match centre's season table, its fixtures, and the rosters of all captured matches."""
    latest = _latest(spark, root, "centre", "league", season)
    out: Lines = []
    if latest is None:
        out.append(Staged(C.CENTRE_PLAYERS.table, None, "no league capture"))
    else:
        body = _captures(spark, latest).select("body")
        df, report = stage(objects(body, "$.players"), C.CENTRE_PLAYERS, season=season)
        out.append(_put(root, df, C.CENTRE_PLAYERS, _note(report)))
        dates = objects(body, "$.dates")
        inner = {"home_team": ("h", "$.title"), "away_team": ("a", "$.title"), "home_goals": ("goals", "$.h"), "away_goals": ("goals", "$.a"), "home_xg": ("xG", "$.h"), "away_xg": ("xG", "$.a")}
        flat = dates.withColumns({n: F.get_json_object(c, p) for n, (c, p) in inner.items() if c in dates.columns})
        df, report = stage(flat, C.CENTRE_FIXTURES, season=season)
        out.append(_put(root, df, C.CENTRE_FIXTURES, _note(report)))
    base = f"{root}/raw/centre/match/{season}"
    if files.chunk_ids(spark, base):
        records = files.read_chunks(spark, base, "match_id long, rosters map<string,map<string,map<string,string>>>")
        players = records.select("match_id", F.explode("rosters").alias("side", "_p")).select("match_id", "side", F.explode("_p").alias("roster_id", "_o"))
        keys = sorted(r[0] for r in players.select(F.explode(F.map_keys("_o"))).distinct().collect())
        flat = players.select("match_id", "side", "roster_id", *[F.col("_o")[k].alias(k) for k in keys])
        df, report = stage(flat, C.CENTRE_ROSTERS, season=season)
        out.append(_put(root, df, C.CENTRE_ROSTERS, _note(report)))
    return out


SOURCES = {"game": game, "archive": archive, "ratings": ratings, "matches": matches, "schedules": schedules, "centre": centre}
