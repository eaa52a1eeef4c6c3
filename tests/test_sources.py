"""Sources, sinks, the schedule parser, snapshots and the command line."""

import gzip
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import types as T

from asofkit import cli
from asofkit.sources import captures, contracts, fetch, files, schedule, writers
from asofkit.streaming import snapshots


def test_as_of_names():
    t = datetime(2025, 8, 16, 14, 0, 1, tzinfo=UTC)
    assert files.decode_as_of(files.encode_as_of(t)) == t and files.encode_as_of(t) == "2025-08-16T14-00-01Z"
    with pytest.raises(ValueError):
        files.encode_as_of(datetime(2025, 1, 1))


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n\nSané,1\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("﻿name,n\nSané,1\n".encode())
    assert files.read_csv(spark, str(tmp_path / "a.csv"), "cp1252").first()["name"] == "Sané"
    assert files.read_csv(spark, str(tmp_path / "b.csv"), "utf-8-sig").first()["name"] == "Sané"
    assert files.read_crosswalk(spark, str(tmp_path / "none.csv"), "a int").count() == 0


def test_json(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"elements": [{"id": 1}, {"id": 2}], "teams": [{"id": 7}]}))
    got = files.json_lists(spark, str(tmp_path / "d.json"), ("elements", "teams", "events"))
    assert got["elements"].count() == 2 and set(got) == {"elements", "teams"}


def test_raw_round_trip_and_chunks(spark, tmp_path):
    base = tmp_path / "raw"
    assert writers.write_raw(base, "2025-01-01T00-00-00Z", b'{"a":1}', {"source": "s"}) is not None
    assert writers.write_raw(base, "2025-01-02T00-00-00Z", b'{"a":1}', {"source": "s"}) is None
    last = writers.write_raw(base, "2025-01-03T00-00-00Z", b'{"a":2}', {"source": "s"})
    assert files.latest_partition(spark, str(base)).endswith("as_of=2025-01-03T00-00-00Z")
    assert sorted(bytes(r["body"]) for r in files.read_raw(spark, str(base)).collect()) == [b'{"a":1}', b'{"a":2}']
    (last / "data.json.gz").write_bytes(gzip.compress(b"other"))
    with pytest.raises(Exception, match="digest differs"):
        files.read_raw(spark, str(base)).collect()
    chunks = tmp_path / "chunks"
    record = {"entry": 1, "event": 2, "fetched_at": "x", "contaminated": True, "payload": {"picks": [{"element": 5, "position": 1}, {"element": 6, "position": 2}]}}
    assert writers.write_chunk(chunks, 0, [record]) and not writers.write_chunk(chunks, 0, [record])
    got = files.read_chunks(spark, str(chunks), "entry long, event long, fetched_at string, contaminated boolean, payload struct<picks:array<struct<element:long,position:long>>>")
    assert [(r["entry"], r["element"], r["contaminated"]) for r in files.picks(got).orderBy("element").collect()] == [(1, 5, True), (1, 6, True)]
    assert files.chunk_ids(spark, str(chunks)) == [0]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", ["x", "y"]), (1, "a", [])], "k int, s string, l array<string>")
    writers.write_table(df, str(tmp_path / "t"), ["k"], single=True)
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1, 2]
    with pytest.raises(KeyError):
        writers.write_table(df, str(tmp_path / "t"), ["z"])
    writers.write_crosswalk(df, str(tmp_path / "c"), ["k"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).where("k = 2").first()["l"] == "x; y"
    writers.write_partitions(df.drop("l"), str(tmp_path / "p"), ["s"], ["k"])
    writers.write_partitions(spark.createDataFrame([(9, "a")], "k int, s string"), str(tmp_path / "p"), ["s"], ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [2, 9]
    assert writers.markdown(spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double")).splitlines()[-1] == "| 1 |  | 0.5000 |"


SCHEDULE = """= Harbour Cup

▪ Round of Six | Pool B
Fri Nov 28 2025
  9:05 North Pier (FJI) v Lake-on-Sea 2 (TUV)
  Old Mill (KIR)  v  Salt Works (NRU)  2-2 (1-0)
▪ Last Two
Sat Feb 7
 20:30  Lake-on-Sea 2 (TUV)   v   Old Mill (KIR)    1-0 a.e.t.
 no match (x) v here
"""


def test_schedule(spark, tmp_path):
    (tmp_path / "s.txt").write_text(SCHEDULE)
    got = [tuple(r)[2:] for r in schedule.parse(schedule.read_lines(spark, str(tmp_path / "s.txt"))).orderBy("n").collect()]
    assert [(str(d), *rest) for d, *rest in got] == [
        ("2025-11-28", "Round of Six | Pool B", "North Pier", "FJI", "Lake-on-Sea 2", "TUV"),
        ("2025-11-28", "Round of Six | Pool B", "Old Mill", "KIR", "Salt Works", "NRU"),
        ("2026-02-07", "Last Two", "Lake-on-Sea 2", "TUV", "Old Mill", "KIR"),
    ]


@pytest.mark.parametrize(("text", "error"), [("▪ R\n 9:05 A (FJI) v B (TUV)\n", "without a day"), ("Fri Nov 28 2025\n A (FJI) v B (TUV)\n", "without a round"), ("▪ R\nFri Nov 28\n A (FJI) v B (TUV)\n", "year of this day")])
def test_schedule_errors(spark, tmp_path, text, error):
    (tmp_path / "s.txt").write_text(text)
    with pytest.raises(Exception, match=error):
        schedule.parse(schedule.read_lines(spark, str(tmp_path / "s.txt"))).collect()


def test_fetcher():
    waits, replies = [], [fetch.Response(429, b"", {"Retry-After": "7"}), fetch.Response(503, b""), fetch.Response(200, b'{"elements": []}')]
    f = fetch.Fetcher(spacing=0, send=lambda u, t: replies.pop(0), sleep=waits.append)
    assert fetch.game_endpoints("http://x")["event_live"].fetch(f, event=1) == b'{"elements": []}' and waits[0] == 7 and len(waits) == 2
    with pytest.raises(fetch.BlockedError):
        fetch.Fetcher(spacing=0, send=lambda u, t: fetch.Response(403, b"")).get("u")
    with pytest.raises(fetch.ShapeError):
        fetch.game_endpoints("http://x")["fixtures"].fetch(fetch.Fetcher(spacing=0, send=lambda u, t: fetch.Response(200, b"{}")))
    events = [{"id": 1, "deadline_time": "2025-01-01T00:00:00Z", "finished": True}, {"id": 2, "deadline_time": "2025-01-08T00:00:00Z"}, {"id": 3, "deadline_time": "2025-02-01T00:00:00Z"}]
    assert fetch.open_event(events, datetime(2025, 1, 9, tzinfo=UTC), set()) == 2 and fetch.open_event(events, datetime(2025, 1, 9, tzinfo=UTC), {2}) is None


def test_snapshot_stream(spark, tmp_path):
    for day, price in (("2025-01-01T00-00-00Z", 50), ("2025-01-02T00-00-00Z", 55)):
        d = tmp_path / "in" / f"as_of={day}"
        d.mkdir(parents=True)
        (d / "a.json").write_text(json.dumps({"player_id": 1, "price": price}) + "\n")
        (d / "b.json").write_text(json.dumps({"player_id": 1, "price": price}) + "\n")
    schema = T.StructType([T.StructField("player_id", T.LongType()), T.StructField("price", T.LongType())])
    s = snapshots.captures(spark, str(tmp_path / "in"), schema)
    snapshots.write_snapshots(s, str(tmp_path / "out"), str(tmp_path / "ck"), ["player_id"]).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2
    assert snapshots.as_of(out, ["player_id"], "as_of_ts", "2025-01-01 12:00:00").first()["price"] == 50


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0 and cli.main(["ingest"]) == 2 and cli.main(["nonsense"]) == 2
    assert cli.main(["--root", str(tmp_path), "facts"]) == 0 and cli.main(["--root", str(tmp_path), "check"]) == 0
    assert cli.main(["--root", str(tmp_path), "dataset"]) == 1


def _replies(table):
    """A fetcher that answers from a table of url endings; an absent one is a server error."""

    def send(url, timeout):
        found = next((v for k, v in table.items() if url.endswith(k)), None)
        return fetch.Response(500, b"") if found is None else fetch.Response(200, found if isinstance(found, bytes) else json.dumps(found).encode())

    return fetch.Fetcher(spacing=0, retries=0, send=send, sleep=lambda s: None)


def test_leagues_are_read_page_by_page():
    page = lambda ids, more: {"standings": {"results": [{"entry": i} for i in ids], "has_next": more}}
    f = _replies({"page_standings=1": page(range(50), True), "page_standings=2": page(range(50, 70), False), "/entry/7/": {"id": 7, "leagues": {"classic": [{"id": 1, "league_type": "x", "name": "us"}, {"id": 2, "league_type": "s"}]}}})
    assert captures.league_entries(f, "http://g", 9) == list(range(70)) and captures.league_entries(f, "http://g", 9, 30) == list(range(30))
    assert captures.private_leagues(f, "http://g", 7) == [(1, "us")]


def test_captures_resume(spark, tmp_path):
    squads = {f"/entry/{i}/event/3/picks/": {"picks": [{"element": i, "position": 1}], "automatic_subs": [1] if i == 2 else []} for i in range(1, 6) if i != 4}
    out = captures.ownership(_replies(squads), tmp_path, "http://g", "2025-26", 3, "elite", range(1, 6), size=2)
    assert (out.asked, out.written, out.failed, out.complete) == (5, 2, (4,), False)
    squads["/entry/4/event/3/picks/"] = {"picks": []}
    again = captures.ownership(_replies(squads), tmp_path, "http://g", "2025-26", 3, "elite", range(1, 6), size=2)
    assert (again.written, again.skipped, again.complete) == (1, 4, True) and captures.captured_events(tmp_path, "2025-26", "elite") == {3}
    match = captures.match_data(_replies({"Data/8": {"rosters": {}}}), tmp_path, fetch.centre_endpoints("http://c")["match"], "2025-26", [8, 8])
    assert match.written == 1


def test_a_broken_sidecar_counts_as_absent(spark, tmp_path):
    first = writers.write_raw(tmp_path / "raw", "2025-01-01T00-00-00Z", b"body", {"source": "s"})
    (first / "meta.json").write_text('{"source": "s", "sha2')
    row = files.read_raw(spark, str(tmp_path / "raw")).first()
    assert bytes(row["body"]) == b"body" and (row["meta"] is None or row["meta"]["sha256"] is None)
    # The latest digest can't be read, so the same body is stored again.
    assert writers.write_raw(tmp_path / "raw", "2025-01-02T00-00-00Z", b"body", {"source": "s"}) is not None
    assert writers.write_raw(tmp_path / "raw", "2025-01-03T00-00-00Z", b"body", {"source": "s"}) is None
    (first / "meta.json").write_text("{}")
    assert files.read_raw(spark, str(tmp_path / "raw")).count() == 2


def test_sections_say_what_they_leave_out(spark):
    df = spark.range(7).toDF("n")
    assert writers.section(df, 3).startswith("The first 3 of 7 rows.") and writers.section(df, 3).count("| ") == 4 and writers.section(df, 9).startswith("7 rows.")


def test_one_failure_costs_no_other_answer(tmp_path):
    asked = []

    def get(i):
        asked.append(i)
        if i == 7:
            raise fetch.ServerError("always")
        if i == 25 and len(asked) < 30:
            raise fetch.BlockedError("403")
        return {"v": i}

    with pytest.raises(fetch.BlockedError):
        captures.in_chunks(tmp_path, range(30), get, size=10)
    assert len(captures._stored(tmp_path, "id")) == 24  # all before the block but 7
    asked.clear()
    asked.extend([None] * 30)
    out = captures.in_chunks(tmp_path, range(30), get, size=10)
    assert (out.written, out.skipped, out.failed) == (1, 24, (7,)) and asked[30:] == [7, *range(25, 30)]
    # A run that ended between a chunk and its line in the log, and a line that was cut off.
    log = tmp_path / captures.LOG
    log.write_text("\n".join(log.read_text().splitlines()[:-1]) + '\n{"chunk": 9, "id')
    asked.clear()
    asked.extend([None] * 30)
    assert captures.in_chunks(tmp_path, range(30), get, size=10).skipped == 29 and asked[30:] == [7]
    chunks = sorted(tmp_path.glob("chunk=*/data.ndjson.gz"))
    assert sorted(json.loads(x)["id"] for c in chunks for x in gzip.decompress(c.read_bytes()).splitlines()) == [i for i in range(30) if i != 7]


def test_network_commands(spark, tmp_path, capsys):
    """Every command that fetches, over recorded replies."""
    now = lambda: datetime(2024, 8, 20, tzinfo=UTC)
    events = [{"id": 1, "deadline_time": "2024-08-16T17:30:00Z"}, {"id": 2, "deadline_time": "2024-08-18T17:30:00Z"}]
    page = lambda ids: {"standings": {"results": [{"entry": i} for i in ids], "has_next": False}}
    squad = {"picks": [{"element": 1, "position": 1}]}
    replies = {
        "bootstrap-static/": {"elements": [], "teams": [], "events": events}, "fixtures/": [],
        "/entry/7/": {"id": 7, "leagues": {"classic": [{"id": 5, "league_type": "x", "name": "us"}]}}, "/entry/8/": {"id": 8, "leagues": {"classic": []}},
        "leagues-classic/5/standings/?page_standings=1": page([7, 9]), "leagues-classic/314/standings/?page_standings=1": page(range(20, 24)),
        **{f"/entry/{i}/event/{e}/picks/": squad for i in (7, 9, *range(20, 24)) for e in (1, 2) if (i, e) != (22, 2)},
    }
    run = lambda *a: cli.main(["--root", str(tmp_path), *a, "--url", "http://g"], _replies(replies), now)
    assert run("ingest", "--season", "2024-25") == 0 and run("ingest", "--season", "2024-25") == 0
    assert capsys.readouterr().out.count("bootstrap: new") == 1
    assert run("discover-league", "--entry", "7") == 0 and "5: us" in capsys.readouterr().out and run("discover-league", "--entry", "8") == 1
    assert run("capture-ownership", "--season", "2024-25", "--cohort", "self") == 2  # no entry
    assert run("capture-ownership", "--season", "2024-25", "--entry", "7", "--dry-run") == 0 and not (tmp_path / "raw/game/picks").exists()
    assert run("capture-ownership", "--season", "2024-25", "--entry", "7") == 1  # 22 has no answer yet
    said = capsys.readouterr().out
    assert "self: event 1, 1 entries" in said and "mini: event 1, 2 entries" in said and "elite: event 2, 4 entries, 0 there, 1 chunks written, failed [22]" in said
    replies["/entry/22/event/2/picks/"] = squad
    assert run("capture-ownership", "--season", "2024-25", "--entry", "7") == 0
    said = capsys.readouterr().out
    assert "self: event 2" in said and "elite: event 2, 4 entries, 3 there, 1 chunks written" in said
    assert run("capture-ownership", "--season", "2024-25", "--cohort", "elite") == 0 and "no event is open" in capsys.readouterr().out
    assert run("capture-ownership", "--season", "2024-25", "--cohort", "elite", "--event", "1", "--limit", "2") == 0 and captures.captured_events(tmp_path, "2024-25", "elite") == {2}
    # Ratings and a past season.
    assert run("backfill-elo", "--from", "2023-24", "--to", "2023-24") == 1  # no facts yet
    assert run("backfill", "--from", "2031-32", "--to", "2031-32") == 2
    columns = [c.source for c in contracts.merged_for("2023-24")[1].columns if c.required]
    row = dict.fromkeys(columns, "1") | {"name": "A", "position": "MID", "team": "x", "kickoff_time": "2023-08-12T15:00:00Z", "was_home": "True"}
    rows = [row | {"element": "1", "opponent_team": "2"}, row | {"element": "2", "opponent_team": "1", "was_home": "False"}]
    lines = lambda rs: ("\n".join([",".join(rs[0]), *(",".join(map(str, r.values())) for r in rs)]) + "\n").encode()
    replies |= {"2023-24/gws/merged_gw.csv": lines(rows), "2023-24/players_raw.csv": lines([{"id": i, "element_type": 3, "team": i, "code": 100 + i} for i in (1, 2)])}
    assert run("backfill", "--from", "2023-24", "--to", "2023-24") == 0, capsys.readouterr()
    assert "2 new files" in capsys.readouterr().out and spark.read.parquet(f"{tmp_path}/facts/player_fixture").count() == 2
    assert run("backfill", "--from", "2023-24", "--to", "2023-24", "--skip-fetch") == 0
    assert run("backfill-elo", "--from", "2023-24", "--to", "2023-24", "--dry-run") == 0 and "1 days, 0 there" in capsys.readouterr().out
    assert run("backfill-elo", "--from", "2023-24", "--to", "2023-24") == 1
    replies["2023-08-11"] = b"Rank,Club,Country,Level,Elo,From,To\n1,A,ENG,1,1800.5,2023-08-01,2023-08-19\n"
    assert run("backfill-elo", "--from", "2023-24", "--to", "2023-24") == 0 and spark.read.parquet(f"{tmp_path}/staged/ratings").count() == 1


def test_rating_backfill_resumes(tmp_path):
    days = captures.rating_dates([datetime(2025, 1, 3).date(), datetime(2025, 1, 3).date(), datetime(2025, 1, 4).date()])
    assert [str(d) for d in days] == ["2025-01-02", "2025-01-03"]
    body = b"Rank,Club,Country,Level,Elo,From,To\n1,A,ENG,1,1800.5,2025-01-01,2025-01-09\n"
    at = lambda: datetime(2025, 5, 1, tzinfo=UTC)
    end = fetch.rating_endpoint("http://r")
    first = captures.backfill_ratings(_replies({"2025-01-02": body}), tmp_path, end, "2024-25", days, now=at)
    assert (first.written, [str(d) for d in first.failed]) == (1, ["2025-01-03"])
    then = captures.backfill_ratings(_replies({"2025-01-03": body}), tmp_path, end, "2024-25", days, now=at)
    assert (then.written, then.skipped, then.complete) == (1, 1, True) and len(list((tmp_path / "raw/ratings/daily/2024-25").iterdir())) == 2


def test_contracts_hold_and_an_unknown_season_raises():
    assert contracts.merged_for("2016-17")[1].encoding == "cp1252" and set(contracts.MERGED) == set(contracts.ERAS.values())
    assert contracts.PLAYERS.groups["expected"][0] == "starts" and contracts.FIXTURES.key == ("fixture_id",)
    with pytest.raises(KeyError, match="2031-32"):
        contracts.merged_for("2031-32")
    with pytest.raises(fetch.ShapeError):
        fetch.result_endpoint("http://m").fetch(_replies({"E0.csv": b"Date,HomeTeam\n"}), season="2425", division="E0")
