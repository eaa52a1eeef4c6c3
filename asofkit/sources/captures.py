"""Capture loops over a fetcher: leagues, picks and matches in chunks, rating dates one by one. All resume."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from .fetch import BlockedError, Endpoint, Fetcher, FetchError, game_endpoints
from .files import encode_as_of
from .writers import _put, write_chunk, write_raw

CHUNK = 100
#: The log of a folder's chunks, and the mark of a folder that has all it should have.
LOG, DONE = "chunks.ndjson", "complete.json"
PAGE = 50
#: Private leagues are of this kind (a fixed value); the others hold everyone.
PRIVATE = "x"
#: A rating counts from the day before a match.
BEFORE = timedelta(days=1)


@dataclass(frozen=True)
class Outcome:
    """How many were asked for, how many chunks (or captures) were written, how many were there, and which failed."""

    asked: int
    written: int
    skipped: int
    failed: tuple = ()

    @property
    def complete(self) -> bool:
        return not self.failed


def log(name: str, **fields) -> str:
    """One line of JSON about an event, times as text."""
    line = json.dumps({"event": name, **fields}, sort_keys=True, default=str)
    print(line)
    return line


def _now() -> datetime:
    return datetime.now(UTC)


def ingest(fetcher: Fetcher, root: Path, base: str, season: str, names: Sequence[str] = ("bootstrap", "fixtures"), now: Callable[[], datetime] = _now) -> dict[str, bool]:
    """Fetch the named endpoints once; a body that is stored already is not written again. True where it is new."""
    out = {}
    for n in names:
        body = game_endpoints(base)[n].fetch(fetcher)
        at = now()
        put = write_raw(root / "raw" / "game" / n / season, encode_as_of(at), body, {"source": "game", "endpoint": n, "season": season, "fetched_at": at.isoformat()})
        out[n] = put is not None
        log("ingested", endpoint=n, season=season, new=out[n])
    return out


def league_entries(fetcher: Fetcher, base: str, league: int, top: int | None = None) -> list[int]:
    """The entries of a league, page by page, at most ``top``; a league without standings has none.

    With ``top`` no more pages are asked for than hold so many. A page without rows ends it.
    """
    found: list[int] = []
    page = 1
    while top is None or (len(found) < top and page <= -(-top // PAGE)):
        standings = json.loads(game_endpoints(base)["standings"].fetch(fetcher, league=league, page=page)).get("standings")
        rows = standings.get("results") if isinstance(standings, dict) else None
        rows = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
        found += [r["entry"] for r in rows if isinstance(r.get("entry"), int)]
        if not rows or not standings.get("has_next"):
            break
        page += 1
    return found if top is None else found[:top]


def private_leagues(fetcher: Fetcher, base: str, entry: int) -> list[tuple[int, str]]:
    """id and name of the private leagues that an entry is in."""
    leagues = json.loads(game_endpoints(base)["entry"].fetch(fetcher, entry=entry)).get("leagues") or {}
    return [(x["id"], x.get("name", "")) for x in leagues.get("classic", []) if x.get("league_type") == PRIVATE]


def _stored(folder: Path, key: str) -> dict:
    """The chunk of every id that is stored: as logged, and from chunks that a run left before it could log them."""
    found, logged = {}, set()
    try:
        for line in (folder / LOG).read_text().splitlines():
            try:
                entry = json.loads(line)
            except ValueError:
                continue  # a line that was cut off; its chunk is read below
            logged.add(entry["chunk"])
            found.update(dict.fromkeys(entry["ids"], entry["chunk"]))
    except FileNotFoundError:
        pass
    for data in folder.glob("chunk=*/data.ndjson.gz"):
        k = int(data.parent.name.partition("=")[2])
        if k not in logged:
            found.update({json.loads(line)[key]: k for line in gzip.decompress(data.read_bytes()).splitlines()})
    return found


def in_chunks(folder: Path, ids: Sequence[int], fetch: Callable[[int], dict], size: int = CHUNK, key: str = "id") -> Outcome:
    """Fetch a record for every id that isn't stored yet and store them in chunks of ``size``.

    Records hold their id as ``key``. A log that is only added to says which ids each chunk has, so a
    run takes up exactly those that are missing: an id that fails is named and costs no other
    its answer, this time or the next. A blocked source ends the run at once; what had come
    until then is stored.
    """
    have = _stored(folder, key)
    todo = [i for i in dict.fromkeys(ids) if i not in have]
    chunk = max(have.values(), default=-1) + 1
    written, failed, records = 0, [], {}

    def put() -> None:
        nonlocal chunk, written, records
        if records:
            while not write_chunk(folder, chunk, list(records.values())):  # never over another one
                chunk += 1
            with open(folder / LOG, "a") as f:
                f.write(json.dumps({"chunk": chunk, "ids": list(records)}) + "\n")
                f.flush()
                os.fsync(f.fileno())
            chunk, written, records = chunk + 1, written + 1, {}

    try:
        for i in todo:
            try:
                records[i] = {key: i, **fetch(i)}
            except BlockedError:
                raise
            except FetchError as e:
                failed.append(i)
                log("failed", id=i, reason=str(e))
            if len(records) == size:
                put()
    finally:
        put()
    return Outcome(len(ids), written, len(ids) - len(todo), tuple(failed))


def ownership(fetcher: Fetcher, root: Path, base: str, season: str, event: int, cohort: str, entries: Sequence[int], size: int = CHUNK, now: Callable[[], datetime] = _now, whole: bool = True) -> Outcome:
    """The picks of all entries of a cohort for an event; squads with automatic substitutions are marked.

    When all of a ``whole`` cohort's have come, the event is marked as captured.
    """
    folder = root / "raw" / "game" / "picks" / season / cohort / f"event={event}"

    def one(entry: int) -> dict:
        payload = json.loads(game_endpoints(base)["picks"].fetch(fetcher, entry=entry, event=event))
        return {"entry": entry, "event": event, "fetched_at": now().isoformat(), "contaminated": bool(payload.get("automatic_subs")), "payload": payload}

    out = in_chunks(folder, entries, one, size, "entry")
    if out.complete and whole and entries:
        _put(folder / DONE, json.dumps({"entries": len(entries), "at": now().isoformat()}).encode())
    return out


def match_data(fetcher: Fetcher, root: Path, endpoint: Endpoint, season: str, matches: Iterable[int], size: int = 20) -> Outcome:
    """The rosters and shots of finished matches in chunks, in the order of their ids."""
    one = lambda m: {"match_id": m, **json.loads(endpoint.fetch(fetcher, match=m))}
    return in_chunks(root / "raw" / "centre" / "match" / season, sorted(set(matches)), one, size, "match_id")


def rating_dates(kickoffs: Iterable[date]) -> list[date]:
    """The days whose ratings matches on these days need, each once."""
    return sorted({k - BEFORE for k in kickoffs})


def captured_dates(folder: Path) -> set[date]:
    """The dates that stored captures were asked for; unreadable metadata counts as not captured."""
    found = set()
    for meta in folder.glob("as_of=*/meta.json"):
        try:
            found.add(date.fromisoformat(str(json.loads(meta.read_text())["params"]["date"])))
        except (OSError, ValueError, KeyError, TypeError):
            continue
    return found


def backfill_ratings(fetcher: Fetcher, root: Path, endpoint: Endpoint, season: str, dates: Sequence[date], limit: int | None = None, now: Callable[[], datetime] = _now) -> Outcome:
    """Fetch every date that isn't stored; each is a capture of its own even if its body repeats.

    Two captures of one second go to the next free one. A date that fails is named and the run goes
    on; ``limit`` bounds the requests of a run.
    """
    folder = root / "raw" / "ratings" / "daily" / season
    have = captured_dates(folder)
    todo = [d for d in dates if d not in have]
    written, failed = 0, []
    for d in todo if limit is None else todo[:limit]:
        try:
            body = endpoint.fetch(fetcher, date=d.isoformat())
        except BlockedError:
            raise
        except FetchError as e:
            failed.append(d)
            log("failed", date=d, reason=str(e))
            continue
        at = now()
        while (out := folder / f"as_of={encode_as_of(at)}").exists():
            at += timedelta(seconds=1)
        _put(out / "data.csv.gz", gzip.compress(body, mtime=0))
        _put(out / "meta.json", json.dumps({"source": "ratings", "season": season, "sha256": hashlib.sha256(body).hexdigest(), "params": {"date": d.isoformat()}}, sort_keys=True).encode())
        written += 1
    return Outcome(len(dates), written, len(dates) - len(todo), tuple(failed))


def captured_events(root: Path, season: str, cohort: str) -> set[int]:
    """The events of which all of a cohort's picks are stored."""
    return {int(p.name.partition("=")[2]) for p in (root / "raw" / "game" / "picks" / season / cohort).glob("event=*") if (p / DONE).exists()}


def archive(fetcher: Fetcher, root: Path, base: str, season: str, now: Callable[[], datetime] = _now) -> int:
    """A past season's merged statistics and list of players; how many were new."""
    new = 0
    for name, path in {"merged": f"{season}/gws/merged_gw.csv", "players": f"{season}/players_raw.csv"}.items():
        at = now()
        new += write_raw(root / "raw" / "archive" / name / season, encode_as_of(at), fetcher.get(f"{base}/{path}").body, {"source": "archive", "endpoint": name, "season": season, "fetched_at": at.isoformat()}, "csv") is not None
    return new
