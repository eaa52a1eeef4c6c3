"""Polite HTTP fetching with retries, and shape checks of what comes back."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

# Exit codes of the command line (fixed values).
SUCCESS, FAILURE, USAGE, NOT_IMPLEMENTED, BLOCKED, SCHEMA_CHANGED, GATE_FAILED = 0, 1, 2, 10, 11, 12, 13


class FetchError(RuntimeError):
    exit_code = FAILURE


class BlockedError(FetchError):
    """403: never retried."""

    exit_code = BLOCKED


class RateLimitedError(FetchError):
    """429 after all retries."""


class ServerError(FetchError):
    """5xx, or no connection, after all retries."""


class ShapeError(FetchError):
    """The body isn't what its endpoint promises."""

    exit_code = SCHEMA_CHANGED


@dataclass
class Response:
    status: int
    body: bytes
    headers: Mapping[str, str] = field(default_factory=dict)


def _open(url: str, timeout: float) -> Response:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return Response(r.status, r.read(), dict(r.headers))
    except urllib.error.HTTPError as e:
        return Response(e.code, e.read(), dict(e.headers))


@dataclass
class Fetcher:
    """Spaced requests; 429 waits as told, 5xx and lost connections back off with full jitter."""

    spacing: float = 2.0
    retries: int = 4
    base_delay: float = 1.0
    longest_delay: float = 60.0
    timeout: float = 30.0
    send: Callable[[str, float], Response] = _open
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: float | None = None

    def get(self, url: str) -> Response:
        for attempt in range(self.retries + 1):
            if self._last is not None and (wait := self._last + self.spacing - self.clock()) > 0:
                self.sleep(wait)
            self._last = self.clock()
            try:
                r = self.send(url, self.timeout)
            except OSError:
                r = Response(599, b"")
            if r.status == 403:
                raise BlockedError(url)
            if r.status < 400:
                return r
            if r.status != 429 and r.status < 500:
                raise FetchError(f"{r.status} for {url}")
            if attempt == self.retries:
                raise (RateLimitedError if r.status == 429 else ServerError)(f"{r.status} for {url}")
            told = next((v for k, v in r.headers.items() if k.lower() == "retry-after"), "")
            delay = float(told) if r.status == 429 and told.isdigit() else random.uniform(0, min(self.longest_delay, self.base_delay * 2**attempt))
            self.sleep(delay)
        raise AssertionError


@dataclass(frozen=True)
class Endpoint:
    """A URL template and what its body must have: keys of an object, a list, or a CSV header."""

    template: str
    keys: Sequence[str] = ()
    is_list: bool = False
    header: Sequence[str] = ()

    def fetch(self, fetcher: Fetcher, **params) -> bytes:
        body = fetcher.get(self.template.format(**params)).body
        if self.header:
            first = body.split(b"\n", 1)[0].decode("utf-8-sig", "replace").strip().split(",")
            if lost := [h for h in self.header if h not in first]:
                raise ShapeError(f"columns are missing: {lost}")
        elif self.keys or self.is_list:
            try:
                data = json.loads(body)
            except ValueError as e:
                raise ShapeError("not JSON") from e
            if self.is_list and not isinstance(data, list):
                raise ShapeError("not a list")
            if self.keys and (not isinstance(data, dict) or any(k not in data for k in self.keys)):
                raise ShapeError(f"keys are missing of {list(self.keys)}")
        return body


def game_endpoints(base: str) -> dict[str, Endpoint]:
    """The endpoints of a fantasy game's API under ``base``."""
    return {
        "bootstrap": Endpoint(f"{base}/bootstrap-static/", keys=("elements", "teams", "events")),
        "fixtures": Endpoint(f"{base}/fixtures/", is_list=True),
        "event_live": Endpoint(f"{base}/event/{{event}}/live/", keys=("elements",)),
        "element_summary": Endpoint(f"{base}/element-summary/{{player}}/", keys=("fixtures", "history")),
        "standings": Endpoint(f"{base}/leagues-classic/{{league}}/standings/?page_standings={{page}}", keys=("standings",)),
        "entry": Endpoint(f"{base}/entry/{{entry}}/", keys=("id",)),
        "picks": Endpoint(f"{base}/entry/{{entry}}/event/{{event}}/picks/", keys=("picks",)),
    }


def rating_endpoint(base: str) -> Endpoint:
    """Ratings of all clubs on a day."""
    return Endpoint(f"{base}/{{date}}", header=("Rank", "Club", "Country", "Level", "Elo", "From", "To"))


def result_endpoint(base: str) -> Endpoint:
    """A division's results of a season, with odds where they are."""
    return Endpoint(f"{base}/{{season}}/{{division}}.csv", header=("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"))


def centre_endpoints(base: str) -> dict[str, Endpoint]:
    """The match centre's season tables and single matches."""
    return {
        "league": Endpoint(f"{base}/getLeagueData/{{league}}/{{year}}", keys=("dates", "players")),
        "match": Endpoint(f"{base}/getMatchData/{{match}}", keys=("rosters",)),
    }


def open_event(events: Sequence[Mapping], now, captured: set[int], first: int = 1) -> int | None:
    """The earliest event past its deadline that has neither finished nor been captured."""
    from datetime import datetime

    found = []
    for e in events:
        try:
            deadline = datetime.fromisoformat(str(e["deadline_time"]).replace("Z", "+00:00"))
            if int(e["id"]) >= first and e["id"] not in captured and not e.get("finished") and deadline <= now:
                found.append(int(e["id"]))
        except (KeyError, ValueError, TypeError):
            continue
    return min(found, default=None)
