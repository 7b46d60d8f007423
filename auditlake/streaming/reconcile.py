"""Stateful reconcilers over streams of polls: uptime incidents and backlinks.

Each keeps a few numbers for every key.  Rows of a micro-batch are applied in the order of
their time and id; a poll that comes in a later batch than a newer one is applied when it
comes.  A key's rows are one task's work, as its state is one; keys are sites and links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UPTIME = "site long, at timestamp, id long, transition string, started_at timestamp, failure_count long, alert string"
DAY = pd.Timedelta(days=1)


def uptime(polls: DataFrame, ssl_days: int = 14) -> DataFrame:
    """polls (site, at, id, ok, ssl_days) as UPTIME rows, one for each poll.

    A first failure opens the site's incident and alerts ('down'), others only count, the first
    good poll closes it and alerts ('recovered').  A certificate with 0 to ssl_days days left
    alerts ('ssl_expiring', after a comma if there is another) once in 24 hours.  Null ok is down.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, failures, warned = state.get if state.exists else (None, 0, None)
        rows = []
        for r in pd.concat(list(frames)).sort_values(["at", "id"]).itertuples():
            ok, alerts = (not pd.isna(r.ok)) and bool(r.ok), []
            if ok and failures:
                kind, shown = "recovered", (since, failures)
                since, failures = None, 0
                alerts.append("recovered")
            elif ok:
                kind, shown = "none", (None, 0)
            else:
                kind = "still-down" if failures else "went-down"
                alerts += [] if failures else ["down"]
                since, failures = (since if failures else r.at), failures + 1
                shown = (since, failures)
            if not pd.isna(r.ssl_days) and 0 <= r.ssl_days <= ssl_days and (warned is None or r.at - pd.Timestamp(warned) >= DAY):
                warned = r.at
                alerts.append("ssl_expiring")
            rows.append((key[0], r.at, r.id, kind, *shown, ",".join(alerts) or None))
        state.update((since, failures, warned))
        out = pd.DataFrame(rows, columns=["site", "at", "id", "transition", "started_at", "failure_count", "alert"])
        out["started_at"] = pd.to_datetime(out["started_at"])
        yield out

    kept = "since timestamp, failures long, warned timestamp"
    return polls.select("site", "at", "id", "ok", "ssl_days").groupBy("site").applyInPandasWithState(step, UPTIME, kept, "append", GroupStateTimeout.NoTimeout)


BACKLINK = "link long, at timestamp, id long, status string, rel string, transition string"


def backlink_step(status: str, rel: str | None, http: int | None, found: bool, seen: str | None) -> tuple[str, str]:
    """(status, transition) of a link after a check; an unreachable page keeps an active link active."""
    active = status == "active"
    if not http or http >= 500:
        return ("active" if active else "broken"), "broken"
    if http >= 400:
        return "broken", "lost" if active else "none"
    if not found:
        return "lost", "lost" if active else "none"
    if not active:
        return "active", "found"
    if rel == "dofollow" and seen != "dofollow":
        return "active", "became-nofollow"
    if rel and rel != "dofollow" and seen == "dofollow":
        return "active", "became-dofollow"
    return "active", "none"


def backlinks(checks: DataFrame) -> DataFrame:
    """checks (link, at, id, http_status, found, rel) as BACKLINK rows, one for each check; a new link is 'unverified'."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, rel = state.get if state.exists else ("unverified", None)
        rows = []
        for r in pd.concat(list(frames)).sort_values(["at", "id"]).itertuples():
            seen = None if pd.isna(r.rel) else r.rel
            status, change = backlink_step(status, rel, None if pd.isna(r.http_status) else int(r.http_status), (not pd.isna(r.found)) and bool(r.found), seen)
            rel = seen
            rows.append((key[0], r.at, r.id, status, rel, change))
        state.update((status, rel))
        yield pd.DataFrame(rows, columns=["link", "at", "id", "status", "rel", "transition"])

    return checks.select("link", "at", "id", "http_status", "found", "rel").groupBy("link").applyInPandasWithState(step, BACKLINK, "status string, rel string", "append", GroupStateTimeout.NoTimeout)
