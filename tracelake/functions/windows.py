"""Time windows of reports, as half-open pairs of aware datetimes, worked out on the driver."""

from __future__ import annotations

import datetime as dt
import re

Window = tuple[dt.datetime, dt.datetime]


def today(now: dt.datetime) -> Window:
    """From local midnight of ``now``'s zone."""
    return now.replace(hour=0, minute=0, second=0, microsecond=0), now


def weekly(now: dt.datetime) -> Window:
    """The last seven days, not the calendar week."""
    return now - dt.timedelta(days=7), now


def monthly(now: dt.datetime) -> Window:
    """From the first of the month."""
    return today(now)[0].replace(day=1), now


def last_days(now: dt.datetime, days: int) -> Window:
    return now - dt.timedelta(days=days), now


def custom(since: dt.datetime | None, until: dt.datetime | None, now: dt.datetime, days: int = 7) -> Window:
    """Given ends, those without a zone in ``now``'s; else the last ``days`` until now."""
    start, end = (x.replace(tzinfo=now.tzinfo) if x is not None and x.tzinfo is None else x for x in (since, until))
    start, end = start or now - dt.timedelta(days=days), end or now
    if end <= start:
        raise ValueError(f"a window cannot end at {end.isoformat()} before it begins at {start.isoformat()}")
    return start, end


def since(text: str | None, default_days: int, now: dt.datetime) -> dt.datetime:
    """Start of a window from ``60d``, ``YYYY-MM-DD`` or nothing; what cannot be read counts as nothing."""
    if text and (m := re.fullmatch(r"(\d+)d", text)):
        return now - dt.timedelta(days=int(m[1]))
    try:
        return dt.datetime.strptime(text or "", "%Y-%m-%d").replace(tzinfo=now.tzinfo)
    except ValueError:
        return now - dt.timedelta(days=default_days)


def previous(window: Window) -> Window:
    """The window of the same length just before."""
    start, end = window
    return start - (end - start), start


def elapsed_hours(window: Window, now: dt.datetime | None = None) -> float:
    """Hours of the window that have passed."""
    start, end = window
    return ((min(now, end) if now else end) - start).total_seconds() / 3600.0


def stamp(at: dt.datetime) -> str:
    """A datetime as Spark and SQL read it, in UTC."""
    return (at.astimezone(dt.UTC) if at.tzinfo else at).strftime("%Y-%m-%d %H:%M:%S.%f")
