"""Argument defaults and checks. What makes no sense raises; nothing is changed silently."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

# The status filters of a run page, the shape of a run id, usual row counts and window.
STATUS_FILTERS = ("all", "error", "issues")
RUN_ID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
FEED_LIMIT, PAGE_LIMIT = 100, 200
WINDOW_HOURS = 24


def row_limit(rows: int) -> int:
    """Any whole number above zero."""
    if isinstance(rows, bool) or not isinstance(rows, int) or rows < 1:
        raise ValueError(f"a row limit is a whole number above 0, not {rows!r}")
    return rows


def window_start(now: datetime | str, hours: float = WINDOW_HOURS) -> datetime:
    """Start of the trailing window that a run page or the acquisition view covers."""
    if not hours > 0:
        raise ValueError(f"a window is longer than 0 hours, not {hours!r}")
    return as_instant(now) - timedelta(hours=hours)


def status_filter(name: str) -> str:
    """One of ``STATUS_FILTERS``, in any case."""
    known = name.strip().lower()
    if known not in STATUS_FILTERS:
        raise ValueError(f"a status filter is one of {', '.join(STATUS_FILTERS)}, not {name!r}")
    return known


def require_uuid(raw: str) -> str:
    """The id in the lower-case form that new rows hold."""
    if not re.fullmatch(RUN_ID, raw):
        raise ValueError(f"{raw!r} has not the shape of a run id")
    return raw.lower()


def as_instant(raw: datetime | str) -> datetime:
    """An aware datetime; without a zone it means UTC."""
    value = datetime.fromisoformat(raw) if isinstance(raw, str) else raw
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value
