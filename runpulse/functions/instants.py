"""Instants: guarded parsing, rendering and ages. The session time zone must be UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from runpulse.params import as_instant

# Fixed value: the only shape of an event's dt that is read as an instant.
ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z"


def instant(value: datetime | str) -> Column:
    """A literal instant. A datetime without a zone, like a text without one, means UTC."""
    utc = as_instant(value).astimezone(timezone.utc)
    return F.lit(utc.isoformat(timespec="microseconds")).cast("timestamp")


def safe_ts(col: Column) -> Column:
    """ISO-8601 UTC text to an instant; any other text, and any impossible date, is null."""
    return F.when(col.rlike(ISO_UTC), col.try_cast("timestamp"))


def iso_micros(col: Column) -> Column:
    """Six fractional digits, so that a paging cursor survives the round trip."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_seconds(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_ms(col: Column, now: datetime | str) -> Column:
    """Milliseconds from ``col`` to ``now``; negative for a future instant."""
    return F.unix_millis(instant(now)) - F.unix_millis(col)
