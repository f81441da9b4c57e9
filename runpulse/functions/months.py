"""Month and day folders of stored tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.params import as_instant


def month_of(ts: Column) -> Column:
    """The UTC month as ``yyyy-MM``, whatever the zone of the session."""
    return F.date_format(F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int")), "yyyy-MM")


def month_label(value: datetime | str) -> str:
    return as_instant(value).astimezone(timezone.utc).strftime("%Y-%m")


def day_of(ts: Column) -> Column:
    """The UTC day as ``yyyy-MM-dd``, whatever the zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int")).cast("string")


def day_label(value: datetime | str) -> str:
    return as_instant(value).astimezone(timezone.utc).strftime("%Y-%m-%d")


def within_days(runs: DataFrame, since: datetime | str | None = None, until: datetime | str | None = None) -> DataFrame:
    """Restrict ``runs`` to the month and day folders that can hold ``[since, until]``.

    Spark cannot derive this from a bound on ``inserted_at``, so every bounded operator says
    it explicitly. A table without these columns passes unchanged; months without day folders
    have a null day.
    """
    for column, label in (("month", month_label), ("day", day_label)):
        if column not in runs.columns:
            continue
        folder = F.col(column)
        if since is not None:
            runs = runs.where(folder.isNull() | (folder >= label(since)))
        if until is not None:
            runs = runs.where(folder.isNull() | (folder <= label(until)))
    return runs
