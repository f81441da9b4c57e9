"""Error feed, one application's run history, and one run's timeline."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from runpulse.functions.events import (
    duration_ms,
    event_fields,
    first_and_last,
    has_type,
    job_name,
    severities,
    status_from,
)
from runpulse.functions.instants import instant, iso_micros, safe_ts
from runpulse.functions.months import day_label, day_of, within_days
from runpulse.operators.ordering import with_position
from runpulse.params import FEED_LIMIT, PAGE_LIMIT, as_instant, require_uuid, row_limit, status_filter

# A run is stored after its last event, and no run takes longer than this.
LONGEST_RUN = timedelta(days=1)
# Clocks of writers may differ by so much.
CLOCK_SLACK = timedelta(hours=1)


def error_feed(runs: DataFrame, now: datetime | str, lookback_days: int = 2, limit: int = FEED_LIMIT) -> DataFrame:
    """Newest WARN/ERROR events of runs with ``inserted_at > now - lookback_days``.

    An event whose ``dt`` is no instant sorts first, where it is noticed. Ties go by run id
    and place in the run. Returns ``limit`` events, if there are so many.
    """
    since = as_instant(now) - timedelta(days=lookback_days)
    recent = within_days(runs, since).where(F.col("inserted_at") > instant(since))
    fields = ("dt", "type", "func", "tag", "err_msg", "note")
    events = recent.select(
        "app_name", "run_id", F.posexplode(event_fields(F.col("warn_error_logs"), *fields)).alias("_pos", "_event")
    ).select("app_name", "run_id", *[F.col("_event")[f].alias(f) for f in fields], "_pos")
    newest = events.orderBy(safe_ts(F.col("dt")).desc_nulls_first(), "run_id", "_pos")
    return newest.limit(row_limit(limit)).drop("_pos")


def feed_parts(runs: DataFrame) -> DataFrame:
    """Per UTC day of ``inserted_at`` and hour of ``dt``: the WARN/ERROR ``events``; a null hour has those without an instant."""
    dts = F.explode(event_fields(F.col("warn_error_logs"), "dt")["dt"]).alias("dt")
    hour = F.date_trunc("hour", safe_ts(F.col("dt"))).alias("hour")
    return runs.select(day_of(F.col("inserted_at")).alias("day"), dts).groupBy("day", hour).agg(F.count("*").alias("events"))


def feed_days(parts: DataFrame, now: datetime | str, lookback_days: int = 2, limit: int = FEED_LIMIT) -> list[str]:
    """The days whose runs can hold any of ``error_feed``'s events, from ``feed_parts``; all others need no reading.

    Whole days inside the window tell an hour from which on there are ``limit`` events. A day matters if it
    has an event of that hour or later, or one without an instant, which sorts first.
    """
    first = day_label(as_instant(now) - timedelta(days=lookback_days))
    known = parts.where(F.col("day") >= first)
    # The window starts inside its first day, so that day's counts promise nothing.
    hours = known.where((F.col("day") > first) & F.col("hour").isNotNull()).groupBy("hour").agg(F.sum("events").alias("n"))
    # An hour per row, however many runs there are.
    newer = F.sum("n").over(Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    enough = hours.withColumn("newer", newer).where(F.col("newer") >= row_limit(limit)).agg(F.max("hour").cast("timestamp_ntz"))
    cutoff = enough.head()[0]
    if cutoff is not None:
        known = known.where(F.col("hour").isNull() | (F.col("hour") >= instant(cutoff)))
    return sorted(row["day"] for row in known.select("day").distinct().collect())


def run_by_id(
    runs: DataFrame,
    run_id: str,
    hint: datetime | str | None = None,
    longest_run: timedelta = LONGEST_RUN,
    clock_slack: timedelta = CLOCK_SLACK,
) -> DataFrame:
    """The newest row of a run id, or none. Letters may be in either case, here and in the table.

    ``hint`` is the run's ``inserted_at`` or any of its event times. A row is stored at most
    ``longest_run`` after any of its events, so only ``[hint - clock_slack, hint + longest_run +
    clock_slack)`` is searched: a few day folders. Rows stored outside of it are not found by
    that hint.
    """
    if hint is not None:
        low, high = as_instant(hint) - clock_slack, as_instant(hint) + longest_run + clock_slack
        runs = within_days(runs, low, high)
        runs = runs.where((F.col("inserted_at") >= instant(low)) & (F.col("inserted_at") < instant(high)))
    known = require_uuid(run_id)
    # Plain values reach the row groups' bounds and bloom filters, which lower(run_id) would not.
    found = runs.where(F.col("run_id").isin(*dict.fromkeys([known, known.upper(), run_id])))
    return found.select("app_name", "run_id", "inserted_at", "verbose_log").orderBy(F.desc("inserted_at")).limit(1)


def run_events(runs: DataFrame) -> DataFrame:
    """Every event of ``runs``, in array order, below its run's header."""
    header = runs.select(
        "app_name",
        job_name(F.col("verbose_log")).alias("job"),
        "run_id",
        "inserted_at",
        event_fields(F.col("verbose_log"), "dt", "type", "func", "tag", "note", "err_msg").alias("_events"),
    )
    started, ended = first_and_last(F.col("_events")["dt"])
    timed = header.withColumns({"started_at": started, "ended_at": ended})
    return timed.select(
        "app_name",
        "job",
        "run_id",
        "inserted_at",
        "started_at",
        "ended_at",
        duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"),
        F.posexplode("_events").alias("pos", "_event"),
    ).select("*", "_event.*").drop("_event")


def run_timeline(
    runs: DataFrame,
    run_id: str,
    hint: datetime | str | None = None,
    longest_run: timedelta = LONGEST_RUN,
    clock_slack: timedelta = CLOCK_SLACK,
) -> DataFrame:
    """All events of one run, ordered. Arguments as in ``run_by_id``."""
    return run_events(run_by_id(runs, run_id, hint, longest_run, clock_slack)).orderBy("pos")


def app_runs(runs: DataFrame, app: str, since: datetime | str, status: str = "all") -> DataFrame:
    """One application's runs with ``inserted_at > since``, unordered. Never reads ``verbose_log``."""
    mine = within_days(runs, since).where((F.col("app_name") == app) & (F.col("inserted_at") > instant(since)))
    typed = mine.select("run_id", "inserted_at", severities(F.col("warn_error_logs")).alias("_types"))
    wanted = _status_predicate(status_filter(status))
    if wanted is not None:
        typed = typed.where(wanted)
    return typed.select(
        "run_id",
        "inserted_at",
        iso_micros(F.col("inserted_at")).alias("inserted_at_iso"),
        status_from(F.col("_types")).alias("status"),
        F.size("_types").alias("issue_count"),
    )


def _status_predicate(status: str) -> Column | None:
    types = F.col("_types")
    return {"all": None, "error": has_type(types, "ERROR"), "issues": has_type(types, "ERROR", "WARN")}[status]


def app_runs_page(
    runs: DataFrame,
    app: str,
    since: datetime | str,
    limit: int = PAGE_LIMIT,
    cursor: tuple[datetime | str | None, str | None] | None = None,
    status: str = "all",
) -> DataFrame:
    """One page of ``app_runs``, newest first; runs of one instant by id, in whatever case it is stored.

    ``cursor`` is the last row of the page before, ``(inserted_at, run_id)`` to the
    microsecond; half a cursor is none. The bound on ``inserted_at`` is implied by the row
    comparison, but only the plain bound reaches the month folders and the row groups.
    """
    if cursor and cursor[0] and cursor[1]:
        before, before_id = as_instant(cursor[0]), require_uuid(cursor[1])
        runs = within_days(runs, until=before).where(F.col("inserted_at") <= instant(before))
        position = F.struct("inserted_at", F.lower("run_id").alias("run_id"))
        runs = runs.where(position < F.struct(instant(before).alias("inserted_at"), F.lit(before_id).alias("run_id")))
    return app_runs(runs, app, since, status).orderBy(*_newest_first()).limit(row_limit(limit))


def _newest_first() -> list[Column]:
    return [F.desc("inserted_at"), F.lower("run_id").desc()]


def app_runs_pages(
    runs: DataFrame, app: str, since: datetime | str, limit: int = PAGE_LIMIT, status: str = "all"
) -> DataFrame:
    """Every page of ``app_runs_page`` at once: its rows with ``page`` and ``place`` in it, both from 1.

    The pages are cut from one range-partitioned order, so no page waits for the one before.
    """
    rows = row_limit(limit)
    placed = with_position(app_runs(runs, app, since, status), _newest_first(), "_pos")
    at = F.col("_pos") - 1
    page, place = F.floor(at / rows) + 1, at % rows + 1
    return placed.select("*", page.alias("page"), place.alias("place")).drop("_pos")


def page_cursors(pages: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """Per page of ``app_runs_pages``: ``runs`` in it, and the cursor of the next one; null after a page that is not full."""
    last = lambda name: F.max_by(name, "place")
    found = pages.groupBy("page").agg(
        F.count("*").alias("runs"), last("inserted_at_iso").alias("_at"), last("run_id").alias("_id")
    )
    full = F.col("runs") == row_limit(limit)
    return found.select("page", "runs", F.when(full, F.col("_at")).alias("next_at"), F.when(full, F.col("_id")).alias("next_id"))


class Page(NamedTuple):
    runs: list[Row]
    cursor: tuple[str, str] | None


def fetch_page(page: DataFrame, limit: int = PAGE_LIMIT) -> Page:
    """Run one page, at most ``limit`` rows. A page of exactly ``limit`` may have a next one, by its cursor."""
    rows = page.limit(row_limit(limit)).collect()
    last = rows[-1] if len(rows) == limit else None
    return Page(rows, (last["inserted_at_iso"], last["run_id"]) if last else None)
