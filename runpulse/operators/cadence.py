"""Observed cadence: gaps between consecutive runs of a job."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runpulse.functions.events import job_name
from runpulse.functions.instants import instant
from runpulse.functions.months import day_label, day_of, within_days
from runpulse.params import as_instant

PERCENTILES = {"median_gap_min": 0.5, "p90_gap_min": 0.9, "p99_gap_min": 0.99}
JOB = ("app_name", "job")
_MINUTE_US = 60_000_000


def gap_counts(runs: DataFrame, since: datetime | str) -> DataFrame:
    """``app_name, job, gap_us, gaps, runs``: how often each gap occurs per job.

    Rows without a gap carry the run counts.
    """
    recent = within_days(runs, since).where(F.col("inserted_at") > instant(since))
    return _gaps_and_ends(recent, JOB)[0]


def _gaps_and_ends(runs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per group of ``keys``: ``gap_us, gaps, runs`` as in ``gap_counts``, and ``first, last, runs``.

    A job may own a large share of all runs, so no task sees a whole job. Runs at the same
    instant are counted before the shuffle (they are zero gaps). The instants of a job are
    split by minute; a gap inside a minute is a lag there, and a gap between minutes joins
    the last instant of one to the first of the next, over one row per minute.
    """
    job = F.col("job") if "job" in runs.columns else job_name(F.col("verbose_log"))
    at = F.col("inserted_at")
    instants = (
        runs.select("app_name", job.alias("job"), day_of(at).alias("day"), "inserted_at")
        .groupBy(*keys, "inserted_at")
        .agg(F.count("*").alias("n"))
        .withColumn("minute", F.date_trunc("minute", "inserted_at"))
    )
    before = F.lag("inserted_at").over(Window.partitionBy(*keys, "minute").orderBy("inserted_at"))
    inside = instants.withColumn("_gap", _micros_between(before, at)).select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("_gap").alias("gap_us"), F.lit(1).cast("long").alias("gaps")),
                F.struct(F.lit(0).cast("long").alias("gap_us"), (F.col("n") - 1).alias("gaps")),
            )
        ),
        F.lit(0).cast("long").alias("runs"),
    )
    minutes = instants.groupBy(*keys, "minute").agg(
        F.min("inserted_at").alias("first"), F.max("inserted_at").alias("last"), F.sum("n").alias("runs")
    )
    gaps = inside.where("gap_us IS NOT NULL AND gaps > 0").unionByName(_between(minutes, keys, "minute"))
    ends = minutes.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("runs").alias("runs"))
    return gaps.groupBy(*keys, "gap_us").agg(F.sum("gaps").alias("gaps"), F.sum("runs").alias("runs")), ends


def _between(parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The gap in front of each part (``first, last, runs``) of a group; the first part has none."""
    last_before = F.lag("last").over(Window.partitionBy(*keys).orderBy(order))
    return parts.select(
        *keys,
        _micros_between(last_before, F.col("first")).alias("gap_us"),
        F.when(last_before.isNull(), 0).otherwise(1).cast("long").alias("gaps"),
        "runs",
    )


def cadence_parts(runs: DataFrame) -> DataFrame:
    """Per job and UTC day what later days need of it: gaps inside the day with their counts, and its ends.

    Rows with a ``gap_us`` are the day's histogram; the one without holds ``first, last, runs``. Parts of different
    days never overlap, so a day is computed from its own runs alone.
    """
    keys = (*JOB, "day")
    gaps, ends = _gaps_and_ends(runs, keys)
    none = lambda kind: F.lit(None).cast(kind)
    inside = gaps.where("gap_us IS NOT NULL").select(
        *keys, "gap_us", "gaps", none("timestamp").alias("first"), none("timestamp").alias("last"), none("long").alias("runs")
    )
    return inside.unionByName(ends.select(*keys, none("long").alias("gap_us"), none("long").alias("gaps"), "first", "last", "runs"))


def cadence_of_parts(parts: DataFrame, runs: DataFrame, now: datetime | str, days: int = 7) -> DataFrame:
    """``cadence_profile`` from stored parts; of ``runs`` only the day that the window starts in is read.

    Days are joined at their borders: the gap from the last run of one to the first of the next that has any.
    """
    since = as_instant(now) - timedelta(days=days)
    first_day = day_label(since)
    edge = within_days(runs, since, since).where((F.col("inserted_at") > instant(since)) & (day_of(F.col("inserted_at")) == first_day))
    known = parts.where(F.col("day") > first_day).unionByName(cadence_parts(edge))
    borders = _between(known.where("gap_us IS NULL"), JOB, "day")
    inside = known.where("gap_us IS NOT NULL").select(*JOB, "gap_us", "gaps", F.lit(0).cast("long").alias("runs"))
    counts = inside.unionByName(borders).groupBy(*JOB, "gap_us").agg(F.sum("gaps").alias("gaps"), F.sum("runs").alias("runs"))
    return _profile(counts)


def _micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def cadence_profile(runs: DataFrame, now: datetime | str, days: int = 7) -> DataFrame:
    """Per (app, job): gaps seen (``runs``), exact median, 90th and 99th percentile and maximum.

    Minutes with one decimal, plus the exact ``max_gap_us``. The percentile is taken over
    (gap, count) pairs. The distinct gaps of a job add up to at most the window, so a
    seven-day window has at most sqrt(2 * 7 days in microseconds), 1.1 million, of them
    however many runs there are: that is all one group can hold.
    """
    return _profile(gap_counts(runs, as_instant(now) - timedelta(days=days)))


def _profile(counts: DataFrame) -> DataFrame:
    """The profile of each job from the rows of ``gap_counts``."""
    shares = F.array(*[F.lit(p) for p in PERCENTILES.values()])
    stats = counts.groupBy(*JOB).agg(
        (F.sum("runs") - 1).alias("runs"),
        F.percentile("gap_us", shares, F.col("gaps")).alias("_p"),
        F.max("gap_us").alias("max_gap_us"),
    )
    return stats.where("runs > 0").select(
        *JOB,
        "runs",
        *[_minutes(F.col("_p")[i]).alias(name) for i, name in enumerate(PERCENTILES)],
        _minutes(F.col("max_gap_us")).alias("max_gap_min"),
        "max_gap_us",
    )


def _minutes(us: Column) -> Column:
    return F.round(us / _MINUTE_US, 1)


def budget_audit(profile: DataFrame, schedules: DataFrame) -> DataFrame:
    """Does each silence budget clear the longest normal gap? One that does not will flap."""
    minutes = F.col("every_min") + F.coalesce("grace_min", F.lit(0.0))
    budgets = schedules.select(*JOB, minutes.alias("budget_min"))
    max_min = F.col("max_gap_us") / _MINUTE_US
    return profile.join(budgets, list(JOB), "left").select(
        *JOB,
        "max_gap_min",
        "budget_min",
        F.round(F.try_divide("budget_min", max_min), 2).alias("budget_ratio"),
        (F.col("budget_min") > max_min).alias("clears_max_gap"),
    )
