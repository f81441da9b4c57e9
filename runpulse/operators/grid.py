"""The job grid: latest run per (app, job), judged against its cadence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runpulse.functions.events import duration_ms, first_and_last, job_of, log_heads, severities, status_from
from runpulse.functions.instants import age_ms, instant
from runpulse.functions.months import within_days
from runpulse.schemas import LATEST_RUNS

MINUTE_MS = 60_000


def run_summaries(runs: DataFrame) -> DataFrame:
    """One narrow row per run: job, status, issue count, start, end, duration.

    Each document is parsed once, where it is read, so that no later shuffle carries it. Rows that
    are summaries already, as of ``read_summaries``, pass as they are.
    """
    if set(LATEST_RUNS.names) <= set(runs.columns):
        return runs.select(*LATEST_RUNS.names)
    parsed = runs.select(
        "app_name",
        "run_id",
        "inserted_at",
        log_heads(F.col("verbose_log")).alias("_heads"),
        severities(F.col("warn_error_logs")).alias("_types"),
    ).withColumn("job", job_of(F.col("_heads")))
    started, ended = first_and_last(F.col("_heads")["dt"])
    status, issues = status_from(F.col("_types")), F.size("_types")
    return (
        parsed.withColumns({"started_at": started, "ended_at": ended, "status": status, "issue_count": issues})
        .withColumn("duration_ms", duration_ms(F.col("started_at"), F.col("ended_at")))
        .select(*LATEST_RUNS.names)
    )


def latest_of(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row per (app_name, job) in ``order``.

    A row-number filter lets every task keep its own winner before the shuffle, so a hot
    key sends one row per task.
    """
    newest = Window.partitionBy("app_name", "job").orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def latest_runs(runs: DataFrame, since: datetime | str | None = None) -> DataFrame:
    """Newest run per (app, job) with ``inserted_at >= since``; a tie goes to the larger run id."""
    if since is not None:
        runs = within_days(runs, since).where(F.col("inserted_at") >= instant(since))
    return latest_of(run_summaries(runs), F.desc("inserted_at"), F.desc("run_id"))


def _with_budget(grid: DataFrame, schedules: DataFrame, app: str) -> DataFrame:
    """Left join of the cadence. ``budget_ms`` stays null without one."""
    minutes = F.col("every_min") + F.coalesce("grace_min", F.lit(0.0))
    budgets = schedules.select(F.col("app_name").alias(app), "job", (minutes * MINUTE_MS).cast("long").alias("budget_ms"))
    return grid.join(budgets, [app, "job"], "left")


def staleness(
    grid: DataFrame, schedules: DataFrame, now: datetime | str, clock: str = "inserted_at", app: str = "app_name"
) -> DataFrame:
    """Adds ``age_ms, budget_ms, stale``: overdue means older than the budget, not equal to it.

    Without a cadence ``stale`` is null: unknown is not the same as on time.
    """
    judged = _with_budget(grid, schedules, app).withColumn("age_ms", age_ms(F.col(clock), now))
    return judged.withColumn("stale", F.col("age_ms") > F.col("budget_ms"))


def job_grid(latest: DataFrame, schedules: DataFrame, now: datetime | str) -> DataFrame:
    """The grid as served, in (app, job) order."""
    judged = staleness(latest, schedules, now)
    return judged.select(
        F.col("app_name").alias("app"),
        "job",
        "run_id",
        F.col("inserted_at").alias("last_run"),
        "started_at",
        "ended_at",
        "duration_ms",
        "status",
        "issue_count",
        "age_ms",
        "stale",
        "budget_ms",
    ).orderBy("app", "job")


def cadence_coverage(grid: DataFrame, schedules: DataFrame) -> DataFrame:
    """One row: how many grid jobs have a cadence and how many do not."""
    known = F.count("budget_ms")
    return _with_budget(grid.select("app", "job"), schedules, "app").agg(
        F.count("*").alias("total"),
        known.alias("configured"),
        (F.count("*") - known).alias("unknown"),
    )


def unknown_jobs(grid: DataFrame, schedules: DataFrame) -> DataFrame:
    """The jobs without a cadence, one ``app/job`` per row, in grid order."""
    missing = _with_budget(grid.select("app", "job"), schedules, "app").where("budget_ms IS NULL")
    return missing.select("app", "job", F.concat_ws("/", "app", "job").alias("unknown_job")).orderBy("app", "job")
