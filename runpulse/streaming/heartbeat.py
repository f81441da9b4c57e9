"""The refresher's own run, logged like any other.

Without beats the row ages to stale, which is the signal that the refresher is down.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.functions.instants import instant
from runpulse.functions.text import summarize_error
from runpulse.operators.grid import cadence_coverage
from runpulse.schemas import FLAT_EVENTS
from runpulse.sources.assemble import assemble_runs
from runpulse.streaming.state import Refresh

# Fixed values of the beat's events: job, functions, phase of a failure, and note keys.
JOB = "heartbeat"
BOOT_FUNC, BEAT_FUNC, FAILED_FUNC = "on_boot", "heartbeat", "refresh"
FAILED_PHASE = "grid refresh"
ARGV = ("python", "runpulse", JOB)


def refresh_metrics(grid: DataFrame, schedules: DataFrame, last: Refresh, as_of: datetime | str) -> DataFrame:
    """One row of metrics about a refresh, for ``heartbeat_run``."""
    coverage = cadence_coverage(grid, schedules)
    return coverage.select(
        instant(as_of).alias("as_of"),
        F.col("total").alias("cache_size"),
        F.col("unknown").alias("coverage_unknown"),
        F.lit(last.took_ms).cast("long").alias("last_refresh_ms"),
        F.lit(last.error).cast("string").alias("last_error"),
    )


def _millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _note(**fields: Column) -> Column:
    return F.to_json(F.struct(*[col.alias(name) for name, col in fields.items()]), {"ignoreNullFields": "false"})


def heartbeat_events(metrics: DataFrame, now: datetime | str, app_name: str) -> DataFrame:
    """Flat events, one run per row of ``metrics``; its ``run_id`` is used if it has one."""
    run_id = F.lower("run_id") if "run_id" in metrics.columns else F.uuid()
    # An empty error text means no error.
    failed = F.coalesce(F.length("last_error") > 0, F.lit(False))

    def event(seq: int, kind: str, func: str, tag: str, note: Column, err: Column | None = None) -> Column:
        message = F.lit(None).cast("string") if err is None else err
        texts = {"type": F.lit(kind), "func": F.lit(func), "tag": F.lit(tag), "note": note, "err_msg": message}
        return F.struct(F.lit(seq).alias("seq"), *[col.alias(name) for name, col in texts.items()])

    details = _note(
        asOf=_millis(F.col("as_of")),
        cacheSize=F.col("cache_size"),
        coverageUnknown=F.col("coverage_unknown"),
        lastRefreshMs=F.col("last_refresh_ms"),
    )
    boot = event(1, "INFO", BOOT_FUNC, "CALL", _note(argv=F.array(*[F.lit(a) for a in ARGV])))
    beat = event(2, "INFO", BEAT_FUNC, "DETAILS", details)
    error = event(3, "ERROR", FAILED_FUNC, "CATCH", _note(phase=F.lit(FAILED_PHASE)), summarize_error(F.col("last_error")))
    events = F.array_compact(F.array(boot, beat, F.when(failed, error)))
    flat = metrics.select(run_id.alias("run_id"), events.alias("_events")).select("run_id", F.inline("_events"))
    return flat.withColumns({"app_name": F.lit(app_name), "dt": _millis(instant(now))}).select(*FLAT_EVENTS.names)


def heartbeat_run(metrics: DataFrame, now: datetime | str, app_name: str) -> DataFrame:
    """Run rows ready for ``append_run_rows``: INFO events only, plus one ERROR after a failed refresh."""
    return assemble_runs(heartbeat_events(metrics, now, app_name))
