"""Run summaries, parsed once: what the grid, the reconciling scan and the cadence need of a run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from runpulse.operators.grid import run_summaries
from runpulse.schemas import RUN_SUMMARIES
from runpulse.sources.run_logs import read_days, write_days


def append_summaries(runs: DataFrame, path: str) -> None:
    """Parse ``runs`` and append one narrow row for each, in day folders like the run logs."""
    write_days(run_summaries(runs), path)


def read_summaries(spark: SparkSession, path: str, since: datetime | str, until: datetime | str | None = None) -> DataFrame:
    """Summaries with ``since <= inserted_at < until``.

    Wherever runs are taken for their job, times and status, these can be given instead: to
    ``latest_runs``, as the source of ``refresh_latest``, and to ``cadence_profile``.
    """
    return read_days(spark, path, RUN_SUMMARIES, since, until)
