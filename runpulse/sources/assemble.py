"""From flat events to run rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_json() -> Column:
    """One flat event as JSON text. ``note`` is JSON text itself and is embedded, nulls inside it kept."""
    note = F.parse_json(F.col("note")).alias("note")
    return F.to_json(F.struct("run_id", "dt", "type", "func", "tag", note, "err_msg"))


def assemble_runs(events: DataFrame, /, *also_by: str, **extra: Column) -> DataFrame:
    """One row per (app_name, run_id) with its event arrays as JSON text.

    ``verbose_log`` holds all events by ``seq``, ``warn_error_logs`` the WARN and ERROR ones.
    Further aggregates of the run's events can be asked for by name. ``also_by`` names
    columns that are constant in a run; where ``events`` is already partitioned by them, no
    shuffle is added. Each event is rendered once and used in both arrays. A run is one row
    holding one document by definition of the table, so a run's events do meet in one task;
    nothing larger does.
    """
    rendered = events.withColumn("_event", F.struct("seq", "type", event_json().alias("json")))
    runs = rendered.groupBy(*also_by, "app_name", "run_id").agg(
        F.array_sort(F.collect_list("_event")).alias("_events"),
        *[agg.alias(name) for name, agg in extra.items()],
    )
    issues = F.filter("_events", lambda e: e["type"].isin("WARN", "ERROR"))
    return runs.select(
        "app_name",
        "run_id",
        _as_array(F.col("_events")).alias("verbose_log"),
        _as_array(issues).alias("warn_error_logs"),
        *extra,
    )


def _as_array(events: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(events["json"], ","), F.lit("]"))
