"""Recent health per application."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.functions.events import has_type, severities
from runpulse.functions.instants import instant
from runpulse.functions.months import within_days


def app_health(runs: DataFrame, since: datetime | str) -> DataFrame:
    """Per app: runs, runs with an ERROR, runs with a WARN (a run can be both), ``inserted_at > since``."""
    recent = within_days(runs, since).where(F.col("inserted_at") > instant(since))
    typed = recent.select("app_name", severities(F.col("warn_error_logs")).alias("_types"))
    return typed.groupBy("app_name").agg(
        F.count("*").alias("runs"),
        F.count_if(has_type(F.col("_types"), "ERROR")).alias("errored"),
        F.count_if(has_type(F.col("_types"), "WARN")).alias("warned"),
    )


def health_label(window_hours: float | None = None) -> Column:
    """Short text over the columns of ``app_health``: ``24h: 14/22 err · 9 warn``; empty without runs."""
    prefix = ""
    if window_hours and window_hours > 0:
        prefix = f"{int(window_hours) if window_hours == int(window_hours) else window_hours}h: "
    share = F.concat_ws("/", F.coalesce("errored", F.lit(0)).cast("string"), F.col("runs").cast("string"))
    errored = F.concat(F.lit(prefix), share, F.lit(" err"))
    warned = F.when(F.col("warned") > 0, F.concat(F.lit(" · "), F.col("warned").cast("string"), F.lit(" warn")))
    return F.when(F.col("runs") > 0, F.concat(errored, F.coalesce(warned, F.lit("")))).otherwise("")
