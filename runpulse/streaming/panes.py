"""Sliding health from minute panes.

A pane counts one application's runs of one minute. Panes of the same minute add up, so every micro-batch stores only
those of its own rows, in a folder by day and batch. A window is the sum of the panes behind its first minute,
and of that minute's runs, which are read again because the window starts inside it.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpulse.functions.events import has_type, severities
from runpulse.functions.instants import instant
from runpulse.functions.months import day_label, day_of, within_days
from runpulse.operators.health import app_health
from runpulse.params import as_instant
from runpulse.sources.folders import labels_below

PANES = T.StructType(
    [
        T.StructField("app_name", T.StringType()),
        T.StructField("minute", T.TimestampType()),
        T.StructField("runs", T.LongType()),
        T.StructField("errored", T.LongType()),
        T.StructField("warned", T.LongType()),
        T.StructField("day", T.StringType()),
        T.StructField("batch", T.LongType()),
    ]
)
COUNTS = ("runs", "errored", "warned")
MINUTE = timedelta(minutes=1)


def minute_of(at: datetime | str) -> datetime:
    return as_instant(at).astimezone(timezone.utc).replace(second=0, microsecond=0)


def health_panes(runs: DataFrame) -> DataFrame:
    """Per application and minute of ``inserted_at``: runs, those with an ERROR, those with a WARN."""
    typed = runs.select(
        "app_name", F.date_trunc("minute", "inserted_at").alias("minute"), severities(F.col("warn_error_logs")).alias("_types")
    )
    return typed.groupBy("app_name", "minute").agg(
        F.count("*").alias("runs"),
        F.count_if(has_type(F.col("_types"), "ERROR")).alias("errored"),
        F.count_if(has_type(F.col("_types"), "WARN")).alias("warned"),
    )


def add_panes(runs: DataFrame, path: str, batch: int) -> None:
    """Stores the panes of one micro-batch; one that is run again replaces what it stored."""
    dated = health_panes(runs).withColumns({"day": day_of(F.col("minute")), "batch": F.lit(batch).cast("long")})
    # A few rows per application and minute: a file per day.
    writer = dated.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day", "batch").parquet(path)


def read_panes(spark: SparkSession, path: str, since: datetime | str) -> DataFrame:
    """Partial panes from the day of ``since`` on; only those days' folders are listed."""
    days = [day for day in labels_below(spark, path, "day") if day >= day_label(since)]
    if not days:
        return spark.createDataFrame([], PANES)
    return spark.read.schema(PANES).option("basePath", path).parquet(*[f"{path}/day={day}" for day in days])


def sliding_health(panes: DataFrame, runs: DataFrame, since: datetime | str) -> DataFrame:
    """What ``app_health(runs, since)`` gives, from panes; of ``runs`` only the minute of ``since`` is read."""
    first = minute_of(since)
    edge = within_days(runs, first, first).where(F.col("inserted_at") < instant(first + MINUTE))
    whole = panes.where(F.col("minute") >= instant(first + MINUTE)).select("app_name", *COUNTS)
    both = whole.unionByName(app_health(edge, since))
    return both.groupBy("app_name").agg(*[F.sum(name).alias(name) for name in COUNTS])
