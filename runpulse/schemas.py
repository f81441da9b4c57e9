"""Declared schemas of the tables and of one log event. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RUN_LOGS = T.StructType(
    [
        T.StructField("app_name", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("inserted_at", T.TimestampType(), False),
        T.StructField("verbose_log", T.StringType(), True),
        T.StructField("warn_error_logs", T.StringType(), True),
        T.StructField("month", T.StringType(), True),
        T.StructField("day", T.StringType(), True),
    ]
)

LATEST_RUNS = T.StructType(
    [
        T.StructField("app_name", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("inserted_at", T.TimestampType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ended_at", T.TimestampType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("issue_count", T.IntegerType()),
    ]
)

RUN_SUMMARIES = T.StructType(
    [*LATEST_RUNS.fields, T.StructField("month", T.StringType()), T.StructField("day", T.StringType())]
)

SCHEDULES = T.StructType(
    [
        T.StructField("app_name", T.StringType(), False),
        T.StructField("job", T.StringType(), False),
        T.StructField("every_min", T.DoubleType(), True),
        T.StructField("grace_min", T.DoubleType(), True),
    ]
)

# The alert tables carry more columns; these are the ones the panel reads.
CONNECTIVITY = T.StructType(
    [
        T.StructField("system_id", T.StringType(), False),
        T.StructField("capture_datetime", T.TimestampType(), True),
        T.StructField("inserted_at", T.TimestampType(), True),
        T.StructField("successful_acquisition", T.BooleanType(), True),
        T.StructField("host_intervention", T.BooleanType(), True),
        T.StructField("connection_error", T.StringType(), True),
        T.StructField("error_category", T.StringType(), True),
        T.StructField("phase", T.StringType(), True),
    ]
)

ACQUISITIONS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("system_id", T.StringType(), False),
        T.StructField("data_source", T.StringType(), False),
        T.StructField("manufacturer", T.StringType(), True),
        T.StructField("modality", T.StringType(), True),
        T.StructField("successful_acquisition", T.BooleanType(), True),
        T.StructField("connection_error", T.StringType(), True),
        T.StructField("error_category", T.StringType(), True),
        T.StructField("phase", T.StringType(), True),
        T.StructField("inserted_at", T.TimestampType()),
    ]
)

FLAT_EVENTS = T.StructType(
    [
        T.StructField("app_name", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("dt", T.StringType(), True),
        T.StructField("type", T.StringType(), True),
        T.StructField("func", T.StringType(), True),
        T.StructField("tag", T.StringType(), True),
        T.StructField("note", T.StringType(), True),
        T.StructField("err_msg", T.StringType(), True),
    ]
)

HEARTBEAT_METRICS = T.StructType(
    [
        T.StructField("as_of", T.TimestampType(), True),
        T.StructField("cache_size", T.LongType(), True),
        T.StructField("coverage_unknown", T.LongType(), True),
        T.StructField("last_refresh_ms", T.LongType(), True),
        T.StructField("last_error", T.StringType(), True),
    ]
)
