"""Partial results per UTC day, stored once and added up by later windows; and the index of run ids."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpulse.functions.months import day_label
from runpulse.operators.acquisition import acquisition_parts
from runpulse.operators.cadence import cadence_parts
from runpulse.operators.feeds import error_feed, feed_days, feed_parts, run_by_id
from runpulse.params import FEED_LIMIT, as_instant, require_uuid
from runpulse.schemas import RUN_LOGS
from runpulse.sources.folders import labels_below
from runpulse.sources.run_logs import read_run_logs



def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in columns.items()])


KINDS = {"string": T.StringType(), "long": T.LongType(), "timestamp": T.TimestampType()}
CADENCE_PARTS = _schema(
    app_name="string", job="string", gap_us="long", gaps="long", first="timestamp", last="timestamp", runs="long", day="string"
)
ACQUISITION_PARTS = _schema(
    system_id="string", data_source="string", manufacturer="string", modality="string", runs="long", failed="long",
    last="timestamp", day="string",
)
FEED_PARTS = _schema(hour="timestamp", events="long", day="string")
RUN_INDEX = _schema(run_id="string", inserted_at="timestamp", bucket="string")
#: Hexadecimal digits of a bucket's name: 256 buckets.
BUCKET_DIGITS = 2


def _store_days(parts: DataFrame, path: str) -> None:
    """Replaces the folders of the days that ``parts`` has rows of, and leaves all others."""
    writer = parts.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def _read_days(spark: SparkSession, path: str, schema: T.StructType, since: datetime | str) -> DataFrame:
    """Parts of the days from that of ``since`` on; only their folders are listed."""
    days = [day for day in labels_below(spark, path, "day") if day >= day_label(since)]
    if not days:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/day={day}" for day in days])


def store_cadence_parts(runs: DataFrame, path: str) -> None:
    """Stores the parts of the whole days in ``runs``; a day whose runs have changed is stored again."""
    _store_days(cadence_parts(runs), path)


def read_cadence_parts(spark: SparkSession, path: str, since: datetime | str) -> DataFrame:
    return _read_days(spark, path, CADENCE_PARTS, since)


def store_acquisition_parts(acq: DataFrame, path: str) -> None:
    """Stores the parts of the whole days in ``acq``; a day whose acquisitions have changed is stored again."""
    _store_days(acquisition_parts(acq), path)


def read_acquisition_parts(spark: SparkSession, path: str, since: datetime | str) -> DataFrame:
    return _read_days(spark, path, ACQUISITION_PARTS, since)


def store_feed_parts(runs: DataFrame, path: str) -> None:
    """Stores the parts of the whole days in ``runs``; a day whose runs have changed is stored again."""
    _store_days(feed_parts(runs), path)


def error_feed_by_days(
    spark: SparkSession, logs: str, parts: str, now: datetime | str, lookback_days: int = 2, limit: int = FEED_LIMIT
) -> DataFrame:
    """``error_feed`` of stored run logs, which opens only the days that its parts name."""
    since = as_instant(now) - timedelta(days=lookback_days)
    days = feed_days(_read_days(spark, parts, FEED_PARTS, since), now, lookback_days, limit)
    found = [read_run_logs(spark, logs, day, as_instant(day) + timedelta(days=1)) for day in days]
    # The bound names the next day's folder as well, which has nothing below it.
    found = [runs.where(F.col("day") == day) for runs, day in zip(found, days)]
    runs = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RUN_LOGS)
    return error_feed(runs, now, lookback_days, limit)


def append_run_index(runs: DataFrame, path: str) -> None:
    """Adds where each run is stored, in a folder per bucket of its id, sorted by id.

    Ids go by a digest of their lower-case form, so buckets are even whatever the ids look like, and each
    call adds one file to a bucket.
    """
    run_id = F.lower("run_id")
    bucket = F.substring(F.md5(run_id.cast("binary")), 1, BUCKET_DIGITS)
    rows = runs.select(run_id.alias("run_id"), "inserted_at", bucket.alias("bucket"))
    placed = rows.repartition("bucket").sortWithinPartitions("bucket", "run_id")
    placed.write.mode("append").partitionBy("bucket").parquet(path)


def read_run_index(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Where the runs of an id are stored: the files of one bucket, of which row groups without the id are skipped."""
    known = require_uuid(run_id)
    bucket = hashlib.md5(known.encode()).hexdigest()[:BUCKET_DIGITS]
    if bucket not in labels_below(spark, path, "bucket"):
        return spark.createDataFrame([], RUN_INDEX)
    rows = spark.read.schema(RUN_INDEX).option("basePath", path).parquet(f"{path}/bucket={bucket}")
    return rows.where(F.col("run_id") == known)


def run_by_index(spark: SparkSession, logs: str, index: str, run_id: str) -> DataFrame:
    """``run_by_id`` without a hint: one bucket of the index tells the day, and one day folder holds the run."""
    stored_at = read_run_index(spark, index, run_id).agg(F.max("inserted_at").cast("timestamp_ntz")).head()[0]
    if stored_at is None:
        none = spark.createDataFrame([], RUN_LOGS)
        return run_by_id(none, run_id)
    return run_by_id(read_run_logs(spark, logs, stored_at, stored_at + timedelta(microseconds=1)), run_id)
