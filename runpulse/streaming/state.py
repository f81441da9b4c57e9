"""The latest-run table, kept up to date by small scans.

A full scan of the retention window happens at first (bootstrap) and every few hours
(reconcile); in between, a tick reads only what was inserted since the watermark less an
overlap. The watermark is a scan position, not a limit for late data: a late row inside the
overlap is found by the next tick, an older one by the next reconcile, and merging a row
twice changes nothing.

A refresh appends what it found, one row per job, in a folder of its own; a read takes the newest row per job
of all folders since the last full scan. Merging is idempotent and its order does not matter, so that
takes nothing but Spark's Parquet writer: what is half written is not seen, a failed refresh adds nothing, and two
refreshes at once both count. A full scan starts a new generation of folders, which is read once it is complete.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpulse.functions.instants import instant, iso_micros
from runpulse.operators.grid import latest_of, latest_runs
from runpulse.operators.health import app_health
from runpulse.params import as_instant
from runpulse.schemas import LATEST_RUNS
from runpulse.sources.folders import is_complete, labels_below, remove_folder

HEALTH = T.StructType(
    [
        T.StructField("app_name", T.StringType()),
        T.StructField("runs", T.LongType()),
        T.StructField("errored", T.LongType()),
        T.StructField("warned", T.LongType()),
    ]
)
#: Rows of the stored state. One row of each refresh has no application: it holds the refresh's retention floor and
#: the watermark from before.
_STORED = T.StructType(
    [
        *LATEST_RUNS.fields,
        T.StructField("floor", T.TimestampType()),
        T.StructField("watermark", T.TimestampType()),
        T.StructField("at", T.StringType()),
    ]
)
#: The generation of refreshes before the first full scan.
_NO_SCAN = "0"

# Reads the run logs inserted at or after the given instant.
Source = Callable[[datetime], DataFrame]


@dataclass(frozen=True)
class RefreshConfig:
    retention: timedelta = timedelta(days=30)
    overlap: timedelta = timedelta(minutes=5)
    reconcile_every: timedelta = timedelta(hours=6)
    health_window: timedelta = timedelta(hours=24)
    # How long readers may use what a later full scan or health window has replaced.
    keep: timedelta = timedelta(days=1)


class Refresh(NamedTuple):
    """Outcome of one refresh; an error leaves the last good state in place.

    Without a phase, not even the state of the table could be read.
    """

    phase: str | None
    since: datetime | None
    jobs: int | None
    watermark: datetime | None
    took_ms: int
    error: str | None = None
    health_error: str | None = None


class State(NamedTuple):
    """The generation in use, when it was scanned in full, and its watermark."""

    generation: str = _NO_SCAN
    last_full: datetime | None = None
    watermark: datetime | None = None


def merge_latest(
    state: DataFrame, batch: DataFrame, now: datetime | str, retention: timedelta = RefreshConfig.retention
) -> DataFrame:
    """Newest row per (app, job) of state and batch; the batch wins a tie. Then ``evict``."""
    both = state.withColumn("_fed", F.lit(0)).unionByName(batch.withColumn("_fed", F.lit(1)))
    newest = latest_of(both, F.desc("inserted_at"), F.desc("_fed"), F.desc("run_id")).drop("_fed")
    return evict(newest, now, retention)


def evict(state: DataFrame, now: datetime | str, retention: timedelta = RefreshConfig.retention) -> DataFrame:
    """Drops what is older than the retention; a row exactly that old stays."""
    return state.where(F.col("inserted_at") >= instant(as_instant(now) - retention))


def since_bound(
    watermark: datetime | None,
    now: datetime | str,
    overlap: timedelta = RefreshConfig.overlap,
    retention: timedelta = RefreshConfig.retention,
) -> datetime:
    """Start of the next tick's scan, never before the retention floor."""
    floor = as_instant(now) - retention
    return floor if watermark is None else max(watermark - overlap, floor)


def _label(at: datetime) -> str:
    """A folder label that sorts like the instant."""
    return as_instant(at).astimezone(timezone.utc).strftime("%Y%m%dT%H%M%S.%f")


def _instant_of(label: str) -> datetime:
    return datetime.strptime(label, "%Y%m%dT%H%M%S.%f").replace(tzinfo=timezone.utc)


def _generation(spark: SparkSession, root: str) -> str:
    """The newest generation whose full scan is complete."""
    found = labels_below(spark, f"{root}/latest", "gen")
    whole = [g for g in found if g == _NO_SCAN or is_complete(spark, f"{root}/latest/gen={g}/at={g}")]
    return whole[-1] if whole else _NO_SCAN


def _rows(spark: SparkSession, root: str, generation: str) -> DataFrame:
    """All rows that the refreshes of a generation added."""
    path = f"{root}/latest/gen={generation}"
    if not labels_below(spark, path, "at"):
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).option("basePath", path).parquet(path)


def _marks(rows: DataFrame) -> tuple[datetime | None, datetime | None]:
    """The watermark and the highest floor of all refreshes."""
    mark = F.greatest(F.max("inserted_at"), F.max("watermark"))
    found = rows.agg(*[iso_micros(c) for c in (mark, F.max("floor"))]).head()
    return tuple(as_instant(text) if text else None for text in found)


def _merged(rows: DataFrame, floor: datetime | None) -> DataFrame:
    """The newest row per job, of equally new ones the one added last, from ``floor`` on."""
    runs = rows.where("app_name IS NOT NULL")
    runs = runs.where(F.col("inserted_at") >= instant(floor)) if floor else runs
    return latest_of(runs, F.desc("inserted_at"), F.desc("at"), F.desc("run_id")).select(*LATEST_RUNS.names)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    rows = _rows(spark, root, _generation(spark, root))
    return _merged(rows, _marks(rows)[1])


def current_state(spark: SparkSession, root: str) -> State:
    generation = _generation(spark, root)
    last_full = None if generation == _NO_SCAN else _instant_of(generation)
    return State(generation, last_full, _marks(_rows(spark, root, generation))[0])


def add_rows(
    batch: DataFrame, root: str, generation: str, name: str, floor: datetime, watermark: datetime | None, mode: str = "append"
) -> None:
    """Adds a row per job, and the one about the refresh, to a generation, in the folder ``name``."""
    mark = instant(watermark) if watermark else F.lit(None).cast("timestamp")
    nothing = F.lit(None).cast("timestamp")
    about = batch.sparkSession.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in LATEST_RUNS.fields],
        instant(floor).alias("floor"),
        mark.alias("watermark"),
    )
    rows = batch.select(*LATEST_RUNS.names, nothing.alias("floor"), nothing.alias("watermark")).unionByName(about)
    # A row per job: one small file.
    rows.coalesce(1).write.mode(mode).parquet(f"{root}/latest/gen={generation}/at={name}")


def refresh_latest(
    spark: SparkSession, source: Source, root: str, now: datetime | str, config: RefreshConfig = RefreshConfig()
) -> Refresh:
    """One bootstrap, reconcile or tick. Raises on failure, with the table as it was."""
    now = as_instant(now)
    state = current_state(spark, root)
    return _refresh_planned(spark, source, root, now, config, state, *plan_refresh(state, now, config))


def _refresh_planned(
    spark: SparkSession, source: Source, root: str, now: datetime, config: RefreshConfig, state: State, phase: str, since: datetime
) -> Refresh:
    started = time.monotonic()
    batch = latest_runs(source(since), since)
    generation = state.generation
    if phase != "tick":
        # The new generation starts with what is known of the old one.
        generation = _label(now)
        batch = merge_latest(read_latest(spark, root), batch, now, config.retention)
    add_rows(batch, root, generation, _label(now), now - config.retention, state.watermark)
    rows = _rows(spark, root, generation)
    watermark, highest = _marks(rows)
    jobs = _merged(rows, highest).count()
    if phase != "tick":
        _forget(spark, f"{root}/latest", "gen", now - config.keep)
    return Refresh(phase, since, jobs, watermark, _millis_since(started))


def _forget(spark: SparkSession, folder: str, key: str, before: datetime) -> None:
    """Removes folders of instants before ``before`` that a later one of before then has replaced."""
    old = [label for label in labels_below(spark, folder, key) if label < _label(before)]
    for label in old[:-1]:
        remove_folder(spark, f"{folder}/{key}={label}")


def _millis_since(started: float) -> int:
    return round((time.monotonic() - started) * 1000)


def plan_refresh(before: State, now: datetime, config: RefreshConfig) -> tuple[str, datetime]:
    """Phase of the next refresh and start of its scan."""
    if before.last_full is None:
        return "bootstrap", now - config.retention
    if now - before.last_full >= config.reconcile_every:
        return "reconcile", now - config.retention
    return "tick", since_bound(before.watermark, now, config.overlap, config.retention)


def publish_health(health: DataFrame, root: str, since: datetime, config: RefreshConfig = RefreshConfig()) -> None:
    """Stores the health of the window from ``since`` on; readers take the latest window that is complete."""
    health.select(*HEALTH.names).coalesce(1).write.mode("overwrite").parquet(f"{root}/health/since={_label(since)}")
    _forget(health.sparkSession, f"{root}/health", "since", since - config.keep)


def read_health(spark: SparkSession, root: str) -> DataFrame:
    folders = [f"{root}/health/since={label}" for label in labels_below(spark, f"{root}/health", "since")]
    whole = [folder for folder in folders if is_complete(spark, folder)]
    return spark.read.schema(HEALTH).parquet(whole[-1]) if whole else spark.createDataFrame([], HEALTH)


def refresh_health(
    spark: SparkSession, source: Source, root: str, now: datetime | str, config: RefreshConfig = RefreshConfig()
) -> None:
    """Recompute the health of the trailing window from its runs and publish it beside the grid."""
    since = as_instant(now) - config.health_window
    publish_health(app_health(source(since), since), root, since, config)


def refresh(
    spark: SparkSession, source: Source, root: str, now: datetime | str, config: RefreshConfig = RefreshConfig()
) -> Refresh:
    """Grid and health, each failing on its own; errors are reported, not raised."""
    now = as_instant(now)
    started = time.monotonic()
    phase = since = None
    try:
        state = current_state(spark, root)
        phase, since = plan_refresh(state, now, config)
        result = _refresh_planned(spark, source, root, now, config, state, phase, since)
    except Exception as failure:
        result = Refresh(phase, since, None, None, _millis_since(started), error=str(failure))
    try:
        refresh_health(spark, source, root, now, config)
    except Exception as failure:
        result = result._replace(health_error=str(failure))
    return result
