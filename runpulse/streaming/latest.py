"""Structured Streaming forms of the latest-run table and of the health panel."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runpulse.operators.grid import latest_runs, run_summaries
from runpulse.params import as_instant
from runpulse.schemas import LATEST_RUNS
from runpulse.streaming.panes import add_panes, read_panes, sliding_health
from runpulse.streaming.state import RefreshConfig, Source, add_rows, current_state, publish_health

Clock = Callable[[], datetime]

# A run in the state: when it was written, its id, and the rest as JSON.
_STATE = "at_us long, run_id string, rest string"
_REST = "started_us long, ended_us long, duration_ms long, status string, issue_count int"


def _utc_now() -> datetime:
    return datetime.now(timezone.utc)


def _keep_newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One job's newest run; told when it changes, and once more when it is so old that the job goes."""
    if state.hasTimedOut:
        newest, evicted = state.get, True
        state.remove()
    else:
        before = newest = state.get if state.exists else None
        for frame in frames:
            last = frame.sort_values(["at_us", "run_id"]).iloc[-1]
            found = (int(last["at_us"]), last["run_id"], last["rest"])
            newest = found if newest is None or found[:2] > tuple(newest[:2]) else newest
        evicted = False
        state.update(tuple(newest))
        # The timer goes off when the watermark has passed the run.
        state.setTimeoutTimestamp(max(newest[0] // 1000, state.getCurrentWatermarkMs() + 1))
        if before is not None and tuple(before) == tuple(newest):
            return
    yield pd.DataFrame([[*key, *newest, evicted]], columns=["app_name", "job", "at_us", "run_id", "rest", "evicted"])


def stream_latest_runs(stream: DataFrame, retention: timedelta = RefreshConfig.retention) -> DataFrame:
    """Latest run per (app, job) of a run-log stream, and ``evicted``, for an update-mode sink.

    The watermark trails the newest row by the ``retention``, so what Spark drops as late is what would be evicted at
    once; any other late row is merged, and an older row never replaces a newer one. The state is one row per
    job. A job whose newest run is older than the watermark leaves it, with a last row where ``evicted`` is true. As the
    watermark moves between micro-batches, that row comes a micro-batch later.
    """
    seconds = f"{retention.total_seconds():.0f} seconds"
    summaries = run_summaries(stream).withWatermark("inserted_at", seconds)
    times = {"started_us": "started_at", "ended_us": "ended_at"}
    rest = F.to_json(
        F.struct(*[F.unix_micros(c).alias(n) for n, c in times.items()], "duration_ms", "status", "issue_count")
    )
    narrow = summaries.select("app_name", "job", "inserted_at", F.unix_micros("inserted_at").alias("at_us"), "run_id", rest.alias("rest"))
    kept = narrow.groupBy("app_name", "job").applyInPandasWithState(
        _keep_newest,
        f"app_name string, job string, {_STATE}, evicted boolean",
        _STATE,
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )
    read = kept.select("*", F.from_json("rest", _REST).alias("r")).withColumns(
        {"inserted_at": F.timestamp_micros("at_us")}
        | {c: F.timestamp_micros(F.col("r")[n]) for n, c in times.items()}
        | {n: F.col("r")[n] for n in ("duration_ms", "status", "issue_count")}
    )
    return read.select(*LATEST_RUNS.names, "evicted")


def maintain_latest(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    clock: Clock = _utc_now,
    config: RefreshConfig = RefreshConfig(),
) -> DataStreamWriter:
    """A writer that merges every micro-batch into the latest-run table below ``root``.

    The table is the state, with eviction; the query itself keeps none. A micro-batch that
    is run again after a failure replaces what it added. The caller sets a trigger and
    starts it, and goes on scheduling ``refresh_latest`` for the reconciling scans.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        now = as_instant(clock())
        state = current_state(batch.sparkSession, root)
        name, floor = f"stream-{batch_id:012d}", now - config.retention
        add_rows(latest_runs(batch), root, state.generation, name, floor, state.watermark, mode="overwrite")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def stream_app_health(
    stream: DataFrame,
    source: Source,
    root: str,
    checkpoint: str,
    clock: Clock = _utc_now,
    config: RefreshConfig = RefreshConfig(),
) -> DataStreamWriter:
    """A writer that publishes the trailing-window health whenever runs arrive.

    A micro-batch reads its own rows, for their minute panes, and the one minute of ``source`` that the window starts
    in. The panes below ``root`` belong to this query's checkpoint: the stream must begin with the first window, and
    a new checkpoint needs a new ``root``.
    """
    panes = f"{root}/panes"

    def publish(batch: DataFrame, batch_id: int) -> None:
        add_panes(batch, panes, batch_id)
        since = as_instant(clock()) - config.health_window
        health = sliding_health(read_panes(batch.sparkSession, panes, since), source(since), since)
        publish_health(health, root, since, config)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
