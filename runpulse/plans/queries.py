"""Every operator as a named query over the given tables. ``oracle.py`` has the same in SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import reduce, wraps

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpulse import functions as fn
from runpulse import operators as op
from runpulse import sources as src
from runpulse import streaming as st
from runpulse.functions.labels import status_rank
from runpulse.operators.feeds import run_events
from runpulse.operators.grid import run_summaries
from runpulse.params import as_instant
from runpulse.plans import bridge
from runpulse.plans.bridge import ACQUISITIONS_SINCE, NOW
from runpulse.session import prepare, scratch_path
from runpulse.streaming.latest import stream_app_health

Query = Callable[[SparkSession, str], DataFrame]

RETENTION_START = NOW - timedelta(days=30)
DAY_AGO = NOW - timedelta(hours=24)
RUN_DAY = "2024-01-15"
# The id that the bridge's rule gives one user's run of one day.
RUN_ID = str(uuid.UUID(hashlib.md5(f"run|7|{RUN_DAY}".encode()).hexdigest()))
# Where the incremental queries split the history.
SPLIT = "2024-01-20T00:00:00+00:00"
APP = "app_1"

REGISTRY: dict[str, Query] = {}


def _comparable(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and JSON text, which every checker can read."""
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz").alias(field.name)
        elif isinstance(field.dataType, T.VariantType):
            col = F.to_json(col).alias(field.name)
        columns.append(col)
    return df.select(*columns)


def query(build: Query) -> Query:
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _comparable(build(prepare(spark), sf_dir))

    REGISTRY[build.__name__] = run
    return run


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latest_runs(bridge.run_logs(spark, sf_dir), RETENTION_START)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.job_grid(_latest(spark, sf_dir), bridge.schedules(spark), NOW)



# --- sources, sinks and assembly -------------------------------------------------------------

@query
def assemble_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.run_logs(spark, sf_dir)


def _stored_logs(spark: SparkSession, sf_dir: str) -> str:
    """The run-log table as day folders in the shared scratch folder."""
    path = scratch_path(spark, "run-logs")
    src.write_days(bridge.run_logs(spark, sf_dir).repartitionByRange("inserted_at"), path)
    return path


@query
def read_run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_logs(spark, sf_dir)
    columns = ["app_name", "run_id", "inserted_at", "warn_error_logs", "month", "day"]
    return src.read_run_logs(spark, path, "2024-01-05", "2024-01-25", columns)


@query
def append_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run appended again as the monitor's own, at one write time."""
    path = scratch_path(spark, "appended")
    src.append_run_rows(bridge.run_logs(spark, sf_dir), path, "monitor", NOW)
    return src.read_run_logs(spark, path, NOW).drop("verbose_log")


def _write_run_files(folder: str) -> Callable:
    """A task function that stores each run as a file of its own; a repeated task writes the same files.

    The files lie in folders by the first digits of the run id, so that many tasks can list them.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for row in batch.itertuples():
                inside = f"{root}/{row.run_id[:2]}"
                if inside not in made:
                    files.create_dir(inside)
                    made.add(inside)
                # A reader never sees half a file, whatever becomes of the task.
                begun = f"{inside}/.{row.run_id}-{uuid.uuid4().hex}"
                with files.open_output_stream(begun) as out:
                    out.write(row.verbose_log.encode())
                files.move(begun, f"{inside}/{row.app_name}-log.dev.{row.run_id}.json")
            yield batch[["run_id"]]

    return write


@query
def read_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "run-files")
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(top)
    uri = files.makeQualified(top).toUri().toString()
    runs = bridge.run_logs(spark, sf_dir).select("app_name", "run_id", "verbose_log")
    runs.mapInPandas(_write_run_files(uri), "run_id string").write.format("noop").mode("overwrite").save()
    return src.read_run_files(spark, folder).drop("modified_at")


@query
def read_acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "acquisitions")
    src.write_acquisitions(bridge.acquisitions(spark, sf_dir).withColumn("run_id", F.lit(None).cast("string")), path)
    return src.read_acquisitions(spark, path, ACQUISITIONS_SINCE).select(
        "system_id", "data_source", "manufacturer", "modality", "successful_acquisition", "inserted_at"
    )


@query
def read_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored state tables with further columns, read back without them."""
    paths = []
    for name, state in zip(("hhm", "mmb"), bridge.connectivity_tables(spark, sf_dir)):
        paths.append(scratch_path(spark, name))
        state.withColumn("lifetime_total", F.lit(1)).write.parquet(paths[-1])
    return src.read_connectivity(spark, *paths)


# --- the run contract ------------------------------------------------------------------------

@query
def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_events(bridge.run_logs(spark, sf_dir)).drop("inserted_at", "started_at", "ended_at", "duration_ms")


@query
def run_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summaries(bridge.run_logs(spark, sf_dir))


@query
def run_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    timing = fn.run_timing(F.col("verbose_log"))
    return bridge.dirty_runs(spark, sf_dir).select("run_id", timing.alias("t")).select("run_id", "t.*")


@query
def issue_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = fn.issue_subset(fn.event_fields(F.col("verbose_log"), "dt", "type"))
    return bridge.run_logs(spark, sf_dir).select("run_id", F.array_join(issues["dt"], ",").alias("issue_dts"))


@query
def dirty_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc")
    return bridge.dirty_arrays(spark, sf_dir).select(
        "event_id",
        fn.derive_status(doc).alias("status"),
        fn.issue_count(doc).alias("issue_count"),
        F.size(fn.parse_events(doc)).alias("elements"),
    )


@query
def safe_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.dirty_dts(spark, sf_dir).select("event_id", "dt", fn.safe_ts(F.col("dt")).alias("instant"))


@query
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return bridge.table(spark, sf_dir, "events").select(
        "event_id",
        fn.iso_micros(ts).alias("micros"),
        fn.iso_seconds(ts).alias("seconds"),
        fn.age_ms(ts, NOW).alias("age_ms"),
    )


@query
def summarize_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.table(spark, sf_dir, "documents").select("doc_id", fn.summarize_error(F.col("text")).alias("summary"))


@query
def contract_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.contract_audit(bridge.dirty_runs(spark, sf_dir))


@query
def contract_audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.contract_audit(bridge.dirty_issues(spark, sf_dir))


@query
def stored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs parsed once and stored, read back for a part of the month."""
    path = scratch_path(spark, "summaries")
    src.append_summaries(bridge.run_logs(spark, sf_dir).repartitionByRange("inserted_at"), path)
    return src.read_summaries(spark, path, "2024-01-05", "2024-01-25")


@query
def latest_of_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "summaries")
    src.append_summaries(bridge.run_logs(spark, sf_dir).repartitionByRange("inserted_at"), path)
    return op.latest_runs(src.read_summaries(spark, path, RETENTION_START), RETENTION_START)


# --- the grid --------------------------------------------------------------------------------

@query
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


@query
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op.staleness(_latest(spark, sf_dir), bridge.schedules(spark), NOW)
    return judged.select("app_name", "job", "age_ms", "budget_ms", "stale")


@query
def job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query
def cadence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cadence_coverage(_grid(spark, sf_dir), bridge.schedules(spark))


@query
def unknown_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unknown_jobs(_grid(spark, sf_dir), bridge.schedules(spark))


def _sorted(key: str, direction: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = op.sort_jobs(_grid(spark, sf_dir), key, direction, position="pos")
        return grid.select("pos", "app", "job", "status", "age_ms", "duration_ms", "issue_count")

    build.__name__ = f"sort_jobs_{key.lower()}_{direction}"
    query(build)


KEYS = ("app", "job", "status", "lastRun", "age", "duration", "issues")
for _key in (*KEYS, "other"):
    for _direction in ("asc", "desc"):
        _sorted(_key, _direction)


def _sorted_runs(key: str, direction: str) -> None:
    """Every broken run as a job of its own: thousands of rows, with nulls and ties."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        runs = run_summaries(bridge.dirty_runs(spark, sf_dir)).withColumn("job", F.col("run_id"))
        grid = op.sort_jobs(op.job_grid(runs, bridge.schedules(spark), NOW), key, direction, position="pos")
        return grid.select("pos", "app", "job", "status", "age_ms", "duration_ms", "issue_count")

    build.__name__ = f"sort_runs_{key}_{direction}"
    query(build)


for _key, _direction in (("duration", "asc"), ("duration", "desc"), ("issues", "asc"), ("status", "asc")):
    _sorted_runs(_key, _direction)


def _grouped(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    positioned = op.sort_jobs(_grid(spark, sf_dir), "status", "asc", position="pos")
    return op.group_jobs(positioned, by).select("group_key", "group_pos", "pos", "app", "job", "status")


@query
def group_jobs_by_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, "app")


@query
def group_jobs_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, "job")


@query
def group_jobs_by_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, "none")


@query
def filter_jobs_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_jobs(_grid(spark, sf_dir), None, ["ERROR", "STALE"]).select("app", "job", "run_id", "status", "stale")


@query
def group_rollup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.group_rollup_status(_grid(spark, sf_dir), "app")


@query
def filter_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_jobs(_grid(spark, sf_dir), " job_1", ["WARN", "STALE"]).select("app", "job", "run_id", "status", "stale")


@query
def summarize_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.summarize_grid(_grid(spark, sf_dir))


# --- feeds -----------------------------------------------------------------------------------

@query
def error_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.error_feed(bridge.run_logs(spark, sf_dir), NOW)


@query
def error_feed_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.error_feed(bridge.run_logs(spark, sf_dir), NOW, lookback_days=7, limit=500)


@query
def error_feed_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More events than any page would show."""
    return op.error_feed(bridge.run_logs(spark, sf_dir), NOW, lookback_days=31, limit=1000)


def _feed_by_days(spark: SparkSession, sf_dir: str, lookback_days: int, limit: int) -> DataFrame:
    path, parts = _stored_logs(spark, sf_dir), scratch_path(spark, "feed-parts")
    src.store_feed_parts(bridge.run_logs(spark, sf_dir), parts)
    return src.error_feed_by_days(spark, path, parts, NOW, lookback_days, limit)


@query
def error_feed_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's window, of which only the newest days are read."""
    return _feed_by_days(spark, sf_dir, 31, 300)


@query
def feed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.feed_parts(bridge.run_logs(spark, sf_dir))


@query
def run_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.run_by_id(bridge.run_logs(spark, sf_dir), RUN_ID)


@query
def run_by_id_hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hint is the run's own write time, as the grid would carry it."""
    runs = bridge.run_logs(spark, sf_dir)
    found = op.run_by_id(runs, RUN_ID).select(fn.iso_micros(F.col("inserted_at"))).head()
    return op.run_by_id(runs, RUN_ID, found[0] if found else f"{RUN_DAY}T00:00:00Z")


@query
def run_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No hint: the index of run ids names the day."""
    path, index = _stored_logs(spark, sf_dir), scratch_path(spark, "run-index")
    src.append_run_index(bridge.run_logs(spark, sf_dir), index)
    return src.run_by_index(spark, path, index, RUN_ID.upper())


@query
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every run is stored, by bucket."""
    index = scratch_path(spark, "run-index")
    src.append_run_index(bridge.run_logs(spark, sf_dir), index)
    return spark.read.parquet(index)


@query
def run_by_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of hours, stored under an upper-case id, by the lower-case id and the time of its first event."""
    runs = bridge.run_logs(spark, sf_dir).withColumn("run_id", F.upper("run_id"))
    started = run_summaries(runs.where(F.lower("run_id") == RUN_ID)).select(fn.iso_micros(F.col("started_at"))).head()
    return op.run_by_id(runs, RUN_ID, started[0] if started else f"{RUN_DAY}T00:00:00Z")


@query
def run_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.run_timeline(bridge.run_logs(spark, sf_dir), RUN_ID)


@query
def app_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.app_runs(bridge.run_logs(spark, sf_dir), APP, RETENTION_START)


@query
def app_runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.app_runs_page(bridge.run_logs(spark, sf_dir), APP, RETENTION_START)


@query
def app_runs_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first, by the first one's cursor."""
    runs = bridge.run_logs(spark, sf_dir)
    first = op.fetch_page(op.app_runs_page(runs, APP, RETENTION_START, limit=50), limit=50)
    return op.app_runs_page(runs, APP, RETENTION_START, limit=50, cursor=first.cursor)


@query
def app_runs_pages_to_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.app_runs_pages(bridge.run_logs(spark, sf_dir), APP, RETENTION_START, 600).drop("page", "place")


@query
def app_runs_upper_case_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids stored in upper case, half of the runs at one instant with others."""
    runs = bridge.run_logs(spark, sf_dir).withColumn("run_id", F.upper("run_id"))
    return op.app_runs_pages(runs, APP, RETENTION_START, 300).drop("inserted_at_iso", "page", "place")


@query
def app_runs_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = op.app_runs_pages(bridge.run_logs(spark, sf_dir), APP, RETENTION_START, 50, "issues")
    return pages.select("page", "place", "run_id", "inserted_at", "status", "issue_count")


@query
def app_runs_page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page_cursors(op.app_runs_pages(bridge.run_logs(spark, sf_dir), APP, RETENTION_START, 50), 50)


@query
def app_runs_error_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.app_runs_page(bridge.run_logs(spark, sf_dir), APP, RETENTION_START, status="error")


@query
def app_runs_issue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.app_runs_page(bridge.run_logs(spark, sf_dir), APP, RETENTION_START, status="issues")


@query
def app_runs_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inline peek: twelve hours, fifty newest."""
    return op.app_runs_page(bridge.run_logs(spark, sf_dir), APP, NOW - timedelta(hours=12), limit=50)


# --- health and cadence ----------------------------------------------------------------------

@query
def app_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.app_health(bridge.run_logs(spark, sf_dir), DAY_AGO)


@query
def health_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = op.app_health(bridge.run_logs(spark, sf_dir), DAY_AGO)
    return health.select("app_name", op.health_label(24).alias("label"))


@query
def cadence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cadence_profile(bridge.run_logs(spark, sf_dir), NOW)


@query
def cadence_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile from parts per day, stored in two goes."""
    path, runs = scratch_path(spark, "cadence-parts"), bridge.run_logs(spark, sf_dir)
    for days in (F.col("inserted_at") < fn.instant(SPLIT), F.col("inserted_at") >= fn.instant(SPLIT)):
        src.store_cadence_parts(runs.where(days), path)
    since = NOW - timedelta(days=7)
    return op.cadence_of_parts(src.read_cadence_parts(spark, path, since), runs, NOW)


@query
def budget_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = op.cadence_profile(bridge.run_logs(spark, sf_dir), NOW)
    return op.budget_audit(profile, bridge.schedules(spark))


# --- connectivity and acquisition ------------------------------------------------------------

def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.connectivity_union(*bridge.connectivity_tables(spark, sf_dir))


@query
def connectivity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(spark, sf_dir)


@query
def connectivity_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = op.connectivity_panel(_union(spark, sf_dir), NOW, position="pos")
    return panel.withColumn("status_rank", status_rank(F.col("status"), "connectivity"))


@query
def connectivity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.connectivity_rollup(op.connectivity_panel(_union(spark, sf_dir), NOW))


@query
def acquisition_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.acquisition_systems(bridge.acquisitions(spark, sf_dir), ACQUISITIONS_SINCE, position="pos")


@query
def acquisition_systems_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from parts per day, with the window starting in the middle of one."""
    path, acq = scratch_path(spark, "acquisition-parts"), bridge.acquisitions(spark, sf_dir)
    src.store_acquisition_parts(acq, path)
    parts = src.read_acquisition_parts(spark, path, ACQUISITIONS_SINCE)
    return op.systems_of_parts(parts, acq, ACQUISITIONS_SINCE, position="pos")


@query
def acquisition_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.acquisition_by_source(op.acquisition_systems(bridge.acquisitions(spark, sf_dir), ACQUISITIONS_SINCE))


# --- incremental and streaming ---------------------------------------------------------------

def _source(spark: SparkSession, path: str, until: datetime | str | None = None) -> Callable:
    return lambda since: src.read_run_logs(spark, path, since, until)


@query
def merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State up to the split, merged with everything from an hour before it."""
    runs = bridge.run_logs(spark, sf_dir)
    split = fn.instant(SPLIT)
    state = op.latest_runs(runs.where(F.col("inserted_at") < split), RETENTION_START)
    batch = op.latest_runs(runs.where(F.col("inserted_at") >= split - F.expr("INTERVAL 1 HOUR")))
    return st.merge_latest(state, batch, NOW)


@query
def evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.evict(_latest(spark, sf_dir), NOW, timedelta(hours=1))


@query
def refresh_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap up to the split, then one tick from the watermark."""
    path, root = _stored_logs(spark, sf_dir), scratch_path(spark, "state")
    config = st.RefreshConfig(reconcile_every=timedelta(days=365))
    st.refresh_latest(spark, _source(spark, path, SPLIT), root, SPLIT, config)
    st.refresh_latest(spark, _source(spark, path), root, NOW, config)
    return st.read_latest(spark, root)


@query
def refresh_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application's rows arrive late: the tick misses most of them, the reconcile none."""
    path, root = _stored_logs(spark, sf_dir), scratch_path(spark, "state")
    arrived = _source(spark, path)
    st.refresh_latest(spark, lambda since: arrived(since).where("app_name <> 'app_3'"), root, NOW - timedelta(hours=7))
    st.refresh_latest(spark, arrived, root, NOW - timedelta(hours=6))
    st.refresh_latest(spark, arrived, root, NOW)
    return st.read_latest(spark, root)


@query
def refresh_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state and the scan after each of four refreshes: bootstrap, tick, a failed one, reconcile.

    The bootstrap misses the later rows of one application. The tick reads from its watermark
    less the overlap, so it misses most of them too; the reconcile finds them all.
    """
    path, root = _stored_logs(spark, sf_dir), scratch_path(spark, "state")
    split = as_instant(SPLIT)
    late = (F.col("app_name") == "app_3") & (F.col("inserted_at") >= fn.instant("2024-01-10"))
    late = late & (F.col("inserted_at") < fn.instant(split - timedelta(minutes=6)))
    steps = {
        "1 bootstrap": (split, lambda since: _source(spark, path, SPLIT)(since).where(~late)),
        "2 tick": (split + timedelta(hours=1), _source(spark, path, split + timedelta(hours=1))),
        "3 failed": (split + timedelta(hours=2), lambda since: spark.read.parquet(f"{path}-missing")),
        "4 reconcile": (split + timedelta(hours=7), _source(spark, path, split + timedelta(hours=7))),
    }
    states = []
    for name, (now, source) in steps.items():
        done = st.refresh(spark, source, root, now)
        assert (done.error is not None) == (name == "3 failed")
        said = [F.lit(name).alias("step"), F.lit(done.phase).alias("phase"), fn.instant(done.since).alias("since")]
        watermark = fn.instant(done.watermark) if done.watermark else F.lit(None).cast("timestamp")
        state = st.read_latest(spark, root).select("app_name", "job", "run_id", "inserted_at")
        states.append(state.select(*said, watermark.alias("watermark"), "*"))
    return reduce(DataFrame.unionByName, states)


@query
def refresh_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = _stored_logs(spark, sf_dir), scratch_path(spark, "state")
    st.refresh_health(spark, _source(spark, path), root, NOW)
    return st.read_health(spark, root)


@query
def maintain_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run logs as a file stream, merged batch by batch into the state table."""
    path, root = _stored_logs(spark, sf_dir), scratch_path(spark, "state")
    stream = src.stream_run_logs(spark, path, max_files=12)
    writer = st.maintain_latest(stream, root, scratch_path(spark, "progress"), clock=lambda: NOW)
    writer.trigger(availableNow=True).start().awaitTermination()
    return st.read_latest(spark, root)


@query
def stream_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful form, drained in update mode; the last update of each key is the result."""
    path, out = _stored_logs(spark, sf_dir), scratch_path(spark, "updates")
    updates = st.stream_latest_runs(src.stream_run_logs(spark, path, max_files=12))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    writer = updates.writeStream.outputMode("update").foreachBatch(keep)
    progress = scratch_path(spark, "progress")
    writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    last = op.latest_of(spark.read.parquet(out), F.desc("batch"))
    return last.where("NOT evicted").drop("batch", "evicted")


@query
def stream_latest_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appended slices through the stateful form with five days of retention.

    Of the first slice one application comes late, with the second; another has no runs in the third, and so leaves
    the state. What is left must be what the batch form finds in all runs, evicted against the newest.
    """
    path, out = scratch_path(spark, "run-logs"), scratch_path(spark, "updates")
    progress, runs = scratch_path(spark, "progress"), bridge.run_logs(spark, sf_dir)
    at, app = F.col("inserted_at"), F.col("app_name")
    first, second = at < fn.instant("2024-01-12"), at < fn.instant("2024-01-20")
    slices = [first & (app != "app_2"), (second & ~first) | (first & (app == "app_2")), ~second & (app != "app_3")]
    for number, rows in enumerate(slices):
        src.write_days(runs.where(rows).repartitionByRange("inserted_at").drop("month", "day"), path)
        updates = st.stream_latest_runs(src.stream_run_logs(spark, path), timedelta(days=5))

        def keep(batch: DataFrame, batch_id: int, number: int = number) -> None:
            told = batch.withColumns({"slice": F.lit(number), "batch": F.lit(batch_id)})
            told.write.mode("append").parquet(out)

        writer = updates.writeStream.outputMode("update").foreachBatch(keep)
        writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    last = op.latest_of(spark.read.parquet(out), F.desc("batch"))
    return last.where("NOT evicted").drop("slice", "batch", "evicted")


@query
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = _stored_logs(spark, sf_dir), scratch_path(spark, "state")
    stream = src.stream_run_logs(spark, path)
    writer = stream_app_health(stream, _source(spark, path), root, scratch_path(spark, "progress"), clock=lambda: NOW)
    writer.trigger(availableNow=True).start().awaitTermination()
    return st.read_health(spark, root)


@query
def stream_health_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published health after each of three slices of runs, with the window ending at odd instants."""
    path, root, progress = (scratch_path(spark, name) for name in ("run-logs", "state", "progress"))
    runs, ticks = bridge.run_logs(spark, sf_dir), []
    config = st.RefreshConfig(keep=timedelta(days=365))
    bounds = [as_instant(t) for t in ("2024-01-01", "2024-01-12T09:30:17", "2024-01-20T18:00:00.000001", "2024-02-01")]
    for since, until in zip(bounds, bounds[1:]):
        some = runs.where((F.col("inserted_at") >= fn.instant(since)) & (F.col("inserted_at") < fn.instant(until)))
        src.write_days(some.repartitionByRange("inserted_at").drop("month", "day"), path)
        now = min(until, NOW)
        stream = src.stream_run_logs(spark, path)
        writer = stream_app_health(stream, _source(spark, path), root, progress, lambda now=now: now, config)
        writer.trigger(availableNow=True).start().awaitTermination()
        ticks.append(st.read_health(spark, root).withColumn("tick", fn.instant(now)))
    return reduce(DataFrame.unionByName, ticks)


@query
def heartbeat_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beat about the grid, after a refresh that failed."""
    last = st.Refresh("tick", DAY_AGO, None, None, 42, error=" connection\n\trefused ")
    metrics = st.refresh_metrics(_grid(spark, sf_dir), bridge.schedules(spark), last, NOW)
    metrics = metrics.withColumn("run_id", bridge.uuid_of(F.lit("beat")))
    return st.heartbeat_run(metrics, NOW, "monitor")
