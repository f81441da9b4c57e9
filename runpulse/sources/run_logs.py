"""The run-log table: one row per run, Parquet, a folder per UTC month and day of ``inserted_at``."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpulse.functions.instants import instant
from runpulse.functions.months import day_label, day_of, month_label, month_of, within_days
from runpulse.schemas import RUN_LOGS


def read_run_logs(
    spark: SparkSession,
    path: str,
    since: datetime | str,
    until: datetime | str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Runs with ``since <= inserted_at < until``; prunes month and day folders and row groups.

    Only the folders of those days are listed and opened, so the cost of a short read grows
    neither with the age of the table nor with the day of the month.
    """
    runs = read_days(spark, path, RUN_LOGS, since, until)
    return runs.select(*columns) if columns else runs


def read_days(
    spark: SparkSession, path: str, schema: T.StructType, since: datetime | str, until: datetime | str | None = None
) -> DataFrame:
    """Rows of a table of ``write_days`` with ``since <= inserted_at < until``."""
    folders = day_folders(spark, path, since, until)
    # Folders of days and of months are not read at once: their partition columns differ.
    layouts = [f for f in folders if "/day=" in f], [f for f in folders if "/day=" not in f]
    reader = spark.read.schema(schema).option("basePath", path)
    found = [reader.parquet(*same) for same in layouts if same] or [spark.createDataFrame([], schema)]
    rows = within_days(reduce(DataFrame.unionByName, found), since, until).where(F.col("inserted_at") >= instant(since))
    return rows if until is None else rows.where(F.col("inserted_at") < instant(until))


def day_folders(spark: SparkSession, path: str, since: datetime | str, until: datetime | str | None = None) -> list[str]:
    """The existing folders from ``since`` to ``until``: of days, or of months that have none for days.

    A table without month folders is its own folder.

    One listing of the top folder and one of each month in the bounds.
    """
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def below(folder: str, key: str, first: str, last: str) -> list[str]:
        names = [e.getPath().getName() for e in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))]
        labels = sorted(name.removeprefix(f"{key}=") for name in names if name.startswith(f"{key}="))
        kept = [f"{folder}/{key}={label}" for label in labels if first <= label <= last]
        return kept if labels else [folder]

    last_month, last_day = ("9999-12", "9999-12-31") if until is None else (month_label(until), day_label(until))
    months = below(path, "month", month_label(since), last_month)
    if months == [path]:
        return months
    return [day for month in months for day in below(month, "day", day_label(since), last_day)]


def write_days(rows: DataFrame, path: str) -> None:
    """Append ``rows`` in a folder per UTC month and day of ``inserted_at``.

    Rows stay in the tasks they are in, so a task writes a file per day that it holds; range
    partition many days by ``inserted_at`` first. A run looked up without a hint skips the row groups
    whose Bloom filter shows that they cannot hold its id.
    """
    at = F.col("inserted_at")
    dated = rows.withColumns({"month": month_of(at), "day": day_of(at)}).write.mode("append").partitionBy("month", "day")
    dated.option("parquet.bloom.filter.enabled#run_id", "true").parquet(path)


def months_from(label: str) -> str:
    """A folder pattern for the month ``label`` and all later ones.

    A later label has the same first digits and then a larger one: ``2026-09`` is matched by
    ``2026-09``, ``2026-[1-9]*``, ``202[7-9]*`` and so on.
    """
    larger = [f"{label[:i]}[{int(c) + 1}-9]*" for i, c in enumerate(label) if c.isdigit() and c < "9"]
    return "month={" + ",".join([label, *larger]) + "}"


def stream_run_logs(
    spark: SparkSession, path: str, since: datetime | str | None = None, max_files: int | None = None
) -> DataFrame:
    """The same table as a file stream.

    A file stream lists its folders at every trigger. With ``since`` only that month and
    later ones are listed, and older rows are left out.
    """
    reader = spark.readStream.schema(RUN_LOGS).option("basePath", path)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if since is None:
        return reader.parquet(path)
    recent = within_days(reader.parquet(f"{path}/{months_from(month_label(since))}"), since)
    return recent.where(F.col("inserted_at") >= instant(since))


def append_run_rows(df: DataFrame, path: str, app_name: str, now: datetime | str | None = None) -> None:
    """Append runs of one application.

    The caller supplies ``run_id, verbose_log, warn_error_logs`` and nothing else: the name
    is forced to ``app_name`` and the clock is the write time, so a self-logging writer
    cannot touch another application's rows. Rows stay in the tasks they are in; one write
    time means one day folder, hence one file per task.
    """
    written_at = F.current_timestamp() if now is None else instant(now)
    rows = df.select(
        F.lit(app_name).alias("app_name"),
        F.lower("run_id").alias("run_id"),
        written_at.alias("inserted_at"),
        "verbose_log",
        "warn_error_logs",
    )
    write_days(rows, path)
