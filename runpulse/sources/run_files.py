"""Per-run JSON files, one event array per file, as a second source of runs."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: <APP>-log.<LOGGER>.<RUN_ID>.json
FILE_NAME = r"^(.+)-log\.([^.]+)\.([0-9a-fA-F-]{36})\.json$"
FILE_GLOB = "*-log.*.json"
# A task sends on its texts whenever it holds so many bytes of them, and its paths whenever it holds so many.
BATCH_BYTES, BATCH_PATHS = 4_000_000, 10_000


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """``app_name, logger, run_id, verbose_log, modified_at`` of the run files below ``path``.

    Files of other names are skipped, and so are hidden and empty ones. Name a folder, or a pattern of
    folders, rather than a pattern of files: what a pattern matches is gathered by the driver. Each file is
    one row; many small files share a task. Files of a file system that is mounted on every machine are
    listed by tasks, each folder by one, so the driver holds none of their names. For any other file system
    Spark's reader lists, and the driver holds the list.
    """
    roots = _mounted(spark, path)
    files = _read_by_spark(spark, path) if not roots else _read_in_tasks(spark, roots)
    return files.where(F.col("name").rlike(FILE_NAME)).select(
        F.regexp_extract("name", FILE_NAME, 1).alias("app_name"),
        F.regexp_extract("name", FILE_NAME, 2).alias("logger"),
        F.lower(F.regexp_extract("name", FILE_NAME, 3)).alias("run_id"),
        "verbose_log",
        "modified_at",
    )


def _mounted(spark: SparkSession, path: str) -> list[str]:
    """What ``path`` names, if that are files that tasks can open by name; else nothing."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.getUri().getScheme() != "file":
        return []
    return [found.getPath().toUri().getPath() for found in files.globStatus(top) or ()]


def _read_by_spark(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", FILE_GLOB).option("recursiveFileLookup", "true")
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("value").alias("verbose_log"),
    )


def _read_in_tasks(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The columns of ``_read_by_spark``: one stage lists the roots, one all folders in them, one reads the files."""

    def entries(folder: bytes, deep: bool) -> Iterator[tuple[bytes, bool]]:
        waiting = [folder]
        while waiting:
            with os.scandir(waiting.pop()) as found:
                for entry in found:
                    name = entry.name
                    if name.startswith(b".") or (name.startswith(b"_") and b"=" not in name):
                        continue  # as Spark does
                    if not entry.is_dir():
                        if b"-log." in name and name.endswith(b".json"):
                            yield entry.path, False
                    elif deep:
                        waiting.append(entry.path)
                    else:
                        yield entry.path, True

    def listing(rows: DataFrame, deep: bool) -> DataFrame:
        def below(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bool]]:
            for batch in batches:
                for path, folder in zip(batch["path"].to_pylist(), batch["folder"].to_pylist()):
                    if folder:
                        yield from entries(path, deep)
                    else:
                        yield path, False

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = below(batches)
            while some := list(islice(found, BATCH_PATHS)):
                columns = [pa.array([path for path, _ in some], pa.binary()), pa.array([folder for _, folder in some])]
                yield pa.RecordBatch.from_arrays(columns, ["path", "folder"])

        return rows.mapInArrow(each, "path binary, folder boolean")

    def rows_of(names: list[str], times: list[int], texts: list[bytes]) -> pa.RecordBatch:
        # Spark takes a text's bytes as they are, valid or not.
        columns = [pa.array(names, pa.string()), pa.array(times, pa.int64()), pa.array(texts, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["name", "modified_ms", "verbose_log"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, times, texts, held = [], [], [], 0
        for batch in batches:
            for path in batch["path"].to_pylist():
                with open(path, "rb") as file:
                    text, modified = file.read(), os.fstat(file.fileno()).st_mtime_ns // 1_000_000
                if not text:
                    continue
                names.append(os.path.basename(path).decode("utf-8", "replace"))
                times.append(modified)
                texts.append(text)
                held += len(text)
                if held >= BATCH_BYTES:
                    yield rows_of(names, times, texts)
                    names, times, texts, held = [], [], [], 0
        yield rows_of(names, times, texts)

    # A number given is kept: the rows are a path each, and by their size few tasks would do.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [(os.fsencode(root), os.path.isdir(root)) for root in roots]
    rows = listing(spark.createDataFrame(named, "path binary, folder boolean"), False)
    rows = listing(rows.repartition(tasks, "path"), True).repartition(tasks, "path")
    files = rows.mapInArrow(read, "name string, modified_ms long, verbose_log string")
    return files.select("name", F.timestamp_millis("modified_ms").alias("modified_at"), "verbose_log")
