"""Helpers the operators of this package share: columns by exact name, stored tables, prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runpulse.session import scratch_path

#: Texts are worked on in slices of about so many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 2_000_000
#: Parts in which a sample's groups are thinned out.
SAMPLE_PARTS = 32
#: Narrow tables of so many rows are sent to every task, some 20 MB.
BROADCAST_ROWS = 500_000

T = TypeVar("T")

_NOTED: ContextVar[list[str] | None] = ContextVar("_NOTED", default=None)


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where it is not installed but lies in a folder they can read."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, also where others differ from them in case only."""
    marks = [f"_c{i}" for i in range(len(df.columns))]
    marked = df.toDF(*marks)
    return marked.select(*[F.col(marks[df.columns.index(name)]).alias(name) for name in names])


def store(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, on files no executor owns."""
    path = scratch_path(df.sparkSession, label)
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def if_small(df: DataFrame) -> DataFrame:
    """``df``, a stored table of a few numbers a row, to be sent to every task if it has few rows; else joined."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def discard(*stored: DataFrame) -> None:
    """Deletes tables of ``store`` that nothing reads any more."""
    for df in stored:
        delete_paths(df.sparkSession, df.stored_at)


def delete_paths(spark: SparkSession, *paths: str) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def noting_stored() -> Iterator[list[str]]:
    """A list to which ``store`` adds the path of each table that it writes meanwhile."""
    token = _NOTED.set(noted := [])
    try:
        yield noted
    finally:
        _NOTED.reset(token)


def running_totals(df: DataFrame, order: Sequence[Column], sums: Sequence[str], label: str) -> DataFrame:
    """Adds ``pos`` (from 0) and, for each column of ``sums``, ``<column>_before``: the sum over all earlier rows.

    The rows are range partitioned by ``order`` and sorted, and the borders are fixed by storing
    them. A task's total is one row; offsets are running sums over those, one row per task. The
    running sum inside a task's rows is then shifted by its offset. Rows equal in ``order`` keep
    the order they are read in, and may be split between tasks, so a repeated key makes no hot task.
    """
    keyed = df.withColumn("_rt_tie", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange(*order, F.col("_rt_tie")).sortWithinPartitions(*order, F.col("_rt_tie"))
    placed = placed.withColumn("_rt_task", F.spark_partition_id()).withColumn("_rt_row", F.monotonically_increasing_id())
    stored = store(placed.drop("_rt_tie"), label)
    earlier = Window.orderBy("_rt_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_rt_task").agg(F.count("*").alias("_rt_n"), *[F.sum(c).alias(f"_rt_n_{c}") for c in sums])
    offsets = totals.select(
        F.col("_rt_task"),
        F.coalesce(F.sum("_rt_n").over(earlier), F.lit(0)).alias("_rt_at"),
        *[F.coalesce(F.sum(f"_rt_n_{c}").over(earlier), F.lit(0)).alias(f"_rt_at_{c}") for c in sums],
    )
    inside = Window.partitionBy("_rt_task").orderBy("_rt_row")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = stored.select(
        "*",
        F.row_number().over(inside).alias("_rt_place"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_rt_in_{c}") for c in sums],
    )
    return local.join(offsets, "_rt_task").select(
        *df.columns,
        (F.col("_rt_at") + F.col("_rt_place") - 1).alias("pos"),
        *[(F.col(f"_rt_at_{c}") + F.col(f"_rt_in_{c}")).alias(f"{c}_before") for c in sums],
    )


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: each holds one row or at most ``most`` bytes of ``column``."""
    for batch in batches:
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        for at, length in enumerate(lengths):
            if at > start and size + length > most:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += length
        if start < len(lengths):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts, a null as an empty one."""
    texts = batch[column]
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_binary())
    elif pa.types.is_string(texts.type):
        texts = texts.cast(pa.binary())
    return [raw or b"" for raw in texts.to_pylist()]


def utf8(column: str) -> Column:
    """The text's bytes, as the Python side takes them; keeps the column's name."""
    return F.col(column).cast("binary").alias(column)


def add_columns(
    df: DataFrame,
    text: str,
    fields: Mapping[str, str],
    compute: Callable[[list[bytes]], list[pa.Array]],
    keep_text: bool = True,
) -> DataFrame:
    """``df`` with the columns ``fields`` (name to type) that ``compute`` makes of each whole text.

    Columns of ``df`` with such a name are replaced. The text goes to the Python worker once.
    """
    at = df.columns.index(text)
    kept = [i for i, name in enumerate(df.columns) if name not in fields and (keep_text or i != at)]
    mark = [f"_c{i}" for i in range(len(df.columns))]
    marked = df.toDF(*mark)
    kinds = [f"`{mark[i]}` {marked.schema[i].dataType.simpleString()}" for i in kept]
    kinds += [f"`_new{n}` {kind}" for n, kind in enumerate(fields.values())]
    names = [mark[i] for i in kept] + [f"_new{n}" for n in range(len(fields))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, mark[at]):
            found = compute(texts_of(batch, mark[at]))
            yield pa.RecordBatch.from_arrays([*(batch[mark[i]] for i in kept), *found], names)

    sent = marked.select(*[mark[i] for i in sorted({*kept, at})])
    return sent.mapInArrow(add, ", ".join(kinds)).toDF(*[df.columns[i] for i in kept], *fields)


def hashed_sample(rows: DataFrame, group: str, number: int, key: str = "doc_id") -> DataFrame:
    """At most ``number`` rows of each ``group``: those with the smallest hash of ``key``.

    A group is first thinned out in ``SAMPLE_PARTS`` parts, so what meets in one task in the end is at
    most that many times ``number`` rows, however large the group is and however many tasks there are.
    """
    order = [F.xxhash64(key), F.col(key)]
    part = F.pmod(F.xxhash64(key), F.lit(SAMPLE_PARTS))
    for window in (Window.partitionBy(group, part), Window.partitionBy(group)):
        rows = rows.withColumn("_n", F.row_number().over(window.orderBy(*order))).where(F.col("_n") <= number)
    return rows.drop("_n")


_REMEMBERED: dict[Hashable, object] = {}


def remembered(key: Hashable, build: Callable[[], T]) -> T:
    """What ``build`` made, kept by this Python worker from task to task.

    Only the last thing is kept: a worker serves one stage after another, and their memories of words
    must not add up.
    """
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = build()
    return _REMEMBERED[key]
