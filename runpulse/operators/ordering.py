"""Global positions without funnelling all rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runpulse.session import shared_folder

# monotonically_increasing_id: task number above bit 33, row number in the task below.
_ROW_BITS = 33


def with_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Adds the 1-based position of each row in the total order ``order``.

    A row number over the whole table would be one task's work. Instead the rows are range
    partitioned and sorted, numbered inside their task and shifted by the number of rows in
    earlier tasks. Those counts are one row per task; how they are joined is left to the optimizer. The
    sorted rows are checkpointed in the shared folder in between, so the count and the numbering see
    the same task borders even when an executor is lost. So the call itself runs jobs, and the stored
    copy stays until the result is dropped (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_folder(df.sparkSession)
    local = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_slot", local).checkpoint()
    placed = placed.withColumn("_task", F.shiftright("_slot", _ROW_BITS))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_task")
        .agg(F.count("*").alias("_n"))
        .select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    row = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = placed.join(offsets, "_task")
    return numbered.withColumn(name, F.col("_before") + row + 1).drop("_task", "_slot", "_before")
