"""Connectivity state and acquisition history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpulse.functions.instants import instant
from runpulse.functions.months import month_of
from runpulse.operators.connectivity import connectivity_union
from runpulse.schemas import ACQUISITIONS, CONNECTIVITY
from runpulse.sources.run_logs import read_days


def read_connectivity(spark: SparkSession, hhm_path: str, mmb_path: str) -> DataFrame:
    """Both current-state tables in full, labelled by source; unread columns never leave the files."""
    hhm, mmb = (spark.read.schema(CONNECTIVITY).parquet(p) for p in (hhm_path, mmb_path))
    return connectivity_union(hhm, mmb)


def read_acquisitions(spark: SparkSession, path: str, since: datetime | str) -> DataFrame:
    """Acquisitions with ``inserted_at > since``; older month folders and row groups are skipped."""
    stored = T.StructType([*ACQUISITIONS.fields, T.StructField("month", T.StringType())])
    recent = read_days(spark, path, stored, since).where(F.col("inserted_at") > instant(since))
    return recent.select(*ACQUISITIONS.names)


def write_acquisitions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store a folder per UTC month, in ``inserted_at`` order, which keeps each row group's min/max narrow.

    The run and system ids split a range that one bulk insert filled with a single instant.
    """
    keys = ["inserted_at", "system_id", "run_id"]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.withColumn("month", month_of(F.col("inserted_at"))).write.mode(mode).partitionBy("month").parquet(path)
