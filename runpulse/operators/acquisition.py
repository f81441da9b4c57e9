"""Acquisition outcomes per system and per source."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.functions.instants import instant, iso_seconds
from runpulse.functions.months import day_label, day_of
from runpulse.functions.text import blank_to_null
from runpulse.operators.domain import over_domain
from runpulse.operators.ordering import with_position
from runpulse.params import as_instant

SOURCES = ("hhm", "mmb")
SYSTEM = ("system_id", "data_source")


def systems_order(collation: str | None = None) -> list[Column]:
    """Most failures first, then most runs, then the system."""
    system = F.collate(F.col("system_id"), collation) if collation else F.col("system_id")
    return [F.desc("failed"), F.desc("runs"), system.asc(), F.col("data_source").asc()]


def acquisition_systems(
    acq: DataFrame, since: datetime | str, collation: str | None = None, position: str | None = None
) -> DataFrame:
    """Per (system, source) with ``inserted_at > since``: runs, failures, last seen, worst first.

    A missing outcome counts as a run, not as a failure. The maximum of a text has no place
    in a hash aggregate, so the rows are first counted per distinct text (hash, combined
    before the shuffle) and the maxima taken over what little remains.
    """
    recent = acq.where(F.col("inserted_at") > instant(since))
    return _systems(_summed(recent, SYSTEM), collation, position)


def _summed(acq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group of ``keys`` the sums and maxima of its acquisitions, which add up with those of other groups."""
    distinct = acq.groupBy(*keys, "manufacturer", "modality").agg(
        F.count("*").alias("runs"),
        F.count_if(~F.col("successful_acquisition")).alias("failed"),
        F.max("inserted_at").alias("last"),
    )
    return _added(distinct, keys)


def _added(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.max("manufacturer").alias("manufacturer"),
        F.max("modality").alias("modality"),
        F.sum("runs").alias("runs"),
        F.sum("failed").alias("failed"),
        F.max("last").alias("last"),
    )


def _systems(summed: DataFrame, collation: str | None, position: str | None) -> DataFrame:
    systems = summed.select(
        *SYSTEM,
        blank_to_null(F.col("manufacturer")).alias("manufacturer"),
        blank_to_null(F.col("modality")).alias("modality"),
        "runs",
        "failed",
        iso_seconds(F.col("last")).alias("last_seen"),
    )
    order = systems_order(collation)
    return with_position(systems, order, position) if position else systems.orderBy(*order)


def acquisition_parts(acq: DataFrame) -> DataFrame:
    """Per UTC day, system and source: runs, failures, last seen and the largest texts, for windows to add up."""
    return _summed(acq.withColumn("day", day_of(F.col("inserted_at"))), (*SYSTEM, "day"))


def systems_of_parts(
    parts: DataFrame, acq: DataFrame, since: datetime | str, collation: str | None = None, position: str | None = None
) -> DataFrame:
    """``acquisition_systems`` from stored parts; of ``acq`` only the day that the window starts in is read."""
    first_day = day_label(since)
    midnight = as_instant(first_day) + timedelta(days=1)
    edge = acq.where((F.col("inserted_at") > instant(since)) & (F.col("inserted_at") < instant(midnight)))
    days = parts.where(F.col("day") > first_day).drop("day")
    return _systems(_added(days.unionByName(_summed(edge, SYSTEM)), SYSTEM), collation, position)


def acquisition_by_source(systems: DataFrame) -> DataFrame:
    """Per source: systems, runs and failures. Always two rows; other sources are ignored."""
    sums = systems.groupBy("data_source").agg(
        F.count("*").alias("systems"), F.sum("runs").alias("runs"), F.sum("failed").alias("failed")
    )
    return over_domain(sums, "data_source", SOURCES)
