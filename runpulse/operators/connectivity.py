"""Connectivity of the monitored systems, from two current-state tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.functions.instants import age_ms
from runpulse.functions.labels import conn_status, status_rank
from runpulse.operators.domain import over_domain
from runpulse.operators.ordering import with_position
from runpulse.schemas import CONNECTIVITY

SOURCES = ("HHM", "MMB")


def connectivity_union(hhm: DataFrame, mmb: DataFrame) -> DataFrame:
    """Both tables, labelled; only the shared columns."""
    labelled = [t.select(F.lit(s).alias("source"), *CONNECTIVITY.names) for s, t in zip(SOURCES, (hhm, mmb))]
    return labelled[0].unionByName(labelled[1])


def panel_order(collation: str | None = None) -> list[Column]:
    """Worst status first, then the oldest capture with an unknown one last, then the system."""
    system = F.coalesce("system_id", F.lit(""))
    return [
        status_rank(F.col("status"), "connectivity").asc(),
        F.col("capture_age_ms").desc_nulls_last(),
        (F.collate(system, collation) if collation else system).asc(),
        F.col("source").asc(),
    ]


def connectivity_panel(
    union: DataFrame, now: datetime | str, collation: str | None = None, position: str | None = None
) -> DataFrame:
    """Status and two ages per system, worst first: age of the data, and of the last check."""
    panel = union.select(
        "source",
        "system_id",
        conn_status(F.col("successful_acquisition")).alias("status"),
        "capture_datetime",
        "inserted_at",
        age_ms(F.col("capture_datetime"), now).alias("capture_age_ms"),
        age_ms(F.col("inserted_at"), now).alias("checked_age_ms"),
        "error_category",
        "phase",
        "connection_error",
        "host_intervention",
    )
    order = panel_order(collation)
    return with_position(panel, order, position) if position else panel.orderBy(*order)


def connectivity_rollup(panel: DataFrame) -> DataFrame:
    """Per source: systems offline and in all. Always two rows; other sources are ignored."""
    counts = panel.groupBy("source").agg(
        F.count_if(F.col("status") == "OFFLINE").alias("offline"), F.count("*").alias("total")
    )
    return over_domain(counts, "source", SOURCES)
