"""Connectivity status and the worst-first ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Worst-first ranks; a run status outside the list ranks last.
RUN_RANK = {"ERROR": 0, "WARN": 1, "SUCCESS": 2, "INFO": 3}
OTHER_RANK = 99
CONNECTIVITY_RANK = {"OFFLINE": 0, "UNKNOWN": 1, "ONLINE": 2}


def conn_status(ok: Column) -> Column:
    """Tri-state: a missing result is UNKNOWN, never ONLINE."""
    return F.when(~ok, "OFFLINE").when(ok, "ONLINE").otherwise("UNKNOWN")


def status_rank(status: Column, kind: str = "run") -> Column:
    ranks = {"run": RUN_RANK, "connectivity": CONNECTIVITY_RANK}[kind]
    known = F.coalesce(*[F.when(status == name, rank) for name, rank in ranks.items()])
    return F.coalesce(known, F.lit(OTHER_RANK))
