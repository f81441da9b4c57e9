"""Aggregates over a fixed list of groups."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def over_domain(counts: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Exactly one row per listed value: absent groups count zero, unlisted ones are dropped."""
    domain = counts.sparkSession.createDataFrame(pa.table({key: list(values)}))
    return domain.join(counts, key, "left").fillna(0)
