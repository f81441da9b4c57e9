"""The cadence dimension."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from runpulse.schemas import SCHEDULES


def load_schedules(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Rows with ``app_name, job`` and optionally ``every_min, grace_min``; a key may occur once.

    A missing or non-numeric ``every_min`` (a cron text, say) stays null: cadence unknown.
    The rows become a local relation, whose exact size the optimizer knows: joins broadcast
    it while it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffle beyond that.
    """
    columns: dict[str, list] = {name: [] for name in SCHEDULES.names}
    seen = set()
    for row in rows:
        key = (row["app_name"], row["job"])
        if key in seen:
            raise ValueError(f"duplicate schedule {key[0]}/{key[1]}")
        seen.add(key)
        columns["app_name"].append(key[0])
        columns["job"].append(key[1])
        columns["every_min"].append(_minutes(row.get("every_min")))
        columns["grace_min"].append(_minutes(row.get("grace_min")))
    types = [pa.string(), pa.string(), pa.float64(), pa.float64()]
    table = pa.table({n: pa.array(columns[n], t) for n, t in zip(SCHEDULES.names, types)})
    return spark.createDataFrame(table, SCHEDULES)


def _minutes(value: object) -> float | None:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    return None
