"""Sorting, grouping, filtering and tallying the job grid."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.functions.labels import RUN_RANK, status_rank
from runpulse.functions.text import trim_text
from runpulse.operators.ordering import with_position

STALE_TOKEN = "STALE"


def _name(col: str, collation: str | None) -> Column:
    value = F.coalesce(F.col(col), F.lit(""))
    return F.collate(value, collation) if collation else value


def sort_order(key: str | None, direction: str | None = "asc", collation: str | None = None) -> list[Column]:
    """Order columns for a grid key.

    Numbers put nulls last in both directions. Equal statuses put the oldest run first in
    both directions. Remaining ties, and an unknown key, fall back to app, job.
    """
    descending = direction == "desc"

    def directed(col: Column) -> Column:
        return col.desc_nulls_last() if descending else col.asc_nulls_last()

    numbers = {
        "lastRun": F.unix_millis("last_run"),
        "age": F.col("age_ms"),
        "duration": F.col("duration_ms"),
        "issues": F.col("issue_count"),
    }
    if key in ("app", "job"):
        first = [directed(_name(key, collation))]
    elif key == "status":
        first = [directed(status_rank(F.col("status"))), F.col("age_ms").desc_nulls_last()]
    elif key in numbers:
        first = [directed(numbers[key])]
    else:
        first = []
    return [*first, _name("app", collation).asc(), _name("job", collation).asc()]


def sort_jobs(
    grid: DataFrame,
    key: str | None,
    direction: str | None = "asc",
    collation: str | None = None,
    position: str | None = None,
) -> DataFrame:
    """The grid in order; with ``position`` the place of each row is added as a column of that name."""
    order = sort_order(key, direction, collation)
    return with_position(grid, order, position) if position else grid.orderBy(*order)


def group_jobs(positioned: DataFrame, by: str | None) -> DataFrame:
    """Bucket a positioned grid by app or job; any other ``by`` gives one group with a null key.

    Rows stay flat: ``group_key``, ``group_pos`` (the place of the group's first row) and the
    row's own ``pos``. Groups come in first-seen order and rows keep their order inside.
    """
    if by not in ("app", "job"):
        single = positioned.withColumns({"group_key": F.lit(None).cast("string"), "group_pos": F.lit(1).cast("long")})
        return single.orderBy("pos")
    keyed = positioned.withColumn("group_key", F.col(by))
    first_seen = keyed.groupBy("group_key").agg(F.min("pos").alias("group_pos"))
    joined = keyed.join(first_seen.withColumnRenamed("group_key", "_key"), F.col("group_key").eqNullSafe(F.col("_key")))
    return joined.drop("_key").orderBy("group_pos", "pos")


def group_rollup_status(grid: DataFrame, by: str | None) -> DataFrame:
    """Worst status per app or job, or over the whole grid for any other ``by``.

    Unexpected statuses do not count; where nothing worse is found, rows or no rows, it is SUCCESS.
    """
    rank = status_rank(F.col("status"))
    worst = F.min(F.when(rank <= RUN_RANK["SUCCESS"], rank)).alias("_worst")
    if by in ("app", "job"):
        rolled = grid.groupBy(F.col(by).alias("group_key")).agg(worst)
    else:
        rolled = grid.agg(worst).withColumn("group_key", F.lit(None).cast("string"))
    label = F.when(F.col("_worst") == RUN_RANK["ERROR"], "ERROR").when(F.col("_worst") == RUN_RANK["WARN"], "WARN")
    return rolled.select("group_key", label.otherwise("SUCCESS").alias("status"))


def filter_jobs(grid: DataFrame, search: str | None = None, statuses: Collection[str] = ()) -> DataFrame:
    """Literal, case-insensitive search over app, job and run id, AND any of the status tokens.

    The token STALE stands for overdue rows; an unknown cadence is not overdue.
    """
    needle = F.lower(trim_text(F.lit(search or "")))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("app", "job", "run_id")]
    kept = grid.where(F.lower(F.concat_ws(" ", *parts)).contains(needle))
    tokens = sorted(set(statuses))
    if not tokens:
        return kept
    wanted = F.col("status").isin(tokens)
    if STALE_TOKEN in tokens:
        wanted = wanted | F.col("stale").eqNullSafe(F.lit(True))
    return kept.where(wanted)


def summarize_grid(grid: DataFrame) -> DataFrame:
    """One row of tallies; zeros for an empty grid."""
    tallies = [F.count_if(F.col("status") == name).alias(name) for name in ("ERROR", "WARN", "SUCCESS")]
    return grid.agg(
        F.count("*").alias("total"),
        *tallies,
        F.count_if("stale").alias("stale"),
        F.count_if(F.col("stale").isNull()).alias("unknown"),
    )
