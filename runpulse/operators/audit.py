"""Does the run-log table keep its contract?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.functions.events import DEFAULT_JOB, first_and_last, is_array, job_of, log_heads, parse_events
from runpulse.params import RUN_ID


def contract_audit(runs: DataFrame) -> DataFrame:
    """Per app, how many runs break each rule of the contract.

    Arrays are read as everywhere else in the library, so a text that the grid takes for an empty
    array counts as none here. Issues are compared with the log event by event, whatever the order of
    an event's keys; one that occurs more often among the issues than in the log is not in the log.
    """
    verbose, issues = F.col("verbose_log"), F.col("warn_error_logs")
    parsed = runs.select(
        "app_name",
        "run_id",
        log_heads(verbose).alias("_heads"),
        F.coalesce(is_array(verbose), F.lit(False)).alias("_log_ok"),
        F.coalesce(is_array(issues), F.lit(True)).alias("_issues_ok"),
        _canonical(issues).alias("_issues"),
        # The whole log is compared only for runs that have issues.
        F.when(F.size(_canonical(issues)) > 0, _canonical(verbose)).alias("_log"),
    )
    started, ended = first_and_last(F.col("_heads")["dt"])
    timed = parsed.withColumns({"_start": started, "_end": ended})
    well_formed = F.col("run_id").rlike(f"^{RUN_ID}\\z")
    rules = {
        "bad_run_id": ~well_formed,
        "upper_case_run_id": well_formed & (F.col("run_id") != F.lower("run_id")),
        "bad_first_dt": F.col("_start").isNull(),
        "bad_last_dt": F.col("_end").isNull(),
        "log_not_array": ~F.col("_log_ok"),
        "issues_not_array": ~F.col("_issues_ok"),
        "default_job": job_of(F.col("_heads")) == DEFAULT_JOB,
        "out_of_order": F.col("_end") < F.col("_start"),
        "issues_not_in_log": F.when(F.size("_issues") > 0, _not_within(F.col("_issues"), F.col("_log"))),
    }
    return timed.groupBy("app_name").agg(
        F.count("*").alias("runs"), *[F.count_if(broken).alias(name) for name, broken in rules.items()]
    )


def _canonical(col: Column) -> Column:
    """The array's elements as JSON text with sorted keys."""
    return F.transform(parse_events(col), lambda e: F.to_json(e))


def _not_within(part: Column, whole: Column) -> Column:
    """Does ``part`` hold an element more often than ``whole``? Sorting both is the most that it takes.

    Each side becomes its distinct elements with their counts. Sorted together, an element of ``part`` stands
    right before the same one of ``whole``, if there is one.
    """

    def more(both: Column) -> Column:
        def lacking(i: Column) -> Column:
            here, there = F.element_at(both, i), F.try_element_at(both, i + 1)
            found = (there["text"] == here["text"]) & (there["times"] >= here["times"])
            return (here["side"] == 0) & ~F.coalesce(found, F.lit(False))

        return F.exists(F.sequence(F.lit(1), F.size(both)), lacking)

    return _bound(F.array_sort(F.concat(_counted(part, 0), _counted(whole, 1))), more)


def _counted(texts: Column, side: int) -> Column:
    """The distinct elements as ``struct<text, side, times>``."""

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        first = F.filter(
            F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.element_at(ordered, i) != F.element_at(ordered, F.greatest(i - 1, F.lit(1))))
        )

        def lengths(starts: Column) -> Column:
            # The index of a lambda counts from 0: the next start is at that index plus 2.
            def one(start: Column, i: Column) -> Column:
                end = F.coalesce(F.try_element_at(starts, i + 2), size + 1)
                return F.struct(F.element_at(ordered, start).alias("text"), F.lit(side).alias("side"), (end - start).alias("times"))

            return F.transform(starts, one)

        return _bound(first, lengths)

    none = F.array().cast("array<struct<text: string, side: int, times: int>>")
    return F.when(F.size(texts) > 0, _bound(F.array_sort(texts), runs)).otherwise(none)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda computes what it refers to again for every element."""
    return F.transform(F.array(value), use)[0]
