"""Latest runs, staleness, coverage, and the grid transforms."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from runpulse import operators as op
from runpulse.operators.ordering import with_position
from runpulse.sources import load_schedules
from util import NOW, latest_table, log_of, run_row, run_table, uid, utc

SCHEDULES = [
    {"app_name": "a", "job": "J30", "every_min": 30, "grace_min": 15},
    {"app_name": "a", "job": "(default)", "every_min": 20, "grace_min": 10},
    {"app_name": "a", "job": "NOGRACE", "every_min": 30},
    {"app_name": "a", "job": "CRON", "every_min": None, "grace_min": 30},
]


def test_latest_is_newest_per_key_and_tie_goes_to_larger_id(spark):
    rows = [
        run_row("a", uid(1), "2026-06-25T10:00:00", log_of("J"), [{"type": "ERROR"}]),
        run_row("a", uid(2), "2026-06-25T11:00:00", log_of("J"), []),
        run_row("a", uid(3), "2026-06-25T11:00:00", log_of("J"), [{"type": "WARN"}]),
        run_row("a", uid(4), "2026-06-25T09:00:00", log_of(None)),
        run_row("b", uid(5), "2026-06-25T09:00:00", log_of("J")),
        run_row("c", uid(6), "2026-05-01T00:00:00", log_of("J")),
    ]
    got = op.latest_runs(run_table(spark, rows), "2026-06-01").orderBy("app_name", "job").collect()
    assert [(r.app_name, r.job, r.run_id, r.status) for r in got] == [
        ("a", "(default)", uid(4), "SUCCESS"),
        ("a", "J", uid(3), "WARN"),
        ("b", "J", uid(5), "SUCCESS"),
    ]


def test_latest_bound_is_inclusive(spark):
    rows = [run_row("a", uid(1), "2026-06-25T10:00:00", log_of("J"))]
    assert op.latest_runs(run_table(spark, rows), "2026-06-25T10:00:00").count() == 1
    assert op.latest_runs(run_table(spark, rows), "2026-06-25T10:00:00.000001").count() == 0


def test_staleness_is_tri_state_and_strict(spark):
    ages = {"J30": 45, "(default)": 31, "NOGRACE": 35, "CRON": 999, "OTHER": 1}
    rows = [("a", job, uid(i), NOW - timedelta(minutes=m)) for i, (job, m) in enumerate(ages.items())]
    rows.append(("b", "J30", uid(9), NOW))
    judged = op.staleness(latest_table(spark, rows), load_schedules(spark, SCHEDULES), NOW).collect()
    got = {(r.app_name, r.job): (r.stale, r.budget_ms) for r in judged}
    assert got == {
        ("a", "J30"): (False, 45 * 60000),
        ("a", "(default)"): (True, 30 * 60000),
        ("a", "NOGRACE"): (True, 30 * 60000),
        ("a", "CRON"): (None, None),
        ("a", "OTHER"): (None, None),
        ("b", "J30"): (None, None),
    }


def test_coverage(spark):
    rows = [("a", j, uid(i), NOW) for i, j in enumerate(["J30", "CRON", "(default)", "X"])]
    schedules = load_schedules(spark, SCHEDULES)
    grid = op.job_grid(latest_table(spark, rows), schedules, NOW)
    assert op.cadence_coverage(grid, schedules).head() == (4, 2, 2)
    assert [r.unknown_job for r in op.unknown_jobs(grid, schedules).collect()] == ["a/CRON", "a/X"]
    assert op.cadence_coverage(grid.limit(0), schedules).head() == (0, 0, 0)


def test_duplicate_schedule_is_rejected(spark):
    with pytest.raises(ValueError):
        load_schedules(spark, [SCHEDULES[0], SCHEDULES[0]])


GRID = "app string, job string, run_id string, last_run timestamp, duration_ms long, status string, issue_count int, age_ms long, stale boolean"


def grid_of(spark, rows):
    return spark.createDataFrame(rows, GRID)


def sample_grid(spark):
    t = utc("2026-06-25T10:00:00")
    return grid_of(
        spark,
        [
            ("b_app", "J2", uid(1), t, 500, "ERROR", 3, 1000, True),
            ("a_app", "J1", uid(2), t + timedelta(minutes=1), None, "SUCCESS", 0, 3000, False),
            ("a_app", "J3", uid(3), t + timedelta(minutes=2), 100, "ERROR", 1, 2000, None),
            ("c_app", "(default)", uid(4), None, 200, "ODD", None, None, True),
            ("a_app", "J0", uid(5), t + timedelta(microseconds=10), 200, "WARN", 1, None, None),
        ],
    )


@pytest.mark.parametrize(
    "key, direction, want",
    [
        ("app", "asc", ["J0", "J1", "J3", "J2", "(default)"]),
        ("app", "desc", ["(default)", "J2", "J0", "J1", "J3"]),
        ("job", "desc", ["J3", "J2", "J1", "J0", "(default)"]),
        ("status", "asc", ["J3", "J2", "J0", "J1", "(default)"]),
        ("status", "desc", ["(default)", "J1", "J0", "J3", "J2"]),
        ("duration", "asc", ["J3", "J0", "(default)", "J2", "J1"]),
        ("duration", "desc", ["J2", "J0", "(default)", "J3", "J1"]),
        ("age", "desc", ["J1", "J3", "J2", "J0", "(default)"]),
        ("lastRun", "asc", ["J0", "J2", "J1", "J3", "(default)"]),
        ("issues", "desc", ["J2", "J0", "J3", "J1", "(default)"]),
        ("nonsense", "asc", ["J0", "J1", "J3", "J2", "(default)"]),
        ("app", "sideways", ["J0", "J1", "J3", "J2", "(default)"]),
    ],
)
def test_sort(spark, key, direction, want):
    assert [r.job for r in op.sort_jobs(sample_grid(spark), key, direction).collect()] == want


def test_sort_by_language_rules(spark):
    grid = grid_of(spark, [(a, "j", uid(i), None, None, "SUCCESS", 0, 0, None) for i, a in enumerate("bAaB")])
    assert [r.app for r in op.sort_jobs(grid, "app").collect()] == ["A", "B", "a", "b"]
    assert [r.app for r in op.sort_jobs(grid, "app", collation="UNICODE").collect()] == ["a", "A", "b", "B"]


def test_positions_follow_the_order(spark):
    rng = random.Random(3)
    values = [rng.choice([None, 1, 2, 2, 2, 2, 2, 9]) for _ in range(5000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    placed = with_position(df, [F.col("v").desc_nulls_last(), F.col("i").asc()]).collect()
    want = sorted(range(5000), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert [r.i for r in sorted(placed, key=lambda r: r.pos)] == want
    assert sorted(r.pos for r in placed) == list(range(1, 5001))


def test_positions_of_nothing_and_in_language_order(spark):
    assert op.sort_jobs(sample_grid(spark).limit(0), "status", position="pos").count() == 0
    grid = grid_of(spark, [(a, "j", uid(i), None, None, "SUCCESS", 0, 0, None) for i, a in enumerate("bAaB")])
    placed = op.sort_jobs(grid, "app", collation="UNICODE", position="pos").orderBy("pos")
    assert [r.app for r in placed.collect()] == ["a", "A", "b", "B"]


def test_group_keeps_order(spark):
    placed = op.sort_jobs(sample_grid(spark), "status", "asc", position="pos")
    got = [(r.group_key, r.group_pos, r.job) for r in op.group_jobs(placed, "app").collect()]
    assert got == [("a_app", 1, "J3"), ("a_app", 1, "J0"), ("a_app", 1, "J1"), ("b_app", 2, "J2"), ("c_app", 5, "(default)")]
    single = op.group_jobs(placed, "none").collect()
    assert {r.group_key for r in single} == {None} and [r.pos for r in single] == [1, 2, 3, 4, 5]


def test_group_rollup(spark):
    got = {r.group_key: r.status for r in op.group_rollup_status(sample_grid(spark), "app").collect()}
    assert got == {"a_app": "ERROR", "b_app": "ERROR", "c_app": "SUCCESS"}
    warn = sample_grid(spark).where("status <> 'ERROR'")
    assert [tuple(r) for r in op.group_rollup_status(warn, None).collect()] == [(None, "WARN")]
    assert [tuple(r) for r in op.group_rollup_status(warn.limit(0), None).collect()] == [(None, "SUCCESS")]


@pytest.mark.parametrize(
    "search, statuses, want",
    [
        ("", [], {"J0", "J1", "J2", "J3", "(default)"}),
        ("  A_APP ", [], {"J0", "J1", "J3"}),
        ("(DEF", [], {"(default)"}),
        ("app j", [], {"J0", "J1", "J2", "J3"}),
        (uid(3)[-4:], [], {"J3"}),
        ("%", [], set()),
        (None, ["STALE"], {"J2", "(default)"}),
        ("a_app", ["ERROR", "STALE"], {"J3"}),
        ("", ["WARN", "SUCCESS"], {"J0", "J1"}),
    ],
)
def test_filter(spark, search, statuses, want):
    assert {r.job for r in op.filter_jobs(sample_grid(spark), search, statuses).collect()} == want


def test_summarize(spark):
    got = op.summarize_grid(sample_grid(spark)).head().asDict()
    assert got == {"total": 5, "ERROR": 2, "WARN": 1, "SUCCESS": 1, "stale": 2, "unknown": 2}
    empty = op.summarize_grid(sample_grid(spark).limit(0)).head()
    assert list(empty) == [0, 0, 0, 0, 0, 0]


