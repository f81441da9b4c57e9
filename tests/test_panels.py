"""Health, cadence, connectivity and acquisition."""

import random
from datetime import timedelta

import numpy as np
import pytest

from runpulse import operators as op
from runpulse.operators.cadence import gap_counts
from runpulse.schemas import ACQUISITIONS, CONNECTIVITY
from runpulse.sources import load_schedules
from util import NOW, log_of, run_row, run_table, uid


def test_health_counts_a_run_under_both(spark):
    both = [{"type": "WARN"}, {"type": "ERROR"}, {"type": "ERROR"}]
    hour = NOW - timedelta(hours=1)
    rows = [
        run_row("a", uid(1), hour, None, both),
        run_row("a", uid(2), hour, None, [{"type": "WARN"}]),
        run_row("a", uid(3), hour, None, None),
        run_row("b", uid(4), hour, None, "[7]"),
        run_row("c", uid(5), NOW - timedelta(hours=24), None, both),
    ]
    health = op.app_health(run_table(spark, rows), NOW - timedelta(hours=24))
    assert {tuple(r) for r in health.collect()} == {("a", 3, 1, 2), ("b", 1, 0, 0)}
    labels = {r.app_name: r.label for r in health.select("app_name", op.health_label(24).alias("label")).collect()}
    assert labels == {"a": "24h: 1/3 err · 2 warn", "b": "24h: 0/1 err"}


@pytest.mark.parametrize("window, want", [(None, "14/22 err · 9 warn"), (0, "14/22 err · 9 warn"), (1.5, "1.5h: 14/22 err · 9 warn")])
def test_health_label_prefix(spark, window, want):
    df = spark.createDataFrame([(22, 14, 9), (0, 0, 0), (None, None, None)], "runs int, errored int, warned int")
    assert [r[0] for r in df.select(op.health_label(window)).collect()] == [want, "", ""]


def test_cadence_against_brute_force(spark):
    """One job owns most runs, in bursts, at equal instants and over idle hours."""
    rng = random.Random(11)
    times = {"HOT": [], "COLD": [], "ONCE": [NOW - timedelta(hours=5)]}
    at = NOW - timedelta(days=6)
    while at < NOW and len(times["HOT"]) < 3000:
        times["HOT"] += [at] * rng.choice([1, 1, 1, 4])
        at += rng.choice([timedelta(0), timedelta(microseconds=rng.randrange(1, 9)), timedelta(seconds=rng.randrange(400)), timedelta(minutes=50)])
    times["COLD"] = [NOW - timedelta(minutes=31 * i) for i in range(40)]
    times["OLD"] = [NOW - timedelta(days=7), NOW - timedelta(days=8)]
    rows = [run_row("a", uid(i), t, log_of(job)) for i, (job, t) in enumerate((j, t) for j, ts in times.items() for t in ts)]
    runs = run_table(spark, rows)
    got = {r.job: r for r in op.cadence_profile(runs, NOW).collect()}
    assert set(got) == {"HOT", "COLD"}
    for job in got:
        us = np.diff(np.array(sorted(int(t.timestamp()) * 1_000_000 + t.microsecond for t in times[job])))
        assert got[job].runs == len(us) and got[job].max_gap_us == us.max()
        for name, q in (("median_gap_min", 50), ("p90_gap_min", 90), ("p99_gap_min", 99), ("max_gap_min", 100)):
            assert got[job][name] == pytest.approx(np.percentile(us, q) / 6e7, abs=0.0501)
    counts = {r.gap_us: r.gaps for r in gap_counts(runs, NOW - timedelta(days=7)).where("job = 'HOT' AND gaps > 0").collect()}
    us = np.diff(np.array(sorted(int(t.timestamp()) * 1_000_000 + t.microsecond for t in times["HOT"])))
    values, numbers = np.unique(us, return_counts=True)
    assert counts == dict(zip(values.tolist(), numbers.tolist()))


def test_budget_audit(spark):
    rows = [run_row("a", uid(i), NOW - timedelta(minutes=30 * i), log_of("J")) for i in range(5)]
    rows += [run_row("a", uid(50 + i), NOW - timedelta(minutes=10 * i), log_of("K")) for i in range(5)]
    schedules = load_schedules(spark, [{"app_name": "a", "job": "J", "every_min": 20, "grace_min": 10}])
    audit = op.budget_audit(op.cadence_profile(run_table(spark, rows), NOW), schedules)
    got = {r.job: (r.budget_min, r.budget_ratio, r.clears_max_gap) for r in audit.collect()}
    assert got == {"J": (30.0, 1.0, False), "K": (None, None, None)}


def state(spark, rows):
    return spark.createDataFrame([(s, c, i, ok, None, None, None, None) for s, c, i, ok in rows], CONNECTIVITY)


def test_connectivity(spark):
    h = lambda n: NOW - timedelta(hours=n)
    hhm = state(spark, [("S2", h(1), h(0), True), ("S1", h(5), h(1), False), ("S3", None, None, False), ("S0", h(9), h(1), None)])
    mmb = state(spark, [("S4", h(5), h(2), False), ("S0", None, h(1), False)])
    panel = op.connectivity_panel(op.connectivity_union(hhm, mmb), NOW)
    got = panel.collect()
    assert [(r.source, r.system_id, r.status) for r in got] == [
        ("HHM", "S1", "OFFLINE"),
        ("MMB", "S4", "OFFLINE"),
        ("MMB", "S0", "OFFLINE"),
        ("HHM", "S3", "OFFLINE"),
        ("HHM", "S0", "UNKNOWN"),
        ("HHM", "S2", "ONLINE"),
    ]
    assert (got[0].capture_age_ms, got[0].checked_age_ms, got[3].capture_age_ms) == (5 * 3600000, 3600000, None)
    assert {tuple(r) for r in op.connectivity_rollup(panel).collect()} == {("HHM", 2, 4), ("MMB", 2, 2)}
    only = op.connectivity_rollup(panel.where("source = 'HHM'").replace("HHM", "XXX", "source")).collect()
    assert {tuple(r) for r in only} == {("HHM", 0, 0), ("MMB", 0, 0)}


def test_acquisitions(spark):
    def row(system, source, maker, ok, hours):
        return (None, system, source, maker, None, ok, None, None, None, NOW - timedelta(hours=hours))

    acq = spark.createDataFrame(
        [
            row("S1", "hhm", "", False, 1),
            row("S1", "hhm", "GE", None, 2),
            row("S1", "hhm", "", True, 3),
            row("S1", "mmb", None, False, 1),
            row("S2", "hhm", "", False, 1),
            row("S2", "other", "", False, 1),
            row("S9", "hhm", "", False, 24),
        ],
        ACQUISITIONS,
    )
    systems = op.acquisition_systems(acq, NOW - timedelta(hours=24))
    got = [(r.system_id, r.data_source, r.manufacturer, r.runs, r.failed) for r in systems.collect()]
    assert got == [("S1", "hhm", "GE", 3, 1), ("S1", "mmb", None, 1, 1), ("S2", "hhm", None, 1, 1), ("S2", "other", None, 1, 1)]
    assert systems.head().last_seen == "2026-06-25T11:00:00Z"
    assert {tuple(r) for r in op.acquisition_by_source(systems).collect()} == {("hhm", 2, 4, 2), ("mmb", 1, 1, 1)}
    empty = op.acquisition_by_source(systems.limit(0)).collect()
    assert {tuple(r) for r in empty} == {("hhm", 0, 0, 0), ("mmb", 0, 0, 0)}
