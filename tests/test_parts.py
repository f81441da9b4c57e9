"""Stored parts, the run index, pages at once and the audit of long runs, each against the plain way."""

import json
import random
import re
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from runpulse import operators as op
from runpulse import sources as src
from runpulse.schemas import ACQUISITIONS
from util import NOW, log_of, run_row, run_table, uid

DAY = timedelta(days=1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def cadence_rows(n=300, seed=3):
    rng = random.Random(seed)
    rows = [run_row(f"app{i % 2}", uid(i), NOW - timedelta(seconds=rng.randrange(9 * 86400)), log_of(f"J{i % 3}")) for i in range(n)]
    # Equal instants, both sides of midnight, a day without runs, a job with one run.
    midnight = NOW.replace(hour=0) - DAY
    for k, at in enumerate([midnight, midnight, midnight - timedelta(microseconds=1), midnight + timedelta(microseconds=1)]):
        rows.append(run_row("app0", uid(1000 + k), at, log_of("J0")))
    rows += [run_row("app9", uid(2000), NOW - DAY, log_of("ONCE")), run_row("app9", uid(2001), NOW - 6 * DAY, log_of("RARE")),
             run_row("app9", uid(2002), NOW - 2 * DAY, log_of("RARE"))]
    return rows


@pytest.mark.parametrize("back", [timedelta(0), timedelta(hours=5, seconds=7), timedelta(hours=12), timedelta(days=30), -3 * DAY])
def test_cadence_of_parts(spark, tmp_path, back):
    runs, path, now = run_table(spark, cadence_rows()), str(tmp_path / "parts"), NOW - back
    src.store_cadence_parts(runs, path)
    # A day stored again replaces itself.
    src.store_cadence_parts(runs.where(F.col("day") == "2026-06-22"), path)
    parts = src.read_cadence_parts(spark, path, now - 7 * DAY)
    assert rows_of(op.cadence_of_parts(parts, runs, now)) == rows_of(op.cadence_profile(runs, now))


def test_a_new_day_reads_one_day(spark, tmp_path):
    logs, path = str(tmp_path / "logs"), str(tmp_path / "parts")
    src.write_days(run_table(spark, cadence_rows()).drop("month", "day"), logs)
    since = NOW - 7 * DAY
    src.store_cadence_parts(src.read_run_logs(spark, logs, NOW - 20 * DAY), path)
    parts = src.read_cadence_parts(spark, path, since)
    days = {re.search("day=([0-9-]+)", f)[1] for f in parts.inputFiles()}
    assert min(days) == "2026-06-18" and len(days) == 8
    profile = op.cadence_of_parts(parts, src.read_run_logs(spark, logs, since), NOW)
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    above = [line for line in plan.splitlines() if "Filter" in line and "inserted_at" in line]
    assert above and all(re.search(r"day#\d+ <= 2026-06-18", line) for line in above)


def test_no_parts(spark, tmp_path):
    parts = src.read_cadence_parts(spark, str(tmp_path / "none"), NOW)
    assert op.cadence_of_parts(parts, run_table(spark, []), NOW).collect() == []


def acquisition_rows():
    rng = random.Random(5)
    texts = [None, "", "A", "b", "Z"]
    return [
        (uid(i), f"S{rng.randrange(6)}", rng.choice(["hhm", "mmb"]), rng.choice(texts), rng.choice(texts), rng.choice([True, False, None]),
         None, None, None, NOW - timedelta(seconds=rng.randrange(4 * 86400)))
        for i in range(400)
    ]


@pytest.mark.parametrize("back", [timedelta(hours=24), timedelta(hours=12), timedelta(hours=61, microseconds=1), timedelta(days=9), -DAY])
def test_systems_of_parts(spark, tmp_path, back):
    acq, since, path = spark.createDataFrame(acquisition_rows(), ACQUISITIONS), NOW - back, str(tmp_path / "parts")
    src.store_acquisition_parts(acq, path)
    parts = src.read_acquisition_parts(spark, path, since)
    systems = op.systems_of_parts(parts, acq, since)
    assert systems.collect() == op.acquisition_systems(acq, since).collect()
    assert rows_of(op.acquisition_by_source(systems)) == rows_of(op.acquisition_by_source(op.acquisition_systems(acq, since)))


def issue(dt, n):
    return {"dt": dt, "type": "ERROR", "func": f"f{n}"}


def feed_rows():
    rows = []
    for n in range(240):
        at = NOW - timedelta(hours=n)
        dts = [f"{at - timedelta(minutes=5 * k):%Y-%m-%dT%H:%M:%S.000Z}" for k in range(n % 3)]
        rows.append(run_row(f"a{n % 2}", uid(n), at, log_of("J"), [issue(dt, n) for dt in dts]))
    rows.append(run_row("a0", uid(900), NOW - 6 * DAY, log_of("J"), [issue("no instant", 1)]))
    rows.append(run_row("a0", uid(901), NOW - 8 * DAY, log_of("J"), [issue("2026-06-25T11:59:00Z", 2)]))
    return rows


@pytest.mark.parametrize("lookback,limit,days", [(9, 10, 3), (9, 60, 5), (9, 1000, 10), (1, 5, 1), (2, 500, 3), (7, 1, 2)])
def test_feed_reads_days_backwards(spark, tmp_path, lookback, limit, days):
    logs, path = str(tmp_path / "logs"), str(tmp_path / "parts")
    runs = run_table(spark, feed_rows()).cache()
    src.write_days(runs.drop("month", "day").coalesce(1), logs)
    src.store_feed_parts(runs, path)
    got = src.error_feed_by_days(spark, logs, path, NOW, lookback, limit)
    assert got.collect() == op.error_feed(runs, NOW, lookback, limit).collect()
    opened = {re.search("day=([0-9-]+)", f)[1] for f in got.inputFiles()}
    needed = op.feed_days(spark.read.parquet(path).withColumn("day", F.col("day").cast("string")), NOW, lookback, limit)
    assert opened >= set(needed) and len(needed) == days


def test_lookup_by_index(spark, tmp_path):
    logs, index = str(tmp_path / "logs"), str(tmp_path / "index")
    rows = [run_row("a", uid(i), NOW - timedelta(hours=i), log_of("J")) for i in range(200)]
    rows += [run_row("a", "ABCDEF00-0000-4000-8000-00000000000A", NOW - 3 * DAY, log_of("UP")), run_row("a", uid(7), NOW - 20 * DAY, log_of("OLD"))]
    runs = run_table(spark, rows).cache()
    src.write_days(runs.drop("month", "day").coalesce(1), logs)
    for part in (runs.where("run_id < 'A'"), runs.where("run_id >= 'A'")):
        src.append_run_index(part, index)
    for run_id in (uid(7), uid(150), "abcdef00-0000-4000-8000-00000000000a", "ABCDEF00-0000-4000-8000-00000000000A"):
        found = src.run_by_index(spark, logs, index, run_id)
        assert found.collect() == op.run_by_id(runs, run_id).collect() and found.count() == 1
        entry = src.read_run_index(spark, index, run_id)
        assert len({re.search("bucket=(..)", f)[1] for f in entry.inputFiles()}) == 1
        assert len({re.search("day=([0-9-]+)", f)[1] for f in found.inputFiles()}) == 1
    assert src.run_by_index(spark, logs, index, uid(5000)).collect() == []
    with pytest.raises(ValueError):
        src.run_by_index(spark, logs, index, "x")


@pytest.mark.parametrize("limit", [1, 7, 50, 1000])
def test_all_pages_at_once(spark, limit):
    rows = [run_row("a", uid(i).upper() if i % 2 else uid(i), NOW - timedelta(minutes=i // 4), log_of("J"), [issue("x", 1)] * (i % 2)) for i in range(100)]
    runs = run_table(spark, [*rows, run_row("b", uid(500), NOW, log_of("J"))]).repartition(5)
    pages = op.app_runs_pages(runs, "a", NOW - DAY, limit).cache()
    cursors = {r.page: r for r in op.page_cursors(pages, limit).collect()}
    cursor = None
    for number in range(1, min(len(cursors), 4) + 1):
        want = op.fetch_page(op.app_runs_page(runs, "a", NOW - DAY, limit, cursor), limit)
        got = [tuple(r)[:-2] for r in sorted(pages.where(F.col("page") == number).collect(), key=lambda r: r.place)]
        assert got == [tuple(r) for r in want.runs]
        told = cursors[number]
        assert (told.next_at, told.next_id) == (want.cursor or (None, None)) and told.runs == len(want.runs)
        cursor = want.cursor
    assert pages.count() == 100 and len(cursors) == -(-100 // limit)
    assert op.app_runs_pages(runs, "nobody", NOW - DAY, limit).count() == 0


def audited(spark, log, issues):
    run = run_table(spark, [run_row("a", uid(1), NOW, log, issues)])
    return op.contract_audit(run).head()["issues_not_in_log"]


def test_issues_as_multisets(spark):
    e = [{"type": "ERROR", "n": n} for n in range(4)]
    cases = [([0, 1], [0], 0), ([0, 1], [2], 1), ([0], [0, 0], 1), ([0, 0], [0, 0], 0), ([1, 0, 1], [1, 1, 0], 0), ([1, 0, 1], [1, 1, 1], 1),
             ([], [3], 1), ([0, 1, 2, 3], [3, 2, 1, 0], 0), ([0, 1, 2, 3], [3, 3], 1)]
    for log, issues, bad in cases:
        assert audited(spark, [e[n] for n in log], [e[n] for n in issues]) == bad, (log, issues)
    turned = [{"n": 0, "type": "ERROR"}, None, 5]
    assert audited(spark, [e[0], 5, None], turned) == 0 and audited(spark, [e[0], 5], turned) == 1


def test_audit_of_long_runs(spark):
    """Ten times the events take about ten times as long, whether they are equal or all different."""
    audited(spark, log_of("J"), [{"type": "ERROR"}])
    for event in (lambda n: {"type": "ERROR", "n": 1}, lambda n: {"type": "ERROR", "n": n}):
        took = []
        for size in (10_000, 100_000):
            events = json.dumps([event(n) for n in range(size)])
            started = time.perf_counter()
            assert audited(spark, events, events) == 0
            took.append(time.perf_counter() - started)
        assert took[1] < 30 * max(took[0], 0.2)
