"""Merge, eviction, watermark, refresh phases, publishing and the streams."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from runpulse import operators as op
from runpulse import sources as src
from runpulse import streaming as st
from runpulse.schemas import HEARTBEAT_METRICS
from runpulse.streaming import state as state_module
from runpulse.streaming.state import State, plan_refresh
from util import NOW, latest_table, log_of, plan_of, run_row, run_table, uid

DAY = timedelta(days=1)


def content(df):
    return {(r.app_name, r.job): (r.run_id, r.inserted_at) for r in df.collect()}


def ids(df):
    return {job: run_id for (_, job), (run_id, _) in content(df).items()}


def test_merge(spark):
    state = latest_table(spark, [("a", "J", uid(5), NOW - DAY), ("a", "K", uid(6), NOW - DAY), ("a", "OLD", uid(7), NOW - 31 * DAY)])
    batch = latest_table(spark, [("a", "J", uid(1), NOW), ("a", "K", uid(2), NOW - 2 * DAY), ("a", "NEW", uid(3), NOW - 16 * DAY)])
    once = st.merge_latest(state, batch, NOW)
    assert ids(once) == {"J": uid(1), "K": uid(6), "NEW": uid(3)}
    assert content(st.merge_latest(once, batch, NOW)) == content(once)
    tied = latest_table(spark, [("a", "K", uid(1), NOW - DAY)])
    assert ids(st.merge_latest(state, tied, NOW))["K"] == uid(1)
    assert content(st.merge_latest(state, tied.limit(0), NOW)) == content(st.evict(state, NOW))


def test_evict_keeps_the_floor(spark):
    rows = [("a", "AT", uid(1), NOW - 30 * DAY), ("a", "BEFORE", uid(2), NOW - 30 * DAY - timedelta(microseconds=1))]
    assert set(ids(st.evict(latest_table(spark, rows), NOW))) == {"AT"}


def test_since_bound():
    floor = NOW - 30 * DAY
    assert st.since_bound(None, NOW) == floor
    assert st.since_bound(NOW - timedelta(hours=1), NOW) == NOW - timedelta(hours=1, minutes=5)
    assert st.since_bound(NOW - 40 * DAY, NOW) == floor


def test_phases():
    config = st.RefreshConfig()
    full = NOW - timedelta(hours=6)
    before = State("any", full, NOW - timedelta(minutes=1))
    assert plan_refresh(State(), NOW, config) == ("bootstrap", NOW - 30 * DAY)
    assert plan_refresh(before, NOW, config) == ("reconcile", NOW - 30 * DAY)
    just = NOW - timedelta(seconds=1)
    assert plan_refresh(before, just, config) == ("tick", NOW - timedelta(minutes=6))


def logs(*runs):
    """(job, run id, age) triples as run rows."""
    return [run_row("a", uid(n), NOW - age, log_of(job), []) for job, n, age in runs]


def test_refresh_cycle_with_late_rows(spark, tmp_path):
    h, m = timedelta(hours=1), timedelta(minutes=1)
    table = []
    source = lambda since: run_table(spark, table).where(F.col("inserted_at") >= F.lit(since))
    root = str(tmp_path)

    table += logs(("J", 1, 3 * h), ("K", 2, 10 * DAY))
    first = st.refresh_latest(spark, source, root, NOW - 2 * h)
    assert (first.phase, first.jobs, first.watermark) == ("bootstrap", 2, NOW - 3 * h)

    table += logs(("J", 3, 1 * h), ("LATE", 4, 3 * h + 4 * m), ("LATER", 5, 9 * h))
    tick = st.refresh_latest(spark, source, root, NOW - h)
    assert (tick.phase, tick.since, tick.watermark) == ("tick", NOW - 3 * h - 5 * m, NOW - h)
    assert ids(st.read_latest(spark, root)) == {"J": uid(3), "K": uid(2), "LATE": uid(4)}

    idle = st.refresh_latest(spark, source, root, NOW)
    assert (idle.phase, idle.watermark, idle.jobs) == ("tick", NOW - h, 3)

    healed = st.refresh_latest(spark, source, root, NOW + 4 * h)
    assert healed.phase == "reconcile"
    assert ids(st.read_latest(spark, root))["LATER"] == uid(5)

    st.refresh_latest(spark, source, root, NOW + 25 * DAY)
    assert set(ids(st.read_latest(spark, root))) == {"J", "LATE", "LATER"}


def test_empty_source(spark, tmp_path):
    source = lambda since: run_table(spark, [])
    got = st.refresh_latest(spark, source, str(tmp_path), NOW)
    assert (got.jobs, got.watermark) == (0, None)
    assert st.read_latest(spark, str(tmp_path)).count() == 0


def test_failed_refresh_keeps_last_good(spark, tmp_path):
    root = str(tmp_path)
    good = lambda since: run_table(spark, logs(("J", 1, timedelta(0))))
    assert st.refresh(spark, good, root, NOW).error is None
    before = content(st.read_latest(spark, root))

    boom = F.raise_error(F.lit("source is down")).cast("string")
    broken = lambda since: good(since).withColumn("verbose_log", boom)
    failed = st.refresh(spark, broken, root, NOW + timedelta(hours=7))
    assert failed.phase == "reconcile" and "source is down" in failed.error and failed.health_error is None
    assert content(st.read_latest(spark, root)) == before
    assert st.read_health(spark, root).count() == 1

    retried = st.refresh(spark, good, root, NOW + timedelta(hours=7))
    assert retried.phase == "reconcile" and retried.error is None

    no_issues = lambda since: good(since).withColumn("warn_error_logs", boom)
    half = st.refresh(spark, lambda s: no_issues(s) if s >= NOW - 2 * DAY else good(s), root, NOW + timedelta(hours=14))
    assert half.error is None and "source is down" in half.health_error


def one(job, n, age=timedelta(0)):
    return lambda spark: lambda since: run_table(spark, logs((job, n, age)))


def generations(root):
    return sorted(p.name for p in (root / "latest").iterdir())


def test_generations_are_kept_by_age(spark, tmp_path):
    root, times = str(tmp_path), [NOW, NOW + timedelta(hours=7), NOW + timedelta(hours=30), NOW + timedelta(hours=60)]
    readers = []
    for at in times[:3]:
        assert st.refresh_latest(spark, one("J", 1)(spark), root, at).phase in ("bootstrap", "reconcile")
        readers.append(st.read_latest(spark, root))
    assert len(generations(tmp_path)) == 3 and all(ids(r) == {"J": uid(1)} for r in readers)
    st.refresh_latest(spark, one("J", 1)(spark), root, times[3])
    # Of those older than a day the newest stays: a reader may have begun with it.
    assert [g[4:15] for g in generations(tmp_path)] == ["20260626T18", "20260628T00"]
    assert ids(readers[2]) == {"J": uid(1)}


def test_half_written_scan_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    st.refresh_latest(spark, one("J", 1)(spark), root, NOW)
    before = st.current_state(spark, root)
    later = tmp_path / "latest" / "gen=20990101T000000.000000" / "at=20990101T000000.000000" / "_temporary"
    later.mkdir(parents=True)
    assert st.current_state(spark, root) == before and ids(st.read_latest(spark, root)) == {"J": uid(1)}


def test_refresh_run_twice_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    done = [st.refresh_latest(spark, one(job, n)(spark), root, NOW).jobs for _ in range(2) for n, job in enumerate("JK", 1)]
    assert done == [1, 2, 2, 2]
    assert ids(st.read_latest(spark, root)) == {"J": uid(1), "K": uid(2)}


def test_unreadable_state_is_reported(spark, tmp_path, monkeypatch):
    def down(*_):
        raise OSError("no reply")

    with monkeypatch.context() as patch:
        patch.setattr(state_module, "_generation", down)
        got = st.refresh(spark, one("J", 1)(spark), str(tmp_path), NOW)
    assert got.error and got.phase is None and got.health_error is None
    assert st.read_health(spark, str(tmp_path)).count() == 1


def test_the_later_health_window_stays(spark, tmp_path):
    root = str(tmp_path)
    st.refresh_health(spark, one("J", 1)(spark), root, NOW)
    st.refresh_health(spark, lambda since: run_table(spark, []), root, NOW - timedelta(hours=1))
    assert st.read_health(spark, root).count() == 1
    st.refresh_health(spark, lambda since: run_table(spark, []), root, NOW + timedelta(hours=1))
    assert st.read_health(spark, root).count() == 0


@pytest.mark.parametrize("after", [timedelta(0), timedelta(seconds=1), -timedelta(seconds=1)])
@pytest.mark.parametrize("first", [True, False])
def test_concurrent_writers_lose_nothing(spark, tmp_path, monkeypatch, after, first):
    """Another refresh begins and ends between this one's read and its write, as first scan or as tick."""
    root, write, calls = str(tmp_path), state_module.add_rows, []
    whole = lambda since: run_table(spark, logs(("J", 1, timedelta(0)), ("K", 2, timedelta(0))))
    start = NOW if first else NOW + timedelta(minutes=1)
    if not first:
        st.refresh_latest(spark, one("OLD", 3, DAY)(spark), root, NOW)

    def slow(*args, **kwargs):
        calls.append(args)
        if len(calls) == 1:
            st.refresh_latest(spark, whole if first else one("K", 2)(spark), root, start + after)
        write(*args, **kwargs)

    monkeypatch.setattr(state_module, "add_rows", slow)
    assert st.refresh_latest(spark, whole if first else one("J", 1)(spark), root, start).jobs == (2 if first else 3)
    assert set(ids(st.read_latest(spark, root))) == ({"J", "K"} if first else {"J", "K", "OLD"})


def stored(spark, tmp_path, rows, files=4):
    path = str(tmp_path / "logs")
    run_table(spark, rows).repartition(files, "run_id").write.partitionBy("month").parquet(path)
    return path


def stream_rows():
    rows = []
    for i in range(60):
        at = NOW - timedelta(hours=(i * 37) % 50, minutes=i)
        rows.append(run_row(f"app{i % 2}", uid(i), at, log_of(f"J{i % 5}"), [{"type": "ERROR"}] if i % 3 == 0 else []))
    return rows


def test_streams_equal_batch(spark, tmp_path):
    path = stored(spark, tmp_path, stream_rows())
    want = sorted(map(tuple, op.latest_runs(src.read_run_logs(spark, path, NOW - 30 * DAY), NOW - 30 * DAY).collect()))

    stream = src.stream_run_logs(spark, path, max_files=1)
    writer = st.maintain_latest(stream, str(tmp_path / "state"), str(tmp_path / "p1"), clock=lambda: NOW)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) > 1
    assert sorted(map(tuple, st.read_latest(spark, str(tmp_path / "state")).collect())) == want
    full = st.refresh_latest(spark, lambda since: src.read_run_logs(spark, path, since), str(tmp_path / "state"), NOW)
    assert full.phase == "bootstrap"
    assert sorted(map(tuple, st.read_latest(spark, str(tmp_path / "state")).collect())) == want

    last = {}

    def keep(batch, batch_id):
        last.update({(r.app_name, r.job): tuple(r)[:-1] for r in batch.collect() if not r.evicted})

    writer = st.stream_latest_runs(stream).writeStream.outputMode("update").foreachBatch(keep)
    writer.option("checkpointLocation", str(tmp_path / "p2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(last.values()) == want


def test_dormant_jobs_leave_the_stream(spark, tmp_path):
    """Four appended slices: late rows count while they are young enough, and a job without news is told to go."""
    path, told = str(tmp_path / "logs"), []

    def feed(*runs):
        run_table(spark, logs(*runs)).write.mode("append").partitionBy("month").parquet(path)
        told.clear()
        stream = st.stream_latest_runs(src.stream_run_logs(spark, path), retention=5 * DAY)
        keep = lambda batch, _id: told.extend(tuple(r) for r in batch.select("job", "run_id", "evicted").collect())
        writer = stream.writeStream.outputMode("update").foreachBatch(keep)
        writer.option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
        return sorted(told)

    assert feed(("A", 1, 20 * DAY), ("B", 2, 19 * DAY), ("B", 3, 18 * DAY)) == [("A", uid(1), False), ("B", uid(3), False)]
    # Two days late, and older than what is known of B; a job that is new, though its row is late.
    assert feed(("B", 4, 20 * DAY), ("C", 5, 20 * DAY), ("A", 6, 16 * DAY)) == [("A", uid(6), False), ("C", uid(5), False)]
    got = feed(("D", 7, 12 * DAY))
    assert ("D", uid(7), False) in got and ("B", uid(3), True) in got and ("C", uid(5), True) in got
    # Too late for the state; B comes back as a new job.
    got = feed(("C", 8, 18 * DAY), ("B", 9, 12 * DAY), ("A", 10, 16 * DAY))
    assert got == [("A", uid(10), False), ("B", uid(9), False)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, root, progress = stored(spark, tmp_path, stream_rows()[:30]), str(tmp_path / "state"), str(tmp_path / "p")

    def drain():
        stream = src.stream_run_logs(spark, path)
        query = st.maintain_latest(stream, root, progress, clock=lambda: NOW).trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert drain() == 30
    late = [run_row("app0", uid(500), NOW - 20 * DAY, log_of("LATE")), run_row("app0", uid(501), NOW - 40 * DAY, log_of("GONE"))]
    run_table(spark, stream_rows()[30:] + late).write.mode("append").partitionBy("month").parquet(path)
    assert drain() == 32
    want = ids(op.latest_runs(run_table(spark, stream_rows()), NOW - 30 * DAY))
    assert ids(st.read_latest(spark, root)) == {**want, "LATE": uid(500)}


def test_stream_from_a_month_on(spark, tmp_path):
    rows = [run_row("a", uid(i), at, log_of(f"J{i}")) for i, at in enumerate(["2025-12-31", "2026-05-09", "2026-05-31", "2026-06-01", "2027-01-01"])]
    path = stored(spark, tmp_path, rows)
    stream = src.stream_run_logs(spark, path, since="2026-05-10")
    writer = stream.select("run_id", "month").writeStream.format("memory").queryName("recent")
    query = writer.option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("recent").collect()))
    assert got == [(uid(2), "2026-05"), (uid(3), "2026-06"), (uid(4), "2027-01")]
    assert sum(p["numInputRows"] for p in query.recentProgress) == 3  # neither the folder of 2025 nor the day before


def test_stream_health(spark, tmp_path):
    path = stored(spark, tmp_path, stream_rows())
    source = lambda since: src.read_run_logs(spark, path, since)
    stream = src.stream_run_logs(spark, path)
    root = str(tmp_path / "state")
    writer = st.stream_app_health(stream, source, root, str(tmp_path / "p"), clock=lambda: NOW)
    writer.trigger(availableNow=True).start().awaitTermination()
    want = op.app_health(source(NOW - DAY), NOW - DAY)
    assert sorted(map(tuple, st.read_health(spark, root).collect())) == sorted(map(tuple, want.collect()))


def test_panes_equal_the_scan(spark, tmp_path):
    path = str(tmp_path / "panes")
    table = run_table(spark, stream_rows()).cache()
    for n in range(3):
        some = table.where(F.crc32(F.col("run_id").cast("binary")) % 3 == n)
        for _ in range(2):  # a micro-batch that is run again
            st.add_panes(some, path, n)
    for since in (NOW - DAY, NOW - DAY + timedelta(seconds=17), NOW - timedelta(hours=49, minutes=59, microseconds=1), NOW + DAY,
                  stream_rows()[7][2], stream_rows()[7][2] - timedelta(microseconds=1)):
        got = st.sliding_health(st.read_panes(spark, path, since), table, since)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, op.app_health(table, since).collect()))


def test_window_reads_one_minute_and_its_days(spark, tmp_path):
    path, root = str(tmp_path / "logs"), str(tmp_path / "panes")
    rows = [run_row("a", uid(i), NOW - timedelta(hours=i), log_of("J"), []) for i in range(96)]
    src.write_days(run_table(spark, rows).drop("month", "day"), path)
    st.add_panes(run_table(spark, rows), root, 0)
    since = NOW - DAY
    panes, raw = st.read_panes(spark, root, since), src.read_run_logs(spark, path, since)
    assert {f.split("day=")[1][:10] for f in panes.inputFiles()} == {"2026-06-24", "2026-06-25"}
    assert st.sliding_health(panes, raw, since).head()["runs"] == 24
    plan = plan_of(st.sliding_health(panes, raw, since))
    assert "(day" in plan and "2026-06-24" in plan and "2026-06-24T12:01" in plan.replace(" ", "T")


METRICS = (NOW, 23, 0, 42, None)


def beat(spark, *metrics):
    rows = st.heartbeat_run(spark.createDataFrame(list(metrics), HEARTBEAT_METRICS), NOW, "monitor").collect()
    return [(r, json.loads(r.verbose_log), json.loads(r.warn_error_logs)) for r in rows]


def test_healthy_beat(spark):
    [(row, log, issues)] = beat(spark, METRICS)
    assert row.app_name == "monitor" and len(row.run_id) == 36
    assert log[0]["note"]["argv"][2] == "heartbeat" and (log[0]["func"], log[0]["tag"]) == ("on_boot", "CALL")
    assert issues == [] and {e["type"] for e in log} == {"INFO"}
    assert log[1]["note"] == {"asOf": "2026-06-25T12:00:00.000Z", "cacheSize": 23, "coverageUnknown": 0, "lastRefreshMs": 42}
    assert {e["run_id"] for e in log} == {row.run_id}
    assert {e["dt"] for e in log} == {"2026-06-25T12:00:00.000Z"}


def test_failed_beat(spark):
    [(_, log, issues)] = beat(spark, (NOW, 1, 0, 1, "refused\n  now " + "x" * 500))
    assert len(issues) == 1 and issues[0] in log and issues[0]["note"] == {"phase": "grid refresh"}
    assert issues[0]["err_msg"].startswith("refused now x") and issues[0]["err_msg"].endswith("…(truncated)")


def test_beat_without_metrics(spark):
    got = beat(spark, (None, None, None, None, ""), METRICS)
    assert len(got) == 2 and len({row.run_id for row, _, _ in got}) == 2
    assert all(not issues for _, _, issues in got)
    nulls = [log[1]["note"] for _, log, _ in got if log[1]["note"]["asOf"] is None]
    assert nulls == [{"asOf": None, "cacheSize": None, "coverageUnknown": None, "lastRefreshMs": None}]


def test_beat_shows_in_the_grid(spark, tmp_path):
    path = str(tmp_path / "logs")
    metrics = spark.createDataFrame([(NOW, 1, 0, 1, "down")], HEARTBEAT_METRICS)
    src.append_run_rows(st.heartbeat_run(metrics, NOW, "monitor"), path, "monitor", NOW)
    schedules = src.load_schedules(spark, [{"app_name": "monitor", "job": "heartbeat", "every_min": 5, "grace_min": 10}])
    later = NOW + timedelta(minutes=16)
    latest = op.latest_runs(src.read_run_logs(spark, path, NOW - DAY), NOW - DAY)
    row = op.job_grid(latest, schedules, later).head()
    assert (row.app, row.job, row.status, row.stale) == ("monitor", "heartbeat", "ERROR", True)
