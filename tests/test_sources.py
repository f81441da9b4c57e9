"""Readers, writers and assembly."""

import json
from datetime import timedelta
from fnmatch import fnmatch

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from runpulse import sources as src
from runpulse.functions import month_of
from runpulse.schemas import ACQUISITIONS, FLAT_EVENTS
from runpulse.session import shared_folder
from runpulse.sources import run_files
from util import NOW, log_of, run_row, run_table, uid, utc


def test_bounds_and_columns(spark, tmp_path):
    rows = [run_row("a", uid(i), at) for i, at in enumerate(["2026-04-30T23:59:59", "2026-05-01T00:00:00", "2026-05-31T00:00:00", "2026-06-01T00:00:00"])]
    path = str(tmp_path / "logs")
    run_table(spark, rows).write.partitionBy("month").parquet(path)
    got = src.read_run_logs(spark, path, "2026-05-01", "2026-06-01", ["run_id", "month"])
    assert sorted(map(tuple, got.collect())) == [(uid(1), "2026-05"), (uid(2), "2026-05")]
    assert src.read_run_logs(spark, path, "2026-05-31").count() == 2


def test_only_the_days_asked_for_are_opened(spark, tmp_path):
    path = str(tmp_path / "logs")
    for i in range(40):
        src.append_run_rows(run_table(spark, [run_row("x", uid(i), NOW)]).coalesce(1), path, "monitor", NOW - timedelta(days=i))
    day = lambda df: sorted(f.split("/day=")[1][:10] for f in df.inputFiles())
    assert day(src.read_run_logs(spark, path, NOW - timedelta(minutes=5))) == ["2026-06-25"]
    assert day(src.read_run_logs(spark, path, NOW - timedelta(days=2), NOW - timedelta(days=1))) == ["2026-06-23", "2026-06-24"]
    assert src.read_run_logs(spark, path, NOW - timedelta(days=25)).count() == 26


def test_months_without_day_folders(spark, tmp_path):
    path = str(tmp_path / "logs")
    old = run_table(spark, [run_row("x", uid(i), NOW - timedelta(days=i)) for i in range(40)]).drop("day")
    old.write.partitionBy("month").parquet(path)
    src.append_run_rows(run_table(spark, [run_row("x", uid(99), NOW)]), path, "monitor", NOW + timedelta(days=10))
    assert src.read_run_logs(spark, path, NOW - timedelta(days=25)).count() == 27


def test_summaries_are_parsed_once(spark, tmp_path):
    from runpulse import operators as op

    path = str(tmp_path / "summaries")
    rows = [run_row("a", uid(i), NOW - timedelta(hours=i), log_of(f"J{i % 3}"), [{"type": "WARN"}] * (i % 2)) for i in range(50)]
    runs, since = run_table(spark, rows), NOW - timedelta(days=1)
    src.append_summaries(runs, path)
    stored = src.read_summaries(spark, path, since)
    assert sorted(op.latest_runs(stored, since).collect()) == sorted(op.latest_runs(runs, since).collect())
    assert sorted(op.cadence_profile(stored, NOW, 1).collect()) == sorted(op.cadence_profile(runs, NOW, 1).collect())


def test_months_are_utc_in_any_session(spark):
    at = [utc("2026-05-31T23:59:59.999999"), utc("2026-06-01T00:00:00"), utc("1969-12-31T23:59:59.5")]
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t timestamp").orderBy("i")
        assert [r[0] for r in rows.select(month_of(F.col("t"))).collect()] == ["2026-05", "2026-06", "1969-12"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_month_pattern():
    """Every month of four decades against the pattern of some."""
    labels = [f"{y}-{m:02d}" for y in range(1995, 2035) for m in range(1, 13)]
    for start in ("1999-12", "2009-09", "2026-06", "2029-10", "2019-99"):
        alternatives = src.run_logs.months_from(start).removeprefix("month={").removesuffix("}").split(",")
        assert [m for m in labels if any(fnmatch(m, a) for a in alternatives)] == [m for m in labels if m >= start]


def test_append_forces_name_and_clock(spark, tmp_path):
    path = str(tmp_path / "logs")
    run_table(spark, [run_row("other", uid(1).upper(), "2020-01-01", log_of("J"), [])]).transform(
        lambda df: src.append_run_rows(df, path, "monitor", NOW) or df
    )
    row = src.read_run_logs(spark, path, "2000-01-01").head()
    assert (row.app_name, row.run_id, row.inserted_at, row.month) == ("monitor", uid(1), NOW.replace(tzinfo=None), "2026-06")
    src.append_run_rows(run_table(spark, [run_row("x", uid(2), NOW)]), path, "monitor")
    assert src.read_run_logs(spark, path, "2000-01-01").count() == 2


def test_appended_files_carry_a_bloom_filter_on_the_run_id(spark, tmp_path):
    path = str(tmp_path / "logs")
    src.append_run_rows(run_table(spark, [run_row("x", uid(i), NOW) for i in range(50)]), path, "monitor", NOW)
    [file, *_] = [str(f) for f in (tmp_path / "logs").glob("month=*/day=*/*.parquet")]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in reader.getFooter().getBlocks()[0].getColumns()}
    reader.close()
    assert offsets["run_id"] > 0 and offsets["app_name"] <= 0


def test_assemble(spark):
    events = [
        ("a", uid(1), 2, "t2", "ERROR", "f", "CATCH", None, 'quote " and \n line'),
        ("a", uid(1), 1, "t1", "INFO", "on_boot", "CALL", '{"argv":["n","i","J"],"none":null}', None),
        ("a", uid(1), 10, "t3", "WARN", None, None, None, None),
        ("b", uid(2), 1, "t1", "INFO", "f", "CALL", None, None),
    ]
    runs = src.assemble_runs(spark.createDataFrame(events, FLAT_EVENTS), events=F.count("*"))
    got = {r.app_name: r for r in runs.collect()}
    log, issues = json.loads(got["a"].verbose_log), json.loads(got["a"].warn_error_logs)
    assert [e["dt"] for e in log] == ["t1", "t2", "t3"] and got["a"].events == 3
    assert log[0]["note"] == {"argv": ["n", "i", "J"], "none": None}
    assert issues == log[1:] and issues[0]["err_msg"] == 'quote " and \n line'
    assert got["b"].warn_error_logs == "[]"


def test_run_files(spark, tmp_path):
    first, second = uid(1), uid(2)
    (tmp_path / f"reports-log.dev.{first}.json").write_text(json.dumps(log_of("J"), indent=1))
    (tmp_path / "my").mkdir()
    (tmp_path / "my" / f"my-log-app-log.prod.{second}.json").write_text("[]")
    (tmp_path / "notes.json").write_text("[]")
    (tmp_path / "odd-log.x.json").write_text("[]")
    assert src.read_run_files(spark, f"{tmp_path}/*.json").count() == 1
    got = {r.app_name: r for r in src.read_run_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"reports", "my-log-app"}
    assert (got["reports"].logger, got["reports"].run_id) == ("dev", first)
    assert json.loads(got["reports"].verbose_log)[0]["note"]["argv"][2] == "J"
    assert got["reports"].modified_at is not None


def test_run_files_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no list of files, and the tasks find what Spark's reader finds."""
    deep = tmp_path / "2026" / "06 é%20" / "x"
    for folder in (deep, tmp_path / "_half", tmp_path / ".gone", tmp_path / "_day=1"):
        folder.mkdir(parents=True)
    for n in range(40):
        (tmp_path / "2026" / f"a{n}-log.dev.{uid(n)}.json").write_bytes(b"[%d]" % n)
    (deep / f"é-log.dev.{uid(50)}.json").write_bytes(b"\xef\xbb\xbf[\xff]\r\n")
    (deep / f"é-log.dev.{uid(51)}.json").write_bytes(b"")
    (deep / f"_x-log.dev.{uid(52)}.json").write_text("[]")
    for name in ("_half", ".gone", "_day=1"):
        (tmp_path / name / f"{name[1:]}-log.dev.{uid(53)}.json").write_text("[]")
    for path in (str(tmp_path), f"file://{tmp_path}/2026", f"{tmp_path}/*/*", f"{tmp_path}/2026/a1*.json"):
        found = src.read_run_files(spark, path)
        assert found.inputFiles() == []
        columns = [F.regexp_extract("name", "^(.+)-log", 1), F.hex(F.col("verbose_log").cast("binary")), "modified_at"]
        expected = run_files._read_by_spark(spark, path).select(*columns).collect()
        got = found.select("app_name", F.hex(F.col("verbose_log").cast("binary")), "modified_at").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and got
    with pytest.raises(AnalysisException):
        src.read_run_files(spark, f"{tmp_path}/none")


def test_acquisitions_are_stored_in_time_order(spark, tmp_path):
    rows = [(None, f"S{i}", "hhm", None, None, True, None, None, None, NOW - timedelta(minutes=i * 7 % 100)) for i in range(100)]
    path = str(tmp_path / "acq")
    src.write_acquisitions(spark.createDataFrame(rows, ACQUISITIONS), path)
    assert src.read_acquisitions(spark, path, NOW - timedelta(minutes=50)).count() == 50
    spans = (
        spark.read.parquet(path)
        .groupBy(F.input_file_name())
        .agg(F.min("inserted_at").alias("a"), F.max("inserted_at").alias("b"))
        .orderBy("a")
        .collect()
    )
    assert all(left.b <= right.a for left, right in zip(spans, spans[1:]))


def test_schedule_values(spark):
    rows = [{"app_name": "a", "job": "J", "every_min": "25 7 * * *"}, {"app_name": "a", "job": "K", "every_min": 0.5, "grace_min": True}]
    got = {r.job: (r.every_min, r.grace_min) for r in src.load_schedules(spark, rows).collect()}
    assert got == {"J": (None, None), "K": (0.5, None)}
    assert src.load_schedules(spark, []).count() == 0


class StubSession:
    """Just enough of a session to name a master and a checkpoint folder."""

    def __init__(self, master, named=None):
        self.master, self.named, self.folder = master, named, None
        self.sparkContext = self.conf = self

    def get(self, _key, _default):
        return self.named

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder + "/run"


def test_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)
    named = StubSession("spark://cluster", "hdfs://cluster/scratch/")
    assert shared_folder(named) == "hdfs://cluster/scratch" and named.folder
    assert shared_folder(StubSession("local[8]")).endswith("/run")
    with pytest.raises(RuntimeError):
        shared_folder(StubSession("yarn"))
