"""The library's input tables, derived from the star-schema and event tables.

One run is one user's calendar day; connectivity comes from customers and suppliers,
acquisitions from line items. All rules are repeated, on flat data, in ``oracle.py``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runpulse.functions.instants import iso_micros
from runpulse.functions.months import day_of, month_of
from runpulse.sources.assemble import assemble_runs
from runpulse.sources.schedules import load_schedules

# The events end three minutes before this.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
ACQUISITIONS_SINCE = datetime(1996, 1, 1, tzinfo=timezone.utc)
# Check times of the two connectivity tables are counted back from this instant, in microseconds.
CHECKED_UNTIL = 1706659200000000
HOUR_US, MINUTE_US = 3_600_000_000, 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uuid_of(text: Column) -> Column:
    digest = F.md5(text)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def event_job(user: Column) -> Column:
    return F.when(user % 5 == 0, "(default)").otherwise(F.concat(F.lit("JOB_"), (user % 15).cast("string")))


# What a run of the bridge is: one user's calendar day.
RUN_OF = ("user_id", "day")


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat log events, plus ``ts`` and the keys of ``RUN_OF``, by which they come partitioned.

    The first event of a run names the job in ``note.argv``. Only numbers and the event type
    are shuffled; ids, names and notes are made afterwards.
    """
    ts = F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").select("event_id", ts.alias("ts"), "user_id", "event_type", F.to_date(ts).alias("day"))
    placed = events.withColumn("seq", F.row_number().over(Window.partitionBy(*RUN_OF).orderBy("ts", "event_id")))
    user, kind, first = F.col("user_id"), F.col("event_type"), F.col("seq") == 1
    severity = F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").otherwise("INFO")
    argv = F.array(F.lit("node"), F.lit("index.js"), F.nullif(event_job(user), F.lit("(default)")))
    note = F.to_json(F.struct(F.array_compact(argv).alias("argv")))
    failure = F.concat(F.lit("failed at event "), F.col("event_id").cast("string"))
    return placed.select(
        *RUN_OF,
        F.concat(F.lit("app_"), (user % 5).cast("string")).alias("app_name"),
        uuid_of(F.concat_ws("|", F.lit("run"), user.cast("string"), F.col("day").cast("string"))).alias("run_id"),
        "seq",
        "ts",
        iso_micros(F.col("ts")).alias("dt"),
        severity.alias("type"),
        kind.alias("func"),
        F.when(first, "CALL").otherwise("DETAILS").alias("tag"),
        F.when(first, note).alias("note"),
        F.when(severity == "ERROR", failure).alias("err_msg"),
    )


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run-log table. A run is written one second after its last event."""
    written = F.max("ts") + F.expr("INTERVAL 1 SECOND")
    runs = assemble_runs(flat_events(spark, sf_dir), *RUN_OF, inserted_at=written)
    written_at = F.col("inserted_at")
    return runs.withColumns({"month": month_of(written_at), "day": day_of(written_at)})


def schedules(spark: SparkSession) -> DataFrame:
    """A cadence for every job but one."""
    rows = [{"app_name": f"app_{u % 5}", "job": f"JOB_{u}", "every_min": 30, "grace_min": 15} for u in range(15) if u % 5 and u != 1]
    return load_schedules(spark, [*rows, {"app_name": "app_0", "job": "(default)", "every_min": 20, "grace_min": 10}])


def _connectivity(source: DataFrame, prefix: str, key: str, balance: str, unseen: int, hours: int, minutes: int) -> DataFrame:
    k, bal = F.col(key), F.col(balance)
    return source.select(
        F.concat(F.lit(prefix), k.cast("string")).alias("system_id"),
        F.when(k % unseen != 0, F.timestamp_micros(F.lit(CHECKED_UNTIL) - (k % hours) * HOUR_US)).alias("capture_datetime"),
        F.timestamp_micros(F.lit(CHECKED_UNTIL) - (k % minutes) * MINUTE_US).alias("inserted_at"),
        F.when(bal < 0, False).when(bal >= 5000, True).alias("successful_acquisition"),
        (k % 2 == 0).alias("host_intervention"),
        F.when(bal < 0, "timeout").alias("connection_error"),
        F.when(bal < 0, "NETWORK").alias("error_category"),
        F.lit("CONNECT").alias("phase"),
    )


def connectivity_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hhm = _connectivity(table(spark, sf_dir, "customer"), "C", "c_custkey", "c_acctbal", 11, 97, 13)
    mmb = _connectivity(table(spark, sf_dir, "supplier"), "S", "s_suppkey", "s_acctbal", 7, 31, 5)
    return hhm, mmb


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("system_id"),
        F.when(F.col("l_linestatus") == "O", "hhm").otherwise("mmb").alias("data_source"),
        F.when(part % 5 == 0, F.concat(F.lit("M"), (part % 7).cast("string"))).otherwise("").alias("manufacturer"),
        F.when(part % 3 == 0, F.concat(F.lit("MOD"), (part % 4).cast("string"))).alias("modality"),
        F.when(flag == "R", False).when(flag == "N", True).alias("successful_acquisition"),
        F.col("l_shipdate").cast("timestamp").alias("inserted_at"),
    )


# --- deliberately broken inputs -------------------------------------------------------------

def dirty_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, doc``: event arrays of ten shapes, most of them against the contract."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    kind = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    shapes = {
        0: '[{"type":"%s"}]',
        1: '[1,{"type":"%s"},null]',
        2: '{"type":"%s"}',
        3: "{bad",
        4: '[{"type":"%s"},{bad]',
        6: "",
        7: ' [{"note":{"type":"ERROR"}},{"type":"%s"}]',
        8: '[[{"type":"ERROR"}],"ERROR",{"type":"%s"}]',
        9: '[{"type":{"ERROR":1}}]',
    }
    shape = F.coalesce(*[F.when(F.col("event_id") % 10 == n, text) for n, text in shapes.items()])
    return events.select("event_id", F.replace(shape, F.lit("%s"), kind).alias("doc"))


def dirty_dts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, dt``: instants of eight shapes, two of them acceptable."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    good, kind = iso_micros(F.col("ts")), F.col("event_id") % 8
    dt = (
        F.when(kind == 0, good)
        .when(kind == 1, F.concat(F.substring(good, 1, 19), F.lit("Z")))
        .when(kind == 2, F.substring(good, 1, 26))
        .when(kind == 3, F.concat(F.substring(good, 1, 26), F.lit("+00:00")))
        .when(kind == 4, F.replace(good, F.lit("T"), F.lit(" ")))
        .when(kind == 5, F.concat(F.lit("2024-02-30"), F.substring(good, 11, 20)))
        .when(kind == 6, "not-a-date")
    )
    return events.select("event_id", dt.alias("dt"))


def dirty_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run-log table with a defect of the issues, or of the id, chosen by the last digit of the run id."""
    runs = run_logs(spark, sf_dir)
    defect = F.ascii(F.substring("run_id", 36, 1)) % 7
    issues = F.col("warn_error_logs")
    keys_turned = F.regexp_replace(issues, r'"run_id":"([^"]*)","dt":"([^"]*)","type":"([A-Z]*)"', '"type":"$3","dt":"$2","run_id":"$1"')
    every_one_twice = F.concat(F.substring(issues, F.lit(1), F.length(issues) - 1), F.lit(","), F.substring(issues, 2, 1 << 30))
    return runs.withColumns(
        {
            "run_id": F.when(defect == 5, F.upper("run_id")).otherwise(F.col("run_id")),
            "verbose_log": F.when(defect == 2, "{bad").otherwise(F.col("verbose_log")),
            "warn_error_logs": F.when(defect == 0, keys_turned)
            .when((defect == 1) & (F.length(issues) > 2), every_one_twice)
            .when(defect == 3, "['a',{'type':'ERROR'}]")
            .when(defect == 4, F.concat(issues, F.lit(" junk")))
            .when(defect == 6, '[{"type":"ERROR","n":NaN}]')
            .otherwise(issues),
        }
    )


def dirty_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run-log table with a defect chosen by the last digit of the run id."""
    runs = run_logs(spark, sf_dir)
    defect = F.ascii(F.substring("run_id", 36, 1)) % 8
    log, issues = F.col("verbose_log"), F.col("warn_error_logs")
    return runs.withColumns(
        {
            "run_id": F.when(defect == 0, F.concat(F.lit("x"), F.substring("run_id", 2, 35))).otherwise(F.col("run_id")),
            "verbose_log": F.when(defect == 1, '{"type":"ERROR"}')
            .when(defect == 3, F.replace(log, F.lit('Z"'), F.lit('"')))
            .when(defect == 4, "[]")
            .when(defect == 7, F.replace(log, F.lit("[{\"run_id\""), F.lit('[{"dt":"2030-01-01T00:00:00Z"},{"run_id"')))
            .otherwise(log),
            "warn_error_logs": F.when(defect == 2, '[{"type":"ERROR","dt":"x"}]')
            .when(defect == 6, "{bad")
            .when(defect != 5, issues),
        }
    )
