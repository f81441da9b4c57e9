"""Small fixtures as DataFrames."""

import json
from datetime import datetime, timezone

from runpulse.schemas import LATEST_RUNS, RUN_LOGS

NOW = datetime(2026, 6, 25, 12, tzinfo=timezone.utc)


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def run_row(app, run_id, inserted_at, verbose=None, issues=None):
    as_text = lambda doc: doc if doc is None or isinstance(doc, str) else json.dumps(doc)
    at = utc(inserted_at) if isinstance(inserted_at, str) else inserted_at
    return (app, run_id, at, as_text(verbose), as_text(issues), f"{at:%Y-%m}", f"{at:%Y-%m-%d}")


def run_table(spark, rows):
    return spark.createDataFrame(rows, RUN_LOGS)


def log_of(job=None, *dts, types=()):
    argv = ["/node", "/index.js"] + ([job] if job is not None else [])
    dts = dts or ("2026-06-25T11:00:00.000Z",)
    types = list(types) + ["INFO"] * (len(dts) - len(types))
    events = [{"dt": dt, "type": t} for dt, t in zip(dts, types)]
    events[0]["note"] = {"argv": argv}
    return events


def latest_table(spark, rows):
    """Rows of (app, job, run_id, inserted_at)."""
    full = [(a, j, r, utc(t) if isinstance(t, str) else t, None, None, None, "SUCCESS", 0) for a, j, r, t in rows]
    return spark.createDataFrame(full, LATEST_RUNS)


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
