"""The queries of ``queries.py`` in plain SQL over the flat tables, for DuckDB.

Nothing here goes through JSON: job, status, times and counts come straight from the event
rows by the bridge's rules, so the Spark side's rendering and parsing are both checked.
"""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
RETENTION_START = "TIMESTAMP '2024-01-01 00:00:00'"
DAY_AGO = "TIMESTAMP '2024-01-30 00:00:00'"
NOW_MS = 1706659200000


def _ms(ts: str) -> str:
    """Whole milliseconds, cut like a clock's: epoch_ms would round."""
    return f"(epoch_us({ts}) // 1000)"


def _uuid(text: str) -> str:
    h = f"md5({text})"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "(" + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in cuts) + ")"


RUN_ID = _uuid("'run|' || user_id || '|' || CAST(ts AS DATE)")
RUN_7 = _uuid("'run|7|2024-01-15'")

EVENTS = f"""
ev AS (
  SELECT event_id, ts, user_id,
         'app_' || (user_id % 5) AS app_name,
         CASE WHEN user_id % 5 = 0 THEN '(default)' ELSE 'JOB_' || (user_id % 15) END AS job,
         {RUN_ID} AS run_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS dt,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS type,
         event_type AS func
  FROM events
),
noted AS (
  SELECT *, CASE WHEN pos = 0 THEN 'CALL' ELSE 'DETAILS' END AS tag,
         CASE WHEN pos = 0 THEN '{{"argv":["node","index.js"' ||
              CASE WHEN job = '(default)' THEN '' ELSE ',"' || job || '"' END || ']}}' END AS note,
         CASE WHEN type = 'ERROR' THEN 'failed at event ' || event_id END AS err_msg
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos FROM ev)
)"""

RUNS = (
    EVENTS
    + """,
runs AS (
  SELECT app_name, job, run_id, max(ts) + INTERVAL 1 SECOND AS inserted_at, min(ts) AS started_at, max(ts) AS ended_at,
         (epoch_us(max(ts)) - epoch_us(min(ts)) + 500) // 1000 AS duration_ms,
         CASE WHEN bool_or(type = 'ERROR') THEN 'ERROR' WHEN bool_or(type = 'WARN') THEN 'WARN' ELSE 'SUCCESS' END AS status,
         CAST(count(*) FILTER (WHERE type IN ('ERROR', 'WARN')) AS INTEGER) AS issue_count,
         bool_or(type = 'ERROR') AS errored, bool_or(type = 'WARN') AS warned
  FROM ev GROUP BY app_name, job, run_id
)"""
)

SUMMARY = "app_name, job, run_id, inserted_at, started_at, ended_at, duration_ms, status, issue_count"

GRID = (
    RUNS
    + f""",
latest AS (
  SELECT {SUMMARY} FROM (
    SELECT *, row_number() OVER (PARTITION BY app_name, job ORDER BY inserted_at DESC, run_id DESC) AS rn
    FROM runs WHERE inserted_at >= {RETENTION_START}) WHERE rn = 1
),
judged AS (
  SELECT *, {NOW_MS} - {_ms('inserted_at')} AS age_ms,
         CAST(CASE WHEN job = '(default)' THEN 1800000 WHEN job <> 'JOB_1' THEN 2700000 END AS BIGINT) AS budget_ms
  FROM latest
),
grid AS (
  SELECT app_name AS app, job, run_id, inserted_at AS last_run, started_at, ended_at, duration_ms, status,
         issue_count, age_ms, age_ms > budget_ms AS stale, budget_ms,
         CASE status WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END AS status_rank
  FROM judged
)"""
)

LATEST = f"WITH {GRID} SELECT * FROM latest"

EVENT_JSON = """'{"run_id":"' || run_id || '","dt":"' || dt || '","type":"' || type || '","func":"' || func ||
  '","tag":"' || tag || '"' || coalesce(',"note":' || note, '') || coalesce(',"err_msg":"' || err_msg || '"', '') || '}'"""
DOCUMENTS = f"""
docs AS (
  SELECT app_name, run_id, max(ts) + INTERVAL 1 SECOND AS inserted_at,
         '[' || string_agg({EVENT_JSON}, ',' ORDER BY pos) || ']' AS verbose_log,
         '[' || coalesce(string_agg({EVENT_JSON}, ',' ORDER BY pos) FILTER (WHERE type <> 'INFO'), '') || ']' AS warn_error_logs
  FROM noted GROUP BY app_name, run_id
)"""


def _sort(order: str) -> str:
    return f"""WITH {GRID} SELECT row_number() OVER (ORDER BY {order}, app, job) AS pos,
      app, job, status, age_ms, duration_ms, issue_count FROM grid"""


SORT_KEYS = {
    "app": "app",
    "job": "job",
    "status": "status_rank",
    "lastrun": _ms("last_run"),
    "age": "age_ms",
    "duration": "duration_ms",
    "issues": "issue_count",
}
SORT_ORDERS = {
    f"{key}_{direction}": f"{by} {direction} NULLS LAST" + (", age_ms DESC NULLS LAST" if key == "status" else "")
    for key, by in SORT_KEYS.items()
    for direction in ("asc", "desc")
}

# The runs of ``bridge.dirty_runs``, each as a job of its own.
WIDE = f"""
broken AS (SELECT *, ascii(substr(run_id, 36, 1)) % 8 AS defect FROM runs),
wide AS (
  SELECT app_name AS app, CASE WHEN defect = 0 THEN 'x' || substr(run_id, 2) ELSE run_id END AS job,
         CASE WHEN defect = 2 THEN 'ERROR' WHEN defect IN (5, 6) THEN 'SUCCESS' ELSE status END AS status,
         CAST(CASE WHEN defect = 2 THEN 1 WHEN defect IN (5, 6) THEN 0 ELSE issue_count END AS INTEGER) AS issue_count,
         CASE WHEN defect NOT IN (1, 3, 4, 7) THEN duration_ms END AS duration_ms,
         {NOW_MS} - {_ms('inserted_at')} AS age_ms
  FROM broken
)"""


def _sort_wide(order: str) -> str:
    return f"""WITH {RUNS}, {WIDE} SELECT row_number() OVER (ORDER BY {order}, app, job) AS pos,
      app, job, status, age_ms, duration_ms, issue_count FROM wide"""


STATUS_RANK = "CASE status WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END"


def _group(by: str) -> str:
    return f"""WITH {GRID}, placed AS (
      SELECT row_number() OVER (ORDER BY status_rank, age_ms DESC NULLS LAST, app, job) AS pos, * FROM grid)
    SELECT {by} AS group_key, min(pos) OVER (PARTITION BY {by}) AS group_pos, pos, app, job, status FROM placed"""


def _feed(days: int, limit: int) -> str:
    return f"""WITH {RUNS}
    SELECT e.app_name, e.run_id, e.dt, e.type, e.func, e.tag, e.err_msg, e.note
    FROM noted e JOIN runs r USING (run_id)
    WHERE r.inserted_at > {NOW} - INTERVAL {days} DAY AND e.type <> 'INFO'
    ORDER BY e.ts DESC NULLS FIRST, e.run_id, e.pos LIMIT {limit}"""


PAGE_COLUMNS = """run_id, inserted_at, strftime(inserted_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS inserted_at_iso, status, issue_count"""


def _page(limit: str, since: str = RETENTION_START, where: str = "true") -> str:
    return f"""WITH {RUNS} SELECT {PAGE_COLUMNS} FROM runs
    WHERE app_name = 'app_1' AND inserted_at > {since} AND {where}
    ORDER BY inserted_at DESC, run_id DESC {limit}"""


HEALTH = f"""
health AS (
  SELECT app_name, count(*) AS runs, count(*) FILTER (WHERE errored) AS errored,
         count(*) FILTER (WHERE warned) AS warned
  FROM runs WHERE inserted_at > {DAY_AGO} GROUP BY app_name
)"""
HEALTH_SQL = f"WITH {RUNS}, {HEALTH} SELECT * FROM health"

PROFILE = f"""
gaps AS (
  SELECT app_name, job, epoch_us(inserted_at) - lag(epoch_us(inserted_at)) OVER (PARTITION BY app_name, job ORDER BY inserted_at) AS gap
  FROM runs WHERE inserted_at > {NOW} - INTERVAL 7 DAY
),
profile AS (
  SELECT app_name, job, count(*) AS runs,
         round(quantile_cont(gap, 0.5) / 60000000.0, 1) AS median_gap_min,
         round(quantile_cont(gap, 0.9) / 60000000.0, 1) AS p90_gap_min,
         round(quantile_cont(gap, 0.99) / 60000000.0, 1) AS p99_gap_min,
         round(max(gap) / 60000000.0, 1) AS max_gap_min,
         max(gap) AS max_gap_us
  FROM gaps WHERE gap IS NOT NULL GROUP BY app_name, job
)"""


def _state(source: str, prefix: str, key: str, balance: str, unseen: int, hours: int, minutes: int, name: str) -> str:
    return f"""SELECT '{name}' AS source, '{prefix}' || {key} AS system_id,
      CASE WHEN {key} % {unseen} <> 0 THEN make_timestamp(1706659200000000 - ({key} % {hours}) * 3600000000) END AS capture_datetime,
      make_timestamp(1706659200000000 - ({key} % {minutes}) * 60000000) AS inserted_at,
      CASE WHEN {balance} < 0 THEN false WHEN {balance} >= 5000 THEN true END AS successful_acquisition,
      {key} % 2 = 0 AS host_intervention,
      CASE WHEN {balance} < 0 THEN 'timeout' END AS connection_error,
      CASE WHEN {balance} < 0 THEN 'NETWORK' END AS error_category,
      'CONNECT' AS phase FROM {source}"""


CONNECTIVITY = f"""
conn AS (
  {_state("customer", "C", "c_custkey", "c_acctbal", 11, 97, 13, "HHM")}
  UNION ALL
  {_state("supplier", "S", "s_suppkey", "s_acctbal", 7, 31, 5, "MMB")}
),
panel AS (
  SELECT source, system_id,
         CASE successful_acquisition WHEN false THEN 'OFFLINE' WHEN true THEN 'ONLINE' ELSE 'UNKNOWN' END AS status,
         capture_datetime, inserted_at,
         {NOW_MS} - {_ms('capture_datetime')} AS capture_age_ms,
         {NOW_MS} - {_ms('inserted_at')} AS checked_age_ms,
         error_category, phase, connection_error, host_intervention,
         CASE successful_acquisition WHEN false THEN 0 WHEN true THEN 2 ELSE 1 END AS status_rank
  FROM conn
)"""

ACQUISITIONS = """
acq AS (
  SELECT 'S' || l_suppkey AS system_id, CASE WHEN l_linestatus = 'O' THEN 'hhm' ELSE 'mmb' END AS data_source,
         CASE WHEN l_partkey % 5 = 0 THEN 'M' || (l_partkey % 7) ELSE '' END AS manufacturer,
         CASE WHEN l_partkey % 3 = 0 THEN 'MOD' || (l_partkey % 4) END AS modality,
         CASE l_returnflag WHEN 'R' THEN false WHEN 'N' THEN true END AS successful_acquisition,
         l_shipdate AS inserted_at
  FROM lineitem
),
recent AS (SELECT * FROM acq WHERE inserted_at > TIMESTAMP '1996-01-01 00:00:00'),
systems AS (
  SELECT system_id, data_source, nullif(max(manufacturer), '') AS manufacturer, nullif(max(modality), '') AS modality,
         count(*) AS runs, count(*) FILTER (WHERE NOT successful_acquisition) AS failed,
         strftime(max(inserted_at), '%Y-%m-%dT%H:%M:%SZ') AS last_seen
  FROM recent GROUP BY system_id, data_source
)"""

# The white space of the run-log contract, character by character.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"

KIND = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'SUCCESS' END"
DT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"

ORACLE: dict[str, str] = {
    "assemble_runs": f"WITH {EVENTS}, {DOCUMENTS} SELECT *, strftime(inserted_at, '%Y-%m') AS month, strftime(inserted_at, '%Y-%m-%d') AS day FROM docs",
    "read_run_logs": f"""WITH {EVENTS}, {DOCUMENTS}
      SELECT app_name, run_id, inserted_at, warn_error_logs, strftime(inserted_at, '%Y-%m') AS month,
        strftime(inserted_at, '%Y-%m-%d') AS day FROM docs
      WHERE inserted_at >= TIMESTAMP '2024-01-05 00:00:00' AND inserted_at < TIMESTAMP '2024-01-25 00:00:00'""",
    "append_run_rows": f"""WITH {EVENTS}, {DOCUMENTS}
      SELECT 'monitor' AS app_name, run_id, {NOW} AS inserted_at, warn_error_logs, '2024-01' AS month, '2024-01-31' AS day FROM docs""",
    "read_run_files": f"WITH {EVENTS}, {DOCUMENTS} SELECT app_name, 'dev' AS logger, run_id, verbose_log FROM docs",
    "read_acquisitions": f"WITH {ACQUISITIONS} SELECT * FROM recent",
    "read_connectivity": f"WITH {CONNECTIVITY} SELECT * FROM conn",
    "parse_events": f"""WITH {EVENTS}
      SELECT app_name, job, run_id, pos, dt, type, func, tag, note, err_msg FROM noted""",
    "run_contract": f"WITH {RUNS} SELECT {SUMMARY} FROM runs",
    "run_timing": f"""WITH {RUNS}, broken AS (SELECT *, ascii(substr(run_id, 36, 1)) % 8 AS defect FROM runs)
      SELECT CASE WHEN defect = 0 THEN 'x' || substr(run_id, 2) ELSE run_id END AS run_id,
        CASE WHEN defect = 7 THEN TIMESTAMP '2030-01-01 00:00:00' WHEN defect NOT IN (1, 3, 4) THEN started_at END AS started_at,
        CASE WHEN defect NOT IN (1, 3, 4) THEN ended_at END AS ended_at,
        CASE WHEN defect NOT IN (1, 3, 4, 7) THEN duration_ms END AS duration_ms
      FROM broken""",
    "issue_subset": f"""WITH {EVENTS}
      SELECT run_id, coalesce(string_agg(dt, ',' ORDER BY pos) FILTER (WHERE type <> 'INFO'), '') AS issue_dts
      FROM noted GROUP BY run_id""",
    "dirty_status": f"""SELECT event_id,
      CASE WHEN event_id % 10 IN (0, 1, 7, 8) THEN {KIND} ELSE 'SUCCESS' END AS status,
      CAST(n AS INTEGER) AS issue_count, CAST(n AS INTEGER) AS elements
      FROM (SELECT *, CASE event_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 7 THEN 2 WHEN 8 THEN 3 WHEN 9 THEN 1 ELSE 0 END AS n FROM events)""",
    "safe_ts": f"""SELECT event_id,
      CASE event_id % 8 WHEN 0 THEN {DT} WHEN 1 THEN substr({DT}, 1, 19) || 'Z' WHEN 2 THEN substr({DT}, 1, 26)
        WHEN 3 THEN substr({DT}, 1, 26) || '+00:00' WHEN 4 THEN replace({DT}, 'T', ' ')
        WHEN 5 THEN '2024-02-30' || substr({DT}, 11) WHEN 6 THEN 'not-a-date' END AS dt,
      CASE event_id % 8 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) END AS instant
      FROM events""",
    "iso_instants": f"""SELECT event_id, {DT} AS micros, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds,
      {NOW_MS} - {_ms('ts')} AS age_ms FROM events""",
    "summarize_error": f"""SELECT doc_id,
      CASE WHEN length(line) > 300 THEN substr(line, 1, 300) || ' …(truncated)' ELSE line END AS summary
      FROM (SELECT doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g'), ' ') AS line FROM documents)""",
    "contract_audit": f"""WITH {RUNS}, broken AS (SELECT *, ascii(substr(run_id, 36, 1)) % 8 AS defect FROM runs)
      SELECT app_name, count(*) AS runs,
        count(*) FILTER (WHERE defect = 0) AS bad_run_id,
        0 AS upper_case_run_id,
        count(*) FILTER (WHERE defect IN (1, 3, 4)) AS bad_first_dt,
        count(*) FILTER (WHERE defect IN (1, 3, 4)) AS bad_last_dt,
        count(*) FILTER (WHERE defect = 1) AS log_not_array,
        count(*) FILTER (WHERE defect = 6) AS issues_not_array,
        count(*) FILTER (WHERE job = '(default)' OR defect IN (1, 4, 7)) AS default_job,
        count(*) FILTER (WHERE defect = 7) AS out_of_order,
        count(*) FILTER (WHERE defect = 2 OR (defect IN (1, 3, 4) AND issue_count > 0)) AS issues_not_in_log
      FROM broken GROUP BY app_name""",
    "contract_audit_issues": f"""WITH {RUNS}, broken AS (SELECT *, ascii(substr(run_id, 36, 1)) % 7 AS defect FROM runs)
      SELECT app_name, count(*) AS runs, 0 AS bad_run_id,
        count(*) FILTER (WHERE defect = 5 AND upper(run_id) <> run_id) AS upper_case_run_id,
        count(*) FILTER (WHERE defect = 2) AS bad_first_dt,
        count(*) FILTER (WHERE defect = 2) AS bad_last_dt,
        count(*) FILTER (WHERE defect = 2) AS log_not_array,
        count(*) FILTER (WHERE defect IN (3, 4, 6)) AS issues_not_array,
        count(*) FILTER (WHERE job = '(default)' OR defect = 2) AS default_job,
        0 AS out_of_order,
        count(*) FILTER (WHERE defect IN (1, 2) AND issue_count > 0) AS issues_not_in_log
      FROM broken GROUP BY app_name""",
    "stored_summaries": f"""WITH {RUNS} SELECT {SUMMARY}, strftime(inserted_at, '%Y-%m') AS month,
        strftime(inserted_at, '%Y-%m-%d') AS day FROM runs
      WHERE inserted_at >= TIMESTAMP '2024-01-05 00:00:00' AND inserted_at < TIMESTAMP '2024-01-25 00:00:00'""",
    "latest_of_summaries": LATEST,
    "latest_runs": LATEST,
    "staleness": f"WITH {GRID} SELECT app_name, job, age_ms, budget_ms, age_ms > budget_ms AS stale FROM judged",
    "job_grid": f"WITH {GRID} SELECT * EXCLUDE (status_rank) FROM grid",
    "cadence_coverage": f"""WITH {GRID} SELECT count(*) AS total, count(budget_ms) AS configured,
      count(*) - count(budget_ms) AS unknown FROM grid""",
    "unknown_jobs": f"WITH {GRID} SELECT app, job, app || '/' || job AS unknown_job FROM grid WHERE budget_ms IS NULL",
    **{f"sort_jobs_{name}": _sort(order) for name, order in SORT_ORDERS.items()},
    **{f"sort_jobs_other_{direction}": _sort("1") for direction in ("asc", "desc")},
    "sort_runs_duration_asc": _sort_wide("duration_ms NULLS LAST"),
    "sort_runs_duration_desc": _sort_wide("duration_ms DESC NULLS LAST"),
    "sort_runs_issues_asc": _sort_wide("issue_count"),
    "sort_runs_status_asc": _sort_wide(f"{STATUS_RANK}, age_ms DESC"),
    "group_jobs_by_nothing": f"""WITH {GRID} SELECT CAST(NULL AS VARCHAR) AS group_key, CAST(1 AS BIGINT) AS group_pos,
      row_number() OVER (ORDER BY status_rank, age_ms DESC NULLS LAST, app, job) AS pos, app, job, status FROM grid""",
    "filter_jobs_overdue": f"""WITH {GRID} SELECT app, job, run_id, status, stale FROM grid
      WHERE status = 'ERROR' OR stale IS TRUE""",
    "group_jobs_by_app": _group("app"),
    "group_jobs_by_job": _group("job"),
    "group_rollup_status": f"""WITH {GRID} SELECT app AS group_key,
      CASE min(status_rank) WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'SUCCESS' END AS status FROM grid GROUP BY app""",
    "filter_jobs": f"""WITH {GRID} SELECT app, job, run_id, status, stale FROM grid
      WHERE contains(lower(app || ' ' || job || ' ' || run_id), 'job_1') AND (status = 'WARN' OR stale IS TRUE)""",
    "summarize_grid": f"""WITH {GRID} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ERROR') AS ERROR,
      count(*) FILTER (WHERE status = 'WARN') AS WARN, count(*) FILTER (WHERE status = 'SUCCESS') AS SUCCESS,
      count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE stale IS NULL) AS unknown FROM grid""",
    "error_feed": _feed(2, 100),
    "error_feed_week": _feed(7, 500),
    "error_feed_month": _feed(31, 1000),
    "error_feed_by_days": _feed(31, 300),
    "feed_parts": f"""WITH {RUNS} SELECT strftime(r.inserted_at, '%Y-%m-%d') AS day, date_trunc('hour', e.ts) AS hour, count(*) AS events
      FROM ev e JOIN runs r USING (run_id) WHERE e.type IN ('ERROR', 'WARN') GROUP BY ALL""",
    "run_by_index": f"""WITH {EVENTS}, {DOCUMENTS}
      SELECT app_name, run_id, inserted_at, verbose_log FROM docs WHERE run_id = {RUN_7}""",
    "run_index": f"WITH {RUNS} SELECT run_id, inserted_at, substr(md5(run_id), 1, 2) AS bucket FROM runs",
    "run_by_id": f"""WITH {EVENTS}, {DOCUMENTS}
      SELECT app_name, run_id, inserted_at, verbose_log FROM docs WHERE run_id = {RUN_7}""",
    "run_by_id_hinted": f"""WITH {EVENTS}, {DOCUMENTS}
      SELECT app_name, run_id, inserted_at, verbose_log FROM docs WHERE run_id = {RUN_7}""",
    "run_timeline": f"""WITH {RUNS}
      SELECT r.app_name, r.job, r.run_id, r.inserted_at, r.started_at, r.ended_at, r.duration_ms,
        e.pos, e.dt, e.type, e.func, e.tag, e.note, e.err_msg
      FROM runs r JOIN noted e USING (run_id) WHERE r.run_id = {RUN_7}""",
    "app_runs": _page(""),
    "app_runs_page": _page("LIMIT 200"),
    "app_runs_next_page": _page("LIMIT 50 OFFSET 50"),
    "app_runs_error_page": _page("LIMIT 200", where="errored"),
    "app_runs_issue_page": _page("LIMIT 200", where="(errored OR warned)"),
    "app_runs_pages_to_the_end": _page(""),
    "app_runs_pages": f"""WITH {RUNS}, placed AS (
        SELECT *, row_number() OVER (ORDER BY inserted_at DESC, run_id DESC) - 1 AS nth FROM runs
        WHERE app_name = 'app_1' AND inserted_at > {RETENTION_START} AND (errored OR warned))
      SELECT nth // 50 + 1 AS page, nth % 50 + 1 AS place, run_id, inserted_at, status, issue_count FROM placed""",
    "app_runs_page_cursors": f"""WITH {RUNS}, placed AS (
        SELECT *, (row_number() OVER (ORDER BY inserted_at DESC, run_id DESC) - 1) // 50 + 1 AS page FROM runs
        WHERE app_name = 'app_1' AND inserted_at > {RETENTION_START})
      SELECT page, count(*) AS runs,
        CASE WHEN count(*) = 50 THEN strftime(min(inserted_at), '%Y-%m-%dT%H:%M:%S.%fZ') END AS next_at,
        CASE WHEN count(*) = 50 THEN arg_min(run_id, (inserted_at, run_id)) END AS next_id
      FROM placed GROUP BY page""",
    "app_runs_upper_case_pages": f"""WITH {RUNS} SELECT upper(run_id) AS run_id, inserted_at, status, issue_count FROM runs
      WHERE app_name = 'app_1' AND inserted_at > {RETENTION_START}""",
    "run_by_first_event": f"""WITH {EVENTS}, {DOCUMENTS}
      SELECT app_name, upper(run_id) AS run_id, inserted_at, verbose_log FROM docs WHERE run_id = {RUN_7}""",
    "app_runs_peek": _page("LIMIT 50", since=f"{NOW} - INTERVAL 12 HOUR"),
    "app_health": HEALTH_SQL,
    "health_label": f"""WITH {RUNS}, {HEALTH} SELECT app_name, '24h: ' || errored || '/' || runs || ' err' ||
      CASE WHEN warned > 0 THEN ' · ' || warned || ' warn' ELSE '' END AS label FROM health""",
    "cadence_profile": f"WITH {RUNS}, {PROFILE} SELECT * FROM profile",
    "cadence_of_parts": f"WITH {RUNS}, {PROFILE} SELECT * FROM profile",
    "budget_audit": f"""WITH {RUNS}, {PROFILE}, budgets AS (
        SELECT *, CAST(CASE WHEN job = '(default)' THEN 30 WHEN job <> 'JOB_1' THEN 45 END AS DOUBLE) AS budget_min FROM profile)
      SELECT app_name, job, max_gap_min, budget_min, round(budget_min / (max_gap_us / 60000000.0), 2) AS budget_ratio,
        budget_min > max_gap_us / 60000000.0 AS clears_max_gap FROM budgets""",
    "connectivity_union": f"WITH {CONNECTIVITY} SELECT * FROM conn",
    "connectivity_panel": f"""WITH {CONNECTIVITY} SELECT *, row_number() OVER (
      ORDER BY status_rank, capture_age_ms DESC NULLS LAST, system_id, source) AS pos FROM panel""",
    "connectivity_rollup": f"""WITH {CONNECTIVITY} SELECT source, count(*) FILTER (WHERE status = 'OFFLINE') AS offline,
      count(*) AS total FROM panel GROUP BY source""",
    "acquisition_systems": f"""WITH {ACQUISITIONS} SELECT *, row_number() OVER (
      ORDER BY failed DESC, runs DESC, system_id, data_source) AS pos FROM systems""",
    "acquisition_systems_of_parts": f"""WITH {ACQUISITIONS} SELECT *, row_number() OVER (
      ORDER BY failed DESC, runs DESC, system_id, data_source) AS pos FROM systems""",
    "acquisition_by_source": f"""WITH {ACQUISITIONS} SELECT data_source, count(*) AS systems,
      CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(failed) AS BIGINT) AS failed FROM systems GROUP BY data_source""",
    "merge_latest": LATEST,
    "evict": f"{LATEST} WHERE inserted_at >= {NOW} - INTERVAL 1 HOUR",
    "refresh_latest": LATEST,
    "refresh_reconcile": LATEST,
    "refresh_steps": f"""WITH {RUNS},
      split AS (SELECT TIMESTAMP '2024-01-20 00:00:00' AS split_at),
      boot AS (SELECT runs.* FROM runs, split
        WHERE inserted_at >= split_at - INTERVAL 30 DAY AND inserted_at < split_at
          AND NOT (app_name = 'app_3' AND inserted_at >= TIMESTAMP '2024-01-10 00:00:00' AND inserted_at < split_at - INTERVAL 6 MINUTE)),
      mark1 AS (SELECT max(inserted_at) AS w FROM boot),
      tick AS (SELECT * FROM boot UNION SELECT runs.* FROM runs, split, mark1
        WHERE inserted_at >= w - INTERVAL 5 MINUTE AND inserted_at < split_at + INTERVAL 1 HOUR),
      mark2 AS (SELECT max(inserted_at) AS w FROM tick),
      whole AS (SELECT runs.* FROM runs, split
        WHERE inserted_at >= split_at + INTERVAL 7 HOUR - INTERVAL 30 DAY AND inserted_at < split_at + INTERVAL 7 HOUR),
      mark4 AS (SELECT greatest(w, max(inserted_at)) AS w FROM whole, mark2 GROUP BY w),
      steps AS (
        SELECT '1 bootstrap' AS step, 'bootstrap' AS phase, split_at - INTERVAL 30 DAY AS since, w AS watermark, boot.* FROM boot, split, mark1
        UNION ALL SELECT '2 tick', 'tick', mark1.w - INTERVAL 5 MINUTE, mark2.w, tick.* FROM tick, mark1, mark2
        UNION ALL SELECT '3 failed', 'tick', w - INTERVAL 5 MINUTE, NULL, tick.* FROM tick, mark2
        UNION ALL SELECT '4 reconcile', 'reconcile', split_at + INTERVAL 7 HOUR - INTERVAL 30 DAY, w, whole.* FROM whole, split, mark4)
      SELECT step, phase, since, watermark, app_name, job, run_id, inserted_at FROM steps
      QUALIFY row_number() OVER (PARTITION BY step, app_name, job ORDER BY inserted_at DESC, run_id DESC) = 1""",
    "refresh_health": HEALTH_SQL,
    "maintain_latest": LATEST,
    "stream_latest_runs": LATEST,
    "stream_latest_expiring": f"""WITH {RUNS},
      seen AS (SELECT * FROM runs WHERE NOT (app_name = 'app_3' AND inserted_at >= TIMESTAMP '2024-01-20 00:00:00')),
      newest AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY app_name, job ORDER BY inserted_at DESC, run_id DESC) = 1)
      SELECT {SUMMARY} FROM newest WHERE inserted_at >= (SELECT max(inserted_at) - INTERVAL 5 DAY FROM seen)""",
    "stream_health": HEALTH_SQL,
    "stream_health_panes": f"""WITH {RUNS}, ticks(tick) AS (
        VALUES (TIMESTAMP '2024-01-12 09:30:17'), (TIMESTAMP '2024-01-20 18:00:00.000001'), ({NOW}))
      SELECT tick, app_name, count(*) AS runs, count(*) FILTER (WHERE errored) AS errored, count(*) FILTER (WHERE warned) AS warned
      FROM ticks JOIN runs ON inserted_at > tick - INTERVAL 24 HOUR AND (inserted_at < tick OR tick = {NOW})
      GROUP BY tick, app_name""",
    "heartbeat_run": f"""WITH {GRID}, beat AS (
        SELECT {_uuid("'beat'")} AS run_id, count(*) AS jobs, count(*) - count(budget_ms) AS unknown FROM grid),
      head AS (SELECT *, '{{"run_id":"' || run_id || '","dt":"2024-01-31T00:00:00.000Z","type":' AS h FROM beat),
      parts AS (SELECT *,
        h || '"ERROR","func":"refresh","tag":"CATCH","note":{{"phase":"grid refresh"}},"err_msg":"connection refused"}}' AS failed
        FROM head)
      SELECT 'monitor' AS app_name, run_id,
        '[' || h || '"INFO","func":"on_boot","tag":"CALL","note":{{"argv":["python","runpulse","heartbeat"]}}}},' ||
        h || '"INFO","func":"heartbeat","tag":"DETAILS","note":{{"asOf":"2024-01-31T00:00:00.000Z","cacheSize":' || jobs ||
        ',"coverageUnknown":' || unknown || ',"lastRefreshMs":42}}}},' || failed || ']' AS verbose_log,
        '[' || failed || ']' AS warn_error_logs
      FROM parts""",
}
