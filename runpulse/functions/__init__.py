from runpulse.functions.events import (  # noqa: F401
    DEFAULT_JOB,
    derive_status,
    duration_ms,
    event_dts,
    event_fields,
    first_and_last,
    has_type,
    issue_count,
    issue_subset,
    job_name,
    parse_events,
    run_timing,
    severities,
    status_from,
)
from runpulse.functions.instants import age_ms, instant, iso_micros, iso_seconds, safe_ts  # noqa: F401
from runpulse.functions.labels import conn_status, status_rank  # noqa: F401
from runpulse.functions.months import day_of, month_of, within_days  # noqa: F401
from runpulse.functions.text import blank_to_null, squeeze, summarize_error, trim_text  # noqa: F401
