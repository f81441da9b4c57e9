from runpulse.operators.acquisition import acquisition_by_source, acquisition_parts, acquisition_systems, systems_of_parts  # noqa: F401
from runpulse.operators.audit import contract_audit  # noqa: F401
from runpulse.operators.cadence import budget_audit, cadence_of_parts, cadence_parts, cadence_profile  # noqa: F401
from runpulse.operators.connectivity import connectivity_panel, connectivity_rollup, connectivity_union  # noqa: F401
from runpulse.operators.feeds import (  # noqa: F401
    Page,
    app_runs,
    app_runs_page,
    app_runs_pages,
    error_feed,
    feed_days,
    feed_parts,
    fetch_page,
    page_cursors,
    run_by_id,
    run_timeline,
)
from runpulse.operators.grid import (  # noqa: F401
    cadence_coverage,
    job_grid,
    latest_of,
    latest_runs,
    run_summaries,
    staleness,
    unknown_jobs,
)
from runpulse.operators.grid_view import (  # noqa: F401
    filter_jobs,
    group_jobs,
    group_rollup_status,
    sort_jobs,
    summarize_grid,
)
from runpulse.operators.health import app_health, health_label  # noqa: F401
