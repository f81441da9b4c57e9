from runpulse.sources.assemble import assemble_runs  # noqa: F401
from runpulse.sources.parts import (  # noqa: F401
    append_run_index,
    error_feed_by_days,
    read_acquisition_parts,
    read_cadence_parts,
    read_run_index,
    run_by_index,
    store_acquisition_parts,
    store_cadence_parts,
    store_feed_parts,
)
from runpulse.sources.run_files import read_run_files  # noqa: F401
from runpulse.sources.run_logs import append_run_rows, read_run_logs, stream_run_logs, write_days  # noqa: F401
from runpulse.sources.summaries import append_summaries, read_summaries  # noqa: F401
from runpulse.sources.schedules import load_schedules  # noqa: F401
from runpulse.sources.tables import read_acquisitions, read_connectivity, write_acquisitions  # noqa: F401
