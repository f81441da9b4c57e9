from runpulse.streaming.heartbeat import heartbeat_run, refresh_metrics  # noqa: F401
from runpulse.streaming.latest import maintain_latest, stream_app_health, stream_latest_runs  # noqa: F401
from runpulse.streaming.panes import add_panes, health_panes, read_panes, sliding_health  # noqa: F401
from runpulse.streaming.state import (  # noqa: F401
    Refresh,
    RefreshConfig,
    State,
    current_state,
    evict,
    merge_latest,
    publish_health,
    read_health,
    read_latest,
    refresh,
    refresh_health,
    refresh_latest,
    since_bound,
)
