from airloom.streaming.clock import STATE_STORE, live_conversions, live_sessions, live_states
from airloom.streaming.live import live_counts, live_dedup, live_latest, live_status
from airloom.streaming.sinks import latest_status, run_to_end, status_log

__all__ = [
    "STATE_STORE",
    "latest_status",
    "live_conversions",
    "live_counts",
    "live_dedup",
    "live_latest",
    "live_sessions",
    "live_states",
    "live_status",
    "run_to_end",
    "status_log",
]
