from airloom.functions.tags import tag_set
from airloom.functions.timing import (
    as_event_time,
    as_local_time,
    epoch_seconds,
    seconds_between,
    time_slice,
    week_second,
)

__all__ = [
    "as_event_time",
    "as_local_time",
    "epoch_seconds",
    "seconds_between",
    "tag_set",
    "time_slice",
    "week_second",
]
