from airloom.operators.asof import as_of_join, status_as_of
from airloom.operators.changes import state_changes
from airloom.operators.conversions import conversions_within
from airloom.operators.dominance import dominance_counts
from airloom.operators.funnel import (
    funnel_reach,
    funnel_split,
    funnel_transitions,
    ordered_funnel,
)
from airloom.operators.metrics import (
    Metric,
    calendar_fill,
    conversion_trend,
    entity_stats,
    kpi_summary,
    trend_by_kind,
)
from airloom.operators.props import merged_props, parsed_props
from airloom.operators.ranking import (
    drilldown,
    effect_ranking,
    ranking_by_group,
    topic_suggestions,
)
from airloom.operators.schedule import (
    events_in_schedule,
    merge_intervals,
    schedule_summary,
    timeline_overlap,
    weekly_intervals,
)
from airloom.operators.search import (
    catalog_page,
    facet_counts,
    search_filter,
    status_tab_counts,
)
from airloom.operators.sessions import session_starts, sessions
from airloom.operators.sketches import distinct_counts, distinct_shared, distinct_sketches
from airloom.operators.similar import similar_items
from airloom.operators.tags import expand_batch, linked_programs, related_items, tag_pool
from airloom.operators.windows import sliding_windows
from airloom.operators.workflow import (
    batch_progress,
    capacity_check,
    checklist_complete,
    content_profile,
    current_status,
    new_entities,
    queue_position,
    return_reasons,
    shared_capacity_check,
    source_readiness,
    status_history,
)

__all__ = [
    "Metric",
    "as_of_join",
    "batch_progress",
    "calendar_fill",
    "capacity_check",
    "catalog_page",
    "checklist_complete",
    "content_profile",
    "conversion_trend",
    "conversions_within",
    "current_status",
    "distinct_counts",
    "distinct_shared",
    "distinct_sketches",
    "dominance_counts",
    "drilldown",
    "effect_ranking",
    "entity_stats",
    "events_in_schedule",
    "expand_batch",
    "facet_counts",
    "funnel_reach",
    "funnel_split",
    "funnel_transitions",
    "kpi_summary",
    "linked_programs",
    "merge_intervals",
    "merged_props",
    "new_entities",
    "ordered_funnel",
    "parsed_props",
    "queue_position",
    "ranking_by_group",
    "related_items",
    "return_reasons",
    "schedule_summary",
    "search_filter",
    "session_starts",
    "sessions",
    "shared_capacity_check",
    "similar_items",
    "sliding_windows",
    "source_readiness",
    "state_changes",
    "status_as_of",
    "status_history",
    "status_tab_counts",
    "tag_pool",
    "timeline_overlap",
    "topic_suggestions",
    "trend_by_kind",
    "weekly_intervals",
]
