"""Behaviour analytics for e-commerce event logs, on Spark."""

from trailmark.operators.brands import brand_analysis
from trailmark.operators.clean import apply_filters, deduplicate_events, remove_bots
from trailmark.operators.cluster import cluster_users
from trailmark.operators.cohort import cohort_assign, cohort_retention, cohort_sizes
from trailmark.operators.funnel import funnel
from trailmark.operators.kpis import compute_kpis
from trailmark.operators.quality import ValidationResult, coerce_columns, validate
from trailmark.operators.segments import segment_users
from trailmark.operators.sessions import assign_sessions, session_summary
from trailmark.operators.stats import chi_square_conversion_test
from trailmark.operators.temporal import time_patterns
from trailmark.params import DEFAULTS, Params
from trailmark.plans.pipeline import Analysis, run
from trailmark.sources import generate_events, read_events_csv, read_log, write_events_csv, write_log

__all__ = [
    "DEFAULTS",
    "Analysis",
    "Params",
    "ValidationResult",
    "apply_filters",
    "assign_sessions",
    "brand_analysis",
    "chi_square_conversion_test",
    "cluster_users",
    "coerce_columns",
    "cohort_assign",
    "cohort_retention",
    "cohort_sizes",
    "compute_kpis",
    "deduplicate_events",
    "funnel",
    "generate_events",
    "read_events_csv",
    "read_log",
    "write_log",
    "remove_bots",
    "run",
    "segment_users",
    "session_summary",
    "time_patterns",
    "validate",
    "write_events_csv",
]
