"""The analyses: functions from DataFrame to DataFrame, lazy unless said otherwise."""

from trailmark.operators import (
    brands,
    clean,
    cluster,
    cohort,
    funnel,
    kpis,
    quality,
    rollups,
    segments,
    sessions,
    stats,
    temporal,
)

__all__ = [
    "brands",
    "clean",
    "cluster",
    "cohort",
    "funnel",
    "kpis",
    "quality",
    "rollups",
    "segments",
    "sessions",
    "stats",
    "temporal",
]
