"""The whole analysis of one log, from raw events to every result."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from trailmark.operators import brands as brand_ops
from trailmark.operators import clean, cluster, cohort, funnel, kpis, quality, rollups
from trailmark.operators import segments as segment_ops
from trailmark.operators import sessions, temporal
from trailmark.params import DEFAULTS, Params
from trailmark.storage import materialize


@dataclass(frozen=True)
class Analysis:
    """Everything one run yields. After a failed validation only that is set."""

    validation: quality.ValidationResult
    error: str | None = None
    sessioned: DataFrame | None = None
    funnel: DataFrame | None = None
    retention: DataFrame | None = None
    cohort_sizes: DataFrame | None = None
    segments: DataFrame | None = None
    time_patterns: temporal.TimePatterns | None = None
    brands: DataFrame | None = None
    kpis: DataFrame | None = None
    cleaning: clean.CleaningCounts | None = None
    params: Params = DEFAULTS

    @cached_property
    def clustered(self) -> DataFrame | None:
        """Users with their cluster; k-means is fitted when this is first asked for."""
        if self.segments is None:
            return None
        return cluster.cluster_users(self.segments, self.params.clusters, self.params.seed)


def run(
    events: DataFrame,
    params: Params = DEFAULTS,
    date_range: tuple[dt.date | str, dt.date | str] | None = None,
    brands: list[str] | None = None,
    use_existing_sessions: bool = True,
) -> Analysis:
    """Filter, validate, clean, build sessions and set up every analysis.

    Two tables are written to the shared folder: the clean events, and one row
    per user. All results read those, each only the
    columns it needs; the clean events are never shuffled whole again unless
    the tagged log (``sessioned``) itself is asked for.
    """
    chosen = clean.apply_filters(events, date_range, brands)
    validation = quality.validate(chosen)
    if not validation.is_valid:
        return Analysis(validation, error=validation.summary())

    gap = params.session_gap_minutes
    cleaned, counts = clean.clean_log(chosen, validation.row_count, params.bot_threshold)
    rollup = sessions.session_rollup(cleaned, gap, use_existing_sessions)
    users = materialize(rollups.user_rollup(rollup), "users")
    segments = segment_ops.segments_of_users(users)
    cohorts = cohort.cohort_assign(cleaned)
    return Analysis(
        validation,
        sessioned=sessions.assign_sessions(cleaned, gap, use_existing_sessions),
        funnel=funnel.funnel_of_users(users),
        retention=cohort.cohort_retention(cohorts, params.cohort_periods),
        cohort_sizes=cohort.cohort_sizes(cohorts),
        segments=segments,
        time_patterns=temporal.time_patterns(cleaned),
        brands=brand_ops.brand_analysis(cleaned, params.top_brands, params.min_brand_events),
        kpis=kpis.kpis_of_users(users, kpis.distinct_products(cleaned)),
        cleaning=counts,
        params=params,
    )
