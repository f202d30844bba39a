"""Monthly cohorts: who came back how many months after the first event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from trailmark.functions import check_clock, exact_mean, month_index, month_label, percent, round_to
from trailmark.params import DEFAULTS, EVENT_TIME, EVENT_TYPE, USER_ID


def cohort_assign(events: DataFrame, event_types: list[str] | None = None) -> DataFrame:
    """One row per user and active month, with the user's first month.

    Events are reduced to distinct (user, month) before any window, so a user
    has one row per calendar month there, whatever the number of events.
    """
    if event_types:
        events = events.where(F.col(EVENT_TYPE).isin(event_types))
    months = (
        check_clock(events)
        .where(F.col(USER_ID).isNotNull() & F.col(EVENT_TIME).isNotNull())
        .select(USER_ID, month_index(F.col(EVENT_TIME)).alias("month"))
        .distinct()
    )
    first = F.min("month").over(Window.partitionBy(USER_ID))
    return months.withColumn("first", first).select(
        USER_ID,
        month_label(F.col("month")).alias("active_month"),
        month_label(F.col("first")).alias("cohort"),
        (F.col("month") - F.col("first")).cast("bigint").alias("period"),
    )


def cohort_active_users(
    assigned: DataFrame, max_periods: int = DEFAULTS.cohort_periods
) -> DataFrame:
    """Users active per cohort and months since its start (long form, no empty cells)."""
    return (
        assigned.where(F.col("period") <= max_periods)
        .groupBy("cohort", "period")
        .agg(F.count("*").alias("active_users"))
    )


def cohort_sizes(assigned: DataFrame) -> DataFrame:
    """Users per cohort, oldest first."""
    return (
        assigned.where(F.col("period") == 0)
        .groupBy("cohort")
        .agg(F.count("*").alias("cohort_size"))
        .orderBy("cohort")
    )


def cohort_retention(assigned: DataFrame, max_periods: int = DEFAULTS.cohort_periods) -> DataFrame:
    """Retention matrix in percent: one row per cohort, columns ``M0`` to ``M<max>``.

    The periods are known, so the matrix is one conditional aggregation.
    """
    size = F.count_if(F.col("period") == 0)
    cells = [
        percent(F.count_if(F.col("period") == p), size, 1).alias(f"M{p}")
        for p in range(max_periods + 1)
    ]
    return assigned.groupBy("cohort").agg(*cells).orderBy("cohort")


def retention_labels(retention: DataFrame) -> DataFrame:
    """Cell texts of the retention heatmap; blank where nobody came back."""
    cells = [
        F.when(F.col(name) > 0, F.format_string("%.1f%%", F.col(name))).otherwise("").alias(name)
        for name in retention.columns
        if name != "cohort"
    ]
    return retention.select("cohort", *cells)


def average_first_month(retention: DataFrame, healthy_above: float = 20.0) -> DataFrame:
    """Mean retention one month on, over all cohorts, and what to make of it."""
    mean = exact_mean(F.col("M1"))
    return retention.agg(
        round_to(mean, 1).alias("avg_m1_retention"),
        F.when(mean > healthy_above, "healthy").otherwise("low").alias("engagement"),
    )
