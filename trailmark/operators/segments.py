"""User rollup, behaviour segments and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.functions import exact_mean, percent, round_to
from trailmark.operators.rollups import mean_price, user_counts, user_rollup
from trailmark.operators.sessions import session_rollup, tagged_rollup
from trailmark.params import (
    BROWSER,
    CART_ABANDONER,
    DEFAULTS,
    EVENT_TYPE,
    PURCHASER,
    SESSION_DURATION,
    SESSION_ID,
    USER_ID,
)


def segment_label(purchases: Column, carts: Column) -> Column:
    return F.when(purchases > 0, PURCHASER).when(carts > 0, CART_ABANDONER).otherwise(BROWSER)


def segments_of_users(users: DataFrame) -> DataFrame:
    """The public shape of a user rollup, one row per known user."""
    return users.where(F.col(USER_ID).isNotNull()).select(
        USER_ID,
        F.col("typed").alias("total_events"),
        F.col("views").alias("total_views"),
        F.col("carts").alias("total_carts"),
        F.col("purchases").alias("total_purchases"),
        round_to(mean_price(), 2).alias("avg_price"),
        "session_count",
        round_to(F.col("avg_session_duration_sec"), 1).alias("avg_session_duration_sec"),
        segment_label(F.col("purchases"), F.col("carts")).alias("segment"),
    )


def segment_users(events: DataFrame) -> DataFrame:
    """One row per user with totals and segment, from events tagged with sessions.

    Without session columns every event counts as a session and lengths are 0.
    """
    if SESSION_ID not in events.columns:
        users = user_counts(events).withColumns(
            {"session_count": F.col("typed"), "avg_session_duration_sec": F.lit(0.0)}
        )
        return segments_of_users(users)
    users = user_rollup(tagged_rollup(events))
    if SESSION_DURATION not in events.columns:
        users = users.withColumn("avg_session_duration_sec", F.lit(0.0))
    return segments_of_users(users)


def segment_users_by_session(
    events: DataFrame,
    gap_minutes: int = DEFAULTS.session_gap_minutes,
    use_existing: bool = True,
) -> DataFrame:
    """The same table straight from untagged events, through the session rollup."""
    return segments_of_users(user_rollup(session_rollup(events, gap_minutes, use_existing)))


def segment_distribution(segments: DataFrame) -> DataFrame:
    """Users per segment, largest first, with their share in percent."""
    counts = segments.groupBy("segment").agg(F.count("*").alias("users"))
    total = counts.agg(F.sum("users")).scalar()
    return counts.withColumn("share_pct", percent(F.col("users"), total, 1)).orderBy(
        F.desc("users"), "segment"
    )


def _mean(name: str) -> Column:
    return round_to(F.sum(name) / F.count(name), 1)


def segment_summary(segments: DataFrame) -> DataFrame:
    """Users and average figures of each segment."""
    return (
        segments.groupBy("segment")
        .agg(
            F.count("*").alias("users"),
            _mean("total_events").alias("avg_events"),
            _mean("total_views").alias("avg_views"),
            _mean("total_carts").alias("avg_carts"),
            _mean("total_purchases").alias("avg_purchases"),
            round_to(exact_mean(F.col("avg_price")), 1).alias("avg_price"),
            round_to(exact_mean(F.col("avg_session_duration_sec")), 1).alias(
                "avg_session_duration"
            ),
        )
        .orderBy("segment")
    )


def segment_metrics(segments: DataFrame) -> DataFrame:
    """The averages compared in the segment chart."""
    return (
        segments.groupBy("segment")
        .agg(
            _mean("total_events").alias("avg_events"),
            _mean("total_views").alias("avg_views"),
            round_to(exact_mean(F.col("avg_price")), 1).alias("avg_price"),
            _mean("session_count").alias("avg_sessions"),
        )
        .orderBy("segment")
    )


def cart_abandoners(events: DataFrame) -> DataFrame:
    """Users with a cart event and no purchase."""
    kind = F.col(EVENT_TYPE)
    return (
        events.where(kind.isin("cart", "purchase") & F.col(USER_ID).isNotNull())
        .groupBy(USER_ID)
        .agg(F.max(kind == "purchase").alias("bought"))
        .where(~F.col("bought"))
        .select(USER_ID)
    )
