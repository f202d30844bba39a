"""Counts per group of events that can be added up again, level by level.

Events are counted once per (user, session) or even finer, and every coarser
result is a sum of those counts. Each level combines on the map side, so a
user, session or brand with a third of all events costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.functions import epoch_micros
from trailmark.functions.numeric import sum_parts, sum_total
from trailmark.params import EVENT_TIME, EVENT_TYPE, PRICE, STAGE_RANK, USER_ID

SUMS = [
    "events", "typed", "views", "carts", "purchases",
    "price_high_units", "price_units", "price_millionths", "price_rest", "price_count",
    "revenue_high_units", "revenue_units", "revenue_millionths", "revenue_rest", "revenue_count",
]
COUNTS = [*SUMS, "stage_rank"]


def stage_rank() -> Column:
    """Funnel rank of the event type; null for types outside the funnel."""
    kind = F.col(EVENT_TYPE)
    ranks = list(STAGE_RANK.items())
    chain = F.when(kind == ranks[0][0], ranks[0][1])
    for stage, rank in ranks[1:]:
        chain = chain.when(kind == stage, rank)
    return chain


def event_counts() -> list[Column]:
    """Aggregates over events: counts, price sums and the furthest funnel stage."""
    kind, price = F.col(EVENT_TYPE), F.col(PRICE).cast("double")
    price = F.when(~F.isnan(price), price)
    paid = F.when(kind == "purchase", price)
    return [
        F.count("*").alias("events"),
        F.count(kind).alias("typed"),
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "cart").alias("carts"),
        F.count_if(kind == "purchase").alias("purchases"),
        *[part.alias(f"price_{name}") for name, part in sum_parts(price).items()],
        F.count(price).alias("price_count"),
        *[part.alias(f"revenue_{name}") for name, part in sum_parts(paid).items()],
        F.count(paid).alias("revenue_count"),
        F.max(stage_rank()).alias("stage_rank"),
    ]


def time_span() -> list[Column]:
    """Aggregates over events: first and last moment in microseconds."""
    micros = epoch_micros(F.col(EVENT_TIME))
    return [F.min(micros).alias("start_us"), F.max(micros).alias("end_us")]


def merged_counts() -> list[Column]:
    """The same counts over groups that already carry them."""
    sums = [F.sum(name).alias(name) for name in SUMS]
    return [*sums, F.max("stage_rank").alias("stage_rank")]


def mean_price() -> Column:
    """Mean of the prices in a rollup; null when there were none."""
    total = sum_total(
        *[F.col(f"price_{part}") for part in ("high_units", "units", "millionths", "rest")]
    )
    return F.when(F.col("price_count") > 0, total / F.col("price_count"))


def user_counts(events: DataFrame) -> DataFrame:
    """Event counts per user; events without a user are under a null user."""
    return events.groupBy(USER_ID).agg(*event_counts())


def user_rollup(sessions: DataFrame) -> DataFrame:
    """Event counts and session figures per user, from a session rollup."""
    return sessions.groupBy(USER_ID).agg(
        *merged_counts(),
        F.sum("sessions").alias("session_count"),
        (F.sum("duration_us") / F.lit(1e6) / F.count("duration_us")).alias(
            "avg_session_duration_sec"
        ),
    )
