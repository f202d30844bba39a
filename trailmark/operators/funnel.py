"""Conversion funnel: how many users reached each stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.functions import percent, round_to
from trailmark.operators.rollups import stage_rank
from trailmark.params import FUNNEL_STAGES, STAGE_LABELS, STAGE_RANK, USER_ID


def user_stages(events: DataFrame) -> DataFrame:
    """The furthest stage each user reached; users with unknown events only are left out."""
    return (
        events.select(USER_ID, stage_rank().alias("stage_rank"))
        .where(F.col(USER_ID).isNotNull() & F.col("stage_rank").isNotNull())
        .groupBy(USER_ID)
        .agg(F.max("stage_rank").alias("stage_rank"))
    )


def funnel(events: DataFrame) -> DataFrame:
    """Three rows in stage order: ``stage, label, users, percentage, drop_off_pct``.

    A user counts for the furthest stage reached and every stage before it.
    """
    return funnel_of_users(user_stages(events))


def funnel_of_users(users: DataFrame) -> DataFrame:
    """The funnel from any table with one ``stage_rank`` per ``user_id``."""
    known = F.col(USER_ID).isNotNull() & F.col("stage_rank").isNotNull()
    reached = users.where(known).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("stage_rank") >= STAGE_RANK[s]).alias(s) for s in FUNNEL_STAGES],
    )
    rows = []
    for position, stage in enumerate(FUNNEL_STAGES):
        before = F.col(FUNNEL_STAGES[position - 1]) if position else None
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(stage).alias("stage"),
                F.lit(STAGE_LABELS[stage]).alias("label"),
                F.col(stage).alias("users"),
                percent(F.col(stage), F.col("total")).alias("percentage"),
                _drop(F.col(stage), before).alias("drop_off_pct"),
            )
        )
    return reached.select(F.inline(F.array(*rows))).drop("position")


def _drop(users: Column, before: Column | None) -> Column:
    if before is None:
        return F.lit(0.0)
    lost = (F.lit(1) - users / before) * F.lit(100)
    return F.when(before > 0, round_to(lost, 2)).otherwise(F.lit(0.0))


def display_table(stages: DataFrame) -> DataFrame:
    """The funnel under the headings of the stage table."""
    return stages.select(
        F.col("label").alias("Stage"),
        F.col("users").alias("Users"),
        F.col("percentage").alias("% of Total"),
        F.col("drop_off_pct").alias("Drop-off %"),
    )


def biggest_drop(stages: DataFrame) -> DataFrame:
    """The stage that loses most users; the earlier one of equals."""
    order = F.when(F.col("stage") == FUNNEL_STAGES[0], 0)
    for position, stage in enumerate(FUNNEL_STAGES[1:], start=1):
        order = order.when(F.col("stage") == stage, position)
    return (
        stages.orderBy(F.desc("drop_off_pct"), order)
        .limit(1)
        .select("label", round_to(F.col("drop_off_pct"), 1).alias("drop_off_pct"))
    )


def step_rates(stages: DataFrame) -> DataFrame:
    """One row: users of each stage in percent of the stage before it and of the first."""
    first, middle, last = (
        F.max(F.when(F.col("stage") == stage, F.col("users"))) for stage in FUNNEL_STAGES
    )
    return stages.agg(
        percent(middle, first).alias("view_to_cart_pct"),
        percent(last, middle).alias("cart_to_purchase_pct"),
        percent(last, first).alias("view_to_purchase_pct"),
    )
