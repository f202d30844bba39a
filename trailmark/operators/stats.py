"""Does the conversion of users differ between groups? A chi-square test."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.functions import round_to
from trailmark.params import EVENT_TIME, EVENT_TYPE, USER_ID

ALPHA = 0.05


@dataclass(frozen=True)
class ChiSquare:
    """Result of the test; all None when there was nothing to test."""

    chi2: float | None
    p_value: float | None
    dof: int | None
    significant: bool | None
    contingency_table: DataFrame | None


def user_groups(events: DataFrame, *group_cols: str) -> DataFrame:
    """Each user's first known group by every factor, and whether the user ever bought.

    First is by time, then by ``event_id`` if there is one, then by the group.
    Events are reduced to one row per user and groups before users are formed,
    for all factors at once.
    """
    moment = F.col(EVENT_TIME)
    if "event_id" in events.columns:
        moment = F.when(moment.isNotNull(), F.struct(moment, "event_id"))
    first = F.col("first")
    names = [f"group_{i}" for i in range(len(group_cols))]

    def first_known(name: str) -> Column:
        group = F.col(name)
        known = F.when(group.isNotNull(), F.struct(first.isNull(), first, group))
        return F.min(known).getField(name)

    return (
        events.where(F.col(USER_ID).isNotNull())
        .groupBy(USER_ID, *[F.col(c).alias(n) for c, n in zip(group_cols, names)])
        .agg(F.min(moment).alias("first"), F.max(F.col(EVENT_TYPE) == "purchase").alias("bought"))
        .groupBy(USER_ID)
        .agg(
            *[first_known(n).alias(n) for n in names],
            F.coalesce(F.max("bought"), F.lit(False)).alias("purchased"),
        )
    )


def contingencies(events: DataFrame, *group_cols: str) -> DataFrame:
    """``factor, group, not_purchased, purchased``: users per group, for all factors in one pass.

    Users without a group are left out of its factor.
    """
    factors = F.array(
        *[
            F.struct(F.lit(c).alias("factor"), F.col(f"group_{i}").cast("string").alias("group"))
            for i, c in enumerate(group_cols)
        ]
    )
    return (
        user_groups(events, *group_cols)
        .select("purchased", F.inline(factors))
        .where(F.col("group").isNotNull())
        .groupBy("factor", "group")
        .agg(
            F.count_if(~F.col("purchased")).alias("not_purchased"),
            F.count_if("purchased").alias("purchased"),
        )
    )


def contingency(events: DataFrame, group_col: str) -> DataFrame:
    """The table of one factor: ``group, not_purchased, purchased``."""
    return contingencies(events, group_col).drop("factor")


def chi_square(tables: DataFrame) -> DataFrame:
    """One row ``factor, chi2, p_value, dof, significant, users`` per factor, in one aggregation.

    The statistic is users * sum(cell^2 / (row total * column total)) - users.
    With one degree of freedom each deviation is reduced by up to one half
    (Yates' correction); the four deviations are then equal and follow from the
    statistic. A column without users is no column.
    """
    size = (F.col("not_purchased") + F.col("purchased")).cast("double")

    def squares(name: str) -> Column:
        return F.sum(F.col(name).cast("double") * F.col(name) / size)

    sums = tables.groupBy("factor").agg(
        F.sum("not_purchased").alias("left"),
        F.sum("purchased").alias("bought"),
        F.count("*").alias("groups"),
        squares("not_purchased").alias("left_squares"),
        squares("purchased").alias("bought_squares"),
        F.sum(1 / size).alias("inverse"),
    )
    users = F.col("left") + F.col("bought")
    columns = (F.col("left") > 0).cast("int") + (F.col("bought") > 0).cast("int")
    both = columns == 2
    dof = ((F.col("groups") - 1) * (columns - 1)).cast("bigint")
    plain = users * (F.col("left_squares") / F.col("left") + F.col("bought_squares") / F.col("bought")) - users
    plain = F.greatest(plain, F.lit(0.0))
    weight = users * F.col("inverse") * (1 / F.col("left") + 1 / F.col("bought"))
    apart = F.sqrt(plain / weight)
    corrected = F.pow(apart - F.least(F.lit(0.5), apart), F.lit(2.0)) * weight
    chi2 = F.when(both & (dof > 0), F.when(dof == 1, corrected).otherwise(plain)).otherwise(F.lit(0.0))
    tail = tail_probability(F.col("chi2"), F.col("dof"))
    return (
        sums.select("factor", chi2.alias("chi2"), dof.alias("dof"), users.alias("users"))
        .withColumn("p", tail)
        .select(
            "factor",
            round_to(F.col("chi2"), 4).alias("chi2"),
            round_to(F.col("p"), 6).alias("p_value"),
            "dof",
            (F.col("p") < ALPHA).alias("significant"),
            "users",
        )
    )


def tail_probability(chi2: Column, dof: Column) -> Column:
    """Probability of a larger value under the chi-square distribution.

    One less the series of the lower incomplete gamma function, whose terms are
    added as they are, in logarithms: no term exceeds 1. The length of the
    series follows from the statistic and the degrees of freedom, not from the data.
    """
    x, s = chi2 / 2, dof / 2
    # ln gamma(s + 1), from 1/2 or 1 upwards
    half = dof % 2 == 1
    start = F.when(half, F.lit(math.log(math.sqrt(math.pi)))).otherwise(F.lit(0.0))
    shift = F.when(half, F.lit(0.5)).otherwise(F.lit(0.0))
    steps = F.ceil(s).cast("int")
    log_gamma = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        start,
        lambda total, i: total + F.when(i <= steps, F.log(F.abs(i - shift))).otherwise(F.lit(0.0)),
    )
    first = -x + s * F.log(x) - log_gamma
    terms = F.ceil(F.greatest(x - s, F.lit(0.0)) + 12 * F.sqrt(x + s) + 60).cast("int")
    lower = F.aggregate(
        F.sequence(F.lit(1), terms),
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda state, n: F.struct(
            (state["log"] + F.log(x) - F.log(s + n)).alias("log"),
            (state["sum"] + F.exp(state["log"] + F.log(x) - F.log(s + n))).alias("sum"),
        ),
        lambda state: state["sum"],
    )
    return F.when((dof > 0) & (chi2 > 0), F.greatest(1 - lower, F.lit(0.0))).otherwise(F.lit(1.0))


def chi_square_conversion_test(events: DataFrame, group_col: str) -> ChiSquare:
    """Test whether the share of buyers differs between the groups of ``group_col``.

    Only the result, a single row, comes to the driver.
    """
    if group_col not in events.columns:
        return ChiSquare(None, None, None, None, None)
    tables = contingencies(events, group_col)
    row = chi_square(tables).first()
    if row is None:
        return ChiSquare(None, None, None, None, tables.drop("factor"))
    return ChiSquare(row.chi2, row.p_value, row.dof, row.significant, tables.drop("factor"))
