"""When things happen: hour of day, day of week, calendar day.

The log is counted once per (weekday, hour, type); the tables below are sums
over that little table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.functions import check_clock, percent
from trailmark.params import EVENT_TIME, EVENT_TYPE, WEEKDAYS


def slot_counts(events: DataFrame) -> DataFrame:
    """Events per weekday (0 = Monday), hour and type."""
    return (
        check_clock(events)
        .where(F.col(EVENT_TIME).isNotNull() & F.col(EVENT_TYPE).isNotNull())
        .groupBy(
            F.weekday(EVENT_TIME).alias("weekday"), F.hour(EVENT_TIME).alias("hour"), EVENT_TYPE
        )
        .agg(F.count("*").alias("count"))
    )


def hourly_events(slots: DataFrame) -> DataFrame:
    return slots.groupBy("hour", EVENT_TYPE).agg(F.sum("count").alias("count"))


def weekday_events(slots: DataFrame) -> DataFrame:
    return slots.groupBy("weekday", EVENT_TYPE).agg(F.sum("count").alias("count")).select(
        "weekday", _day_name(F.col("weekday")).alias("weekday_name"), EVENT_TYPE, "count"
    )


def _day_name(weekday: Column) -> Column:
    # 1 January 2024 was a Monday.
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), weekday), "EEEE")


def _purchases(slots: DataFrame) -> DataFrame:
    return slots.where(F.col(EVENT_TYPE) == "purchase")


def purchase_heatmap(slots: DataFrame) -> DataFrame:
    """Purchases per hour (rows) and weekday (columns ``Mon`` to ``Sun``)."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("weekday") == i, F.col("count"))), F.lit(0)).alias(day)
        for i, day in enumerate(WEEKDAYS)
    ]
    return _purchases(slots).groupBy("hour").agg(*cells).orderBy("hour")


def heatmap_labels(heatmap: DataFrame) -> DataFrame:
    """The heatmap with its hours as ``HH:00``."""
    return heatmap.select(F.format_string("%02d:00", "hour").alias("hour_label"), *WEEKDAYS)


def purchases_by_hour(slots: DataFrame) -> DataFrame:
    return (
        _purchases(slots).groupBy("hour").agg(F.sum("count").alias("count")).orderBy("hour")
    )


def peak_purchase_time(slots: DataFrame) -> DataFrame:
    """Busiest hour over all days and busiest weekday over all hours.

    No row without purchases; of equals the earliest hour and weekday.
    """

    def busiest(by: str) -> DataFrame:
        totals = _purchases(slots).groupBy(by).agg(F.sum("count").alias("n"))
        return totals.orderBy(F.desc("n"), by).limit(1)

    names = F.array(*map(F.lit, WEEKDAYS))
    day = busiest("weekday").select(F.element_at(names, F.col("weekday") + 1)).scalar()
    return busiest("hour").select(
        F.col("hour").alias("peak_hour"),
        day.alias("peak_day"),
        F.concat(F.col("hour").cast("string"), F.lit(":00")).alias("peak_label"),
    )


def daily_events(events: DataFrame) -> DataFrame:
    """Events per calendar day and type."""
    return (
        check_clock(events)
        .where(F.col(EVENT_TIME).isNotNull() & F.col(EVENT_TYPE).isNotNull())
        .groupBy(F.to_date(EVENT_TIME).alias("date"), EVENT_TYPE)
        .agg(F.count("*").alias("count"))
    )


def event_distribution(events: DataFrame) -> DataFrame:
    """Events per type, most frequent first, with their share in percent."""
    counts = (
        events.where(F.col(EVENT_TYPE).isNotNull())
        .groupBy(EVENT_TYPE)
        .agg(F.count("*").alias("count"))
    )
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share_pct", percent(F.col("count"), total, 1)).orderBy(
        F.desc("count"), EVENT_TYPE
    )


@dataclass(frozen=True)
class TimePatterns:
    hourly: DataFrame
    daily: DataFrame
    heatmap: DataFrame


def time_patterns(events: DataFrame) -> TimePatterns:
    """Hourly and weekday counts by type, and the purchase heatmap."""
    slots = slot_counts(events)
    return TimePatterns(hourly_events(slots), weekday_events(slots), purchase_heatmap(slots))
