"""Calendar arithmetic.

Times without a zone are read as they stand, whatever the zone of the session.
Times with a zone have days and hours only in some zone; they are read in UTC,
and a session in another zone is refused before it can give other results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trailmark.params import EVENT_TIME

# Names of the zone in which a wall clock shows UTC.
UTC_NAMES = ["UTC", "Etc/UTC", "GMT", "Z", "+00:00"]


def in_utc(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.session.timeZone") in UTC_NAMES


def check_clock(events: DataFrame) -> DataFrame:
    """``events``, if its times mean the same in this session as in UTC; else an error."""
    if EVENT_TIME in events.columns:
        kind = events.schema[EVENT_TIME].dataType
        if isinstance(kind, T.TimestampType) and not in_utc(events.sparkSession):
            raise ValueError(
                f"'{EVENT_TIME}' has a time zone: set spark.sql.session.timeZone to UTC, "
                "or cast the column to timestamp_ntz in the zone you mean"
            )
    return events


def epoch_micros(time: Column) -> Column:
    """Microseconds since 1970 by the wall clock, as a bigint: exact to compare, cheap to aggregate."""
    spark = SparkSession.getActiveSession()
    if spark is None or in_utc(spark):
        return F.unix_micros(time.cast("timestamp"))
    # A cast would go through the session's zone, where some hours are missing or double.
    seconds = F.unix_date(time.cast("date")).cast("bigint") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60
    fraction = (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
    return seconds * 1_000_000 + fraction


def from_micros(micros: Column, kind: T.DataType) -> Column:
    """The time of ``epoch_micros``, as ``kind``."""
    spark = SparkSession.getActiveSession()
    if isinstance(kind, T.TimestampNTZType) and spark is not None and not in_utc(spark):
        day = F.floor(micros / 86_400_000_000).cast("int")
        rest = (micros - day.cast("bigint") * 86_400_000_000) / F.lit(1_000_000).cast("decimal(20,0)")
        start = F.date_from_unix_date(day).cast("timestamp_ntz")
        none = F.lit(0)
        return start + F.make_dt_interval(none, none, none, rest.cast("decimal(18,6)"))
    return F.timestamp_micros(micros).cast(kind)


def month_index(time: Column) -> Column:
    """Months since year 0, so that the difference of two is a number of months."""
    return F.year(time) * 12 + F.month(time) - 1


def month_label(index: Column) -> Column:
    """``YYYY-MM`` for a month index."""
    year = F.floor(index / 12).cast("int")
    return F.format_string("%04d-%02d", year, (index % 12 + 1).cast("int"))
