"""Event logs kept as Parquet, one folder for each day.

A stored log carries the day of every event as the partition column ``event_day``. Date
filters (``filter_date_range``, ``apply_filters``, ``run``) add the same bounds on that
column, so that other days are not listed for the scan; ``date_bounds`` reads no column of
the files at all. Events without a time lie in a folder of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailmark.functions import check_clock
from trailmark.params import EVENT_DAY, EVENT_TIME


def write_log(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store ``events`` by day; with ``mode="append"`` further days are added to a log.

    The rows of a day are brought together, so that it has few files however many tasks made
    them; a very large day is split and small days share a task (the adaptive rebalance).
    """
    dated = check_clock(events).withColumn(EVENT_DAY, F.to_date(EVENT_TIME))
    dated.hint("rebalance", EVENT_DAY).write.mode(mode).partitionBy(EVENT_DAY).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stored log; ``event_day`` is its last column."""
    log = spark.read.parquet(path)
    if EVENT_DAY not in log.columns:
        raise ValueError(f"not a log stored by day: {path}")
    return log.withColumn(EVENT_DAY, F.col(EVENT_DAY).cast("date"))
