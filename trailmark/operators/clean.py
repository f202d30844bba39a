"""Bots, duplicates and the filters a user sets before an analysis."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from trailmark.functions import check_clock, percent
from trailmark.params import BRAND, DEDUP_KEY, DEFAULTS, EVENT_DAY, EVENT_TIME, USER_ID
from trailmark.storage import materialize


#: Lists of users up to this length are broadcast (one number or name each).
MAX_BROADCAST_USERS = 400_000
#: 64-bit words of the sieve: 2^20 buckets of users in 128 KB, whatever the log.
SIEVE_WORDS = 1 << 14


def bot_users(events: DataFrame, threshold: int = DEFAULTS.bot_threshold) -> DataFrame:
    """Users with more than ``threshold`` events on some day, and their busiest day's count."""
    timed = events.where(F.col(EVENT_TIME).isNotNull())
    return _busy_users(timed, threshold).select(USER_ID, "peak_day_events")


def _busy_users(events: DataFrame, threshold: int) -> DataFrame:
    """Bots with their busiest day's count and that of all their events, those without a time included."""
    in_a_day = F.when(F.col("day").isNotNull(), F.col("n"))
    return (
        check_clock(events)
        .where(F.col(USER_ID).isNotNull())
        .groupBy(USER_ID, F.to_date(EVENT_TIME).alias("day"))
        .agg(F.count("*").alias("n"))
        .groupBy(USER_ID)
        .agg(F.max(in_a_day).alias("peak_day_events"), F.sum("n").alias("events"))
        .where(F.col("peak_day_events") > threshold)
    )


def without_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events of nobody in ``users``; events without a user stay."""
    unwanted = users.select(F.col(USER_ID).alias("unwanted_user"))
    return events.join(unwanted, F.col(USER_ID) == F.col("unwanted_user"), "left_anti")


def _bucket(user: Column) -> tuple[Column, Column]:
    """Word of the sieve and bit in the word that a user falls on."""
    place = F.pmod(F.xxhash64(user), F.lit(SIEVE_WORDS * 64))
    return F.floor(place / 64).cast("int"), (place % 64).cast("int")


def sieve(users: DataFrame) -> DataFrame:
    """One row, ``words``: a bitmap of the buckets that hold one of ``users``; its size is fixed."""
    word, bit = _bucket(F.col(USER_ID))
    flagged = users.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits"))
    empty = users.sparkSession.range(SIEVE_WORDS).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = flagged.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = words.groupBy().agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return ordered.select(F.col("words.bits").alias("words"))


def without_many_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """As ``without_users`` for a long list: only events in a bucket of somebody listed are shuffled.

    The log is read twice, once for either kind, which costs less than to shuffle all of it.
    """
    words = materialize(sieve(users), "sieve").scalar()
    word, bit = _bucket(F.col(USER_ID))
    flagged = F.col(USER_ID).isNotNull() & (F.getbit(F.get(words, word), bit) == 1)
    return events.where(~flagged).unionByName(without_users(events.where(flagged), users))


def remove_bots(events: DataFrame, threshold: int = DEFAULTS.bot_threshold) -> DataFrame:
    """Drop every event of a user who exceeded ``threshold`` events on any day.

    The list of bots is written down first. It is short on any sane log and then broadcast,
    which leaves the events where they are. Before a list too long for that is joined by
    shuffle, a sieve keeps the events out of it whose users cannot be listed.
    """
    return _remove_bots(events, threshold)[0]


def _remove_bots(events: DataFrame, threshold: int) -> tuple[DataFrame, dict[str, int]]:
    """The events that stay, and ``bot_users, bot_events``, observed while the list was written."""
    seen = Observation()
    listed = _busy_users(events, threshold).observe(
        seen,
        F.count(F.lit(1)).alias("bot_users"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("bot_events"),
    )
    bots = materialize(listed.select(USER_ID, "events"), "bots").select(USER_ID)
    if seen.get["bot_users"] <= MAX_BROADCAST_USERS:
        return without_users(events, F.broadcast(bots)), seen.get
    return without_many_users(events, bots), seen.get


@dataclass(frozen=True)
class CleaningCounts:
    """What cleaning removed; the same figures as ``cleaning_report``."""

    bot_users: int
    rows_in: int
    rows_without_bots: int
    rows_out: int

    @property
    def duplicates_removed(self) -> int:
        return self.rows_without_bots - self.rows_out

    @property
    def duplicate_pct(self) -> float:
        """Share of duplicates in percent, with one decimal, half to even."""
        if not self.rows_without_bots:
            return 0.0
        return round(100 * self.duplicates_removed / self.rows_without_bots * 10) / 10


def clean_log(
    events: DataFrame, rows_in: int, threshold: int = DEFAULTS.bot_threshold
) -> tuple[DataFrame, CleaningCounts]:
    """The log without bots and duplicates, written down, and what was removed.

    ``rows_in`` is the number of events, which validation has counted. Bots and remaining rows
    are counted by the very tasks that write them (``DataFrame.observe`` behind the last
    shuffle, where a task that runs twice counts once), so the counts cost no job.
    """
    without_bots, bots = _remove_bots(events, threshold)
    seen = Observation()
    kept = deduplicate_events(without_bots).observe(seen, F.count(F.lit(1)).alias("rows_out"))
    cleaned = materialize(kept, "events")
    counts = CleaningCounts(bots["bot_users"], rows_in, rows_in - bots["bot_events"], seen.get["rows_out"])
    return cleaned, counts


def deduplicate_events(
    events: DataFrame, subset: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """Keep the first event of each key; nulls equal each other.

    Rows have no order in Spark, so "first" is by ``order``: by default
    ``event_id``, or else all the other columns, ascending. Each task keeps one
    row per key before the shuffle, so many copies of one event do not meet.
    """
    key = [name for name in (subset or DEDUP_KEY) if name in events.columns]
    if not key:
        return events
    rest = [name for name in events.columns if name not in key]
    if not rest:
        return events.dropDuplicates(key)
    if order is None:
        order = ["event_id"] if "event_id" in rest else _sortable(events, rest)
    first = Window.partitionBy(*key).orderBy(*[F.col(name).asc_nulls_first() for name in order])
    return (
        events.withColumn("_copy", F.row_number().over(first))
        .where(F.col("_copy") == 1)
        .drop("_copy")
    )


def _sortable(events: DataFrame, names: list[str]) -> list[str]:
    kept = [
        name
        for name in names
        if not isinstance(events.schema[name].dataType, (T.MapType, T.VariantType))
    ]
    return kept or names


def cleaning_report(events: DataFrame, threshold: int = DEFAULTS.bot_threshold) -> DataFrame:
    """One row: bots, rows before and after each step, duplicates and their share.

    All of it comes from the number of copies per event key, so the log is
    read and shuffled once.
    """
    key = [name for name in DEDUP_KEY if name in events.columns]
    copies = check_clock(events).groupBy(*key).agg(F.count("*").alias("copies"))
    per_day = (
        copies.groupBy(USER_ID, F.to_date(EVENT_TIME).alias("day"))
        .agg(F.sum("copies").alias("rows"), F.count("*").alias("distinct_rows"))
        .withColumn(
            "over",
            F.col(USER_ID).isNotNull()
            & F.col("day").isNotNull()
            & (F.col("rows") > threshold),
        )
    )
    per_user = per_day.groupBy(USER_ID).agg(
        F.max("over").alias("bot"),
        F.sum("rows").alias("rows"),
        F.sum("distinct_rows").alias("distinct_rows"),
    )
    kept_rows = F.coalesce(F.sum(F.when(~F.col("bot"), F.col("rows"))), F.lit(0))
    kept_distinct = F.coalesce(F.sum(F.when(~F.col("bot"), F.col("distinct_rows"))), F.lit(0))
    return per_user.agg(
        F.count_if("bot").alias("bot_users"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_in"),
        kept_rows.alias("rows_without_bots"),
        kept_distinct.alias("rows_out"),
        (kept_rows - kept_distinct).alias("duplicates_removed"),
        percent(kept_rows - kept_distinct, kept_rows, 1).alias("duplicate_pct"),
    )


def filter_date_range(
    events: DataFrame,
    start: dt.date | str,
    end: dt.date | str,
    whole_last_day: bool = False,
) -> DataFrame:
    """Events from ``start`` 00:00:00 to ``end`` 23:59:59, both included.

    The fraction of the last second is left out, unless ``whole_last_day``.
    The bounds take the column's own type, so that the scan can use them; on a log stored
    by day, the days bound the folders that are read.
    """
    dtype = check_clock(events).schema[EVENT_TIME].dataType
    first, last = (dt.date.fromisoformat(str(day)[:10]) for day in (start, end))
    if is_stored_by_day(events):
        events = events.where(F.col(EVENT_DAY).between(F.lit(first), F.lit(last)))
    time = F.col(EVENT_TIME)
    lower = time >= F.lit(f"{first} 00:00:00").cast(dtype)
    if whole_last_day:
        after = last + dt.timedelta(days=1)
        return events.where(lower & (time < F.lit(f"{after} 00:00:00").cast(dtype)))
    return events.where(lower & (time <= F.lit(f"{last} 23:59:59").cast(dtype)))


def filter_brands(events: DataFrame, brands: list[str]) -> DataFrame:
    """Events of the given brands; an empty list or a log without brands filters nothing."""
    if not brands or BRAND not in events.columns:
        return events
    return events.where(F.col(BRAND).isin(list(brands)))


def apply_filters(
    events: DataFrame,
    date_range: tuple[dt.date | str, dt.date | str] | None = None,
    brands: list[str] | None = None,
) -> DataFrame:
    """Date range (when both ends are set), then brands."""
    if date_range and len(date_range) == 2 and all(date_range) and EVENT_TIME in events.columns:
        events = filter_date_range(events, *date_range)
    return filter_brands(events, brands or [])


def is_stored_by_day(events: DataFrame) -> bool:
    """Whether the log was read from a store by day, or keeps the column that tells its days."""
    return EVENT_DAY in events.columns and isinstance(events.schema[EVENT_DAY].dataType, T.DateType)


def date_bounds(events: DataFrame) -> DataFrame:
    """First and last day of the log; of one stored by day, from its folders alone."""
    if is_stored_by_day(events):
        return events.agg(F.min(EVENT_DAY).alias("min_date"), F.max(EVENT_DAY).alias("max_date"))
    return check_clock(events).agg(
        F.to_date(F.min(EVENT_TIME)).alias("min_date"),
        F.to_date(F.max(EVENT_TIME)).alias("max_date"),
    )


def brand_options(events: DataFrame) -> DataFrame:
    """All brands in the log, sorted."""
    return events.select(BRAND).dropna().distinct().orderBy(BRAND)
