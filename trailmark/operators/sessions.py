"""Sessions: those the log names, or runs of events without a long pause.

A pause longer than the gap starts a new session. Two events in the same
gap-wide slice of time are never that far apart, so a slice is never split:
slices are counted first (with map-side combine) and only the slices of a user
are put in order. A window thus sees at most (time span / gap) rows per user,
no matter how many events one user has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.functions import (
    check_clock,
    epoch_micros,
    from_micros,
    quantile_neighbours,
    round_to,
)
from trailmark.operators.rollups import COUNTS, event_counts, merged_counts, time_span
from trailmark.params import (
    DEFAULTS,
    EVENT_TIME,
    SESSION_DURATION,
    SESSION_ID,
    USER_ID,
    USER_SESSION,
)
from trailmark.storage import materialize

# Fixed value: the one session of all events whose session is missing.
MISSING_SESSION = "nan"


def seconds(start: Column, end: Column) -> Column:
    return (end - start) / F.lit(1e6)


def _slice_start(gap_minutes: int) -> Column:
    """Start of the gap-wide slice an event falls in; null without a time."""
    if gap_minutes <= 0:
        raise ValueError("gap_minutes must be positive")
    micros = epoch_micros(F.col(EVENT_TIME))
    return micros - F.pmod(micros, F.lit(gap_minutes * 60_000_000).cast("bigint"))


def _numbered_slices(slices: DataFrame, gap_minutes: int) -> DataFrame:
    """Add ``session_seq``, the number of the session within its user."""
    in_order = Window.partitionBy(USER_ID).orderBy(F.col("slice").asc_nulls_last())
    pause = F.col("start_us") - F.lag("end_us").over(in_order)
    same = F.col(USER_ID).isNotNull() & F.coalesce(pause <= gap_minutes * 60_000_000, F.lit(False))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return slices.withColumn("starts", F.when(same, 0).otherwise(1)).withColumn(
        "session_seq", F.sum("starts").over(so_far)
    )


def _alone() -> Column:
    """An event without a user or a time is a session of its own."""
    return F.col(USER_ID).isNull() | F.col(EVENT_TIME).isNull()


def _lone_events(events: DataFrame) -> DataFrame:
    """The events that are alone, with a ``session_id`` made of what they hold.

    Equal events are counted and numbered, so the ids do not depend on the
    order of rows or files.
    """
    names = events.columns
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])), 256)
    name = F.concat_ws("_", F.lit("row"), F.substring(content, 1, 32), "copy")
    return (
        events.where(_alone())
        .groupBy(*[F.col(f"`{n}`") for n in names])
        .agg(F.count(F.lit(1)).alias("copies"))
        .select(*[F.col(f"`{n}`") for n in names], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select(*[F.col(f"`{n}`") for n in names], name.alias(SESSION_ID))
    )


def _numbered_in_ranges(rows: DataFrame, order: list[Column], size: Column, label: str) -> DataFrame:
    """Add ``before``, the sum of ``size`` over all lower rows in a global order.

    The rows are spread by range and counted per range. The window over the
    ranges sees one row per partition, those over rows one partition each.
    """
    ranged = materialize(
        rows.withColumn("size", size).repartitionByRange(*order).withColumn("range", F.spark_partition_id()),
        label,
    )
    lower = (Window.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("n"))
        .select("range", F.sum("n").over(Window.orderBy("range").rowsBetween(*lower)).alias("base"))
    )
    in_range = Window.partitionBy("range").orderBy(*order).rowsBetween(*lower)
    before = F.coalesce("base", F.lit(0)) + F.coalesce(F.sum("size").over(in_range), F.lit(0))
    # `ranges` has one row per partition of the shuffle above.
    return ranged.join(F.broadcast(ranges), "range").withColumn("before", before).drop("range", "base")


def _assign_by_gap(
    events: DataFrame, gap_minutes: int, running_ids: bool = False
) -> DataFrame:
    """Join every event with the session of its slice.

    The join key is (user, slice). Where even a single slice is hot, the
    adaptive skew join splits the events of that slice over several tasks.
    """
    known = events.where(~_alone()).withColumn("event_slice", _slice_start(gap_minutes))
    slices = (
        events.where(~_alone())
        .groupBy(USER_ID, _slice_start(gap_minutes).alias("slice"))
        .agg(*time_span())
    )
    numbered = _numbered_slices(slices, gap_minutes)
    lone = _lone_events(events)
    session_id = F.concat_ws("_", USER_ID, "session_seq")
    if running_ids:
        # written once: counted per user here, joined with the events below
        numbered = materialize(numbered, "numbered-slices")
        counts = numbered.groupBy(USER_ID).agg(F.max("session_seq").alias("n"))
        counts = _numbered_in_ranges(counts, [F.col(USER_ID)], F.col("n"), "session-counts")
        last = F.coalesce(counts.agg(F.sum("size").alias("n")).scalar(), F.lit(0))
        order = [F.col(USER_ID).asc_nulls_last(), F.col(EVENT_TIME).asc_nulls_last(), F.col(SESSION_ID).asc()]
        lone = _numbered_in_ranges(lone, order, F.lit(1), "lone-events")
        lone = lone.withColumn(SESSION_ID, (F.col("before") + 1 + last).cast("string"))
        counts = counts.select(F.col(USER_ID).alias("counted_user"), "before")
        numbered = numbered.join(counts, F.col(USER_ID) == F.col("counted_user"))
        session_id = (F.col("before") + F.col("session_seq")).cast("string")
    session = Window.partitionBy(USER_ID, "session_seq")
    sessions = numbered.select(
        F.col(USER_ID).alias("slice_user"),
        "slice",
        session_id.alias(SESSION_ID),
        seconds(F.min("start_us").over(session), F.max("end_us").over(session)).alias(SESSION_DURATION),
    )
    tagged = known.join(
        sessions, (F.col(USER_ID) == F.col("slice_user")) & (F.col("event_slice") == F.col("slice"))
    )
    columns = [*[F.col(f"`{n}`") for n in events.columns], F.col(SESSION_ID)]
    lone_sec = F.when(F.col(EVENT_TIME).isNotNull(), F.lit(0.0)).alias(SESSION_DURATION)
    return tagged.select(*columns, SESSION_DURATION).unionByName(lone.select(*columns, lone_sec))


def _given_id() -> Column:
    return F.coalesce(F.col(USER_SESSION).cast("string"), F.lit(MISSING_SESSION))


def _join_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Add ``span_us`` of the session to rows that carry a ``session_id``.

    The hash as a second key says nothing new, but keeps the join from taking
    over the partitions of the aggregation that made ``spans``. Both sides are
    then plain shuffles, and only such a join can be broadcast by its real
    size or be split when one session holds a large part of the rows.
    """
    keyed = spans.select(
        F.col(SESSION_ID).alias("span_session"),
        F.xxhash64(SESSION_ID).alias("span_hash"),
        (F.col("end_us") - F.col("start_us")).alias("span_us"),
    )
    same = (F.col(SESSION_ID) == F.col("span_session")) & (
        F.xxhash64(SESSION_ID) == F.col("span_hash")
    )
    return rows.join(keyed, same, "left").drop("span_session", "span_hash")


def _assign_given(events: DataFrame) -> DataFrame:
    """Take the ids as they are; a session's span is over all events with its id."""
    tagged = events.withColumn(SESSION_ID, _given_id())
    spans = tagged.groupBy(SESSION_ID).agg(*time_span())
    return _join_spans(tagged, spans).select(
        *tagged.columns, (F.col("span_us") / F.lit(1e6)).alias(SESSION_DURATION)
    )


def assign_sessions(
    events: DataFrame,
    gap_minutes: int = DEFAULTS.session_gap_minutes,
    use_existing: bool = True,
    missing: str = "shared",
    running_ids: bool = False,
) -> DataFrame:
    """Add ``session_id`` and ``session_duration_sec`` to every event.

    With ``use_existing`` the ids of ``user_session`` are kept if the log has
    them. Events whose id is missing then form one session together
    (``missing="shared"``) or are given sessions by pauses (``missing="gap"``).

    Sessions by pauses are called ``user_number``; an event without a user or a
    time is a session of its own, called after its content. With ``running_ids``
    all of them are numbered 1, 2, 3, ... through the whole log in the order of
    user and time, those events last.
    """
    events = check_clock(events).drop(SESSION_ID, SESSION_DURATION)
    if not (use_existing and USER_SESSION in events.columns):
        return _assign_by_gap(events, gap_minutes, running_ids)
    if missing == "shared":
        return _assign_given(events)
    if missing != "gap":
        raise ValueError("missing must be 'shared' or 'gap'")
    named = F.col(USER_SESSION).isNotNull()
    return _assign_given(events.where(named)).unionByName(
        _assign_by_gap(events.where(~named), gap_minutes, running_ids)
    )


def session_rollup(
    events: DataFrame,
    gap_minutes: int = DEFAULTS.session_gap_minutes,
    use_existing: bool = True,
) -> DataFrame:
    """One row per user and session with its counts, without tagging any event.

    Columns: ``user_id, session_id, sessions, start_us, end_us, duration_us``
    and the event counts; ``sessions`` is 1. With sessions by pauses, an event
    without a user or a time is a session and a row of its own, with the same
    id as in ``assign_sessions``.
    """
    check_clock(events)
    if use_existing and USER_SESSION in events.columns:
        per_user = _given_counts(events)
        spans = per_user.groupBy(SESSION_ID).agg(
            F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")
        )
        rollup = _join_spans(per_user, spans).withColumnRenamed("span_us", "duration_us")
    else:
        slices = (
            events.where(~_alone())
            .groupBy(USER_ID, _slice_start(gap_minutes).alias("slice"))
            .agg(*time_span(), *event_counts())
        )
        known = (
            _numbered_slices(slices, gap_minutes)
            .groupBy(USER_ID, "session_seq")
            .agg(
                F.min("start_us").alias("start_us"),
                F.max("end_us").alias("end_us"),
                *merged_counts(),
            )
            .withColumn(SESSION_ID, F.concat(F.col(USER_ID), F.lit("_"), F.col("session_seq")))
            .drop("session_seq")
        )
        lone = _lone_events(events.drop(SESSION_ID, SESSION_DURATION))
        lone = lone.groupBy(USER_ID, SESSION_ID).agg(*time_span(), *event_counts())
        rollup = known.unionByName(lone).withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    return rollup.select(
        USER_ID,
        SESSION_ID,
        F.lit(1).cast("bigint").alias("sessions"),
        "start_us",
        "end_us",
        "duration_us",
        *COUNTS,
    )


def _given_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(USER_ID, _given_id().alias(SESSION_ID)).agg(
        *time_span(), *event_counts()
    )


def tagged_rollup(sessioned: DataFrame) -> DataFrame:
    """The same rollup from events that already carry a session id and duration."""
    duration = F.lit(None).cast("bigint")
    if SESSION_DURATION in sessioned.columns:
        duration = F.max(F.rint(F.col(SESSION_DURATION) * F.lit(1e6)).cast("bigint"))
    return (
        sessioned.groupBy(USER_ID, SESSION_ID)
        .agg(*time_span(), *event_counts(), duration.alias("duration_us"))
        .withColumn("sessions", F.lit(1).cast("bigint"))
        .select(USER_ID, SESSION_ID, "sessions", "start_us", "end_us", "duration_us", *COUNTS)
    )


def session_summary(
    events: DataFrame,
    gap_minutes: int = DEFAULTS.session_gap_minutes,
    use_existing: bool = True,
) -> DataFrame:
    """One row per session: user, start, end, number of events, length.

    A given id shared by several users is one session; its user is the lowest.
    """
    check_clock(events)
    if use_existing and USER_SESSION in events.columns:
        rows = (
            _given_counts(events)
            .groupBy(SESSION_ID)
            .agg(
                F.min(USER_ID).alias(USER_ID),
                F.min("start_us").alias("start_us"),
                F.max("end_us").alias("end_us"),
                *merged_counts(),
            )
            .withColumn("sessions", F.lit(1).cast("bigint"))
            .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
        )
    else:
        rows = session_rollup(events, gap_minutes, use_existing=False)
    dtype = events.schema[EVENT_TIME].dataType
    return rows.select(
        USER_ID,
        SESSION_ID,
        "sessions",
        from_micros(F.col("start_us"), dtype).alias("session_start"),
        from_micros(F.col("end_us"), dtype).alias("session_end"),
        "events",
        "views",
        "duration_us",
        (F.col("duration_us") / F.lit(1e6)).alias(SESSION_DURATION),
    )


def session_metrics(summary: DataFrame) -> DataFrame:
    """One row over a session summary: sessions, mean length, mean views per session."""
    timed = F.sum(F.when(F.col("duration_us").isNotNull(), F.col("sessions")))
    total_us = F.sum(F.col("duration_us") * F.col("sessions"))
    sessions = F.coalesce(F.sum("sessions"), F.lit(0))
    return summary.agg(
        sessions.alias("session_count"),
        F.when(timed > 0, round_to(total_us / F.lit(1e6) / timed, 2)).alias(
            "avg_session_duration_sec"
        ),
        F.when(sessions > 0, round_to(F.sum("views") / sessions, 2)).alias(
            "avg_products_viewed"
        ),
    )


def length_distribution(summary: DataFrame) -> DataFrame:
    """How many sessions lasted how long: ``duration_us, sessions``."""
    return (
        summary.where(F.col("duration_us").isNotNull())
        .groupBy("duration_us")
        .agg(F.sum("sessions").alias("sessions"))
    )


def session_lengths(summary: DataFrame) -> DataFrame:
    """As ``length_distribution``, but a row a session: nothing is shuffled where most lengths differ."""
    return summary.where(F.col("duration_us").isNotNull()).select("duration_us", "sessions")


def _written(distribution: DataFrame) -> DataFrame:
    """The lengths, written once for all passes over them."""
    return materialize(distribution.select("duration_us", "sessions"), "lengths")


def length_p99(distribution: DataFrame, q: float = 0.99) -> DataFrame:
    """One row: sessions, the exact ``q`` quantile of minutes, sessions up to it."""
    return _quantile(_written(distribution), q).select(
        F.col("total").alias("sessions"),
        round_to(F.col("cap_min"), 4).alias("cap_min"),
        F.col("up_to_lower").alias("sessions_kept"),
    )


def _quantile(distribution: DataFrame, q: float) -> DataFrame:
    """Neighbours of the quantile and the interpolated ``cap_min`` in minutes."""
    lower, upper = F.col("lower") / F.lit(60e6), F.col("upper") / F.lit(60e6)
    return quantile_neighbours(distribution, "duration_us", "sessions", q).withColumn(
        "cap_min", lower + (upper - lower) * F.col("fraction")
    )


def length_histogram(distribution: DataFrame, bins: int = 50, q: float = 0.99) -> DataFrame:
    """Equal bins over session minutes from the shortest to the ``q`` quantile.

    Longer sessions are left out, as in the chart this feeds. All bins are
    listed, those without a session with 0; no sessions at all make no bins.
    """
    distribution = _written(distribution)
    found = _quantile(distribution, q).select(
        "lower", "cap_min", (F.col("smallest") / F.lit(60e6)).alias("min_min")
    )
    limit = found.first()
    if limit is None:
        limit = {"lower": -1, "cap_min": 0.0, "min_min": 0.0}
    minutes = F.col("duration_us") / F.lit(60e6)
    span = limit["cap_min"] - limit["min_min"]
    bins = bins if span > 0 else 1  # sessions of one length
    start, width = F.lit(limit["min_min"]), F.lit(span / bins)
    index = F.when(width > 0, F.least(F.floor((minutes - start) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    # the bound is a literal, so the scan skips what is longer
    counts = (
        distribution.where(F.col("duration_us") <= limit["lower"])
        .groupBy((index + 1).cast("bigint").alias("bin"))
        .agg(F.sum("sessions").alias("n"))
        .groupBy()
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("n"))
    )  # one row, with at most `bins` entries
    return (
        counts.where(F.size("n") > 0)
        .select("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin"))
        .select(
            "bin",
            round_to(start + width * (F.col("bin") - 1), 4).alias("from_min"),
            round_to(start + width * F.col("bin"), 4).alias("to_min"),
            F.coalesce(F.try_element_at("n", F.col("bin")), F.lit(0)).alias("sessions"),
        )
        .orderBy("bin")
    )
