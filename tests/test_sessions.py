import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import log, rows
from pyspark.sql import functions as F

from trailmark.functions import quantile, quantile_neighbours
from trailmark.operators import clean, cohort, sessions, temporal


def spans(frame):
    return rows(frame, "user_id", "event_time", "session_id", "session_duration_sec")


def test_a_pause_must_exceed_the_gap(spark):
    events = log(
        spark,
        [
            ("2024-01-01 00:10:00", "view", 1),
            ("2024-01-01 00:40:00", "view", 1),
            ("2024-01-01 01:10:00.000001", "view", 1),
            ("2024-01-01 01:10:00.000001", "cart", 1),
            ("2024-01-01 00:11:00", "view", 2),
        ],
    )
    tagged = sessions.assign_sessions(events, 30, use_existing=False)
    assert rows(tagged, "user_id", "event_type", "session_id", "session_duration_sec") == [
        (1, "cart", "1_2", 0.0),
        (1, "view", "1_1", 1800.0),
        (1, "view", "1_1", 1800.0),
        (1, "view", "1_2", 0.0),
        (2, "view", "2_1", 0.0),
    ]


def test_events_without_user_or_time_are_sessions_of_their_own(spark):
    events = log(
        spark,
        [
            ("2024-01-01 00:00:00", "view", None),
            ("2024-01-01 00:00:00", "view", None),
            (None, "view", 1),
            (None, "view", 1),
            (None, "view", None),
            ("2024-01-01 00:00:00", "view", 1),
        ],
    )
    tagged = sessions.assign_sessions(events, 30, use_existing=False)
    assert tagged.select("session_id").distinct().count() == 6
    assert [row[0] for row in rows(tagged, "session_duration_sec")] == [0.0, 0.0, 0.0] + [None] * 3
    summary = sessions.session_summary(events, 30, use_existing=False)
    assert sessions.session_metrics(summary).first()["session_count"] == 6
    lengths = sessions.length_distribution(summary)
    assert rows(lengths) == [(0, 3)]


def test_given_sessions_share_an_id_across_users_and_missing_ones_are_one(spark):
    events = log(
        spark,
        [
            ("2024-01-01 00:00:00", "view", 1, 1, 1.0, "b", "s"),
            ("2024-01-01 00:00:10", "view", 2, 1, 1.0, "b", "s"),
            ("2024-01-01 00:00:00", "view", 1, 1, 1.0, "b", None),
            ("2024-01-02 00:00:00", "view", 2, 1, 1.0, "b", None),
        ],
    )
    tagged = sessions.assign_sessions(events)
    assert rows(tagged, "session_id", "session_duration_sec") == [
        ("nan", 86400.0),
        ("nan", 86400.0),
        ("s", 10.0),
        ("s", 10.0),
    ]
    by_gap = sessions.assign_sessions(events, missing="gap")
    assert rows(by_gap, "session_id", "session_duration_sec") == [
        ("1_1", 0.0),
        ("2_1", 0.0),
        ("s", 10.0),
        ("s", 10.0),
    ]
    assert sessions.session_summary(events).count() == 2
    with pytest.raises(ValueError):
        sessions.assign_sessions(events, missing="other")
    with pytest.raises(ValueError):
        sessions.assign_sessions(events, 0, use_existing=False).count()


def brute_force(events, gap):
    """(user, time) -> (number of the session within the user, its seconds)."""
    times = {}
    for user, time in events:
        times.setdefault(user, set()).add(time)
    result = {}
    for user, moments in times.items():
        groups = []
        for moment in sorted(moments):
            if groups and moment - groups[-1][-1] <= gap:
                groups[-1].append(moment)
            else:
                groups.append([moment])
        for number, group in enumerate(groups, start=1):
            for moment in group:
                seconds = (group[-1] - group[0]) / timedelta(seconds=1)
                result[user, moment] = (f"{user}_{number}", seconds)
    return result


@pytest.mark.parametrize("seed,gap", [(1, 30), (2, 7), (3, 1)])
def test_gap_sessions_against_brute_force(spark, seed, gap):
    """Also before 1970, at equal times, and with one user who has a third of all events."""
    rng = random.Random(seed)
    start = datetime(1969, 12, 31, 12)
    events = []
    for _ in range(3000):
        user = 0 if rng.random() < 0.33 else rng.randrange(1, 12)
        micros = rng.choice([rng.randrange(86_400) * 1_000_000, rng.randrange(86_400 * 10**6)])
        events.append((user, start + timedelta(microseconds=micros)))
    frame = spark.createDataFrame(events, "user_id int, event_time timestamp_ntz").withColumns(
        {"event_type": F.lit("view"), "price": F.lit(1.0)}
    )
    want = brute_force(events, timedelta(minutes=gap))
    for parts in (1, 17):
        tagged = sessions.assign_sessions(frame.repartition(parts), gap, use_existing=False)
        got = {(r.user_id, r.event_time): (r[-2], r[-1]) for r in tagged.collect()}
        assert got == want
    running = sessions.assign_sessions(frame, gap, use_existing=False, running_ids=True)
    order = sorted({(user, moment): s for (user, moment), (s, _) in want.items()}.items())
    names = list(dict.fromkeys(session for _, session in order))
    got = {(r.user_id, r.event_time): int(r.session_id) for r in running.collect()}
    assert got == {key: names.index(session) + 1 for key, session in order}
    summary = sessions.session_summary(frame, gap, use_existing=False)
    assert {(r.session_id, r.session_duration_sec) for r in summary.collect()} == set(want.values())
    assert summary.agg(F.sum("events")).first()[0] == len(events)


def test_rollup_from_tagged_events_equals_rollup_from_slices(spark):
    events = log(
        spark,
        [
            (f"2024-01-01 0{i % 7}:{i % 60:02d}:00", ["view", "cart", "purchase"][i % 3], i % 5, i, i / 8)
            for i in range(200)
        ],
    )
    tagged = sessions.assign_sessions(events, 30, use_existing=False)
    direct = sessions.session_rollup(events, 30, use_existing=False)
    assert rows(sessions.tagged_rollup(tagged)) == rows(direct)


@pytest.mark.parametrize("seed", range(4))
def test_quantile_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 400))
    values = rng.integers(0, 10 ** int(rng.integers(1, 13)), size)
    frame = (
        spark.createDataFrame([(int(v),) for v in values], "v bigint").groupBy("v").count()
    )
    for q in (0.0, 0.5, 0.99, 1.0):
        row = quantile_neighbours(frame, "v", "count", q).first()
        got = row.lower + (row.upper - row.lower) * row.fraction
        assert got == pytest.approx(np.quantile(values, q), rel=1e-12)
        assert row.total == size
        assert row.up_to_lower == (values <= row.lower).sum()


@pytest.mark.parametrize("seed", range(3))
def test_quantile_by_many_passes(spark, seed, monkeypatch):
    """Coarse sketches without a margin give wrong bounds, ties and neighbours on both sides of a bound."""
    for name, setting in (("SKETCH_SIZE", 8), ("MARGIN", 0.0), ("FEW", 2)):
        monkeypatch.setattr(quantile, name, setting)
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.integers(0, 60, 300), np.full(200, 31), rng.integers(0, 10**9, 200)])
    frame = spark.createDataFrame([(int(v), 1) for v in values], "v bigint, n bigint").repartition(3).persist()
    for q in (0.0, 0.21, 0.5, 0.77, 0.99, 1.0):
        row = quantile_neighbours(frame, "v", "n", q).first()
        got = row.lower + (row.upper - row.lower) * row.fraction
        assert got == pytest.approx(np.quantile(values, q), rel=1e-12)
        assert (row.total, row.smallest) == (len(values), values.min())
        assert row.up_to_lower == (values <= row.lower).sum()
    frame.unpersist()


def test_quantile_of_nothing(spark):
    nothing = spark.createDataFrame([], "v bigint, n bigint")
    assert quantile_neighbours(nothing, "v", "n", 0.99).count() == 0


def test_histogram_counts_every_session_up_to_the_cap(spark):
    lengths = spark.range(1000).selectExpr("id * 60000000 AS duration_us", "1L AS sessions")
    p99 = sessions.length_p99(lengths).first()
    assert (p99.sessions, p99.cap_min, p99.sessions_kept) == (1000, 989.01, 990)
    bins = sessions.length_histogram(lengths).collect()
    assert [b.bin for b in bins] == list(range(1, 51))
    assert sum(b.sessions for b in bins) == 990
    assert bins[0].from_min == 0.0 and bins[-1].to_min == 989.01
    single = spark.createDataFrame([(5, 3)], "duration_us bigint, sessions bigint")
    assert [tuple(r)[::3] for r in sessions.length_histogram(single).collect()] == [(1, 3)]


def test_running_ids_over_several_ranges_of_users(spark):
    events = spark.range(500).selectExpr(
        "id AS event_id",
        "id % 50 AS user_id",
        "timestamp_seconds(id * 600) AS event_time",
        "'view' AS event_type",
        "1.0D AS price",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tagged = sessions.assign_sessions(events, 30, use_existing=False, running_ids=True)
        got = {(r.user_id, r.event_time): int(r.session_id) for r in tagged.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {key: number for number, key in enumerate(sorted(got), start=1)}


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


NIGHT = [
    (1, "2024-03-10 01:50:00"),
    (1, "2024-03-10 03:10:00.25"),
    (1, "2024-03-10 03:20:00"),
    (1, "1969-12-31 23:59:59.999999"),
]


def night(spark, kind):
    frame = spark.createDataFrame(NIGHT, "user_id int, text string")
    return frame.selectExpr(
        "user_id", f"cast(text AS {kind}) AS event_time", "'view' AS event_type", "1.0D AS price", "7 AS product_id"
    )


def test_times_without_a_zone_mean_the_same_in_any_session(new_york):
    """The night clocks go forward: 80 minutes by the wall clock, 20 in the zone."""
    events = night(new_york, "timestamp_ntz")
    tagged = sessions.assign_sessions(events, 30, use_existing=False)
    assert sorted((r.session_id, r.session_duration_sec) for r in tagged.collect()) == [
        ("1_1", 0.0), ("1_2", 0.0), ("1_3", 599.75), ("1_3", 599.75),
    ]
    summary = sessions.session_summary(events, 30, use_existing=False).collect()
    assert sorted((str(r.session_start), str(r.session_end), r.duration_us) for r in summary) == [
        ("1969-12-31 23:59:59.999999", "1969-12-31 23:59:59.999999", 0),
        ("2024-03-10 01:50:00", "2024-03-10 01:50:00", 0),
        ("2024-03-10 03:10:00.250000", "2024-03-10 03:20:00", 599_750_000),
    ]


def test_times_with_a_zone_are_refused_outside_utc(new_york):
    events = night(new_york, "timestamp")
    for analysis in (
        lambda: sessions.assign_sessions(events, use_existing=False),
        lambda: sessions.session_summary(events),
        lambda: sessions.session_rollup(events),
        lambda: temporal.slot_counts(events),
        lambda: temporal.daily_events(events),
        lambda: cohort.cohort_assign(events),
        lambda: clean.bot_users(events),
        lambda: clean.filter_date_range(events, "2024-01-01", "2024-01-02"),
    ):
        with pytest.raises(ValueError, match="timeZone"):
            analysis()


def lone_log(spark):
    return log(
        spark,
        [
            ("2024-01-01 10:00:00", "view", None, 1, 1.0),
            ("2024-01-01 10:05:00", "view", None, 1, 1.0),
            ("2024-01-01 10:05:00", "view", None, 1, 1.0),
            (None, "cart", None, 1, 1.0),
            (None, "view", 5, 1, 1.0),
            ("2024-01-01 10:00:00", "view", 5, 1, 1.0),
            ("2024-01-01 10:01:00", "cart", 5, 1, 1.0),
            ("2024-01-01 10:01:00", "cart", 3, 1, 1.0),
        ],
    )


def test_events_without_a_user_are_sessions_with_stable_ids(spark):
    events = lone_log(spark)
    tagged = [rows(sessions.assign_sessions(events.repartition(n), 30, False)) for n in (1, 5)]
    assert tagged[0] == tagged[1]
    ids = [row[-2] for row in tagged[0]]
    assert len(set(ids)) == 7 and sum(i.startswith("row_") for i in ids) == 5
    table = sessions.session_summary(events, 30, use_existing=False).collect()
    assert sorted(row.session_id for row in table) == sorted(set(ids))
    assert all(row.sessions == 1 for row in table)
    assert sum(row.events for row in table) == 8
    for row in table:
        if row.user_id is None:
            assert (row.events, row.session_start) == (1, row.session_end)
    metrics = sessions.session_metrics(sessions.session_summary(events, 30, use_existing=False)).first()
    assert metrics.session_count == 7


def test_running_numbers_are_given_to_all_sessions(spark):
    tagged = sessions.assign_sessions(lone_log(spark), 30, False, running_ids=True)
    numbers = {}
    for row in tagged.collect():
        numbers.setdefault(row.user_id, set()).add(int(row.session_id))
    assert numbers == {3: {1}, 5: {2, 3}, None: {4, 5, 6, 7}}
