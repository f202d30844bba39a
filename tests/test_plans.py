"""What the plans must and must not contain, whatever the size of the log."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from trailmark.operators import clean, cluster, sessions
from trailmark.plans.catalog import QUERIES
from trailmark.storage import materialize

FOLDER = "/root/testdata/sf0.001"


BOUNDED_WINDOWS = {
    "session_length_p99", "session_length_histogram", "sessions_gap_running_ids", "running_ids_without_user",
    "activity_cohorts", "activity_uniques",
}
FITS = {"kmeans_clusters", "kmeans_properties", "cluster_summary"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **conf):
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def brackets(text):
    """The bracketed parts of a plan line, outermost only."""
    parts, depth = [], 0
    for char in text:
        depth += (char == "[") - (char == "]")
        if char == "[" and depth == 1:
            parts.append("")
        elif depth:
            parts[-1] += char
    return parts


def is_global(window):
    """A window without partition keys lists its order right after its functions."""
    keys = brackets(window)[1:2]
    return not keys or " ASC " in keys[0] or " DESC " in keys[0]


@pytest.fixture
def written(monkeypatch):
    """Plans of all frames that are written down on the way to a result."""
    plans = []

    def recorded(frame, label):
        plans.append(plan(frame))
        return materialize(frame, label)

    for module in (clean, cluster, sessions):
        monkeypatch.setattr(module, "materialize", recorded)
    return plans


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_no_python_no_pairing_of_all_rows_no_global_window(spark, written, name):
    """Two windows have no keys: over hours, which the calendar bounds, and over partitions."""
    written.append(plan(QUERIES[name](spark, FOLDER)))
    for text in written:
        for node in ("EvalPython", "InPandas", "MapInArrow", "CartesianProduct", "NestedLoopJoin"):
            # records that span lines are cut from the lines in order, in Arrow batches
            assert node not in text or (name, node) == ("csv_round_trip", "MapInArrow")
        windows = [line.split("Window ", 1)[1] for line in text.splitlines() if "- Window [" in line]
        if name not in BOUNDED_WINDOWS:
            assert not any(map(is_global, windows))
    if name.startswith(("sessions_", "session_", "remove_bots", "chi_square", "segment", "kpis")):
        assert any("parquet" in text and "Exchange" in text for text in written)


def test_the_length_search_reads_only_the_buckets_it_needs(spark):
    lengths = spark.range(100_000).selectExpr("id * 1000003 AS duration_us", "1L AS sessions")
    stored = sessions._written(lengths)
    text = plan(sessions.quantile_neighbours(stored, "duration_us", "sessions", 0.99))
    assert "GreaterThanOrEqual(duration_us," in text and "LessThan(duration_us," in text


def test_running_ids_number_the_slices_once(spark, written):
    QUERIES["sessions_gap_running_ids"](spark, FOLDER)
    assert sum("events.parquet" in text and "lag(" in text for text in written) == 1


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_date_range"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts,2024-01-05" in text
    assert "LessThanOrEqual(ts,2024-01-20" in text
    text = plan(QUERIES["hourly_events"](spark, FOLDER))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string>", text)
    text = plan(QUERIES["funnel"](spark, FOLDER))
    assert "l_extendedprice" not in text and "part.parquet" not in text


def hot_log(spark, rows=300_000):
    """A third of the events in one slice of one user; the rest over many users and months."""
    hot = F.col("id") % 3 == 0
    frame = spark.range(0, rows, 1, 8).select(
        F.col("id").alias("event_id"),
        F.when(hot, 0).otherwise(F.col("id") % 5000).alias("user_id"),
        F.timestamp_seconds(
            F.when(hot, F.col("id") % 900).otherwise(F.pmod(F.xxhash64("id"), F.lit(20_000_000)))
        ).alias("event_time"),
        F.lit("view").alias("event_type"),
        F.lit(1.0).alias("price"),
        (F.col("id") % 100).alias("product_id"),
        F.repeat(F.lit("x"), 100).alias("note"),
        F.when(hot, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("user_session"),
    )
    return materialize(frame, "hot")


SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
}


@pytest.mark.parametrize("use_existing", [False, True])
def test_a_hot_session_is_split_over_tasks(spark, use_existing):
    with settings(spark, **SHUFFLED):
        tagged = sessions.assign_sessions(hot_log(spark), 30, use_existing)
        rows = tagged.select("event_id", "session_id", "session_duration_sec", "note").collect()
        spans = {row.session_id: row.session_duration_sec for row in rows if row.event_id % 3 == 0}
        assert len(rows) == 300_000 and len(spans) == 1 and set(spans.values()) == {897.0}
        whole = tagged.select("event_id", "session_id", "session_duration_sec", "note")
        whole.collect()
        assert "skew=true" in plan(whole)


def test_a_session_shared_by_many_users_is_split_over_tasks(spark):
    shared = hot_log(spark).withColumn(
        "user_id", F.when(F.col("user_session") == "hot", F.col("event_id")).otherwise(-1)
    )
    with settings(spark, **SHUFFLED):
        rollup = sessions.session_rollup(shared)
        hot = [row for row in rollup.collect() if row.session_id == "hot"]
        assert len(hot) == 100_000 and {row.duration_us for row in hot} == {897_000_000}
        assert "skew=true" in plan(rollup)


def test_a_long_list_of_bots_is_joined_by_shuffle_and_split(spark):
    with settings(spark, **SHUFFLED):
        events = hot_log(spark)
        others = materialize(events.select("user_id").where("user_id > 2500").distinct(), "others")
        kept = clean.without_users(events, others)
        assert len(kept.collect()) == events.where("user_id <= 2500").count()
        assert "skew=true" in plan(kept)


def test_copies_are_dropped_before_the_shuffle(spark):
    text = plan(clean.deduplicate_events(hot_log(spark)))
    before, after = text.split("Exchange hashpartitioning", 1)
    assert "Final" in before and "Partial" in after and "WindowGroupLimit" in after


def test_sessions_are_counted_before_any_user_is_gathered(spark):
    """The shuffle by user alone must be fed by an aggregation by (user, slice)."""
    text = plan(sessions.session_rollup(hot_log(spark), use_existing=False))
    below = text.split("Exchange hashpartitioning(user_id", 1)[1]
    assert re.search(r"HashAggregate\(keys=\[user_id#\d+L, _groupingexpression", below)
    assert "Window" not in below


def test_results_do_not_depend_on_partitions(spark):
    events = hot_log(spark, 3000)
    results = []
    for parts in (1, 17):
        spread = events.repartition(parts)
        summary = sessions.session_summary(spread, use_existing=False)
        results.append(
            (
                sorted(map(tuple, summary.collect())),
                sorted(map(tuple, clean.deduplicate_events(spread).collect())),
            )
        )
    assert results[0] == results[1]
