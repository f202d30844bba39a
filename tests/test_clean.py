from helpers import at, log, rows

from trailmark.operators import clean
from trailmark.storage import materialize


def bot_log(spark):
    busy = [("2024-01-01 10:00:00", "view", 1)] * 4 + [("2024-01-02 10:00:00", "view", 1)]
    limit = [("2024-01-01 10:00:00", "view", 2)] * 3
    spread = [(f"2024-01-0{day} 10:00:00", "view", 3) for day in (1, 1, 1, 2, 2, 2)]
    nobody = [("2024-01-01 10:00:00", "view", None)] * 9
    timeless = [(None, "view", 4)] * 9
    return log(spark, busy + limit + spread + nobody + timeless)


def test_bots_exceed_the_threshold_on_one_day(spark):
    assert rows(clean.bot_users(bot_log(spark), 3)) == [(1, 4)]


def test_bots_lose_all_days_and_unknown_users_stay(spark):
    kept = clean.remove_bots(bot_log(spark), 3)
    counts = {row[0]: row[1] for row in kept.groupBy("user_id").count().collect()}
    assert counts == {2: 3, 3: 6, 4: 9, None: 9}
    assert kept.columns == bot_log(spark).columns


def test_no_bots(spark):
    assert clean.remove_bots(bot_log(spark), 1000).count() == bot_log(spark).count()


def test_known_duplicate(spark):
    events = log(
        spark,
        [
            ("2024-01-01 00:00:00", "view", 1, 10, 5.0),
            ("2024-01-01 00:00:00", "view", 1, 10, 5.0),
            ("2024-01-01 00:01:00", "cart", 1, 10, 5.0),
        ],
    )
    once = clean.deduplicate_events(events)
    assert once.count() == 2
    assert clean.deduplicate_events(once).count() == 2


def test_duplicates_keep_the_first_by_the_other_columns_and_nulls_are_equal(spark):
    events = log(
        spark,
        [
            ("2024-01-01 00:00:00", "view", None, 10, 7.0, "b"),
            ("2024-01-01 00:00:00", "view", None, 10, 5.0, "c"),
            ("2024-01-01 00:00:00", "view", None, 10, 5.0, "a"),
        ],
    )
    assert rows(clean.deduplicate_events(events), "price", "brand") == [(5.0, "a")]
    assert rows(clean.deduplicate_events(events, order=["brand"]), "price") == [(5.0,)]


def test_duplicates_by_event_id_or_a_subset_or_nothing(spark):
    events = log(
        spark,
        [("2024-01-01 00:00:00", "view", 1, 10, 7.0), ("2024-01-01 00:00:00", "view", 1, 10, 5.0)],
    )
    numbered = events.selectExpr("*", "CASE price WHEN 7.0 THEN 1 ELSE 2 END AS event_id")
    assert rows(clean.deduplicate_events(numbered), "price") == [(7.0,)]
    assert clean.deduplicate_events(events, ["price"]).count() == 2
    assert clean.deduplicate_events(events, ["no_such_column"]).count() == 2
    assert clean.deduplicate_events(events.select("user_id", "event_type")).count() == 1


def test_cleaning_report_equals_the_steps(spark):
    events = bot_log(spark)
    kept = clean.remove_bots(events, 3)
    unique = clean.deduplicate_events(kept)
    report = clean.cleaning_report(events, 3).first().asDict()
    assert report["bot_users"] == 1
    assert report["rows_in"] == events.count()
    assert report["rows_without_bots"] == kept.count()
    assert report["rows_out"] == unique.count()
    assert report["duplicates_removed"] == kept.count() - unique.count()
    empty = clean.cleaning_report(events.limit(0), 3).first().asDict()
    assert empty["rows_in"] == 0 and empty["duplicate_pct"] == 0.0


def test_date_range_ends_with_the_last_whole_second(spark):
    events = log(
        spark,
        [
            ("2023-12-31 23:59:59.999999", "view", 1),
            ("2024-01-01 00:00:00", "view", 2),
            ("2024-01-02 23:59:59", "view", 3),
            ("2024-01-02 23:59:59.5", "view", 4),
            ("2024-01-03 00:00:00", "view", 5),
            (None, "view", 6),
        ],
    )
    kept = clean.filter_date_range(events, "2024-01-01", "2024-01-02")
    assert rows(kept, "user_id") == [(2,), (3,)]
    kept = clean.filter_date_range(events, "2024-01-01", "2024-01-02", whole_last_day=True)
    assert rows(kept, "user_id") == [(2,), (3,), (4,)]


def test_brand_filter_and_options(spark):
    events = log(
        spark,
        [("2024-01-01 00:00:00", "view", u, 1, 1.0, b) for u, b in enumerate(["b", "a", None, "a"])],
    )
    assert clean.filter_brands(events, []).count() == 4
    assert clean.filter_brands(events, ["a"]).count() == 2
    assert clean.filter_brands(events.drop("brand"), ["a"]).count() == 4
    assert [row[0] for row in clean.brand_options(events).collect()] == ["a", "b"]
    assert clean.apply_filters(events, ("2024-01-01", None), ["a", "b"]).count() == 3
    assert clean.apply_filters(events, ("2024-02-01", "2024-02-02")).count() == 0
    assert clean.date_bounds(events).first()[0] == at("2024-01-01").date()


def test_materialized_table_is_the_same(spark):
    events = bot_log(spark)
    assert rows(materialize(events, "copy")) == rows(events)
