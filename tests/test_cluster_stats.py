import math

import pytest
from helpers import log, rows

from trailmark.operators import cluster, stats
from trailmark.plans.catalog import QUERIES


def user_table(spark, n):
    return spark.range(n).selectExpr(
        "id AS user_id",
        "10L * (id % 3) + id % 2 AS total_events",
        "100L * (id % 3) AS total_views",
        "7L AS total_carts",
        "id % 3 AS total_purchases",
        "if(id = 0, null, 1.0D) AS avg_price",
        "1L AS session_count",
        "CASE id % 3 WHEN 0 THEN 'Browser' WHEN 1 THEN 'Purchaser' ELSE 'Cart Abandoner' END AS segment",
    )


def test_scaling_uses_the_population_deviation_and_zero_for_constants(spark):
    table = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 3, 5)], "user_id int, total_events int, total_views int")
    scaled = cluster.scaled_features(table).orderBy("user_id").collect()
    assert [row.total_events_scaled for row in scaled] == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert [row.pc2 for row in scaled] == [0.0, 0.0, 0.0]
    missing = cluster.scaled_features(user_table(spark, 10)).where("user_id = 0").first()
    assert missing.avg_price_scaled == pytest.approx(-3.0)


def test_clear_groups_are_found_and_numbered_by_centre(spark):
    table = user_table(spark, 90).where("user_id > 0")
    clustered = cluster.cluster_users(table, 3)
    assert clustered.columns == [*table.columns, "cluster", "pc1", "pc2"]
    assert {(r.user_id % 3, r.cluster) for r in clustered.collect()} == {(0, 0), (1, 1), (2, 2)}
    summary = cluster.cluster_summary(clustered).collect()
    assert [tuple(r) for r in summary] == [
        (0, 29, 0.5, 0.0, "Browser"),
        (1, 30, 10.5, 1.0, "Purchaser"),
        (2, 30, 20.5, 2.0, "Cart Abandoner"),
    ]
    assert cluster.scatter_points(clustered).count() == 89


def test_labels_do_not_depend_on_partitions(spark):
    table = QUERIES["segment_users"](spark, "/root/testdata/sf0.001")
    labels = [
        {r.user_id: r.cluster for r in cluster.cluster_users(table.repartition(n, "user_id"), 4).collect()}
        for n in (1, 5, 11)
    ]
    assert labels[0] == labels[1] == labels[2] and len(set(labels[0].values())) == 4


def test_too_few_users_or_features(spark):
    with pytest.raises(ValueError):
        cluster.cluster_users(user_table(spark, 3), 4)
    one = cluster.cluster_users(spark.createDataFrame([(1, 2)], "user_id int, total_events int"))
    assert rows(one) == [(1, 2, 0, 0.0, 0.0)]


def test_dominant_segment_of_equals_is_the_first_by_name(spark):
    frame = spark.createDataFrame(
        [(0, "b", 1, 1), (0, "a", 1, 1), (0, "c", 1, 1)],
        "cluster int, segment string, total_events int, total_purchases int",
    )
    assert cluster.cluster_summary(frame).first().dominant_segment == "a"


def conversions(spark, table):
    """{group: (users without, users with a purchase)} as a log."""
    events, user = [], 0
    for group, counts in table.items():
        for bought, count in enumerate(counts):
            for _ in range(count):
                user += 1
                kind = "purchase" if bought else "view"
                events += [("2024-01-01 00:00:00", "view", user, 1, 1.0, group)]
                events += [("2024-01-01 00:00:01", kind, user, 1, 1.0, "later")]
    return log(spark, events)


def test_two_by_two_is_corrected(spark):
    test = stats.chi_square_conversion_test(conversions(spark, {"a": (10, 20), "b": (20, 10)}), "brand")
    assert (test.chi2, test.dof, test.significant) == (5.4, 1, True)
    assert test.p_value == round(math.erfc(math.sqrt(2.7)), 6)
    assert rows(test.contingency_table) == [("a", 10, 20), ("b", 20, 10)]


def test_correction_never_exceeds_the_deviation(spark):
    test = stats.chi_square_conversion_test(conversions(spark, {"a": (5, 5), "b": (5, 5)}), "brand")
    assert (test.chi2, test.p_value, test.significant) == (0.0, 1.0, False)


def test_three_groups_are_not_corrected(spark):
    log_ = conversions(spark, {"a": (10, 20), "b": (20, 10), "c": (15, 15)})
    test = stats.chi_square_conversion_test(log_, "brand")
    assert (test.chi2, test.dof, test.significant) == (6.6667, 2, True)
    assert test.p_value == round(math.exp(-10 / 3), 6)


def test_degenerate_tables(spark):
    one = stats.chi_square_conversion_test(conversions(spark, {"a": (3, 4)}), "brand")
    assert (one.chi2, one.p_value, one.dof, one.significant) == (0.0, 1.0, 0, False)
    all_buy = stats.chi_square_conversion_test(conversions(spark, {"a": (0, 4), "b": (0, 2)}), "brand")
    assert (all_buy.chi2, all_buy.p_value, all_buy.dof) == (0.0, 1.0, 0)
    assert stats.chi_square_conversion_test(log(spark, []), "brand").chi2 is None
    assert stats.chi_square_conversion_test(log(spark, []), "no_such_column").dof is None


def test_group_is_the_first_known_one(spark):
    events = log(
        spark,
        [
            ("2024-01-02 00:00:00", "view", 1, 1, 1.0, "late"),
            ("2024-01-01 00:00:00", "purchase", 1, 1, 1.0, "early"),
            ("2023-01-01 00:00:00", "view", 1, 1, 1.0, None),
            (None, "view", 1, 1, 1.0, "timeless"),
            ("2024-01-01 00:00:00", "view", 2, 1, 1.0, None),
            ("2024-01-01 00:00:00", "view", None, 1, 1.0, "x"),
        ],
    )
    assert rows(stats.user_groups(events, "brand")) == [(1, "early", True), (2, None, False)]
    assert rows(stats.contingency(events, "brand")) == [("early", 0, 1)]


@pytest.mark.parametrize("chi2,dof", [(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (124.342113, 100)])
def test_tail_at_the_critical_values(spark, chi2, dof):
    frame = spark.createDataFrame([(chi2, dof)], "chi2 double, dof bigint")
    tail = frame.select(stats.tail_probability(frame.chi2, frame.dof)).first()[0]
    assert tail == pytest.approx(0.05, abs=1e-6)


def test_tail_far_out(spark):
    rows_ = [(5000.0, 2), (5000.0, 1), (0.0, 3), (1.0, 0), (2000.0, 2001), (1e-9, 7)]
    frame = spark.createDataFrame(rows_, "chi2 double, dof bigint")
    tails = [row[0] for row in frame.select(stats.tail_probability(frame.chi2, frame.dof)).collect()]
    assert tails[0] < 1e-9 and tails[1] < 1e-9 and tails[2:4] == [1.0, 1.0]
    assert tails[4] == pytest.approx(0.5, abs=0.02) and tails[5] == pytest.approx(1.0)


def test_the_statistic_is_computed_from_the_tables(spark):
    plan = QUERIES["chi_square_statistic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    for table in ("lineitem", "orders", "customer", "part"):
        assert f"{table}.parquet" in text


def test_events_at_the_same_time_are_ordered_by_their_id(spark):
    events = spark.createDataFrame(
        [(2, 1, "a"), (1, 1, "b"), (3, 1, None)], "event_id int, user_id int, brand string"
    ).selectExpr("*", "timestamp'2024-01-01 00:00:00' AS event_time", "'view' AS event_type")
    assert rows(stats.user_groups(events, "brand")) == [(1, "b", False)]
    assert rows(stats.user_groups(events.drop("event_id"), "brand")) == [(1, "a", False)]
