from helpers import log, rows

from trailmark.operators import brands, temporal


def test_time_patterns(spark):
    events = log(
        spark,
        [
            ("2024-01-01 05:00:00", "purchase", 1),
            ("2024-01-07 05:59:59", "purchase", 1),
            ("2024-01-02 07:00:00", "purchase", 1),
            ("2024-01-09 07:00:00", "purchase", 1),
            ("2024-01-02 07:00:00", "odd", 1),
            ("2024-01-02 07:00:00", None, 1),
            (None, "view", 1),
        ],
    )
    patterns = temporal.time_patterns(events)
    assert rows(patterns.hourly) == [(5, "purchase", 2), (7, "odd", 1), (7, "purchase", 2)]
    assert rows(patterns.daily) == [
        (0, "Monday", "purchase", 1),
        (1, "Tuesday", "odd", 1),
        (1, "Tuesday", "purchase", 2),
        (6, "Sunday", "purchase", 1),
    ]
    assert rows(patterns.heatmap) == [(5, 1, 0, 0, 0, 0, 0, 1), (7, 0, 2, 0, 0, 0, 0, 0)]
    slots = temporal.slot_counts(events)
    assert rows(temporal.purchases_by_hour(slots)) == [(5, 2), (7, 2)]
    assert rows(temporal.peak_purchase_time(slots)) == [(5, "Tue", "5:00")]
    assert temporal.daily_events(events).count() == 5
    assert rows(temporal.event_distribution(events)) == [
        ("odd", 1, 16.7),
        ("purchase", 4, 66.7),
        ("view", 1, 16.7),
    ]
    assert rows(temporal.heatmap_labels(patterns.heatmap), "hour_label") == [("05:00",), ("07:00",)]


def test_no_purchases_no_peak(spark):
    slots = temporal.slot_counts(log(spark, [("2024-01-01 05:00:00", "view", 1)]))
    assert temporal.purchase_heatmap(slots).count() == 0
    assert temporal.peak_purchase_time(slots).count() == 0


def brand_log(spark):
    def events(brand, *kinds):
        return [("2024-01-01 05:00:00", kind, 1, i % 2, 2.0, brand) for i, kind in enumerate(kinds)]

    return log(
        spark,
        events("b", "view", "cart", "purchase")
        + events("a", "cart", "purchase", "purchase")
        + events("c", "view", "view", "view", None)
        + events("small", "view")
        + events(None, *["view"] * 9),
    )


def test_brands(spark):
    table = brands.brand_analysis(brand_log(spark), min_events=3)
    assert [tuple(r) for r in table.collect()] == [
        ("a", 3, 0, 1, 2, 2.0, 2, 0.0, 200.0, 0.0),
        ("b", 3, 1, 1, 1, 2.0, 2, 100.0, 100.0, 100.0),
        ("c", 3, 3, 0, 0, 2.0, 2, 0.0, 0.0, 0.0),
    ]
    top = brands.brand_analysis(brand_log(spark), top_n=2, min_events=1)
    assert [r.brand for r in top.collect()] == ["a", "b"]
    assert [r.brand for r in brands.brand_conversion_table(table).collect()] == ["b", "a", "c"]
    assert rows(brands.top_converting_brand(table)) == [("b", 100.0, 1, 1)]
    assert [r.brand for r in brands.brand_comparison(table).collect()] == ["c", "b", "a"]


def test_no_brand_column(spark):
    nothing = brands.brand_analysis(brand_log(spark).drop("brand"))
    assert nothing.count() == 0
    assert nothing.columns == brands.brand_analysis(brand_log(spark)).columns
