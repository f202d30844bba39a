import math

from helpers import log, rows

from trailmark.operators import funnel, kpis


def test_later_stages_count_for_earlier_ones(spark):
    events = log(
        spark,
        [
            ("2024-01-01 00:00:00", "purchase", 1),
            ("2024-01-01 00:00:00", "remove_from_cart", 2),
            ("2024-01-01 00:00:00", "view", 3),
            ("2024-01-01 00:00:00", "error", 4),
            ("2024-01-01 00:00:00", "purchase", None),
        ],
    )
    table = [tuple(row) for row in funnel.funnel(events).collect()]
    assert table == [
        ("view", "Product View", 3, 100.0, 0.0),
        ("cart", "Add to Cart", 2, 66.67, 33.33),
        ("purchase", "Purchase", 1, 33.33, 50.0),
    ]
    stages = funnel.funnel(events)
    assert rows(funnel.biggest_drop(stages)) == [("Purchase", 50.0)]
    assert rows(funnel.step_rates(stages)) == [(66.67, 50.0, 33.33)]
    assert funnel.display_table(stages).columns == ["Stage", "Users", "% of Total", "Drop-off %"]


def test_funnel_of_nothing(spark):
    table = [tuple(row)[2:] for row in funnel.funnel(log(spark, [])).collect()]
    assert table == [(0, 0.0, 0.0)] * 3


def test_kpis(spark):
    events = log(
        spark,
        [
            ("2024-01-01 00:00:00", "view", 1, 1, 9.0),
            ("2024-01-01 00:00:00", "cart", 1, 1, 9.0),
            ("2024-01-01 00:00:00", "purchase", 1, 1, 10.005),
            ("2024-01-01 00:00:00", "purchase", 2, 2, 10.0),
            ("2024-01-01 00:00:00", "cart", 3, 2, 10.0),
            ("2024-01-01 00:00:00", "purchase", None, None, 1.0),
            ("2024-01-01 00:00:00", "purchase", 2, 3, math.nan),
            ("2024-01-01 00:00:00", "odd", 4, 3, None),
        ],
    )
    row = kpis.compute_kpis(events).first().asDict()
    assert row == {
        "total_events": 8,
        "unique_users": 4,
        "unique_products": 3,
        "total_revenue": 21.0,
        "avg_order_value": 7.0,
        "overall_conversion_rate": 200.0,
        "cart_abandonment_rate": 50.0,
    }
    assert [tuple(r) for r in kpis.quick_stats(kpis.compute_kpis(events)).collect()] == [
        ("Avg Order Value", "$7.00"),
        ("Overall Conversion Rate", "200.0%"),
        ("Cart Abandonment Rate", "50.0%"),
        ("Total Revenue", "$21.00"),
    ]


def test_kpis_without_viewers_carts_or_purchases(spark):
    for events in (log(spark, []), log(spark, [("2024-01-01 00:00:00", "odd", 1, 1, 2.0)])):
        row = kpis.compute_kpis(events).first()
        assert tuple(row)[3:] == (0.0, 0.0, 0.0, 0.0)


def test_sums_do_not_depend_on_order_and_take_infinite_prices(spark):
    prices = [0.1 * i for i in range(1, 2000)] + [1e12 + 0.01, -3.3]
    events = log(spark, [("2024-01-01 00:00:00", "purchase", 1, 1, p) for p in prices])
    totals = {
        kpis.compute_kpis(events.repartition(n)).first()["total_revenue"] for n in (1, 3, 16)
    }
    assert totals == {round(math.fsum(prices), 2)}
    endless = log(spark, [("2024-01-01 00:00:00", "purchase", 1, 1, p) for p in (1.0, math.inf)])
    assert kpis.compute_kpis(endless).first()["total_revenue"] == math.inf
