"""Headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.functions import percent, round_to
from trailmark.functions.numeric import sum_total
from trailmark.operators.rollups import user_counts
from trailmark.params import PRODUCT_ID, USER_ID


def distinct_products(events: DataFrame) -> DataFrame:
    """One row: number of products in the log."""
    return (
        events.where(F.col(PRODUCT_ID).isNotNull())
        .select(PRODUCT_ID)
        .distinct()
        .agg(F.count("*").alias("unique_products"))
    )


def compute_kpis(events: DataFrame) -> DataFrame:
    """One row of figures. Users are counted over the user rollup, not by count-distinct."""
    return kpis_of_users(user_counts(events), distinct_products(events))


def kpis_of_users(users: DataFrame, products: DataFrame) -> DataFrame:
    """The figures from event counts per user (a null user included) and a product count."""
    known = F.col(USER_ID).isNotNull()

    def having(condition: Column) -> Column:
        return F.count_if(known & condition)

    viewers = having(F.col("views") > 0)
    buyers = having(F.col("purchases") > 0)
    carters = having(F.col("carts") > 0)
    leavers = having((F.col("carts") > 0) & (F.col("purchases") == 0))
    revenue = sum_total(
        *[F.sum(f"revenue_{part}") for part in ("high_units", "units", "millionths", "rest")]
    )
    paid = F.sum("revenue_count")
    return users.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
        F.count(USER_ID).alias("unique_users"),
        products.scalar().alias("unique_products"),
        F.coalesce(round_to(revenue, 2), F.lit(0.0)).alias("total_revenue"),
        # No purchase at all gives 0, purchases without any price give null.
        F.when(paid > 0, round_to(revenue / paid, 2))
        .when(F.coalesce(F.sum("purchases"), F.lit(0)) == 0, 0.0)
        .alias("avg_order_value"),
        percent(buyers, viewers).alias("overall_conversion_rate"),
        percent(leavers, carters).alias("cart_abandonment_rate"),
    )


def _with_percent(name: str) -> Column:
    return F.concat(F.col(name).cast("string"), F.lit("%"))


def _dollars(name: str) -> Column:
    return F.concat(F.lit("$"), F.format_number(name, 2))


def _as_rows(kpis: DataFrame, texts: dict[str, Column]) -> DataFrame:
    pairs = [
        F.struct(F.lit(name).alias("Metric"), text.alias("Value")) for name, text in texts.items()
    ]
    return kpis.select(F.inline(F.array(*pairs)))


def quick_stats(kpis: DataFrame) -> DataFrame:
    """Four figures as text, one per row."""
    return _as_rows(
        kpis,
        {
            "Avg Order Value": F.format_string("$%.2f", "avg_order_value"),
            "Overall Conversion Rate": _with_percent("overall_conversion_rate"),
            "Cart Abandonment Rate": _with_percent("cart_abandonment_rate"),
            "Total Revenue": _dollars("total_revenue"),
        },
    )


def kpi_cards(kpis: DataFrame) -> DataFrame:
    """The six headline figures as text, one per row."""
    return _as_rows(
        kpis,
        {
            "Total Events": F.format_number("total_events", 0),
            "Unique Users": F.format_number("unique_users", 0),
            "Unique Products": F.format_number("unique_products", 0),
            "Total Revenue": _dollars("total_revenue"),
            "Conversion Rate": _with_percent("overall_conversion_rate"),
            "Cart Abandon Rate": _with_percent("cart_abandonment_rate"),
        },
    )
