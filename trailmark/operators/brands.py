"""Brand performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.functions import percent, round_to
from trailmark.operators.rollups import event_counts, mean_price, merged_counts
from trailmark.params import BRAND, DEFAULTS, PRODUCT_ID

# Columns of the table.
TABLE = [
    BRAND, "views", "carts", "purchases",
    "view_to_cart_rate", "cart_to_purchase_rate", "overall_conversion_rate", "avg_price",
]


def brand_analysis(
    events: DataFrame,
    top_n: int = DEFAULTS.top_brands,
    min_events: int = DEFAULTS.min_brand_events,
) -> DataFrame:
    """The brands with most events, with their counts, prices and conversion rates.

    Counted per (brand, product) first: products are then counted as rows, and
    a brand with a third of the log is spread over its products.
    """
    if BRAND not in events.columns:
        return _no_brands(events.sparkSession)
    products = (
        events.where(F.col(BRAND).isNotNull()).groupBy(BRAND, PRODUCT_ID).agg(*event_counts())
    )
    views, carts, purchases = F.col("views"), F.col("carts"), F.col("purchases")
    return (
        products.groupBy(BRAND)
        .agg(*merged_counts(), F.count(PRODUCT_ID).alias("unique_products"))
        .where(F.col("typed") >= min_events)
        .select(
            BRAND,
            F.col("typed").alias("total_events"),
            "views",
            "carts",
            "purchases",
            round_to(mean_price(), 2).alias("avg_price"),
            "unique_products",
            percent(carts, views).alias("view_to_cart_rate"),
            percent(purchases, carts).alias("cart_to_purchase_rate"),
            percent(purchases, views).alias("overall_conversion_rate"),
        )
        .orderBy(F.desc("total_events"), BRAND)
        .limit(top_n)
    )


def _no_brands(spark: SparkSession) -> DataFrame:
    types = {
        BRAND: "string",
        "total_events": "bigint",
        "views": "bigint",
        "carts": "bigint",
        "purchases": "bigint",
        "avg_price": "double",
        "unique_products": "bigint",
        "view_to_cart_rate": "double",
        "cart_to_purchase_rate": "double",
        "overall_conversion_rate": "double",
    }
    return spark.range(0).select(*[F.lit(None).cast(t).alias(name) for name, t in types.items()])


def _by_conversion() -> list[Column]:
    return [F.desc("overall_conversion_rate"), F.col(BRAND)]


def brand_conversion_table(brands: DataFrame) -> DataFrame:
    """Brand rates, best overall conversion first; only the columns that exist."""
    shown = [name for name in TABLE if name in brands.columns]
    return brands.select(*shown).orderBy(*_by_conversion())


def top_converting_brand(brands: DataFrame) -> DataFrame:
    """The brand with the best overall conversion."""
    return (
        brands.orderBy(*_by_conversion())
        .limit(1)
        .select(BRAND, "overall_conversion_rate", "purchases", "views")
    )


def brand_comparison(brands: DataFrame) -> DataFrame:
    """Views, carts and purchases per brand in the bar chart's order, fewest events first."""
    return brands.orderBy("total_events", F.desc(BRAND)).select(
        BRAND, "views", "carts", "purchases"
    )
