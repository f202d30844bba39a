"""Event logs derived from the star-schema tables.

Brand, category and customer columns are joined in only when asked for, so
that an analysis that needs none of them does not pay for the join. ``part``
and ``customer`` grow with the data: the planner chooses the join by their
size, and splits a hot product when it has to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _with_product(
    log: DataFrame, spark: SparkSession, folder: str, columns: list[Column]
) -> DataFrame:
    part = read_table(spark, folder, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("category_code")
    )
    return log.join(part, log.product_id == part.p_partkey, "left").select(*columns)


def clicks(spark: SparkSession, folder: str, products: bool = False) -> DataFrame:
    """``events`` as a click log with times of day and one session per user and day."""
    kind = F.col("event_type")
    log = read_table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.when(kind == "click", "cart")
        .when(kind == "signup", "remove_from_cart")
        .otherwise(kind)
        .alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
        "user_id",
        F.col("value").alias("price"),
        F.concat_ws("_", "user_id", F.to_date("ts").cast("string")).alias("user_session"),
    )
    if not products:
        return log
    front = ["event_id", "event_time", "event_type", "product_id", "user_id", "price"]
    return _with_product(log, spark, folder, [*front, "brand", "category_code", "user_session"])


def orders_log(
    spark: SparkSession, folder: str, products: bool = False, customers: bool = False
) -> DataFrame:
    """Order lines as events of several years, told apart by order status."""
    status = F.col("o_orderstatus")
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").alias("event_time"),
        F.when(status == "F", "purchase")
        .when(status == "P", "cart")
        .otherwise("view")
        .alias("event_type"),
        F.col("o_custkey").alias("user_id"),
    )
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").alias("price"),
    )
    columns = ["event_time", "event_type", "product_id", "user_id", "price"]
    log = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(*columns)
    if products:
        columns += ["brand", "category_code"]
        log = _with_product(log, spark, folder, columns)
    if customers:
        customer = read_table(spark, folder, "customer").select(
            "c_custkey",
            F.col("c_mktsegment").alias("market"),
            F.when(F.col("c_acctbal") >= 0, "credit").otherwise("debit").alias("account_state"),
        )
        columns = [*columns, "market", "account_state"]
        log = log.join(customer, log.user_id == customer.c_custkey).select(*columns)
    return log
