"""Synthetic click log of a cosmetics shop.

Every random choice is a hash of (seed, user, session, step), so the same seed
gives the same events however Spark spreads the users over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.params import DEFAULTS

# Catalogue.
BRANDS = [
    "Maybelline", "L'Oreal", "Garnier", "Nivea", "Dove",
    "Clinique", "MAC", "NYX", "Revlon", "Estee Lauder",
    "Bobbi Brown", "Urban Decay", "Too Faced", "Neutrogena", "Olay",
]
CATEGORIES = [
    "cosmetics.face.foundation", "cosmetics.lip.lipstick",
    "cosmetics.eye.mascara", "cosmetics.eye.eyeshadow",
    "skincare.face.cream", "skincare.body.lotion",
    "haircare.shampoo", "haircare.conditioner",
    "fragrance.women", "fragrance.men",
]
PRODUCTS = 500
FIRST_PRODUCT = 1_000_000
PRICE_LOG_MEAN, PRICE_LOG_SIGMA = 2.5, 0.8

# Behaviour. Seconds are given as (least, one past the most).
FIRST_DAY, DAYS = "2024-01-01 00:00:00", 120
SESSION_STOP, MOST_SESSIONS = 0.15, 20
VIEW_STOP, MOST_VIEWS = 0.2, 15
DWELL, CART_DELAY, PURCHASE_DELAY, REMOVE_DELAY = (10, 300), (5, 60), (30, 300), (30, 180)
CART_SHARE, PURCHASE_SHARE, REMOVE_SHARE = 0.25, 0.4, 0.5

MEAN_SESSIONS = (1 - (1 - SESSION_STOP) ** MOST_SESSIONS) / SESSION_STOP
MEAN_VIEWS = (1 - (1 - VIEW_STOP) ** MOST_VIEWS) / VIEW_STOP
MEAN_CART_EVENTS = CART_SHARE * (1 + PURCHASE_SHARE + (1 - PURCHASE_SHARE) * REMOVE_SHARE)
EVENTS_PER_USER = MEAN_SESSIONS * (MEAN_VIEWS + MEAN_CART_EVENTS)


def _uniform(seed: int, what: str, *keys: Column) -> Column:
    """A number in (0, 1) that depends only on the seed, the purpose and the keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), *keys), 12)
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def _geometric(u: Column, stop: float, most: int) -> Column:
    draws = F.ceil(F.log(u) / F.lit(math.log(1 - stop)))
    return F.least(F.greatest(draws, F.lit(1)), F.lit(most)).cast("int")


def _seconds(u: Column, bounds: tuple[int, int]) -> Column:
    least, end = bounds
    return (F.lit(least) + F.floor(u * (end - least))).cast("bigint")


def _pick(u: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(u * len(names)) + 1).cast("int"))


def simulate_users(users: DataFrame, seed: int = DEFAULTS.seed) -> DataFrame:
    """All events of the given users (one column, ``user_id``), in no order."""
    user, session = F.col("user_id"), F.col("session")
    sessions = users.select(
        "user_id",
        F.explode(
            F.sequence(
                F.lit(0),
                _geometric(_uniform(seed, "sessions", user), SESSION_STOP, MOST_SESSIONS) - 1,
            )
        ).alias("session"),
    )

    def chance(what: str) -> Column:
        return _uniform(seed, what, user, session)

    # A session is at most MOST_VIEWS + 2 events, built as one array per row.
    def step(what: str, i: Column) -> Column:
        return _uniform(seed, what, user, session, i)

    def product_at(i: Column) -> Column:
        return F.floor(step("product", i) * PRODUCTS).cast("bigint")

    def event(kind: Column, product: Column, after: Column) -> Column:
        return F.struct(
            kind.alias("event_type"), product.alias("product"), after.alias("after")
        )

    views = _geometric(chance("views"), VIEW_STOP, MOST_VIEWS)
    planned = sessions.select(
        "user_id",
        "session",
        _seconds(chance("start"), (0, DAYS * 86_400)).alias("start"),
        F.sequence(F.lit(1), views).alias("steps"),
        F.transform(
            F.sequence(F.lit(1), views), lambda i: _seconds(step("dwell", i), DWELL)
        ).alias("dwells"),
        (chance("cart") < CART_SHARE).alias("carts"),
        (chance("purchase") < PURCHASE_SHARE).alias("buys"),
        (chance("remove") < REMOVE_SHARE).alias("removes"),
        product_at((F.floor(chance("cart product") * views) + 1).cast("int")).alias("carted"),
        _seconds(chance("cart delay"), CART_DELAY).alias("cart_delay"),
        F.when(
            chance("purchase") < PURCHASE_SHARE, _seconds(chance("last delay"), PURCHASE_DELAY)
        )
        .otherwise(_seconds(chance("last delay"), REMOVE_DELAY))
        .alias("last_delay"),
    )

    def dwell_before(i: Column) -> Column:
        return F.aggregate(
            F.slice("dwells", F.lit(1), i - 1),
            F.lit(0).cast("bigint"),
            lambda total, seconds: total + seconds,
        )

    cart_at = dwell_before(F.size("dwells") + 1) + F.col("cart_delay")
    empty = F.array().cast("array<struct<event_type:string,product:bigint,after:bigint>>")
    cart = F.when(
        F.col("carts"), F.array(event(F.lit("cart"), F.col("carted"), cart_at))
    ).otherwise(empty)
    last = F.when(
        F.col("carts") & (F.col("buys") | F.col("removes")),
        F.array(
            event(
                F.when(F.col("buys"), "purchase").otherwise("remove_from_cart"),
                F.col("carted"),
                cart_at + F.col("last_delay"),
            )
        ),
    ).otherwise(empty)
    seen = F.transform("steps", lambda i: event(F.lit("view"), product_at(i), dwell_before(i)))
    happened = planned.select(
        "user_id", "session", "start", F.explode(F.concat(seen, cart, last)).alias("e")
    )

    product = F.col("e.product")
    normal = F.sqrt(-2 * F.log(_uniform(seed, "price", product))) * F.cos(
        F.lit(2 * math.pi) * _uniform(seed, "price angle", product)
    )
    price = F.rint(F.exp(F.lit(PRICE_LOG_MEAN) + normal * PRICE_LOG_SIGMA) * 100) / 100
    epoch = F.unix_seconds(F.lit(FIRST_DAY).cast("timestamp"))
    return happened.select(
        F.timestamp_seconds(epoch + F.col("start") + F.col("e.after")).alias("event_time"),
        F.col("e.event_type").alias("event_type"),
        (product + FIRST_PRODUCT).alias("product_id"),
        "user_id",
        price.alias("price"),
        _pick(_uniform(seed, "brand", product), BRANDS).alias("brand"),
        _pick(_uniform(seed, "category", product), CATEGORIES).alias("category_code"),
        F.concat_ws("_", "user_id", "session").alias("user_session"),
    )


def generate_events(
    spark: SparkSession, n_rows: int = DEFAULTS.sample_rows, seed: int = DEFAULTS.seed
) -> DataFrame:
    """About ``n_rows`` events of users 1, 2, 3, ..., all whole; for tests and benchmarks."""
    n_users = max(1, round(n_rows / EVENTS_PER_USER))
    users = spark.range(1, n_users + 1).withColumnRenamed("id", "user_id")
    return simulate_users(users, seed)
