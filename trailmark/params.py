"""Tunable parameters and fixed vocabulary of the event log."""

from __future__ import annotations

from dataclasses import dataclass

# Column names of the event log.
EVENT_TIME = "event_time"
EVENT_TYPE = "event_type"
PRODUCT_ID = "product_id"
USER_ID = "user_id"
PRICE = "price"
BRAND = "brand"
CATEGORY = "category_code"
USER_SESSION = "user_session"
SESSION_ID = "session_id"
SESSION_DURATION = "session_duration_sec"

# Partition column of logs stored by day.
EVENT_DAY = "event_day"

REQUIRED_COLUMNS = [EVENT_TIME, EVENT_TYPE, PRODUCT_ID, USER_ID, PRICE]
OPTIONAL_COLUMNS = ["category_id", CATEGORY, BRAND, USER_SESSION]
DEDUP_KEY = [USER_ID, EVENT_TYPE, PRODUCT_ID, EVENT_TIME]

# Event types, funnel stages with their labels and ranks.
EVENT_TYPES = ["view", "cart", "remove_from_cart", "purchase"]
FUNNEL_STAGES = ["view", "cart", "purchase"]
STAGE_LABELS = {"view": "Product View", "cart": "Add to Cart", "purchase": "Purchase"}
STAGE_RANK = {"view": 1, "cart": 2, "remove_from_cart": 2, "purchase": 3}

# Behaviour segments.
PURCHASER = "Purchaser"
CART_ABANDONER = "Cart Abandoner"
BROWSER = "Browser"

# Weekday column names, Monday first.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


@dataclass(frozen=True)
class Params:
    """Settings of one analysis run; the defaults suit a web-shop click log."""

    session_gap_minutes: int = 30
    bot_threshold: int = 1000
    cohort_periods: int = 12
    clusters: int = 4
    top_brands: int = 15
    min_brand_events: int = 100
    sample_rows: int = 50_000
    seed: int = 42

    def __post_init__(self) -> None:
        for name in ("session_gap_minutes", "bot_threshold", "sample_rows", "top_brands"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.cohort_periods < 0:
            raise ValueError("cohort_periods must not be negative")
        if self.clusters < 2:
            raise ValueError("clusters must be at least 2")


DEFAULTS = Params()
