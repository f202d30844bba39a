"""Small event logs by hand."""

from datetime import datetime

SCHEMA = (
    "event_time timestamp, event_type string, product_id bigint, user_id bigint, "
    "price double, brand string, user_session string"
)


def at(text):
    return datetime.fromisoformat(text) if text else None


def log(spark, rows):
    """Rows of (time, type, user[, product[, price[, brand[, session]]]])."""
    full = []
    for row in rows:
        time, kind, user, product, price, brand, session = [*row, *[None] * (7 - len(row))]
        full.append((at(time), kind, product, user, price, brand, session))
    return spark.createDataFrame(full, SCHEMA)


def rows(frame, *columns):
    return sorted(
        (tuple(row) for row in frame.select(*(columns or frame.columns)).collect()), key=repr
    )
