"""Where events come from and where they go."""

from trailmark.sources.csv import read_events_csv, write_events_csv
from trailmark.sources.generator import generate_events, simulate_users
from trailmark.sources.store import read_log, write_log
from trailmark.sources.tables import clicks, orders_log

__all__ = [
    "clicks",
    "generate_events",
    "orders_log",
    "read_events_csv",
    "read_log",
    "simulate_users",
    "write_events_csv",
    "write_log",
]
