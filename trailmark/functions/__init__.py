"""Column helpers shared by the operators."""

from trailmark.functions.numeric import exact_mean, percent, round_to
from trailmark.functions.quantile import quantile_neighbours
from trailmark.functions.text import normalize_type, strip, to_price
from trailmark.functions.times import (
    check_clock,
    epoch_micros,
    from_micros,
    month_index,
    month_label,
)

__all__ = [
    "check_clock",
    "epoch_micros",
    "exact_mean",
    "from_micros",
    "month_index",
    "month_label",
    "normalize_type",
    "percent",
    "quantile_neighbours",
    "round_to",
    "strip",
    "to_price",
]
