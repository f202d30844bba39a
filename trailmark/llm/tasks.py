"""Python code in tasks: the general helpers, under the name the operators import."""

from trailmark.tasks import map_batches, ship_code

__all__ = ["map_batches", "ship_code"]
