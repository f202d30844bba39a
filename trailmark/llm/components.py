"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailmark.storage import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, class`` for every node of ``links`` (a, b); the class is its smallest node.

    A large star hangs every larger neighbour of a node on the smallest one around, a small
    star does so with the smaller ones; when nothing moves any more, all nodes hang on the
    smallest of their component. Only minima are aggregated, so a node with very many links
    is one row on its side of a join, and the links on the other side can be split.
    """
    smaller = F.least("a", "b").alias("low")
    links = links.where("a != b").select(F.greatest("a", "b").alias("high"), smaller).distinct()
    links = materialize(links, "links", small=True)
    while True:
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = (
            both.groupBy(F.col("high").alias("centre"))
            .agg(F.min("low").alias("least"))
            .select("centre", F.least("least", "centre").alias("least"))
        )
        large = (
            both.join(least, F.col("high") == F.col("centre"))
            .where(F.col("low") > F.col("high"))
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .where("high != low")
            .distinct()
        )
        large = materialize(large, "large-star", small=True)
        least = large.groupBy(F.col("high").alias("centre")).agg(F.min("low").alias("least"))
        moved = large.join(least, F.col("high") == F.col("centre"))
        small = moved.select("high", F.col("least").alias("low")).unionByName(
            moved.where("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        )
        small = materialize(small.where("high != low").distinct(), "small-star", small=True)
        # stable when every node has one link and what it hangs on hangs on nothing
        tops = small.select(F.col("low").alias("top")).distinct()
        chained = small.join(tops, F.col("high") == F.col("top"), "left_semi")
        several = small.groupBy("high").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        links = small
        if chained.isEmpty() and several.isEmpty():
            break
    return links.select(F.col("high").alias("node"), F.col("low").alias("class")).unionByName(
        links.select(F.col("low").alias("node"), F.col("low").alias("class")).distinct()
    )
