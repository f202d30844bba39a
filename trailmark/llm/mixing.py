"""Mixing sources to target weights by Poisson replication.

A source of ``size`` characters and target weight ``w`` is repeated at the mean rate
``budget * w / (sum of weights) / size``. Each document inverts its source's Poisson
distribution at a uniform number that is a hash of the seed and its id, so a count never
depends on partitions or retries. The document is exploded by its count; copies are
dealt to partitions and ordered by a second hash, which is a random order of the whole.

Rates and distribution functions are a small table by source. The planner broadcasts it
if it is small and else shuffles by source, splitting a hot one. A distribution has about
as many steps as its rate, so it stays as small as the largest repetition asked for.

Defined cases: a null source is a source of its own; a source without any text has rate
0, as has one that ``weights`` leaves out; equal ids get equal counts; a null id hashes
as the text ``null``; other columns are carried along unless a result has the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.llm.words import without_columns
from trailmark.storage import materialize

RESULTS = ["copy", "n_copies", "shuffle_key"]
#: Without given weights, a source weighs its size to this power.
SIZE_POWER = 0.5


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def replication_rates(
    docs: DataFrame, weights: dict[str | None, float] | None = None, repeat: float = 1.0
) -> DataFrame:
    """``source, size, rate``; ``repeat`` is the size of the mixture over that of the input."""
    sizes = docs.groupBy("source").agg(
        F.coalesce(F.sum(F.char_length("text").cast("bigint")), F.lit(0)).alias("size")
    )
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(SIZE_POWER))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            same = F.col("source").eqNullSafe(F.lit(name))
            weight = F.when(same, F.lit(float(value))).otherwise(weight)
    weight = F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0))
    sized = materialize(sizes.withColumn("weight", weight), "source-sizes")
    total = sized.agg(
        F.sum("size").cast("double").alias("size"),
        # added up in one order, whatever the partitions
        F.aggregate(
            F.sort_array(F.collect_list("weight")), F.lit(0.0), lambda a, b: a + b
        ).alias("weight"),
    ).first()
    budget, all_weights = repeat * (total["size"] or 0.0), total["weight"] or 1.0
    rate = F.lit(budget) * F.col("weight") / F.lit(all_weights) / F.col("size")
    return sized.select(
        "source", "size", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)).alias("rate")
    )


def distributions(rates: DataFrame) -> DataFrame:
    """``of_source, steps``: P(count <= k) for k = 0, 1, ... up to all but 1e-16 of the mass."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    order = Window.partitionBy("source").orderBy("k")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # in logarithms, as exp(-rate) alone may be too small for a double
    log_mass = (
        -F.col("rate") + F.col("k") * F.log("rate") - F.sum(F.log(F.greatest("k", F.lit(1)))).over(so_far)
    )
    steps = (
        rates.where("rate > 0")
        .select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
        .withColumn("mass", F.exp(log_mass))
        .withColumn("step", F.sum("mass").over(so_far))
    )
    return steps.groupBy(F.col("source").alias("of_source")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "step"))), lambda s: s.step).alias("steps")
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    repeat: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """One row per copy, in random order, with ``copy`` (1, 2, ...), ``n_copies, shuffle_key``."""
    table = materialize(distributions(replication_rates(docs, weights, repeat)), "poisson-steps")
    names = without_columns(docs.columns, RESULTS)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # the columns of a document are in one struct, so that none of them meets a name used here
    rows = docs.select(
        F.struct(*names).alias("row"),
        F.col("source").alias("source"),
        key.alias("key"),
        uniform(F.lit(f"count {seed}"), key).alias("drawn"),
    )
    counted = rows.join(table, F.col("source").eqNullSafe(F.col("of_source")))
    count = F.size(F.filter("steps", lambda step: step < F.col("drawn")))
    copies = (
        counted.select("row", "key", count.alias("n_copies"))
        .where("n_copies > 0")
        .select("row", "key", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"), "n_copies")
        .withColumn(
            "shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.col("key"), F.col("copy")))
        )
    )
    dealt = copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col("row")[name].alias(name) for name in names], *RESULTS)
