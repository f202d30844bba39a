"""Behaviour clusters of users by k-means on standardised features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from trailmark.functions import round_to
from trailmark.params import DEFAULTS, USER_ID
from trailmark.storage import materialize

# The features, in this order.
FEATURES = [
    "total_events", "total_views", "total_carts",
    "total_purchases", "avg_price", "session_count",
]

# A fit has converged when no centre moves further than this.
CENTRE_SHIFT = 0.01
MAX_PASSES = 300
#: Users from whom the starts of a fit are drawn.
SEED_ROWS = 5000


def _available(segments: DataFrame) -> list[str]:
    return [name for name in FEATURES if name in segments.columns]


def _scaled(name: str) -> str:
    return f"{name}_scaled"


def scaled_features(segments: DataFrame) -> DataFrame:
    """Add ``<feature>_scaled``: zero mean, unit population variance, 0 where constant.

    ``pc1`` and ``pc2`` are the first two of them, for a scatter plot.
    """
    names = _available(segments)

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    moments = segments.agg(
        F.struct(
            *[F.avg(filled(name)).alias(f"{name}_mean") for name in names],
            *[F.stddev_pop(filled(name)).alias(f"{name}_sd") for name in names],
        ).alias("m")
    ).scalar()

    def scale(name: str) -> Column:
        mean, sd = F.col(f"_m.{name}_mean"), F.col(f"_m.{name}_sd")
        return F.when(sd > 0, (filled(name) - mean) / sd).otherwise(F.lit(0.0))

    return segments.withColumn("_m", moments).select(
        *segments.columns,
        *[scale(name).alias(_scaled(name)) for name in names],
        scale(names[0]).alias("pc1"),
        scale(names[1]).alias("pc2"),
    )


def cluster_users(
    segments: DataFrame,
    n_clusters: int = DEFAULTS.clusters,
    seed: int = DEFAULTS.seed,
    starts: int = 10,
) -> DataFrame:
    """Add ``cluster``, ``pc1`` and ``pc2`` to the user table.

    The best of ``starts`` k-means fits is kept. Clusters are numbered by their centres, so the
    numbers mean the same from run to run, and labels do not depend on how the log was
    partitioned. The features are written down once: every pass reads that table and not the
    event log behind it.
    """
    if len(_available(segments)) < 2:
        return segments.withColumns(
            {"cluster": F.lit(0), "pc1": F.lit(0.0), "pc2": F.lit(0.0)}
        )
    scaled = materialize(scaled_features(segments), "features")
    point = F.array(*[_scaled(name) for name in _available(segments)])
    points = scaled.select(F.xxhash64(F.lit(seed), USER_ID).alias("draw"), point.alias("point"))
    centres = fit_centres(points, n_clusters, seed, starts)
    nearest = _nearest(point, _literal(sorted(centres.tolist())))["cluster"]
    return scaled.select(*segments.columns, nearest.alias("cluster"), "pc1", "pc2")


def _literal(values: list) -> Column:
    """Nested lists as one constant: equal plans, whatever the numbers, are compiled once."""
    return F.array(*[_literal(v) for v in values]) if isinstance(values, list) else F.lit(float(values))


def _nearest(point: Column, centres: Column) -> Column:
    """Struct ``distance`` (squared) and ``cluster`` of the nearest centre; the first one of equals."""

    def away(centre: Column, number: Column) -> Column:
        squares = F.zip_with(point, centre, lambda a, b: (a - b) * (a - b))
        total = F.aggregate(squares, F.lit(0.0), lambda so_far, square: so_far + square)
        return F.struct(total.alias("distance"), number.alias("cluster"))

    return F.array_min(F.transform(centres, away))


def fit_centres(points: DataFrame, k: int, seed: int, starts: int) -> np.ndarray:
    """Centres of the best fit to ``points`` (draw, point).

    Each start is drawn (k-means++) from the ``SEED_ROWS`` points with the smallest draw, a bound
    on what comes to the driver, and settled on those first. Then Lloyd's algorithm goes over all
    points: one pass, and one aggregation of starts x k rows, moves the centres of all starts.
    """
    drawn = points.orderBy("draw", "point").limit(SEED_ROWS).select("point").collect()
    if len(drawn) < k:
        raise ValueError(f"{k} clusters need at least {k} users")
    sample = np.array([row.point for row in drawn])
    centres: list[np.ndarray] = []
    for i in range(starts):
        found = _settled(sample, _spread(sample, k, np.random.default_rng([seed, i])))
        found = found[np.lexsort(found.T[::-1])]
        # starts that have met go on as one
        if all(_shift(found, other) > CENTRE_SHIFT for other in centres):
            centres.append(found)
    costs = [np.inf] * len(centres)
    moving = list(range(len(centres)))
    cached = points.select("point").persist()
    try:
        for _ in range(MAX_PASSES):
            before = [centres[s].copy() for s in moving]
            for row in _sums(cached, before):
                centres[moving[row.start]][row.cluster] = np.array(row.total) / row.n
                costs[moving[row.start]] = row.cost
            moving = [s for s, old in zip(moving, before) if _shift(old, centres[s]) > CENTRE_SHIFT]
            if not moving:
                break
    finally:
        cached.unpersist()
    return centres[int(np.argmin(costs))]


def _sums(points: DataFrame, centres: list[np.ndarray]) -> list[Row]:
    """``start, cluster, n, total`` (of the points, by dimension) and ``cost`` of the whole start."""
    dimensions = centres[0].shape[1]
    choices = F.transform(
        _literal([c.tolist() for c in centres]), lambda start: _nearest(F.col("point"), start)
    )
    placed = points.select("point", F.posexplode(choices).alias("start", "nearest"))
    sums = placed.groupBy("start", F.col("nearest.cluster").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.get("point", d)) for d in range(dimensions)]).alias("total"),
        F.sum("nearest.distance").alias("share"),
    )
    whole = Window.partitionBy("start")
    return sums.withColumn("cost", F.sum("share").over(whole)).collect()


def _shift(old: np.ndarray, new: np.ndarray) -> float:
    return float(np.sqrt(((old - new) ** 2).sum(axis=1)).max())


def _spread(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Points drawn one after the other with probabilities that grow with the distance to those drawn."""
    centres = [sample[rng.integers(len(sample))]]
    away = np.full(len(sample), np.inf)
    while len(centres) < k:
        away = np.minimum(away, ((sample - centres[-1]) ** 2).sum(axis=1))
        total = away.sum()
        at = rng.choice(len(sample), p=away / total) if total > 0 else rng.integers(len(sample))
        centres.append(sample[at])
    return np.array(centres)


def _settled(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lloyd's algorithm on the few points that seed a fit; a centre without points stays."""
    for _ in range(MAX_PASSES):
        label = ((sample[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array(
            [sample[label == j].mean(axis=0) if (label == j).any() else c for j, c in enumerate(centres)]
        )
        if _shift(centres, moved) <= CENTRE_SHIFT:
            return moved
        centres = moved
    return centres


def cluster_properties(segments: DataFrame, clustered: DataFrame) -> DataFrame:
    """One row about a clustering of ``segments``: users, clusters, and what contradicts it.

    ``misplaced`` counts users to whom another cluster's mean is nearer than that
    of their own by more than the shift at which a fit counts as converged;
    ``unmatched`` counts users that the summary's clusters leave out or add.
    """
    names = [_scaled(name) for name in _available(segments)]
    # one fit: both the means and the distances read its result
    labelled = materialize(clustered.select(USER_ID, "cluster", "segment", "total_events", "total_purchases"), "labels")
    points = scaled_features(segments).select(F.col(USER_ID).alias("of"), *names)
    points = materialize(
        points.join(labelled, F.col("of").eqNullSafe(F.col(USER_ID))).select("cluster", F.array(*names).alias("point")),
        "points",
    )
    means = points.groupBy("cluster").agg(
        F.array(*[F.avg(F.get("point", i)) for i in range(len(names))]).alias("mean")
    )
    # as many rows as there are clusters
    means = means.groupBy().agg(F.sort_array(F.collect_list(F.struct("cluster", "mean"))).alias("means")).scalar()

    def distance(mean: Column) -> Column:
        squares = F.zip_with("point", mean, lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, square: total + square))

    away = F.transform("means", lambda m: F.struct(m.cluster.alias("cluster"), distance(m["mean"]).alias("d")))
    own = F.get(F.filter("away", lambda a: a.cluster == F.col("cluster")), 0)["d"]
    nearest = F.array_min(F.transform("away", lambda a: a.d))
    placed = points.withColumn("means", means).withColumn("away", away)
    counted = placed.agg(
        F.count("*").alias("users"),
        F.count_distinct("cluster").alias("clusters"),
        F.count_if(own > nearest + len(names) * CENTRE_SHIFT).alias("misplaced"),
    )
    listed = cluster_summary(labelled).agg(F.coalesce(F.sum("users"), F.lit(0)).alias("listed")).scalar()
    return counted.select("*", F.abs(F.col("users") - listed).alias("unmatched"))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Users, mean totals and most frequent segment of each cluster.

    Of equally frequent segments the alphabetically first is taken.
    """
    per_segment = clustered.groupBy("cluster", "segment").agg(
        F.count("*").alias("n"),
        F.sum("total_events").alias("events"),
        F.sum("total_purchases").alias("purchases"),
    )
    users = F.sum("n")
    return (
        per_segment.groupBy("cluster")
        .agg(
            users.alias("users"),
            round_to(F.sum("events") / users, 1).alias("avg_events"),
            round_to(F.sum("purchases") / users, 1).alias("avg_purchases"),
            F.min_by("segment", F.struct(-F.col("n"), "segment")).alias("dominant_segment"),
        )
        .orderBy("cluster")
    )


def scatter_points(clustered: DataFrame) -> DataFrame:
    """What the cluster chart shows: one point per user."""
    return clustered.select(USER_ID, "pc1", "pc2", "cluster", "segment")
