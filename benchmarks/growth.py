"""How run times grow with the log, and what one hot user does to them.

    python benchmarks/growth.py SCRATCH_FOLDER 1000000 10000000

For each size a synthetic log is written to the folder, once as generated and
once with a third of all events given to a single user, brand and session.
Every operator then runs in full over both. ``remove_bots`` runs with a
threshold that only the hot user exceeds (a short list), and with one that
about every other user does (a long list).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from trailmark.operators import (  # noqa: E402
    brands,
    clean,
    cluster,
    cohort,
    funnel,
    kpis,
    segments,
    sessions,
    stats,
    temporal,
)
from trailmark.sources import generate_events  # noqa: E402
from trailmark.storage import local_session  # noqa: E402

OPERATORS = {
    "remove_bots_short_list": lambda log: clean.remove_bots(log, 1000),
    "remove_bots_long_list": lambda log: clean.remove_bots(log, 5),
    "cleaning_report": clean.cleaning_report,
    "deduplicate_events": clean.deduplicate_events,
    "sessions_gap": lambda log: sessions.assign_sessions(log, use_existing=False),
    "sessions_existing": sessions.assign_sessions,
    "sessions_running_ids": lambda log: sessions.assign_sessions(log, use_existing=False, running_ids=True),
    "session_length_p99": lambda log: sessions.length_p99(
        sessions.length_distribution(sessions.session_summary(log, use_existing=False))
    ),
    "session_rollup": lambda log: sessions.session_rollup(log, use_existing=False),
    "segment_users": lambda log: segments.segment_users_by_session(log, use_existing=False),
    "funnel": funnel.funnel,
    "kpis": kpis.compute_kpis,
    "cohort_retention": lambda log: cohort.cohort_retention(cohort.cohort_assign(log)),
    "time_heatmap": lambda log: temporal.purchase_heatmap(temporal.slot_counts(log)),
    "brand_analysis": brands.brand_analysis,
    "chi_square": lambda log: stats.chi_square(stats.contingencies(log, "brand", "category_code")),
    "kmeans": lambda log: cluster.cluster_users(segments.segment_users_by_session(log, use_existing=False)),
}


def hot(log):
    """A third of the events, chosen by hash, belongs to one user, brand and session."""
    chosen = F.pmod(F.xxhash64("user_session", "event_time"), F.lit(3)) == 0
    return log.withColumns(
        {
            "user_id": F.when(chosen, F.lit(0)).otherwise(F.col("user_id")),
            "brand": F.when(chosen, F.lit("hot")).otherwise(F.col("brand")),
            "user_session": F.when(chosen, F.lit("hot")).otherwise(F.col("user_session")),
        }
    )


def main(scratch: str, sizes: list[int]) -> None:
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "growth", **{"spark.sql.shuffle.partitions": "64"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(f"{scratch}/intermediate")
    results = {}
    for size in sizes:
        generate_events(spark, size).write.parquet(f"{scratch}/even-{size}")
        hot(spark.read.parquet(f"{scratch}/even-{size}")).write.parquet(f"{scratch}/hot-{size}")
        for shape in ("even", "hot"):
            log = spark.read.parquet(f"{scratch}/{shape}-{size}")
            times = results.setdefault(shape, {}).setdefault(str(size), {})
            for name, operator in OPERATORS.items():
                start = time.perf_counter()
                operator(log).write.format("noop").mode("overwrite").save()
                times[name] = round(time.perf_counter() - start, 2)
            print(shape, size, times, file=sys.stderr, flush=True)
    print(json.dumps(results))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], [int(arg) for arg in sys.argv[2:]] or [1_000_000])
