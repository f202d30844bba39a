"""Exact distinct counts that can be added up: one bitmap of users and products a day.

Users and products are numbered in the order in which they first appear, those of each month
from a new stretch of 32,768 numbers on. A day is stored as one bitmap for each stretch of which
somebody was active. Days, and months of days, are merged by the union of bitmaps, so users are
counted once however many days are asked for, and as a stretch belongs to one month of first
activity, a cohort is a set of stretches: no user is looked up to count it.

Batches are added in order of time. A new one reads its own events and the table of numbers, and
no event or bitmap of earlier days. Users and products without an id, and events without a time,
are not counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailmark.functions import check_clock, month_index, month_label
from trailmark.operators.sessions import _numbered_in_ranges
from trailmark.params import DEFAULTS, EVENT_TIME, PRODUCT_ID, USER_ID
from trailmark.storage import materialize

KINDS = {"user": USER_ID, "product": PRODUCT_ID}
#: Fixed value: bits of one of Spark's bitmaps.
STRETCH = 32_768

NUMBERS = "kind string, id string, month int, number bigint"
DAYS = "kind string, bucket bigint, month int, bits binary, event_day date, event_month string"


class Activity:
    """A folder with the numbers of users and products, and the bitmaps of all days."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def numbers(self) -> DataFrame:
        return self._read("numbers", NUMBERS)

    @property
    def days(self) -> DataFrame:
        """``kind, bucket, month`` (of first activity of those in the bucket)``, bits, event_day``, in folders by month."""
        return self._read("days", DAYS)

    def add(self, events: DataFrame) -> None:
        """Add a batch; its first day must lie behind all days added before."""
        check_clock(events)
        timed = events.where(F.col(EVENT_TIME).isNotNull())
        ids = [F.struct(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("id")) for kind, name in KINDS.items()]
        seen = (
            timed.select(
                F.to_date(EVENT_TIME).alias("event_day"),
                month_index(F.col(EVENT_TIME)).cast("int").alias("month"),
                F.inline(F.array(*ids)),
            )
            .where("id IS NOT NULL")
            .distinct()
        )
        seen = materialize(seen, "active")
        first = seen.agg(F.min("event_day")).first()[0]
        last = self.days.agg(F.max("event_day")).first()[0]
        if first is None:
            return
        if last is not None and first <= last:
            raise ValueError(f"days up to {last} are stored, a batch from {first} on comes too late")
        known = self.numbers
        fresh = seen.groupBy("kind", "id").agg(F.min("month").alias("month"))
        fresh = materialize(self._numbered(fresh.join(known, ["kind", "id"], "left_anti")), "new-numbers")
        fresh.select("kind", "id", "month", "number").write.mode("append").partitionBy("kind").parquet(f"{self.path}/numbers")
        numbered = known.select("kind", "id", "month", "number").unionByName(fresh)
        numbered = numbered.withColumnRenamed("month", "first_month")
        placed = seen.join(numbered, ["kind", "id"])
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
        bitmaps = placed.groupBy(
            "event_day", "kind", F.bitmap_bucket_number("number").alias("bucket"), F.col("first_month").alias("month")
        ).agg(bits)
        stored = bitmaps.select(
            "kind", "bucket", "month", "bits", "event_day", F.date_format("event_day", "yyyy-MM").alias("event_month")
        )
        stored.hint("rebalance", "event_month").write.mode("append").partitionBy("event_month").parquet(f"{self.path}/days")

    def _numbered(self, fresh: DataFrame) -> DataFrame:
        """New ids (kind, id, month) with numbers behind those given; a month begins a stretch of its own."""
        order = [F.col("kind"), F.col("month"), F.col("id")]
        placed = _numbered_in_ranges(fresh, order, F.lit(1), "new-ids")
        sizes = placed.groupBy("kind", "month").agg(F.count("*").alias("n"), F.min("before").alias("first")).collect()
        used = {r.kind: r for r in self.numbers.groupBy("kind").agg(F.max("number").alias("top"), F.max("month").alias("month")).collect()}
        bases = []
        for kind in KINDS:
            top, month = (used[kind].top, used[kind].month) if kind in used else (0, None)
            # one row for each month of the batch
            for size in sorted(s for s in sizes if s.kind == kind):
                if size.month != month:
                    top = -(-top // STRETCH) * STRETCH
                bases.append((kind, size.month, top + 1 - size.first))
                top, month = top + size.n, size.month
        table = self.spark.createDataFrame(bases, "kind string, month int, base bigint")
        return placed.join(F.broadcast(table), ["kind", "month"]).select(
            "kind", "id", "month", (F.col("base") + F.col("before")).alias("number")
        )


def distinct_counts(days: DataFrame) -> DataFrame:
    """One row: users and products active on some of the ``days`` of an ``Activity``."""
    merged = days.groupBy("kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return merged.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"unique_{kind}s")
            for kind in KINDS
        ]
    )


def active_users(days: DataFrame, max_periods: int = DEFAULTS.cohort_periods) -> DataFrame:
    """Users active per cohort and months since its start, as ``cohort_active_users``."""
    month = month_index(F.col("event_day")).cast("int")
    merged = (
        days.where("kind = 'user'")
        .groupBy("bucket", "month", month.alias("active"))
        .agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        .where(F.col("active") - F.col("month") <= max_periods)
    )
    return merged.groupBy("month", "active").agg(F.sum("n").alias("active_users")).select(
        month_label(F.col("month")).alias("cohort"),
        (F.col("active") - F.col("month")).cast("bigint").alias("period"),
        "active_users",
    )
