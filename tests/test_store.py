"""Logs stored by day, the sieve in front of the anti-join, and counts observed in passing."""

import re

import pytest
from helpers import log, rows
from pyspark.sql import functions as F

from trailmark.operators import clean, quality
from trailmark.plans import pipeline
from trailmark.sources import read_log, write_log


def events(spark, days=20, n=400):
    return spark.range(n).select(
        F.expr(f"timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(id % {days}, 0, 0, id * 7 % 3600)").alias("event_time"),
        F.when(F.col("id") % 3 == 0, "cart").otherwise("view").alias("event_type"),
        (F.col("id") % 11).alias("product_id"),
        F.when(F.col("id") % 13 != 5, F.col("id") % 17).alias("user_id"),
        F.lit(1.5).alias("price"),
    )


def scans(frame):
    return re.findall(r"FileScan parquet.*", frame._jdf.queryExecution().executedPlan().toString())


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    path = f"{tmp_path}/log"
    write_log(events(spark), path)
    stored = read_log(spark, path)
    assert len(list(tmp_path.glob("log/event_day=*"))) == 20
    assert len(list(tmp_path.glob("log/event_day=*/part-*"))) == 20  # one file a day, though many tasks made it
    chosen = clean.filter_date_range(stored, "2024-01-03", "2024-01-05")
    (scan,) = scans(chosen)
    assert re.search(r"PartitionFilters: \[[^]]*event_day[^]]*2024-01-03[^]]*2024-01-05", scan), scan
    assert rows(chosen.drop("event_day")) == rows(clean.filter_date_range(events(spark), "2024-01-03", "2024-01-05"))


def test_bounds_come_from_the_folders(spark, tmp_path):
    path = f"{tmp_path}/log"
    write_log(events(spark).unionByName(log(spark, [(None, "view", 1, 1, 1.0, None, None)]).select(events(spark).columns)), path)
    bounds = clean.date_bounds(read_log(spark, path))
    (scan,) = scans(bounds)
    assert "ReadSchema: struct<>" in scan
    assert [str(v) for v in bounds.first()] == ["2024-01-01", "2024-01-20"]


def test_days_can_be_added(spark, tmp_path):
    path = f"{tmp_path}/log"
    write_log(events(spark), path)
    write_log(events(spark).withColumn("event_time", F.expr("event_time + INTERVAL '40' DAY")), path, mode="append")
    assert read_log(spark, path).count() == 800
    with pytest.raises(ValueError, match="not a log stored by day"):
        events(spark).write.parquet(f"{tmp_path}/plain")
        read_log(spark, f"{tmp_path}/plain")


def test_a_run_over_a_stored_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    write_log(events(spark), path)
    days = ("2024-01-02", "2024-01-09")
    stored = pipeline.run(read_log(spark, path), date_range=days)
    plain = pipeline.run(events(spark), date_range=days)
    assert rows(stored.funnel) == rows(plain.funnel)
    assert rows(stored.kpis) == rows(plain.kpis)
    assert stored.cleaning == plain.cleaning


def test_a_long_list_is_joined_behind_the_sieve(spark):
    frame = events(spark, n=5000).withColumn("user_id", F.when(F.col("product_id") != 4, F.hash("price", "event_time")))
    listed = frame.where("user_id % 50 = 0").select("user_id").distinct()
    want = rows(clean.without_users(frame, listed))
    got = clean.without_many_users(frame, listed)
    assert rows(got) == want and len(want) < 5000
    words = clean.sieve(listed).scalar()
    word, bit = clean._bucket(F.col("user_id"))
    flagged = frame.where(F.getbit(F.get(words, word), bit) == 1)
    # everybody listed is flagged, and hardly anybody else
    assert flagged.join(listed, "user_id", "left_anti").count() <= 5
    assert flagged.join(listed, "user_id").count() == frame.join(listed, "user_id").count()
    assert len(clean.sieve(listed.limit(0)).first().words) == clean.SIEVE_WORDS


@pytest.mark.parametrize("most", [0, 10])
def test_counts_are_those_of_the_report(spark, monkeypatch, most):
    monkeypatch.setattr(clean, "MAX_BROADCAST_USERS", most)
    frame = events(spark).unionByName(events(spark).limit(150))
    report = clean.cleaning_report(frame, 1).first()
    cleaned, counts = clean.clean_log(frame, quality.validate(frame).row_count, 1)
    assert cleaned.count() == counts.rows_out
    got = {name: getattr(counts, name) for name in report.asDict()}
    assert got == report.asDict()
    assert counts.bot_users > 0 and counts.duplicates_removed > 0


def test_a_run_carries_its_counts_without_further_jobs(spark):
    frame = events(spark)
    result = pipeline.run(frame)
    assert result.cleaning.rows_in == 400 and result.cleaning.bot_users == 0
    assert result.cleaning.rows_out == rows(result.sessioned.groupBy().count())[0][0]
