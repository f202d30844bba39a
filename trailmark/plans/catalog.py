"""Every operator as a query over the star-schema tables.

``clicks`` feeds the queries that need times of day, brands or given sessions;
``orders_log`` those that need years of history or users who do not buy. Times
and dates are put out as text, so that any engine can be compared with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import astuple
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.operators import (
    activity,
    brands,
    clean,
    cluster,
    cohort,
    funnel,
    kpis,
    quality,
    segments,
    sessions,
    stats,
    temporal,
)
from trailmark.sources import clicks, orders_log, read_events_csv, read_log, write_events_csv, write_log
from trailmark.sources.csv import normalize_events
from trailmark.sources.tables import read_table
from trailmark.storage import materialize, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

CLICK_BOTS, CLICK_GAP = 6, 360
ORDER_BOTS, ORDER_GAP = 8, 30 * 24 * 60
DATES = ("2024-01-05", "2024-01-20")
BRANDS = ["Brand#1", "Brand#2", "Brand#13"]
# The brand differs between the events of a user; the others do not.
CHI_SQUARE_GROUPS = ["market", "account_state", "brand"]


def _time_text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def _click_rows(log: DataFrame) -> DataFrame:
    return log.select(
        "event_id", _time_text("event_time"), "event_type", "product_id", "user_id", "price"
    )


# -- normalisation ---------------------------------------------------------


def _raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as an untidy text file would hold them."""
    kind = F.col("event_type")
    stamp = F.col("ts")
    return read_table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias(" Event_ID"),
        F.concat(F.lit(" "), F.upper(kind), F.lit("\t")).alias("EVENT_TYPE "),
        F.when(kind == "click", F.date_format(stamp, "MM/dd/yyyy HH:mm"))
        .when(kind == "view", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == "signup", F.date_format(stamp, "yyyy-MM-dd"))
        .when(kind == "error", F.date_format(stamp, "yyyy/MM/dd HH:mm:ss"))
        .otherwise(F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
        .alias("Event_Time"),
        F.when(kind == "error", "n.a.")
        .otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
        .alias("Price"),
    )


def normalize_event_type(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_events(_raw_events(spark, folder)).select("event_id", "event_type")


def coerce_price(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_events(_raw_events(spark, folder)).select("event_id", "price")


def parse_event_time(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_events(_raw_events(spark, folder)).select(
        "event_id", _time_text("event_time")
    )


def coerce_columns(spark: SparkSession, folder: str) -> DataFrame:
    untidy = clicks(spark, folder, products=True).withColumns(
        {
            "event_type": F.concat(F.lit("  "), F.col("event_type"), F.lit("\n")),
            "price": F.col("price").cast("string"),
        }
    )
    return quality.coerce_columns(untidy).select(
        "event_id", "event_type", "user_id", "product_id", "price", "brand"
    )


# -- filters and options ---------------------------------------------------


def filter_date_range(spark: SparkSession, folder: str) -> DataFrame:
    return _click_rows(clean.filter_date_range(clicks(spark, folder), *DATES))


def filter_brands(spark: SparkSession, folder: str) -> DataFrame:
    log = clicks(spark, folder, products=True)
    return clean.filter_brands(log, BRANDS).select("event_id", "brand", "price")


def apply_filters(spark: SparkSession, folder: str) -> DataFrame:
    return _click_rows(clean.apply_filters(clicks(spark, folder, products=True), DATES, BRANDS))


def date_bounds(spark: SparkSession, folder: str) -> DataFrame:
    bounds = clean.date_bounds(clicks(spark, folder))
    return bounds.select(*[F.col(name).cast("string").alias(name) for name in bounds.columns])


def _stored_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """The clicks, stored by day and read back."""
    path = f"{shared_folder(spark)}/trailmark/log-{uuid.uuid4().hex}"
    write_log(clicks(spark, folder), path)
    return read_log(spark, path)


def stored_date_range(spark: SparkSession, folder: str) -> DataFrame:
    """``filter_date_range`` on a log stored by day, which reads the days asked for only."""
    return _click_rows(clean.filter_date_range(_stored_clicks(spark, folder), *DATES))


def stored_date_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """``date_bounds`` of a log stored by day, from its folders."""
    bounds = clean.date_bounds(_stored_clicks(spark, folder))
    return bounds.select(*[F.col(name).cast("string").alias(name) for name in bounds.columns])


def brand_options(spark: SparkSession, folder: str) -> DataFrame:
    return clean.brand_options(clicks(spark, folder, products=True))


# -- cleaning and sessions -------------------------------------------------


def bot_users(spark: SparkSession, folder: str) -> DataFrame:
    return clean.bot_users(clicks(spark, folder), CLICK_BOTS)


def remove_bots(spark: SparkSession, folder: str) -> DataFrame:
    return _click_rows(clean.remove_bots(clicks(spark, folder), CLICK_BOTS))


def deduplicate_events(spark: SparkSession, folder: str) -> DataFrame:
    kept = clean.deduplicate_events(orders_log(spark, folder))
    return kept.select(_time_text("event_time"), "event_type", "product_id", "user_id", "price")


def cleaning_report(spark: SparkSession, folder: str) -> DataFrame:
    return clean.cleaning_report(orders_log(spark, folder), ORDER_BOTS)


def run_cleaning_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``cleaning_report`` as the pipeline observes it while it writes the clean log."""
    log = orders_log(spark, folder)
    counts = clean.clean_log(log, quality.validate(log).row_count, ORDER_BOTS)[1]
    row = (*astuple(counts), counts.duplicates_removed, counts.duplicate_pct)
    return spark.createDataFrame(
        [row],
        "bot_users bigint, rows_in bigint, rows_without_bots bigint, rows_out bigint, "
        "duplicates_removed bigint, duplicate_pct double",
    )


def remove_many_bots(spark: SparkSession, folder: str) -> DataFrame:
    """``remove_bots`` by the sieve and the shuffled join that a long list takes."""
    log = clicks(spark, folder)
    bots = materialize(clean.bot_users(log, CLICK_BOTS).select("user_id"), "bots")
    return _click_rows(clean.without_many_users(log, bots))


def sessions_existing(spark: SparkSession, folder: str) -> DataFrame:
    tagged = sessions.assign_sessions(clicks(spark, folder))
    return tagged.select("event_id", "session_id", "session_duration_sec")


def sessions_gap(spark: SparkSession, folder: str) -> DataFrame:
    tagged = sessions.assign_sessions(clicks(spark, folder), CLICK_GAP, use_existing=False)
    return tagged.select("event_id", "session_id", "session_duration_sec")


def sessions_gap_running_ids(spark: SparkSession, folder: str) -> DataFrame:
    tagged = sessions.assign_sessions(
        clicks(spark, folder), CLICK_GAP, use_existing=False, running_ids=True
    )
    return tagged.select("event_id", "session_id", "session_duration_sec")


def _clicks_without_some_users(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh event has no user; of these every third has a copy."""
    log = clicks(spark, folder)
    user = F.when(F.col("event_id") % 7 != 0, F.col("user_id"))
    copies = F.when(F.col("event_id") % 21 == 0, 2).otherwise(1)
    return log.withColumn("user_id", user).withColumn("n", F.explode(F.sequence(F.lit(1), copies))).drop("n")


def sessions_without_user(spark: SparkSession, folder: str) -> DataFrame:
    """How many sessions the tagged events without a user have, event by event."""
    tagged = sessions.assign_sessions(
        _clicks_without_some_users(spark, folder), CLICK_GAP, use_existing=False
    )
    return tagged.groupBy("event_id", "user_id").agg(
        F.count("*").alias("events"),
        F.count_distinct("session_id").alias("sessions"),
        F.max("session_duration_sec").alias("session_duration_sec"),
    )


def session_table_without_user(spark: SparkSession, folder: str) -> DataFrame:
    """The session table, and how many of its ids the tagged events have too."""
    log = _clicks_without_some_users(spark, folder)
    table = sessions.session_summary(log, CLICK_GAP, use_existing=False)
    tagged = sessions.assign_sessions(log, CLICK_GAP, use_existing=False)
    ids = tagged.select(F.col("session_id").alias("tagged_id")).distinct()
    return (
        table.join(ids, F.col("session_id") == F.col("tagged_id"), "left")
        .groupBy("user_id")
        .agg(
            F.count("session_id").alias("sessions"),
            F.count("tagged_id").alias("matched"),
            F.sum("events").alias("events"),
            F.sum("duration_us").alias("duration_us"),
        )
    )


def running_ids_without_user(spark: SparkSession, folder: str) -> DataFrame:
    """Running session numbers per user: their range and number."""
    tagged = sessions.assign_sessions(
        _clicks_without_some_users(spark, folder), CLICK_GAP, use_existing=False, running_ids=True
    )
    number = F.col("session_id").cast("bigint")
    return tagged.groupBy("user_id").agg(
        F.min(number).alias("first"), F.max(number).alias("last"), F.count_distinct(number).alias("sessions")
    )


def session_durations(spark: SparkSession, folder: str) -> DataFrame:
    summary = sessions.session_summary(clicks(spark, folder))
    return summary.select("session_id", "events", "session_duration_sec")


def _click_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_summary(clicks(spark, folder), CLICK_GAP, use_existing=False)


def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _click_sessions(spark, folder).select(
        "user_id",
        "session_id",
        _time_text("session_start"),
        _time_text("session_end"),
        "events",
        "views",
        "session_duration_sec",
    )


def session_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_metrics(_click_sessions(spark, folder))


def _click_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_lengths(_click_sessions(spark, folder))


def session_length_p99(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.length_p99(_click_lengths(spark, folder))


def session_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.length_histogram(_click_lengths(spark, folder))


# -- funnel and key figures ------------------------------------------------


def conversion_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.funnel(orders_log(spark, folder))


def funnel_step_rates(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.step_rates(conversion_funnel(spark, folder))


def funnel_biggest_drop(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.biggest_drop(conversion_funnel(spark, folder))


def headline_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.compute_kpis(orders_log(spark, folder))


def quick_stats(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.quick_stats(headline_kpis(spark, folder))


def kpi_cards(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.kpi_cards(headline_kpis(spark, folder))


def funnel_table(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.display_table(conversion_funnel(spark, folder))


# -- cohorts ---------------------------------------------------------------


def cohort_assign(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cohort_assign(orders_log(spark, folder))


def cohort_active_users(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cohort_active_users(cohort_assign(spark, folder))


def _stored_activity(spark: SparkSession, folder: str) -> DataFrame:
    """The days of the order log as bitmaps, added in two batches."""
    store = activity.Activity(spark, f"{shared_folder(spark)}/trailmark/activity-{uuid.uuid4().hex}")
    log = orders_log(spark, folder)
    early = F.col("event_time") < F.lit("1995-06-18").cast(log.schema["event_time"].dataType)
    store.add(log.where(early))
    store.add(log.where(~early))
    return store.days


def activity_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """``cohort_active_users`` from stored bitmaps of days."""
    return activity.active_users(_stored_activity(spark, folder))


def activity_uniques(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users and products of the headline figures, from stored bitmaps of days."""
    return activity.distinct_counts(_stored_activity(spark, folder))


def cohort_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cohort_sizes(cohort_assign(spark, folder))


def cohort_retention(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cohort_retention(cohort_assign(spark, folder))


def cohort_heatmap_labels(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.retention_labels(cohort_retention(spark, folder))


def cohort_avg_m1(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.average_first_month(cohort_retention(spark, folder))


# -- segments and clusters -------------------------------------------------


def segment_users(spark: SparkSession, folder: str) -> DataFrame:
    log = orders_log(spark, folder)
    return segments.segment_users_by_session(log, ORDER_GAP, use_existing=False)


def segment_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return segments.segment_distribution(segment_users(spark, folder))


def segment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return segments.segment_summary(segment_users(spark, folder))


def segment_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return segments.segment_metrics(segment_users(spark, folder))


def cart_abandoners(spark: SparkSession, folder: str) -> DataFrame:
    return segments.cart_abandoners(orders_log(spark, folder))


def user_features_scaled(spark: SparkSession, folder: str) -> DataFrame:
    scaled = cluster.scaled_features(segment_users(spark, folder))
    names = [name for name in scaled.columns if name.endswith("_scaled")] + ["pc1", "pc2"]
    # Six digits: the last bits of a variance depend on the order of rows.
    return scaled.select("user_id", *[(F.rint(F.col(n) * 1e6) / 1e6).alias(n) for n in names])


def kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.cluster_users(segment_users(spark, folder))


def kmeans_properties(spark: SparkSession, folder: str) -> DataFrame:
    """What any k-means result must fulfil, as one row of counts."""
    return cluster.cluster_properties(segment_users(spark, folder), kmeans_clusters(spark, folder))


def cluster_summary_of_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``cluster_summary`` of clusters that SQL can name: users by the remainder of their number."""
    labelled = segment_users(spark, folder).withColumn("cluster", (F.col("user_id") % 4).cast("int"))
    return cluster.cluster_summary(labelled)


def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.cluster_summary(kmeans_clusters(spark, folder))


# -- time and brands -------------------------------------------------------


def _slots(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.slot_counts(clicks(spark, folder))


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.hourly_events(_slots(spark, folder))


def weekday_events(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.weekday_events(_slots(spark, folder))


def purchase_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.purchase_heatmap(_slots(spark, folder))


def purchase_heatmap_labels(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.heatmap_labels(purchase_heatmap(spark, folder))


def purchases_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.purchases_by_hour(_slots(spark, folder))


def peak_purchase_time(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.peak_purchase_time(_slots(spark, folder))


def event_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.event_distribution(clicks(spark, folder))


def daily_events(spark: SparkSession, folder: str) -> DataFrame:
    days = temporal.daily_events(clicks(spark, folder))
    return days.withColumn("date", F.col("date").cast("string"))


def brand_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return brands.brand_analysis(clicks(spark, folder, products=True))


def brand_conversion_table(spark: SparkSession, folder: str) -> DataFrame:
    return brands.brand_conversion_table(brand_analysis(spark, folder))


def top_converting_brand(spark: SparkSession, folder: str) -> DataFrame:
    return brands.top_converting_brand(brand_analysis(spark, folder))


def brand_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return brands.brand_comparison(brand_analysis(spark, folder))


# -- quality and statistics ------------------------------------------------


def data_quality_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_metrics(clicks(spark, folder))


def _spoiled_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks with bad prices and times, missing users, and without brands."""
    event = F.col("event_id")
    return clicks(spark, folder).select(
        "event_id",
        F.when(event % 10 == 3, "soon").otherwise(F.col("event_time").cast("string")).alias("event_time"),
        "event_type",
        F.when(event % 20 == 0, F.col("product_id")).alias("product_id"),
        F.when(event % 5 > 1, F.col("user_id")).alias("user_id"),
        F.when(event % 5 < 3, F.lit("n.a."))
        .when(event % 5 == 3, F.lit("-1"))
        .otherwise(F.col("price").cast("string"))
        .alias("price"),
    )


def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    """The findings about the clicks as they are, spoiled, without rows, and without columns that are required."""
    log = clicks(spark, folder)
    logs = {
        "clean": log,
        "spoiled": _spoiled_clicks(spark, folder),
        "empty": log.where("event_time IS NULL"),
        "narrow": log.drop("user_id", "price"),
    }
    reports = [
        quality.validation_report(log).select(F.lit(name).alias("log"), "*") for name, log in logs.items()
    ]
    return reduce(DataFrame.unionByName, reports)


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` written as an untidy CSV file and read back as a log."""
    raw = _raw_events(spark, folder)
    note = F.concat(F.lit('said "'), F.col("event_type"), F.lit('",\nthen left'))
    notes = read_table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("of"), note.alias("NOTE")
    )
    untidy = raw.join(notes, F.col("` Event_ID`") == F.col("of")).drop("of")
    path = f"{shared_folder(spark)}/trailmark/csv-{uuid.uuid4().hex}"
    write_events_csv(untidy, path)
    log = read_events_csv(spark, path)
    return log.select("event_id", "event_type", _time_text("event_time"), "price", "note")


def unknown_event_types(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unknown_event_types(clicks(spark, folder))


def _contingencies(spark: SparkSession, folder: str) -> DataFrame:
    log = orders_log(spark, folder, products=True, customers=True)
    return stats.contingencies(log, *CHI_SQUARE_GROUPS)


def chi_square_contingency(spark: SparkSession, folder: str) -> DataFrame:
    return _contingencies(spark, folder)


def chi_square_statistic(spark: SparkSession, folder: str) -> DataFrame:
    return stats.chi_square(_contingencies(spark, folder)).drop("users")


QUERIES: dict[str, Query] = {
    "normalize_event_type": normalize_event_type,
    "coerce_price": coerce_price,
    "parse_event_time": parse_event_time,
    "coerce_columns": coerce_columns,
    "filter_date_range": filter_date_range,
    "filter_brands": filter_brands,
    "apply_filters": apply_filters,
    "date_bounds": date_bounds,
    "stored_date_range": stored_date_range,
    "stored_date_bounds": stored_date_bounds,
    "brand_options": brand_options,
    "bot_users": bot_users,
    "remove_bots": remove_bots,
    "deduplicate_events": deduplicate_events,
    "cleaning_report": cleaning_report,
    "run_cleaning_counts": run_cleaning_counts,
    "remove_many_bots": remove_many_bots,
    "sessions_existing": sessions_existing,
    "sessions_gap": sessions_gap,
    "sessions_gap_running_ids": sessions_gap_running_ids,
    "sessions_without_user": sessions_without_user,
    "session_table_without_user": session_table_without_user,
    "running_ids_without_user": running_ids_without_user,
    "session_durations": session_durations,
    "session_summary": session_summary,
    "session_metrics": session_metrics,
    "session_length_p99": session_length_p99,
    "session_length_histogram": session_length_histogram,
    "funnel": conversion_funnel,
    "funnel_table": funnel_table,
    "funnel_step_rates": funnel_step_rates,
    "funnel_biggest_drop": funnel_biggest_drop,
    "kpis": headline_kpis,
    "quick_stats": quick_stats,
    "kpi_cards": kpi_cards,
    "cohort_assign": cohort_assign,
    "cohort_active_users": cohort_active_users,
    "activity_cohorts": activity_cohorts,
    "activity_uniques": activity_uniques,
    "cohort_sizes": cohort_sizes,
    "cohort_retention": cohort_retention,
    "cohort_heatmap_labels": cohort_heatmap_labels,
    "cohort_avg_m1": cohort_avg_m1,
    "segment_users": segment_users,
    "segment_distribution": segment_distribution,
    "segment_summary": segment_summary,
    "segment_metrics": segment_metrics,
    "cart_abandoners": cart_abandoners,
    "user_features_scaled": user_features_scaled,
    "kmeans_clusters": kmeans_clusters,
    "kmeans_properties": kmeans_properties,
    "cluster_summary": cluster_summary,
    "cluster_summary_of_labels": cluster_summary_of_labels,
    "hourly_events": hourly_events,
    "weekday_events": weekday_events,
    "purchase_heatmap": purchase_heatmap,
    "purchase_heatmap_labels": purchase_heatmap_labels,
    "purchases_by_hour": purchases_by_hour,
    "peak_purchase_time": peak_purchase_time,
    "event_distribution": event_distribution,
    "daily_events": daily_events,
    "brand_analysis": brand_analysis,
    "brand_conversion_table": brand_conversion_table,
    "top_converting_brand": top_converting_brand,
    "brand_comparison": brand_comparison,
    "data_quality_metrics": data_quality_metrics,
    "validation_report": validation_report,
    "csv_round_trip": csv_round_trip,
    "unknown_event_types": unknown_event_types,
    "chi_square_contingency": chi_square_contingency,
    "chi_square_statistic": chi_square_statistic,
}
