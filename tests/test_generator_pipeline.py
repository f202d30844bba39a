import pytest
from helpers import rows
from pyspark.sql import functions as F

import trailmark
from trailmark.params import EVENT_TYPES, Params
from trailmark.plans import pipeline
from trailmark.sources import generate_events, simulate_users
from trailmark.sources.generator import BRANDS, CATEGORIES


@pytest.fixture(scope="module")
def generated(spark):
    return generate_events(spark, 20_000).persist()


def test_generated_log_has_the_promised_shape(generated):
    assert 0.85 * 20_000 < generated.count() < 1.15 * 20_000
    kinds = {r[0]: r[1] for r in generated.groupBy("event_type").count().collect()}
    assert set(kinds) == set(EVENT_TYPES)
    sessions = generated.select("user_session").distinct().count()
    assert kinds["cart"] / sessions == pytest.approx(0.25, abs=0.03)
    assert kinds["purchase"] / kinds["cart"] == pytest.approx(0.4, abs=0.05)
    assert kinds["remove_from_cart"] / kinds["cart"] == pytest.approx(0.3, abs=0.05)
    bounds = generated.agg(
        F.min("event_time"), F.max("event_time"), F.min("product_id"), F.max("product_id")
    ).first()
    assert str(bounds[0]) >= "2024-01-01" and str(bounds[1]) < "2024-05-01"
    assert bounds[2] >= 1_000_000 and bounds[3] < 1_000_500
    product = generated.groupBy("product_id").agg(
        F.count_distinct("price", "brand", "category_code").alias("n")
    )
    assert product.agg(F.max("n")).first()[0] == 1
    assert {r[0] for r in generated.select("brand").distinct().collect()} <= set(BRANDS)
    assert {r[0] for r in generated.select("category_code").distinct().collect()} <= set(CATEGORIES)


def test_generated_sessions_follow_the_rules(generated):
    per_session = generated.groupBy("user_id", "user_session").agg(
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(F.col("event_type") == "cart").alias("carts"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "remove_from_cart").alias("removes"),
        F.collect_set(F.when(F.col("event_type") == "view", F.col("product_id"))).alias("seen"),
        F.max(F.when(F.col("event_type") == "cart", F.col("product_id"))).alias("carted"),
        F.max(F.when(F.col("event_type") == "view", F.col("event_time"))).alias("last_view"),
        F.max(F.when(F.col("event_type") == "cart", F.col("event_time"))).alias("cart_time"),
        F.max(
            F.when(F.col("event_type").isin("purchase", "remove_from_cart"), F.col("event_time"))
        ).alias("end_time"),
    )
    wrong = per_session.where(
        ~F.col("views").between(1, 15)
        | (F.col("carts") > 1)
        | (F.col("purchases") + F.col("removes") > F.col("carts"))
        | ~F.coalesce(F.array_contains("seen", F.col("carted")), F.lit(True))
        | (F.col("cart_time") <= F.col("last_view"))
        | (F.col("end_time") <= F.col("cart_time"))
    )
    assert wrong.count() == 0
    per_user = generated.groupBy("user_id").agg(F.count_distinct("user_session").alias("n"))
    assert per_user.where(~F.col("n").between(1, 20)).count() == 0
    assert per_session.agg(F.avg("views")).first()[0] == pytest.approx(4.82, abs=0.25)


def test_generator_depends_on_the_seed_and_not_on_partitions(spark):
    users = spark.range(1, 40).withColumnRenamed("id", "user_id")
    one = rows(simulate_users(users.repartition(1), 7))
    assert one == rows(simulate_users(users.repartition(9), 7))
    assert one != rows(simulate_users(users, 8))


def test_pipeline_end_to_end(spark, generated):
    result = pipeline.run(generated)
    assert result.error is None and result.validation.is_valid
    users = [row.users for row in result.funnel.collect()]
    assert users == sorted(users, reverse=True) and users[0] == result.segments.count()
    assert result.retention.where("M0 <> 100.0").count() == 0
    assert result.cohort_sizes.agg(F.sum("cohort_size")).first()[0] == users[0]
    segments = {r.segment for r in result.segments.select("segment").distinct().collect()}
    assert segments == {"Purchaser", "Cart Abandoner", "Browser"}
    figures = result.kpis.first()
    assert figures.total_events == result.sessioned.count() <= generated.count()
    assert figures.unique_users == users[0]
    assert result.clustered.select("cluster").distinct().count() == 4
    assert result.clustered.count() == users[0]
    hourly = result.time_patterns.hourly.agg(F.sum("count")).first()[0]
    assert hourly == figures.total_events
    assert result.brands.count() == 15
    assert {"session_id", "session_duration_sec"} <= set(result.sessioned.columns)
    assert rows(trailmark.segment_users(result.sessioned)) == rows(result.segments)
    assert rows(trailmark.funnel(result.sessioned)) == rows(result.funnel)
    assert rows(trailmark.compute_kpis(result.sessioned)) == rows(result.kpis)


def test_pipeline_filters_and_stops_on_invalid_input(spark, generated):
    short = pipeline.run(
        generated,
        Params(clusters=2, session_gap_minutes=20, min_brand_events=1),
        ("2024-02-01", "2024-02-10"),
        ["Olay", "NYX"],
        use_existing_sessions=False,
    )
    assert rows(short.brands.select("brand")) == [("NYX",), ("Olay",)]
    assert short.clustered.select("cluster").distinct().count() == 2
    none = pipeline.run(generated, date_range=("2030-01-01", "2030-01-02"))
    assert none.kpis is None and "no rows" in none.error
    assert not pipeline.run(generated.drop("price")).validation.is_valid


@pytest.mark.parametrize(
    "wrong",
    [{"clusters": 1}, {"session_gap_minutes": 0}, {"bot_threshold": 0}, {"cohort_periods": -1}],
)
def test_parameters_are_checked(wrong):
    with pytest.raises(ValueError):
        Params(**wrong)
