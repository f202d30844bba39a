import math

import pytest
from helpers import at, log, rows
from pyspark.sql import functions as F

from trailmark.operators import quality


def many(spark, n, **columns):
    """``n`` good rows; each keyword is an SQL expression over ``id`` replacing a column."""
    good = {
        "event_time": "timestamp'2024-01-01 00:00:00'",
        "event_type": "'view'",
        "product_id": "id",
        "user_id": "id",
        "price": "1.0D",
        "brand": "'b'",
        "category_code": "'c'",
        "category_id": "1",
        "user_session": "'s'",
    }
    chosen = {**good, **columns}
    return spark.range(n).selectExpr(*[f"{sql} AS {name}" for name, sql in chosen.items()])


def test_clean_log_passes_without_a_word(spark):
    result = quality.validate(many(spark, 100))
    assert (result.is_valid, result.errors, result.warnings) == (True, [], [])
    assert (result.row_count, result.column_count) == (100, 9)
    assert "PASSED (100 rows x 9 columns)" in result.summary()


def test_empty_and_wrong_schema(spark):
    empty = quality.validate(many(spark, 0))
    assert not empty.is_valid and len(empty.errors) == 1 and not empty.warnings
    nothing = quality.validate(spark.createDataFrame([], "struct<>"))
    assert not nothing.is_valid and nothing.column_count == 0
    wrong = quality.validate(spark.createDataFrame([(1, 2)] * 3, "foo int, bar int"))
    assert not wrong.is_valid and wrong.row_count == 3
    assert "event_time" in wrong.errors[0] and "FAILED" in wrong.summary()


def test_missing_optional_columns_only_warn(spark):
    result = quality.validate(many(spark, 10).drop("brand", "category_id"))
    assert result.is_valid
    assert "['category_id', 'brand']" in result.warnings[0]


def test_unknown_types_warn_and_views_are_required(spark):
    result = quality.validate(many(spark, 10, event_type="if(id = 0, 'odd', 'view')"))
    assert result.is_valid and "1 unknown event types in 1 rows" in result.warnings[0]
    assert rows(result.unknown_types) == [("odd",)]
    result = quality.validate(many(spark, 10, event_type="'cart'"))
    assert not result.is_valid and "view" in result.errors[0]
    listed = quality.validate(many(spark, 50, event_type="if(id = 0, 'view', 'x' || id)"))
    assert "49 unknown event types in 49 rows" in listed.warnings[0]
    assert listed.unknown_types.count() == 49


@pytest.mark.parametrize("bad,warns", [(50, 0), (51, 1)])
def test_bad_prices(spark, bad, warns):
    result = quality.validate(many(spark, 100, price=f"if(id < {bad}, 'abc', ' 2.5 ')"))
    assert result.is_valid and len(result.warnings) == warns


def test_negative_prices_are_counted(spark):
    result = quality.validate(many(spark, 10, price="if(id < 3, -1.0D, 1.0D)"))
    assert result.is_valid and result.warnings == ["3 prices are negative"]


@pytest.mark.parametrize("nulls,warns,valid", [(30, 0, True), (31, 1, True), (80, 1, True), (81, 1, False)])
def test_null_rates(spark, nulls, warns, valid):
    result = quality.validate(many(spark, 100, user_id=f"if(id < {nulls}, null, id)"))
    assert (len(result.warnings), result.is_valid) == (warns, valid)
    assert len(result.errors) == (0 if valid else 1)


def test_times_as_text(spark):
    good = many(spark, 10, event_time="if(id = 0, '10/01/2019 05:00', '2019-10-01 05:00:00 UTC')")
    assert quality.validate(good).is_valid
    bad = many(spark, 10, event_time="if(id = 9, 'soon', '2019-10-01')")
    assert "1 values of 'event_time'" in quality.validate(bad).errors[0]


def test_a_failing_check_is_an_error(spark):
    broken = many(spark, 10, price="CAST(raise_error('unreadable') AS double)")
    result = quality.validate(broken)
    assert not result.is_valid and "the check itself failed" in result.errors[0]


def test_metrics_are_one_row_and_nan_counts_as_missing(spark):
    events = log(spark, [("2024-01-01 00:00:00", "odd", 1, 1, math.nan), (None, None, 1, 1, -1.0)])
    row = quality.quality_metrics(events).first()
    assert row.bad_price_rows == row.null_price == 1
    assert row.negative_price_rows == 1
    assert row.unknown_type_rows == 1
    assert row.null_pct_event_time == 50.0
    assert rows(quality.unknown_event_types(events)) == [("odd",)]


def test_coerce_columns(spark):
    raw = spark.createDataFrame(
        [(" 7\t", 5, " 1.5 ", " x y ", at("2024-01-01")), (None, None, "1d", None, None)],
        "user_id string, product_id bigint, price string, brand string, event_time timestamp",
    )
    tidy = quality.coerce_columns(raw)
    assert dict(tidy.dtypes)["price"] == "double" and dict(tidy.dtypes)["product_id"] == "string"
    assert rows(tidy.drop("event_time")) == [("7", "5", 1.5, "x y"), (None, None, None, None)]
    floats = spark.range(1).select(F.lit(float("nan")).alias("price"))
    assert quality.coerce_columns(floats).first()[0] is None
