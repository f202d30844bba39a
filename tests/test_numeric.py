import math
from fractions import Fraction

import pytest

from trailmark.functions import exact_mean


@pytest.mark.parametrize(
    "values",
    [
        [4e-7] * 1000,
        [9e15 - 2.0] * 3000,
        [1e300, 1.0, -1e300],
        [-0.25, -1e-9, 12.34, 99.99, -7.5],
        [0.1] * 1001,
        [1e-12, 1e15, 2.5e-7],
    ],
)
def test_means_lose_nothing_and_do_not_overflow(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "price double").repartition(7)
    got = frame.agg(exact_mean(frame.price)).first()[0]
    want = float(sum(map(Fraction, values)) / len(values))
    assert math.isclose(got, want, rel_tol=1e-14, abs_tol=1e285 if max(values) > 1e200 else 0)


def test_two_decimals_add_up_as_decimals_do(spark):
    frame = spark.range(100_000).selectExpr("cast(id % 1000 as double) / 100 AS price")
    assert frame.agg(exact_mean(frame.price)).first()[0] == 4.995
