import math
from decimal import Decimal

import pytest

from surgewatch.operators import rollup
from tests.helpers import h

SALES = "client_id bigint, country string, sold_at timestamp_ntz, amount {}"


def sales(spark, amounts, kind="double"):
    return spark.createDataFrame([(1, "A", h(1, 3), a) for a in amounts], SALES.format(kind))


def test_amounts_below_a_cent_count(spark):
    df = sales(spark, [0.004] * 1000)
    assert math.isclose(rollup.hourly_sales(df).first().amount, 4.0)
    assert rollup.hourly_sales(df, scale=3).first().amount == 4.0
    assert math.isclose(rollup.client_buckets(df).first().amount, 4.0)
    assert math.isclose(rollup.trailing_sum(rollup.hourly_sales(df)).first().last24h_amount, 4.0)


def test_decimals_stay_decimal(spark):
    df = sales(spark, [Decimal("0.0001")] * 3, "decimal(18,4)")
    hourly = rollup.hourly_sales(df)
    assert hourly.schema["amount"].dataType.simpleString() == "decimal(28,4)" and hourly.first().amount == Decimal("0.0003")
    assert rollup.trailing_sum(hourly).first().last24h_amount == Decimal("0.0003")


def test_nan_stays_nan_without_a_scale(spark):
    df = sales(spark, [1.0, float("nan")])
    assert math.isnan(rollup.hourly_sales(df).first().amount)


@pytest.mark.parametrize("amount", [0.004, float("nan"), float("inf"), 1e17])
def test_a_scale_that_does_not_hold_raises(spark, amount):
    with pytest.raises(Exception, match="does not fit 2 decimals"):
        rollup.hourly_sales(sales(spark, [1.25, amount]), scale=2).collect()


def test_nulls_and_exact_sums(spark):
    df = sales(spark, [None, 0.1, 0.2, 0.7])
    assert rollup.hourly_sales(df, scale=2).first().amount == 1.0
    assert rollup.hourly_sales(sales(spark, [None]), scale=2).first().amount is None
