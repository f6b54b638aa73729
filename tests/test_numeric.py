import decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginflow.functions import numeric
from marginflow.functions.display import display_text


@pytest.mark.parametrize(
    ("value", "cents"), [(1.005, 100), (0.1, 10), (2.675, 267), (-2.68, -268), (99999999.99, 9999999999)]
)
def test_cents_of_a_double(spark, value, cents):
    got = spark.range(1).select(numeric.cents(F.lit(value)).alias("c")).first().c
    # a value with two decimals is exact; others go to the nearest cent of the double
    assert abs(got - cents) <= (1 if round(value, 2) != value else 0)


def half_away(numerator, denominator):
    quotient = abs(Fraction(numerator, denominator))
    whole = int(quotient + Fraction(1, 2))
    return whole if numerator >= 0 else -whole


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.integers(-(10**12), 10**12), st.integers(1, 10**6)), min_size=50, max_size=200
    )
)
def test_quotient_rounds_half_away_from_zero(spark, pairs):
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    rows = df.select("n", "d", numeric.div_half_up(F.col("n"), F.col("d")).alias("q")).collect()
    assert all(r.q == half_away(r.n, r.d) for r in rows)


def test_quotient_ties_and_zero(spark):
    df = spark.createDataFrame([(1, 2), (-1, 2), (5, 2), (-5, 2), (0, 0)], "n bigint, d bigint")
    got = [r.q for r in df.select(numeric.div_half_up(F.col("n"), F.col("d")).alias("q")).collect()]
    assert got == [1, -1, 3, -3, None]


def test_averages(spark):
    df = spark.createDataFrame(
        [(14.9, 0.25, 10.01), (15.0, 0.2505, 10.02)], "p double, s double, m double"
    )
    row = df.agg(
        numeric.avg_percent("p").alias("p"),
        numeric.avg_money("m").alias("m"),
        numeric.sum_money("m").alias("t"),
    ).first()
    assert (row.p, row.m, row.t) == (15.0, 10.02, 20.03)
    empty = df.filter("false").agg(numeric.avg_money("m").alias("m"), numeric.sum_money("m").alias("t"))
    assert tuple(empty.first()) == (None, None)


def test_total_does_not_depend_on_partitions(spark):
    df = spark.range(10000).select((F.col("id") * 0.01 + 0.1).alias("v"))
    totals = {
        df.repartition(n).agg(numeric.sum_money(F.round("v", 2)).alias("t")).first().t for n in (1, 3, 8)
    }
    assert totals == {float(sum(decimal.Decimal(i) / 100 + decimal.Decimal("0.1") for i in range(10000)))}


@pytest.mark.parametrize(
    ("value", "kind", "text"),
    [
        (2.5e9, "currency", "$2.5B"),
        (1234567.0, "currency", "$1.2M"),
        (1500.0, "currency", "$1.5K"),
        (999.4, "currency", "$999"),
        (1234567.9, "integer", "1,234,567"),
        (12.3, "percent", "12.3%"),
        (None, "currency", "$0"),
    ],
)
def test_display_text(spark, value, kind, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(display_text(F.col("v"), F.lit(kind)).alias("t")).first().t == text
