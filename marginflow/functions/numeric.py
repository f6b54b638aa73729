"""Fixed-point arithmetic for money and rates.

Public tables carry doubles.  Every sum, product and rounding is done on
``bigint`` units so that

* results do not depend on the order in which partitions are merged,
* results are rounded once, after the aggregate, half away from zero, with no
  binary-fraction surprises: inputs keep four decimals of money and six of a percentage
  (what lies beyond these is rounded to the nearest unit, ties to even), and
* the work stays on primitive longs inside whole-stage codegen; decimals wider
  than 18 digits would fall back to boxed big numbers row by row.

With ANSI mode (the Spark 4 default) an overflow raises instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENT_PLACES = 2
PERCENT_PLACES = 1
SHARE_PLACES = 3
RATE_PLACES = 6
# Decimals that totals carry until they are rounded.  Money totals have room up to 9e14,
# sums of percentages up to 9e10 rows of 100 percent.
MONEY_SUM_PLACES = 4
PERCENT_SUM_PLACES = 6


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def units(value: Column | str, places: int) -> Column:
    """Whole units of a number that has at most ``places`` decimals."""
    if isinstance(value, str):  # one expression: building it call by call takes most of a query's set-up
        return F.expr(f"CAST(rint(`{value}` * {10**places}D) AS bigint)")
    return F.rint(value * F.lit(float(10**places))).cast("bigint")


def cents(value: Column | str) -> Column:
    return units(value, CENT_PLACES)


def from_units(value: Column, places: int) -> Column:
    """Double holding ``value`` scaled back by ``places`` decimals."""
    return value.cast("double") / F.lit(float(10**places))


def div_half_up(numerator: Column, denominator: Column) -> Column:
    """Integer quotient rounded half away from zero; the denominator is positive.

    A zero denominator gives NULL, which is what an average over no rows is.
    """
    half = F.when(numerator < 0, -denominator).otherwise(denominator)
    return F.call_function(
        "div", numerator * F.lit(2) + half, F.nullif(denominator * F.lit(2), F.lit(0).cast("bigint"))
    )


def round_half_up(value: Column | str, places: int) -> Column:
    """Double rounded half away from zero, for values that are not sums of units."""
    column = _col(value)
    scale = F.lit(float(10**places))
    magnitude = F.floor(F.abs(column) * scale + F.lit(0.5)).cast("double") / scale
    return F.when(column < 0, -magnitude).otherwise(magnitude)


def sum_money(unit_price: Column | str, quantity: Column | str | None = None) -> Column:
    """Exact total of a price, or of price times quantity, as double with 2 decimals."""
    one = F.lit(1) if quantity is None else quantity
    return money_total(F.sum(money_units(unit_price, one)))


def money_units(unit_price: Column | str, quantity: Column | str) -> Column:
    """A line's amount in the units that totals are kept in."""
    return units(unit_price, MONEY_SUM_PLACES) * _col(quantity).cast("bigint")


def money_total(total: Column) -> Column:
    """Double with 2 decimals from a total of ``money_units``."""
    scale = F.lit(10 ** (MONEY_SUM_PLACES - CENT_PLACES)).cast("bigint")
    return from_units(div_half_up(total, scale), CENT_PLACES)


def avg_units(total: Column, count: Column, total_places: int, places: int) -> Column:
    """Average of ``count`` values whose unit total is ``total``, rounded to ``places``."""
    if total_places > places:
        count = count * F.lit(10 ** (total_places - places))
    elif places > total_places:
        total = total * F.lit(10 ** (places - total_places))
    return from_units(div_half_up(total, count), places)


def avg_money(value: Column | str) -> Column:
    amount = units(value, MONEY_SUM_PLACES)
    return avg_units(F.sum(amount), F.count(amount), MONEY_SUM_PLACES, CENT_PLACES)


def avg_percent(value: Column | str) -> Column:
    """Average of a column that is already a percentage, with one decimal."""
    parts = units(value, PERCENT_SUM_PLACES)
    return avg_units(F.sum(parts), F.count(parts), PERCENT_SUM_PLACES, PERCENT_PLACES)


def avg_share_as_percent(value: Column | str) -> Column:
    """Average of a share, shown as a percentage with one decimal.

    A share with eight decimals is a percentage with six.
    """
    parts = units(value, PERCENT_SUM_PLACES + 2)
    return avg_units(F.sum(parts), F.count(parts), PERCENT_SUM_PLACES, PERCENT_PLACES)


def ratio_percent(part: Column, whole: Column) -> Column:
    """``part / whole`` of two counts or unit totals as a percentage with one decimal."""
    return from_units(
        div_half_up(part.cast("bigint") * F.lit(1000), whole.cast("bigint")), PERCENT_PLACES
    )
