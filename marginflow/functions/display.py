"""Display text for KPI values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginflow.functions.numeric import round_half_up


def grouped_integer(value: Column) -> Column:
    """Whole number with thousands separators; any fraction is dropped."""
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return F.format_number(whole.cast("bigint"), 0)


def currency(value: Column) -> Column:
    """$1.2B, $3.4M, $5.6K, or whole dollars below a thousand."""

    def scaled(divisor: float, suffix: str) -> Column:
        return F.concat(
            F.lit("$"),
            round_half_up(value / F.lit(divisor), 1).cast("decimal(28,1)").cast("string"),
            F.lit(suffix),
        )

    return (
        F.when(value >= 1e9, scaled(1e9, "B"))
        .when(value >= 1e6, scaled(1e6, "M"))
        .when(value >= 1e3, scaled(1e3, "K"))
        .otherwise(F.concat(F.lit("$"), F.format_number(round_half_up(value, 0).cast("bigint"), 0)))
    )


def millions(value: Column) -> Column:
    """$12.3M whatever the size: the label of a bar."""
    tenths = round_half_up(value / F.lit(1e6), 1).cast("decimal(28,1)").cast("string")
    return F.concat(F.lit("$"), tenths, F.lit("M"))


def percent(value: Column) -> Column:
    return F.concat(value.cast("decimal(18,1)").cast("string"), F.lit("%"))


def display_text(value: Column, kind: Column) -> Column:
    """Text of ``value`` by its format name; a missing value shows as zero."""
    shown = F.coalesce(value, F.lit(0.0))
    return (
        F.when(kind == "currency", currency(shown))
        .when(kind == "percent", percent(shown))
        .otherwise(grouped_integer(shown))
    )


def attention_note(value: Column) -> Column:
    """What the card of the deals at risk says below their number."""
    return F.concat(value.cast("bigint").cast("string"), F.lit(" need attention"))
