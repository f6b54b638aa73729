"""Calendar columns and contract dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_CONTRACT_MONTH = 30


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day))


def with_calendar(df: DataFrame, day: str) -> DataFrame:
    """Add ``quarter`` ("Q1 2024"), ``year`` and ``month`` of a date column."""
    return df.withColumns(
        {
            "quarter": quarter_label(F.col(day)),
            "year": F.year(day),
            "month": F.month(day),
        }
    )


def contract_end(start: Column, months: Column) -> Column:
    return F.date_add(start, months * DAYS_PER_CONTRACT_MONTH)


def contract_status(start: Column, end: Column, renewed: Column, as_of: dt.date) -> Column:
    """Status of a contract on ``as_of``; ``renewed`` settles what follows the end date."""
    today = F.lit(as_of)
    return (
        F.when(end < today, F.when(renewed, F.lit("Renewed")).otherwise(F.lit("Expired")))
        .when(start > today, F.lit("Pending"))
        .otherwise(F.lit("Active"))
    )


def days_until(day: Column, as_of: dt.date) -> Column:
    return F.datediff(day, F.lit(as_of))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))
