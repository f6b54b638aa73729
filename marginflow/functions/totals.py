"""Totals per contract, in units that add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow.functions.numeric import PERCENT_SUM_PLACES, money_units, units

# Columns of the totals beside their keys.
TOTALS = "line_count bigint, margin_count bigint, margin_units bigint, revenue_units bigint"


def contract_totals(transactions: DataFrame, key: str = "contract_id") -> DataFrame:
    """One row per contract with unit totals, aggregated before any join."""
    margin = units("margin_pct", PERCENT_SUM_PLACES)
    return transactions.groupBy("tenant_id", key).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count(margin).alias("margin_count"),
        F.sum(margin).alias("margin_units"),
        F.sum(money_units("invoice_price", "quantity")).alias("revenue_units"),
    )
