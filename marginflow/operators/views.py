"""The five analytical views.

Every view keeps ``tenant_id`` in its keys, so a tenant predicate on the result is
pushed below the aggregation into the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginflow.functions.numeric import (
    CENT_PLACES,
    MONEY_SUM_PLACES,
    PERCENT_PLACES,
    PERCENT_SUM_PLACES,
    avg_percent,
    avg_share_as_percent,
    avg_units,
    money_total,
    sum_money,
    units,
)
from marginflow.functions.totals import contract_totals as contract_totals  # part of this module's interface
from marginflow.model import TABLE_NAMES, PricingTables

AT_RISK_BELOW_MARGIN = 15
WATCH_ABOVE_DISCOUNT = 0.30


def portfolio_summary(tables: PricingTables) -> DataFrame:
    return tables.transactions.groupBy("tenant_id", "device_category", "deal_structure").agg(
        F.count_distinct("contract_id").alias("contract_count"),
        F.count(F.lit(1)).alias("transaction_count"),
        sum_money("invoice_price", "quantity").alias("total_revenue"),
        avg_percent("margin_pct").alias("avg_margin_pct"),
        avg_share_as_percent("total_discount_pct").alias("avg_discount_pct"),
        sum_money("margin", "quantity").alias("total_margin"),
    )


# Measures of the price waterfall and the columns they average.
WATERFALL_MEASURES = {
    "avg_list_price": "list_price",
    "avg_contract_discount": "list_price - invoice_price",
    "avg_gpo_fee": "gpo_admin_fee",
    "avg_rebate": "rebate_amount",
    "avg_lowest_net": "lowest_net_price",
    "avg_margin": "margin",
    "avg_cost": "unit_cost",
}


def waterfall_states(tables: PricingTables) -> DataFrame:
    """Lines, and unit total and count of each measure, per tenant and category.

    States add up, so averages over any coarser group come from the same scan.
    """
    states = [F.count(F.lit(1)).alias("lines")]
    for name, value in WATERFALL_MEASURES.items():
        amount = units(F.expr(value), MONEY_SUM_PLACES)
        states += [F.sum(amount).alias(f"{name}_units"), F.count(amount).alias(f"{name}_count")]
    return tables.transactions.groupBy("tenant_id", "device_category").agg(*states)


def waterfall_average(name: str) -> Column:
    """The average of a measure, from its state."""
    return avg_units(F.col(f"{name}_units"), F.col(f"{name}_count"), MONEY_SUM_PLACES, CENT_PLACES).alias(name)


def price_waterfall(tables: PricingTables) -> DataFrame:
    return waterfall_states(tables).select(
        "tenant_id", "device_category", *[waterfall_average(name) for name in WATERFALL_MEASURES]
    )


def customer_performance(tables: PricingTables) -> DataFrame:
    """Per customer; ``active_contracts`` counts contracts with transactions, whatever their status.

    Lines are aggregated per customer id first, so the customer table, which grows
    with the data, meets one row per customer and never the line items.
    """
    gpo_names = tables.gpos.select("gpo_id", F.col("name").alias("gpo_name"))
    per_customer = (
        tables.transactions.drop("region", "idn_tier")
        .join(gpo_names, "gpo_id")
        .groupBy("tenant_id", "idn_id", "gpo_name")
        .agg(
            F.count_distinct("contract_id").alias("active_contracts"),
            F.count(F.lit(1)).alias("transaction_count"),
            sum_money("invoice_price", "quantity").alias("total_revenue"),
            avg_percent("margin_pct").alias("avg_margin_pct"),
            avg_share_as_percent("total_discount_pct").alias("avg_discount_pct"),
            sum_money("margin", "quantity").alias("total_margin"),
        )
    )
    customers = tables.idns.select(
        "idn_id", F.col("name").alias("idn_name"), F.col("tier").alias("idn_tier"), "region"
    )
    return per_customer.join(customers, "idn_id").select(
        "tenant_id",
        "idn_id",
        "idn_name",
        "idn_tier",
        "region",
        "gpo_name",
        "active_contracts",
        "transaction_count",
        "total_revenue",
        "avg_margin_pct",
        "avg_discount_pct",
        "total_margin",
    )


def monthly_trends(tables: PricingTables) -> DataFrame:
    """Per month and category.  Ordering is left to the reader of the view."""
    return tables.transactions.groupBy(
        "tenant_id", "year", "month", "quarter", "device_category"
    ).agg(
        F.count(F.lit(1)).alias("transactions"),
        sum_money("invoice_price", "quantity").alias("revenue"),
        avg_percent("margin_pct").alias("avg_margin_pct"),
        avg_share_as_percent("total_discount_pct").alias("avg_discount_pct"),
    )


def risk_status(margin_units: Column, margin_count: Column) -> Column:
    """Risk rule on the unrounded average margin; no lines means no average, never At Risk."""
    threshold = F.lit(AT_RISK_BELOW_MARGIN * 10**PERCENT_SUM_PLACES).cast("bigint")
    return (
        F.when(F.col("aks_risk_flag") == "High", F.lit("Critical"))
        .when(margin_units < threshold * margin_count, F.lit("At Risk"))
        .when(F.col("base_discount_pct") > WATCH_ABOVE_DISCOUNT, F.lit("Watch"))
        .otherwise(F.lit("Healthy"))
    )


def contract_risk(tables: PricingTables) -> DataFrame:
    """Every contract of a known customer once."""
    return (
        tables.totalled_contracts.filter("customer_known")
        .select(
            "tenant_id",
            "contract_id",
            "idn_name",
            "deal_structure",
            "device_category",
            "status",
            "market_share_commitment",
            "base_discount_pct",
            "aks_risk_flag",
            "end_date",
            F.coalesce("line_count", F.lit(0)).alias("transaction_count"),
            avg_units(
                F.col("margin_units"), F.col("margin_count"), PERCENT_SUM_PLACES, PERCENT_PLACES
            ).alias("avg_margin_pct"),
            money_total(F.col("revenue_units")).alias("total_revenue"),
            risk_status(F.col("margin_units"), F.col("margin_count")).alias("risk_status"),
        )
    )


VIEWS = {
    "v_portfolio_summary": portfolio_summary,
    "v_price_waterfall": price_waterfall,
    "v_customer_performance": customer_performance,
    "v_monthly_trends": monthly_trends,
    "v_contract_risk": contract_risk,
}


def register_views(tables: PricingTables, only: tuple[str, ...] | None = None) -> list[str]:
    """Create a temp view per table and analytical view in the tables' own session."""
    wanted = only or (*TABLE_NAMES, *VIEWS)
    for name in wanted:
        frame = VIEWS[name](tables) if name in VIEWS else getattr(tables, name)
        frame.createOrReplaceTempView(name)
    return list(wanted)
