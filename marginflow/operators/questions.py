"""The catalogue of business questions, one function each.

``tenant=None`` answers over all tenants.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow.functions.calendar import days_until
from marginflow.functions.numeric import (
    PERCENT_PLACES,
    PERCENT_SUM_PLACES,
    avg_money,
    avg_percent,
    avg_share_as_percent,
    avg_units,
    money_total,
    money_units,
    ratio_percent,
    sum_money,
    units,
)
from marginflow.model import RISK_STATUSES, PricingTables
from marginflow.operators import views
from marginflow.operators.predicates import for_tenant


def revenue_by_category(tables: PricingTables, tenant: str | None = None) -> DataFrame:
    return (
        for_tenant(tables.transactions, tenant)
        .groupBy("device_category")
        .agg(sum_money("invoice_price", "quantity").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "device_category")
    )


def margin_by_structure(tables: PricingTables, tenant: str | None = None) -> DataFrame:
    return (
        for_tenant(tables.transactions, tenant)
        .groupBy("deal_structure")
        .agg(
            avg_percent("margin_pct").alias("avg_margin_pct"),
            F.count(F.lit(1)).alias("transactions"),
        )
        .orderBy(F.desc("avg_margin_pct"), "deal_structure")
    )


def lowest_margin_customers(
    tables: PricingTables, tenant: str | None = None, more_than: int = 10, n: int = 10
) -> DataFrame:
    """Customers with more than ``more_than`` lines, thinnest margin first.

    Lines are totalled per customer id before the customer names are joined; the
    totals are then merged per name and tier.
    """
    margin = units("margin_pct", PERCENT_SUM_PLACES)
    per_id = (
        for_tenant(tables.transactions, tenant)
        .groupBy("idn_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count(margin).alias("margin_count"),
            F.sum(margin).alias("margin_units"),
            F.sum(money_units("invoice_price", "quantity")).alias("revenue_units"),
        )
    )
    customers = tables.idns.select("idn_id", F.col("name").alias("customer"), "tier")
    return (
        per_id.join(customers, "idn_id")
        .groupBy("customer", "tier")
        .agg(
            F.sum("lines").alias("_lines"),
            avg_units(
                F.sum("margin_units"), F.sum("margin_count"), PERCENT_SUM_PLACES, PERCENT_PLACES
            ).alias("avg_margin"),
            money_total(F.sum("revenue_units")).alias("revenue"),
        )
        .filter(F.col("_lines") > more_than)
        .drop("_lines")
        .orderBy(F.asc_nulls_last("avg_margin"), "customer", "tier")
        .limit(n)
    )


def category_waterfall(
    tables: PricingTables, category: str = "Orthopedic Implants", tenant: str | None = None
) -> DataFrame:
    return (
        for_tenant(tables.transactions, tenant)
        .filter(F.col("device_category") == F.lit(category))
        .agg(
            avg_money("list_price").alias("avg_list_price"),
            avg_money(F.col("list_price") - F.col("invoice_price")).alias("avg_contract_discount"),
            avg_money("gpo_admin_fee").alias("avg_gpo_fee"),
            avg_money("rebate_amount").alias("avg_rebate"),
            avg_money("lowest_net_price").alias("avg_lowest_net"),
        )
    )


def contracts_at_risk(tables: PricingTables, tenant: str | None = None) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in RISK_STATUSES]), F.col("risk_status"))
    return (
        for_tenant(views.contract_risk(tables), tenant)
        .groupBy("risk_status")
        .agg(F.count(F.lit(1)).alias("contract_count"))
        .orderBy(rank)
    )


def margin_by_quarter(tables: PricingTables, tenant: str | None = None) -> DataFrame:
    """In calendar order; the quarter text alone would sort by quarter number first."""
    return (
        for_tenant(tables.transactions, tenant)
        .groupBy("quarter", "year", F.quarter("transaction_date").alias("quarter_of_year"))
        .agg(
            avg_percent("margin_pct").alias("avg_margin"),
            sum_money("invoice_price", "quantity").alias("total_revenue"),
            F.count(F.lit(1)).alias("transactions"),
        )
        .orderBy("year", "quarter_of_year")
    )


def margin_by_gpo(tables: PricingTables, tenant: str | None = None) -> DataFrame:
    names = tables.gpos.select("gpo_id", F.col("name").alias("gpo_name"))
    return (
        for_tenant(tables.transactions, tenant)
        .join(names, "gpo_id")
        .groupBy("gpo_name")
        .agg(
            avg_percent("margin_pct").alias("avg_margin"),
            sum_money("invoice_price", "quantity").alias("total_revenue"),
            F.count_distinct("contract_id").alias("contracts"),
        )
        .orderBy(F.desc("avg_margin"), "gpo_name")
    )


def rebate_earn_rates(tables: PricingTables, tenant: str | None = None) -> DataFrame:
    """Rebates have no tenant of their own; a tenant is reached through its contracts."""
    rebates = tables.rebate_programs
    if tenant is not None:
        own = for_tenant(tables.contracts, tenant).select("contract_id")
        rebates = rebates.join(own, "contract_id", "left_semi")
    earned = F.count_if("earned")
    return (
        rebates.groupBy("rebate_type")
        .agg(
            F.count(F.lit(1)).alias("total_programs"),
            earned.alias("earned_count"),
            avg_share_as_percent("rebate_pct").alias("avg_rebate_pct"),
            ratio_percent(earned, F.count(F.lit(1))).alias("earn_rate_pct"),
        )
        .orderBy(F.desc("earn_rate_pct"), "rebate_type")
    )


def revenue_by_region(tables: PricingTables, tenant: str | None = None) -> DataFrame:
    return (
        for_tenant(tables.transactions, tenant)
        .groupBy("region")
        .agg(
            sum_money("invoice_price", "quantity").alias("total_revenue"),
            avg_percent("margin_pct").alias("avg_margin"),
            F.count_distinct("idn_id").alias("customers"),
        )
        .orderBy(F.desc("total_revenue"), "region")
    )


def highest_price_erosion(
    tables: PricingTables, tenant: str | None = None, more_than: int = 20, n: int = 10
) -> DataFrame:
    """Products sold on more than ``more_than`` lines, deepest discount first.

    Lines are totalled per product id before the product names are joined.
    """
    share = units("total_discount_pct", PERCENT_SUM_PLACES + 2)
    per_id = (
        for_tenant(tables.transactions, tenant)
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count(share).alias("share_count"),
            F.sum(share).alias("share_units"),
        )
    )
    products = tables.products.select("product_id", F.col("name").alias("product"), "category")
    return (
        per_id.join(products, "product_id")
        .groupBy("product", "category")
        .agg(
            F.sum("lines").alias("_lines"),
            # a share with eight decimals is a percentage with six
            avg_units(
                F.sum("share_units"), F.sum("share_count"), PERCENT_SUM_PLACES, PERCENT_PLACES
            ).alias("avg_discount_pct"),
        )
        .filter(F.col("_lines") > more_than)
        .drop("_lines")
        .orderBy(F.desc_nulls_last("avg_discount_pct"), "product", "category")
        .limit(n)
    )


def expiring_contracts(
    tables: PricingTables, as_of: dt.date, tenant: str | None = None, within_days: int = 30
) -> DataFrame:
    left = days_until(F.col("end_date"), as_of)
    return (
        for_tenant(tables.contracts, tenant)
        .select("contract_id", "start_date", "end_date", left.alias("days_until_expiration"))
        .filter(F.col("days_until_expiration").between(0, within_days))
        .orderBy("days_until_expiration", "contract_id")
    )
