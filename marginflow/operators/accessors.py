"""Tenant-scoped reads of the views, and the value lists behind the page filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow.model import PricingTables
from marginflow.operators import views
from marginflow.operators.predicates import VIEW_DIMENSIONS, Filters, apply_filters, for_tenant


def portfolio_summary(
    tables: PricingTables, tenant: str | None, filters: Filters | None = None
) -> DataFrame:
    view = for_tenant(views.portfolio_summary(tables), tenant)
    return apply_filters(view, filters, VIEW_DIMENSIONS["portfolio"])


def price_waterfall(
    tables: PricingTables, tenant: str | None, filters: Filters | None = None
) -> DataFrame:
    view = for_tenant(views.price_waterfall(tables), tenant)
    return apply_filters(view, filters, VIEW_DIMENSIONS["waterfall"])


def customer_performance(
    tables: PricingTables, tenant: str | None, filters: Filters | None = None
) -> DataFrame:
    view = for_tenant(views.customer_performance(tables), tenant)
    return apply_filters(view, filters, VIEW_DIMENSIONS["customers"]).orderBy(
        F.desc_nulls_last("total_revenue"), "idn_id", "tenant_id"
    )


def monthly_trends(
    tables: PricingTables, tenant: str | None, filters: Filters | None = None
) -> DataFrame:
    view = for_tenant(views.monthly_trends(tables), tenant)
    return apply_filters(view, filters, VIEW_DIMENSIONS["trends"]).orderBy(
        "year", "month", "device_category", "tenant_id"
    )


def contract_risk(
    tables: PricingTables, tenant: str | None, filters: Filters | None = None
) -> DataFrame:
    """Sorted by risk text, then revenue.

    The contract id ends the sort key: contracts without revenue are many, and a
    shared key would send all of them to one range partition.
    """
    view = for_tenant(views.contract_risk(tables), tenant)
    return apply_filters(view, filters, VIEW_DIMENSIONS["risk"]).orderBy(
        "risk_status", F.desc_nulls_last("total_revenue"), "contract_id"
    )


def device_categories(tables: PricingTables, tenant: str | None) -> DataFrame:
    lines = for_tenant(tables.transactions, tenant)
    return lines.select("device_category").distinct().orderBy("device_category")


def regions(tables: PricingTables, tenant: str | None) -> DataFrame:
    return for_tenant(tables.transactions, tenant).select("region").distinct().orderBy("region")


def gpo_names(tables: PricingTables, tenant: str | None) -> DataFrame:
    """Names of the buying groups a tenant trades with; the ids are reduced before the join."""
    traded = for_tenant(tables.transactions, tenant).select("gpo_id").distinct()
    return tables.gpos.join(traded, "gpo_id", "left_semi").select("name").distinct().orderBy("name")


def idn_list(tables: PricingTables, tenant: str | None) -> DataFrame:
    """Customers a tenant trades with; the ids are reduced before the join."""
    traded = for_tenant(tables.transactions, tenant).select("idn_id").distinct()
    return (
        tables.idns.join(traded, "idn_id", "left_semi")
        .select("idn_id", "name", "tier", "region")
        .orderBy("name", "idn_id")
    )
