"""Customer drill-down.

Every function takes an optional tenant and customer; without a customer it answers
for all of them at once, unsorted, since the orders mean something within a customer
only.  Both predicates are applied to the tables, not to finished views.  The customer reaches the
scans: on stored tables as a predicate on the id, on the star source as one on the keys the ids
are made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginflow.functions.numeric import (
    PERCENT_PLACES,
    PERCENT_SUM_PLACES,
    avg_money,
    avg_percent,
    avg_share_as_percent,
    avg_units,
    money_total,
)
from marginflow.model import PricingTables
from marginflow.operators import views
from marginflow.operators.frames import top_per_group
from marginflow.operators.predicates import for_tenant


def _of(tables: PricingTables, idn_id: str | None) -> PricingTables:
    return tables if idn_id is None else tables.of_customer(idn_id)


def _sorted(df: DataFrame, idn_id: str | None, *order: str | Column) -> DataFrame:
    return df if idn_id is None else df.orderBy(*order)


def customer_overview(
    tables: PricingTables, tenant: str | None = None, idn_id: str | None = None
) -> DataFrame:
    return for_tenant(views.customer_performance(_of(tables, idn_id)), tenant)


def contract_portfolio(
    tables: PricingTables, tenant: str | None = None, idn_id: str | None = None
) -> DataFrame:
    """Contracts with margin, revenue and risk; Unknown where the customer is missing."""
    margin = avg_units(
        F.col("margin_units"), F.col("margin_count"), PERCENT_SUM_PLACES, PERCENT_PLACES
    )
    known = F.col("customer_known")

    def measured(value, missing):
        return F.coalesce(F.when(known, value), F.lit(missing))

    rows = (
        for_tenant(_of(tables, idn_id).totalled_contracts, tenant)
        .select(
            "tenant_id",
            "idn_id",
            "contract_id",
            "deal_structure",
            "device_category",
            "status",
            "base_discount_pct",
            "market_share_commitment",
            "start_date",
            "end_date",
            "aks_risk_flag",
            measured(margin, 0.0).alias("avg_margin_pct"),
            measured(money_total(F.col("revenue_units")), 0.0).alias("total_revenue"),
            measured(
                views.risk_status(F.col("margin_units"), F.col("margin_count")), "Unknown"
            ).alias("risk_status"),
        )
    )
    return _sorted(rows, idn_id, "status", "end_date", "contract_id")


def pricing_by_category(
    tables: PricingTables, tenant: str | None = None, idn_id: str | None = None
) -> DataFrame:
    rows = (
        for_tenant(_of(tables, idn_id).transactions, tenant)
        .groupBy("tenant_id", "idn_id", "device_category")
        .agg(
            avg_money("list_price").alias("avg_list"),
            avg_money("invoice_price").alias("avg_invoice"),
            avg_money("lowest_net_price").alias("avg_lowest_net"),
            avg_percent("margin_pct").alias("avg_margin_pct"),
            avg_share_as_percent("total_discount_pct").alias("avg_total_discount"),
            F.count(F.lit(1)).alias("txn_count"),
        )
    )
    return _sorted(rows, idn_id, F.desc("avg_list"), "device_category", "tenant_id", "idn_id")


def recent_transactions(
    tables: PricingTables, tenant: str | None = None, idn_id: str | None = None, n: int = 50
) -> DataFrame:
    """Newest ``n`` lines per customer with their product.

    ``product_id`` is a foreign key, so taking the newest lines first and looking the
    product up afterwards gives the same rows with a far smaller join.
    """
    newest = top_per_group(
        for_tenant(_of(tables, idn_id).transactions, tenant).select(
            "tenant_id",
            "idn_id",
            "product_id",
            "transaction_id",
            "transaction_date",
            "quantity",
            "list_price",
            "invoice_price",
            "lowest_net_price",
            "margin_pct",
            "deal_structure",
        ),
        ["tenant_id", "idn_id"],
        [F.desc("transaction_date"), F.asc("transaction_id")],
        n,
    )
    products = tables.products.select("product_id", F.col("name").alias("product_name"), "category")
    rows = newest.join(products, "product_id").select(
        "tenant_id",
        "idn_id",
        "transaction_id",
        "transaction_date",
        "product_name",
        "category",
        "quantity",
        "list_price",
        "invoice_price",
        "lowest_net_price",
        "margin_pct",
        "deal_structure",
    )
    return _sorted(rows, idn_id, "tenant_id", "idn_id", F.desc("transaction_date"), "transaction_id")


def rebates_of_customer(
    tables: PricingTables, tenant: str | None = None, idn_id: str | None = None
) -> DataFrame:
    tables = _of(tables, idn_id)
    contracts = for_tenant(tables.contracts, tenant).select("tenant_id", "idn_id", "contract_id")
    rows = tables.rebate_programs.join(contracts, "contract_id").select(
        "tenant_id",
        "idn_id",
        "rebate_id",
        "contract_id",
        "rebate_type",
        "rebate_pct",
        "trigger_type",
        "trigger_threshold",
        "orientation",
        "earned",
    )
    return _sorted(rows, idn_id, "rebate_type", "rebate_id")
