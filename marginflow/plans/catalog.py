"""Named queries over a star-schema directory, one per operator or report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginflow.functions.calendar import with_calendar
from marginflow.functions.display import display_text
from marginflow.functions.numeric import cents
from marginflow.model import TABLE_NAMES
from marginflow.operators import accessors, conformance, customer, derive, frames, kpis, questions, views
from marginflow.operators.predicates import (
    VIEW_DIMENSIONS,
    Filters,
    apply_filters,
    for_tenant,
    in_gpo,
    in_range,
)
from marginflow.operators.tenancy import ScopedTables, TenantSession
from marginflow.sources import store
from marginflow.sources.star import AS_OF, StarTables

TENANT = "tenant_a"
CHOICE = Filters(category="Cardiovascular", region="ASIA", structure="PV", gpo="BUILDING")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def open_star(spark: SparkSession, directory: str) -> StarTables:
    """Tables of a directory, opened anew so that files added since are seen."""
    return StarTables(spark, directory)


def _query(name: str):
    """Register a function of the star tables under ``name``."""

    def add(build: Callable[[StarTables], DataFrame]):
        _QUERIES[name] = lambda spark, directory: build(open_star(spark, directory))
        return build

    return add


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _tenant_session(tables: StarTables, tenant: str = TENANT) -> TenantSession:
    directory = tables.directory
    return TenantSession(tables.spark, lambda child: StarTables(child, directory), tenant)


# --- tables, sources, sinks -------------------------------------------------


def _register_tables() -> None:
    for name in TABLE_NAMES:
        _query(f"table_{name}")(lambda t, name=name: getattr(t, name))


_register_tables()


@_query("s1_csv_layer_contracts")
def _csv_contracts(t: StarTables) -> DataFrame:
    folder = store.scratch_folder(t.spark)
    store.write_csv(t, folder, ("contracts",))
    return store.read_csv(t.spark, folder, "contracts")


@_query("s2_csv_layer_transactions")
def _csv_transactions(t: StarTables) -> DataFrame:
    folder = store.scratch_folder(t.spark)
    store.write_csv(t, folder, ("transactions",))
    return store.read_csv(t.spark, folder, "transactions")


@_query("s3_store_portfolio_summary")
def _store_summary(t: StarTables) -> DataFrame:
    """Rebuild the store's fact table, then read the portfolio view from the store."""
    folder = store.scratch_folder(t.spark)
    store.write_store(t, folder, ("transactions",))
    return views.portfolio_summary(store.StoredTables(t.spark, folder))


def _register_layers() -> None:
    """Every table through the CSV layer and through the store."""

    def by_csv(t: StarTables, name: str) -> DataFrame:
        folder = store.scratch_folder(t.spark)
        store.write_csv(t, folder, (name,))
        return store.read_csv(t.spark, folder, name)

    def by_store(t: StarTables, name: str) -> DataFrame:
        folder = store.scratch_folder(t.spark)
        store.write_store(t, folder, (name,))
        return getattr(store.StoredTables(t.spark, folder), name)

    for name in TABLE_NAMES:
        _query(f"s2_csv_{name}")(lambda t, name=name: by_csv(t, name))
        _query(f"s3_store_{name}")(lambda t, name=name: by_store(t, name))


_register_layers()


@_query("s4_parse_contract_dates")
def _dates(t: StarTables) -> DataFrame:
    as_text = t.contracts.withColumns(
        {
            "start_date": F.date_format("start_date", "yyyy-MM-dd"),
            "end_date": F.date_format("end_date", "yyyy-MM-dd"),
        }
    )
    return store.parse_dates(as_text, "contracts").select("contract_id", "start_date", "end_date")


@_query("s6_registered_view")
def _registered(t: StarTables) -> DataFrame:
    views.register_views(t, ("v_customer_performance",))
    return t.spark.sql(
        "SELECT tenant_id, idn_tier, count(*) AS customers, sum(transaction_count) AS transactions "
        "FROM v_customer_performance GROUP BY tenant_id, idn_tier"
    )


@_query("s6_registered_views")
def _all_registered(t: StarTables) -> DataFrame:
    """Rows of each of the five views, read by name."""
    views.register_views(t, tuple(views.VIEWS))
    return t.spark.sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS view_name, count(*) AS row_count FROM {name}" for name in views.VIEWS
        )
    )


@_query("s7_row_counts")
def _row_counts(t: StarTables) -> DataFrame:
    return store.row_counts(t)


@_query("s8_parameterised_query")
def _parameterised(t: StarTables) -> DataFrame:
    views.register_views(t, ("contracts",))
    return t.spark.sql(
        "SELECT contract_id, status, end_date FROM contracts "
        "WHERE tenant_id = ? AND deal_structure = ?",
        args=[TENANT, "PV"],
    )


@_query("s9_scalar_query")
def _scalar(t: StarTables) -> DataFrame:
    session = _tenant_session(t)
    return session.scalar(
        "SELECT count(*) FROM contracts WHERE status = :status", {"status": "Active"}
    )


@_query("s9_scalar_query_no_row")
def _scalar_none(t: StarTables) -> DataFrame:
    session = _tenant_session(t)
    return session.scalar(
        "SELECT quantity FROM transactions WHERE device_category = :category",
        {"category": "no such category"},
    )


_SCALARS = {
    "s9_scalar_text": "SELECT max(device_category) FROM transactions",
    "s9_scalar_date": "SELECT max(transaction_date) FROM transactions",
    "s9_scalar_null": "SELECT max(quantity) FROM transactions WHERE device_category = 'no such category'",
}


def _register_scalars() -> None:
    for name, text in _SCALARS.items():
        _query(name)(lambda t, text=text: _tenant_session(t).scalar(text))


_register_scalars()


@_query("s10_metric_table")
def _metrics(t: StarTables) -> DataFrame:
    return kpis.metric_table(_tenant_session(t))


# --- derivations ------------------------------------------------------------

_DERIVED_COLUMNS = {
    "d1_invoice_price": ("list_price", "base_discount_pct", "invoice_price"),
    "d2_gpo_admin_fee": ("gpo_id", "invoice_price", "gpo_admin_fee"),
    "d3_rebate_amount": ("invoice_price", "rebate_pct", "rebate_amount"),
    "d4_lowest_net_price": ("invoice_price", "gpo_admin_fee", "rebate_amount", "lowest_net_price"),
    "d5_margin": ("lowest_net_price", "unit_cost", "margin", "margin_pct"),
    "d6_total_discount": ("list_price", "lowest_net_price", "total_discount_pct"),
    "d8_denormalised": (
        "tenant_id",
        "gpo_id",
        "deal_structure",
        "device_category",
        "region",
        "idn_tier",
    ),
}


def _register_derived() -> None:
    for name, columns in _DERIVED_COLUMNS.items():
        _query(name)(
            lambda t, columns=columns: t.priced_lines.select("transaction_id", *columns)
        )


_register_derived()


@_query("d7_calendar")
def _calendar(t: StarTables) -> DataFrame:
    return with_calendar(
        t.contracts.select("contract_id", "start_date"), "start_date"
    )


@_query("d8_line_outcomes")
def _outcomes(t: StarTables) -> DataFrame:
    return derive.line_outcomes(
        t.lines, t.numbered_deals, t.numbered_products, t.gpos, "contract_key", "product_key"
    )


@_query("d9_eligible_contracts")
def _eligible(t: StarTables) -> DataFrame:
    return derive.eligible_contracts(t.contracts).select("contract_id", "tenant_id", "status")


@_query("d10_contract_end")
def _contract_end(t: StarTables) -> DataFrame:
    return t.contracts.select("contract_id", "start_date", "duration_months").transform(
        derive.with_end_date
    )


@_query("d11_contract_status")
def _contract_status(t: StarTables) -> DataFrame:
    return t.contracts.select("contract_id", "start_date", "end_date", "status")


@_query("d12_base_discount")
def _base_discount(t: StarTables) -> DataFrame:
    return t.customer_contracts.select(
        "contract_id", "deal_structure", "idn_tier", "base_discount_pct"
    )


@_query("d13_commitment_check")
def _commitment(t: StarTables) -> DataFrame:
    return t.contracts.select(
        "contract_id", "deal_structure", "market_share_commitment"
    ).transform(derive.with_commitment_check)


@_query("d14_idn_tier")
def _tier(t: StarTables) -> DataFrame:
    return t.idns.select("idn_id", "facility_count").transform(derive.with_idn_tier)


@_query("d15_quantity_clamp")
def _quantity(t: StarTables) -> DataFrame:
    """Quantity of each line beside what the bounds of a made-up line would leave of it."""
    return t.lines.select(
        F.col("contract_key").cast("string").alias("contract_id"),
        F.col("l_linenumber").cast("bigint").alias("line_number"),
        F.col("quantity").cast("bigint").alias("ordered"),
        "quantity",
    ).transform(derive.with_quantity_clamped, "quantity", 5, 40)


@_query("d16_rebate_check")
def _rebate_check(t: StarTables) -> DataFrame:
    return t.rebate_programs.select(
        "rebate_id", "rebate_type", "trigger_type", "rebate_pct"
    ).transform(derive.with_rebate_check)


@_query("d13_commitment_conformance")
def _commitment_report(t: StarTables) -> DataFrame:
    """How many contracts keep the units they sold to the band of their structure."""
    shares = conformance.unit_shares(t.lines, "contract_key", "product_key")
    deals = t.numbered_deals.select("contract_key", "deal_structure")
    return conformance.violation_report(deals.join(shares, "contract_key"), conformance.commitment_rules())


@_query("d16_rebate_conformance")
def _rebate_report(t: StarTables) -> DataFrame:
    """How many programs have a type whose band the rates granted on the contract's lines keep to."""
    rates = conformance.average_rates(t.lines, "contract_key", "rebate_pct").select(
        F.col("contract_key").cast("string").alias("contract_id"), "rate_units", "rate_count"
    )
    programs = t.rebate_programs.select("contract_id", "rebate_type")
    return conformance.violation_report(programs.join(rates, "contract_id"), conformance.rebate_rules())


@_query("d_line_conformance")
def _line_report(t: StarTables) -> DataFrame:
    """Rules of the sold lines themselves, all counted in one pass."""
    orders = t.raw("orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").cast("date").alias("ordered"),
        F.col("o_totalprice").alias("order_total"),
    )
    lines = t.raw("lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").cast("date").alias("sold"),
    )
    joined = lines.join(orders, "order_key", "left")
    return conformance.violation_report(joined, conformance.line_rules())


@_query("d17_surrogate_ids")
def _ids(t: StarTables) -> DataFrame:
    return t.contracts.select(
        "contract_id",
        derive.surrogate_id("CTR", F.col("contract_id"), 4).alias("contract_code"),
        derive.surrogate_id("IDN", F.col("idn_id"), 3).alias("idn_code"),
    )


@_query("d18_price_transactions")
def _price_transactions(t: StarTables) -> DataFrame:
    return t.transactions


# --- views ------------------------------------------------------------------


def _register_views() -> None:
    names = ("portfolio_summary", "price_waterfall", "customer_performance", "monthly_trends")
    for number, name in enumerate((*names, "contract_risk"), start=1):
        _query(f"v{number}_{name}")(views.VIEWS[f"v_{name}"])


_register_views()

# --- predicates and tenancy -------------------------------------------------


@_query("p1_tenant_predicate")
def _tenant_predicate(t: StarTables) -> DataFrame:
    either = (F.col("status") == "Active") | (F.col("aks_risk_flag") == "High")
    return for_tenant(t.contracts, TENANT, either).select("contract_id", "tenant_id", "status")


@_query("p2_dimension_filters")
def _dimension_filters(t: StarTables) -> DataFrame:
    chosen = Filters(category="Cardiovascular", region="ASIA", structure="All")
    return apply_filters(t.transactions, chosen, VIEW_DIMENSIONS["kpis"]).select(
        "transaction_id", "device_category", "region", "deal_structure"
    )


@_query("p3_gpo_filter_on_table")
def _gpo_table(t: StarTables) -> DataFrame:
    return in_gpo(t.contracts, t.gpos, "BUILDING").select("contract_id", "gpo_id")


@_query("p4_gpo_filter_on_view")
def _gpo_view(t: StarTables) -> DataFrame:
    view = views.customer_performance(t)
    return apply_filters(view, Filters(gpo="BUILDING"), VIEW_DIMENSIONS["customers"])


@_query("p5_dimensions_per_view")
def _dimensions(t: StarTables) -> DataFrame:
    """The same selection narrows the waterfall by category and ignores the rest."""
    return apply_filters(views.price_waterfall(t), CHOICE, VIEW_DIMENSIONS["waterfall"])


@_query("p6_in_list")
def _in_list(t: StarTables) -> DataFrame:
    view = views.contract_risk(t)
    return view.filter(F.col("risk_status").isin("Critical", "At Risk")).select(
        "contract_id", "risk_status"
    )


@_query("p7_range")
def _range(t: StarTables) -> DataFrame:
    lines = t.transactions.select("transaction_id", "margin_pct")
    return in_range(lines, "margin_pct", 0, 30)


@_query("p8_having")
def _having(t: StarTables) -> DataFrame:
    lines = t.transactions.groupBy("idn_id").agg(F.count(F.lit(1)).alias("transactions"))
    return lines.filter(F.col("transactions") > 20)


@_query("p9_tenant_sql")
def _tenant_sql(t: StarTables) -> DataFrame:
    """Free text with a common table, lower-case where and an OR stays inside the tenant."""
    return _tenant_session(t).sql(
        """
        with open_deals as (
            select tenant_id, contract_id from contracts
            where status = 'Active' or aks_risk_flag = 'High' or 1 = 1
        )
        select o.tenant_id, r.risk_status, count(*) as contract_count
        from open_deals o join v_contract_risk r on o.contract_id = r.contract_id
        group by o.tenant_id, r.risk_status
        """
    )


@_query("p10_scoped_tables")
def _scoped(t: StarTables) -> DataFrame:
    """Rows of every table and view that a tenant sees."""
    scoped = ScopedTables(t, TENANT)
    counts = store.row_counts(scoped, (*TABLE_NAMES, "customer_contracts"))
    for name, view in views.VIEWS.items():
        rows = view(scoped).agg(F.count(F.lit(1)).alias("row_count"))
        counts = counts.unionByName(rows.select(F.lit(name).alias("table_name"), "row_count"))
    return counts


# --- accessors --------------------------------------------------------------


def _register_accessors() -> None:
    filtered = {
        "a1_portfolio_summary": accessors.portfolio_summary,
        "a2_price_waterfall": accessors.price_waterfall,
        "a3_customer_performance": accessors.customer_performance,
        "a4_monthly_trends": accessors.monthly_trends,
        "a5_contract_risk": accessors.contract_risk,
    }
    for name, read in filtered.items():
        _query(name)(lambda t, read=read: read(t, TENANT))
        _query(f"{name}_filtered")(lambda t, read=read: read(t, TENANT, CHOICE))
    lists = {
        "a6_device_categories": accessors.device_categories,
        "a7_regions": accessors.regions,
        "a8_gpo_names": accessors.gpo_names,
        "a9_idn_list": accessors.idn_list,
    }
    for name, read in lists.items():
        _query(name)(lambda t, read=read: read(t, TENANT))


_register_accessors()

# --- KPIs -------------------------------------------------------------------

_query("k1_total_revenue")(lambda t: kpis.total_revenue(t, TENANT, CHOICE))
_query("k2_average_margin")(lambda t: kpis.average_margin(t, TENANT, CHOICE))
_query("k3_active_contracts")(lambda t: kpis.active_contracts(t, TENANT))
_query("k4_at_risk_deals")(lambda t: kpis.at_risk_deals(t, TENANT, CHOICE))
_query("k5_revenue_of_year")(lambda t: kpis.revenue_of_year(t, 1999, TENANT))
_query("k5_revenue_growth")(lambda t: kpis.revenue_growth(t))
_query("k6_at_risk_alert")(lambda t: kpis.with_alert(kpis.at_risk_deals(t), 10))
_query("k_portfolio_row")(lambda t: kpis.portfolio_kpis(t, TENANT))
_query("k_portfolio_row_filtered")(lambda t: kpis.portfolio_kpis(t, TENANT, CHOICE))
_query("k8_customer_kpis")(lambda t: kpis.customer_kpis(t))


@_query("k7_display_text")
def _display(t: StarTables) -> DataFrame:
    """Contract revenue as currency, its cents as a count and its margin as a percentage."""
    view = views.contract_risk(t)
    return view.select(
        "contract_id",
        display_text(F.col("total_revenue"), F.lit("currency")).alias("revenue_text"),
        display_text(cents("total_revenue").cast("double"), F.lit("integer")).alias("cents_text"),
        display_text(F.col("avg_margin_pct"), F.lit("percent")).alias("margin_text"),
    )


# --- chart frames -----------------------------------------------------------

_query("c1_waterfall_category")(
    lambda t: frames.waterfall_category(views.price_waterfall(t), "Consumables")
)
_query("c2_waterfall_all")(lambda t: frames.waterfall_all(views.price_waterfall(t)))
_query("c2_waterfall_weighted")(lambda t: frames.waterfall_by_lines(views.waterfall_states(t)))
_query("c3_waterfall_steps")(lambda t: frames.waterfall_steps(views.price_waterfall(t)))
_query("c3_waterfall_steps_all")(
    lambda t: frames.waterfall_steps(frames.waterfall_all(views.price_waterfall(t)))
)
_query("c4_margin_trend")(lambda t: frames.margin_trend(views.monthly_trends(t)))
_query("c4_margin_trend_weighted")(
    lambda t: frames.margin_trend(views.monthly_trends(t), weighted=True)
)
_query("c5_margin_alerts")(
    lambda t: frames.margin_alerts(frames.margin_trend(views.monthly_trends(t)))
)
_query("c6_revenue_by_category")(lambda t: frames.revenue_by_category(views.portfolio_summary(t)))
_query("c6_revenue_by_category_weighted")(
    lambda t: frames.revenue_by_category(views.portfolio_summary(t), weighted=True)
)
_query("c7_deal_structure_mix")(lambda t: frames.deal_structure_mix(views.portfolio_summary(t)))
_query("c8_top_customers")(lambda t: frames.top_customers(views.customer_performance(t)))
_query("c9_concentration")(lambda t: frames.concentration(views.customer_performance(t)))
_query("c10_risk_distribution")(lambda t: frames.risk_distribution(views.contract_risk(t)))
_query("c11_revenue_by_region")(lambda t: frames.revenue_by_region(views.customer_performance(t)))
_query("c11_revenue_by_region_weighted")(
    lambda t: frames.revenue_by_region(views.customer_performance(t), weighted=True)
)
_query("c12_needing_attention")(
    lambda t: frames.display_table(
        frames.needing_attention(views.contract_risk(t)), "attention", ("tenant_id",)
    )
)
_query("c12_needing_attention_by_severity")(
    lambda t: frames.needing_attention(views.contract_risk(t), by_severity=True)
)
_query("c13_display_contracts")(
    lambda t: frames.display_table(customer.contract_portfolio(t), "contracts", ("tenant_id", "idn_id"))
)
_query("c13_display_pricing")(
    lambda t: frames.display_table(customer.pricing_by_category(t), "pricing", ("tenant_id", "idn_id"))
)
_query("c13_display_recent")(
    lambda t: frames.display_table(customer.recent_transactions(t), "recent", ("tenant_id", "idn_id"))
)
_query("c13_display_rebates")(
    lambda t: frames.display_table(customer.rebates_of_customer(t), "rebates", ("tenant_id", "idn_id"))
)
_query("c14_structure_counts")(
    lambda t: frames.value_counts(customer.contract_portfolio(t), "deal_structure")
)
_query("c15_risk_counts")(
    lambda t: frames.value_counts(customer.contract_portfolio(t), "risk_status")
)
_query("c16_price_series")(lambda t: frames.price_series(customer.pricing_by_category(t)))
_query("c17_rebate_summary")(lambda t: frames.rebate_summary(customer.rebates_of_customer(t)))

# --- customer drill-down ----------------------------------------------------

_query("q1_customer_overview")(lambda t: customer.customer_overview(t))
_query("q2_contract_portfolio")(lambda t: customer.contract_portfolio(t))
_query("q3_pricing_by_category")(lambda t: customer.pricing_by_category(t))
_query("q4_recent_transactions")(lambda t: customer.recent_transactions(t))
_query("q5_rebate_programs")(lambda t: customer.rebates_of_customer(t))

ONE_CUSTOMER = "12"


def _register_one_customer() -> None:
    """The same five reports of one customer, whose key reaches the scans."""
    for name, report in {
        "q1_customer_overview": customer.customer_overview,
        "q2_contract_portfolio": customer.contract_portfolio,
        "q3_pricing_by_category": customer.pricing_by_category,
        "q4_recent_transactions": customer.recent_transactions,
        "q5_rebate_programs": customer.rebates_of_customer,
    }.items():
        _query(f"{name}_one")(lambda t, report=report: report(t, None, ONE_CUSTOMER))


_register_one_customer()

# --- questions --------------------------------------------------------------

_query("n1_revenue_by_category")(lambda t: questions.revenue_by_category(t))
_query("n2_margin_by_structure")(lambda t: questions.margin_by_structure(t))
_query("n3_lowest_margin_customers")(lambda t: questions.lowest_margin_customers(t))
_query("n4_category_waterfall")(lambda t: questions.category_waterfall(t))
_query("n5_contracts_at_risk")(lambda t: questions.contracts_at_risk(t))
_query("n6_margin_by_quarter")(lambda t: questions.margin_by_quarter(t))
_query("n7_margin_by_gpo")(lambda t: questions.margin_by_gpo(t))
_query("n8_rebate_earn_rates")(lambda t: questions.rebate_earn_rates(t))
_query("n8_rebate_earn_rates_tenant")(lambda t: questions.rebate_earn_rates(t, TENANT))
_query("n9_revenue_by_region")(lambda t: questions.revenue_by_region(t))
_query("n10_highest_price_erosion")(lambda t: questions.highest_price_erosion(t))
_query("n11_expiring_contracts")(lambda t: questions.expiring_contracts(t, AS_OF))
