"""KPIs, the page's KPI row, customer KPIs and the configurable metric table."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginflow.functions.display import attention_note, currency, display_text, grouped_integer, percent
from marginflow.functions.numeric import (
    PERCENT_PLACES,
    PERCENT_SUM_PLACES,
    avg_percent,
    avg_units,
    cents,
    money_total,
    money_units,
    round_half_up,
    sum_money,
    units,
)
from marginflow.model import ATTENTION_STATUSES, PricingTables
from marginflow.operators import customer, views
from marginflow.operators.fusion import fused
from marginflow.operators.predicates import (
    VIEW_DIMENSIONS,
    Filters,
    apply_filters,
    dimension_condition,
    for_tenant,
)
from marginflow.operators.tenancy import TenantSession

CUSTOMER_MARGIN_TARGET = 20


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("double"))


def _lines(tables: PricingTables, tenant: str | None, filters: Filters | None) -> DataFrame:
    lines = for_tenant(tables.transactions, tenant)
    return apply_filters(lines, filters, VIEW_DIMENSIONS["kpis"], tables.gpos)


def total_revenue(
    tables: PricingTables, tenant: str | None = None, filters: Filters | None = None
) -> DataFrame:
    revenue = sum_money("invoice_price", "quantity")
    return _lines(tables, tenant, filters).agg(or_zero(revenue).alias("value"))


def average_margin(
    tables: PricingTables, tenant: str | None = None, filters: Filters | None = None
) -> DataFrame:
    return _lines(tables, tenant, filters).agg(or_zero(avg_percent("margin_pct")).alias("value"))


def active_contracts(tables: PricingTables, tenant: str | None = None) -> DataFrame:
    """Counts by status alone; page filters do not apply."""
    return (
        for_tenant(tables.contracts, tenant)
        .filter(F.col("status") == "Active")
        .agg(F.count(F.lit(1)).alias("value"))
    )


def at_risk_deals(
    tables: PricingTables, tenant: str | None = None, filters: Filters | None = None
) -> DataFrame:
    risky = for_tenant(
        views.contract_risk(tables), tenant, F.col("risk_status").isin(*ATTENTION_STATUSES)
    )
    return apply_filters(risky, filters, VIEW_DIMENSIONS["risk"]).agg(
        F.count(F.lit(1)).alias("value")
    )


def revenue_of_year(
    tables: PricingTables, year: int, tenant: str | None = None, filters: Filters | None = None
) -> DataFrame:
    revenue = sum_money("invoice_price", "quantity")
    return (
        _lines(tables, tenant, filters)
        .filter(F.col("year") == year)
        .agg(or_zero(revenue).alias("value"))
    )


def revenue_growth(tables: PricingTables, tenant: str | None = None) -> DataFrame:
    """Revenue per year and its change on the year before; the window sees yearly rows only."""
    by_year = Window.partitionBy("tenant_id").orderBy("year")
    before = F.when(F.lag("year").over(by_year) == F.col("year") - 1, F.lag("revenue").over(by_year))
    return (
        for_tenant(tables.transactions, tenant)
        .groupBy("tenant_id", "year")
        .agg(sum_money("invoice_price", "quantity").alias("revenue"))
        .withColumn("prior_revenue", before)
        .withColumn(
            "growth",
            F.when(
                F.col("prior_revenue") > 0,
                round_half_up(F.col("revenue") / F.col("prior_revenue") - 1, 3),
            ),
        )
    )


def with_alert(df: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    return df.withColumn("alert", F.coalesce(F.col(value) > F.lit(threshold), F.lit(False)))


def portfolio_totals(
    tables: PricingTables,
    tenant: str | None = None,
    filters: Filters | None = None,
    base_year: int | None = None,
) -> DataFrame:
    """``revenue, margin, active, risk, base_revenue`` in one row, from one pass over the transactions.

    Lines are totalled per contract, once for the risk rule and once more for the
    lines the filters keep; the contract table then supplies status and risk.  Totals and averages
    of nothing are NULL; ``base_revenue`` is that of ``base_year``.
    """
    chosen = filters or Filters()
    lines = for_tenant(tables.transactions, tenant)
    matches = dimension_condition(chosen, VIEW_DIMENSIONS["kpis"])
    gpo = chosen.selected(["gpo"]).get("gpo")
    if gpo is not None:
        wanted = (
            tables.gpos.filter(F.col("name") == F.lit(gpo))
            .select("gpo_id", F.lit(True).alias("_in_gpo"))
            .distinct()
        )
        lines = lines.join(wanted, "gpo_id", "left")
        matches = matches & F.coalesce("_in_gpo", F.lit(False))
    margin = units("margin_pct", PERCENT_SUM_PLACES)
    kept_margin = F.when(matches, margin)
    money = money_units("invoice_price", "quantity")
    based = F.lit(None).cast("bigint")
    if base_year is not None:
        based = F.when(matches & (F.col("year") == base_year), money)
    per_contract = lines.groupBy("tenant_id", "contract_id").agg(
        F.count(margin).alias("margin_count"),
        F.sum(margin).alias("margin_units"),
        F.count(kept_margin).alias("kept_count"),
        F.sum(kept_margin).alias("kept_units"),
        F.sum(F.when(matches, money)).alias("kept_money"),
        F.sum(based).alias("base_money"),
    )
    at_risk = (
        F.col("customer_known")
        & views.risk_status(F.col("margin_units"), F.col("margin_count")).isin(*ATTENTION_STATUSES)
        & dimension_condition(chosen, VIEW_DIMENSIONS["risk"])
    )
    mean = avg_units(F.sum("kept_units"), F.sum("kept_count"), PERCENT_SUM_PLACES, PERCENT_PLACES)
    return (
        for_tenant(tables.customer_contracts, tenant)
        .join(per_contract, ["tenant_id", "contract_id"], "left")
        .agg(
            money_total(F.sum("kept_money")).alias("revenue"),
            mean.alias("margin"),
            F.count_if(F.col("status") == "Active").cast("double").alias("active"),
            F.count_if(at_risk).cast("double").alias("risk"),
            money_total(F.sum("base_money")).alias("base_revenue"),
        )
    )


def portfolio_kpis(
    tables: PricingTables,
    tenant: str | None = None,
    filters: Filters | None = None,
    alert_threshold: int = 10,
) -> DataFrame:
    """The four page KPIs, a row each; ``note`` is the remark on the card of the deals at risk."""
    totals = portfolio_totals(tables, tenant, filters)

    def row(key: str, label: str, value: str, kind: str, alert: Column) -> Column:
        return F.struct(
            F.lit(key).alias("metric"),
            F.lit(label).alias("label"),
            or_zero(F.col(value)).alias("value"),
            F.lit(kind).alias("format"),
            alert.alias("alert"),
        )

    rows = F.array(
        row("total_revenue", "Total Revenue", "revenue", "currency", F.lit(False)),
        row("avg_margin", "Avg Margin %", "margin", "percent", F.lit(False)),
        row("active_contracts", "Active Contracts", "active", "integer", F.lit(False)),
        row("at_risk_deals", "At-Risk Deals", "risk", "integer", F.col("risk") > alert_threshold),
    )
    return (
        totals.select(F.explode(rows).alias("k"))
        .select("k.*")
        .withColumns(
            {
                "text": display_text(F.col("value"), F.col("format")),
                "note": F.when(F.col("metric") == "at_risk_deals", attention_note(F.col("value"))),
            }
        )
    )


def customer_kpis(
    tables: PricingTables, tenant: str | None = None, idn_id: str | None = None
) -> DataFrame:
    """Display values of one customer (or of all), with the margin target flag."""
    below = F.col("avg_margin_pct") < CUSTOMER_MARGIN_TARGET
    return customer.customer_overview(tables, tenant, idn_id).select(
        "tenant_id",
        "idn_id",
        "idn_name",
        "gpo_name",
        currency(F.col("total_revenue")).alias("revenue_text"),
        percent(F.col("avg_margin_pct")).alias("margin_text"),
        F.when(below, "Below target").otherwise("On target").alias("margin_target"),
        F.col("active_contracts").cast("string").alias("contracts_text"),
        grouped_integer(F.col("transaction_count")).alias("transactions_text"),
    )


@dataclass(frozen=True)
class Metric:
    """A configured KPI: its SQL yields one value, ``delta_sql`` an optional base value.

    ``measure`` and ``delta_measure`` name columns of ``portfolio_totals`` that hold the same values.
    """

    key: str
    label: str
    sql: str
    format: str = "integer"
    delta_sql: str | None = None
    alert_threshold: float | None = None
    measure: str | None = None
    delta_measure: str | None = None


# The configured KPIs.  Totals are exact decimals, rounded once.
_REVENUE_SQL = (
    "SELECT cast(round(sum(cast(invoice_price AS decimal(18, 4)) * quantity), 2) AS double) FROM transactions"
)
_BASE_YEAR = 1999
DEFAULT_METRICS = (
    Metric(
        "total_revenue",
        "Total Revenue",
        _REVENUE_SQL,
        "currency",
        f"{_REVENUE_SQL} WHERE year = {_BASE_YEAR}",
        measure="revenue",
        delta_measure="base_revenue",
    ),
    Metric(
        "avg_margin",
        "Avg Margin %",
        "SELECT round(avg(cast(margin_pct AS decimal(12, 6))), 1) FROM transactions",
        "percent",
        measure="margin",
    ),
    Metric(
        "active_contracts",
        "Active Contracts",
        "SELECT count(*) FROM contracts WHERE status = 'Active'",
        measure="active",
    ),
    Metric(
        "at_risk_deals",
        "At-Risk Deals",
        "SELECT count(*) FROM v_contract_risk WHERE risk_status IN ('Critical', 'At Risk')",
        alert_threshold=10,
        measure="risk",
    ),
)


def metrics_from_config(config: dict) -> list[Metric]:
    """Metrics from a parsed ``{"kpis": {key: {label, sql, ...}}}`` mapping."""
    return [Metric(key=key, **entry) for key, entry in config["kpis"].items()]


def load_metrics(path: str) -> list[Metric]:
    """Read a metric file: JSON, or YAML where a YAML reader is installed."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            return metrics_from_config(json.load(handle))
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("YAML metric files need PyYAML; use JSON instead") from missing
        return metrics_from_config(yaml.safe_load(handle))


def _values(metric: Metric) -> tuple[tuple[str | None, str | None], ...]:
    """(text, measure) of a metric's value and of its base."""
    return (metric.sql, metric.measure), (metric.delta_sql, metric.delta_measure)


def metric_table(session: TenantSession, metrics: Iterable[Metric] = DEFAULT_METRICS) -> DataFrame:
    """One row per configured metric, evaluated inside the tenant's session.

    Metrics with a measure share one pass over the transactions; the other texts are fused into one
    aggregate for each relation, and what can't be fused is a sub-query of its own.
    """
    metrics = list(metrics)
    texts = [text for m in metrics for text, measure in _values(m) if text is not None and measure is None]
    places, queries = fused(texts)
    passes = {f"_{source}": session.sql(query) for source, query in queries.items()}
    if any(measure is not None for m in metrics for _, measure in _values(m)):
        passes["_totals"] = portfolio_totals(session.tables, base_year=_BASE_YEAR)
    shared = [one_row.select(F.struct("*").alias("values")).scalar().alias(name) for name, one_row in passes.items()]

    def value_of(sql: str | None, measure: str | None) -> Column:
        if measure is not None:
            return F.col("_totals")[measure].cast("double")
        if sql is None:
            return F.lit(None).cast("double")
        if sql in places:
            source, place = places[sql]
            return F.col(f"_{source}")[f"m{place}"].cast("double")
        return session.value(sql).cast("double")

    rows = [
        F.struct(
            F.lit(metric.key).alias("metric"),
            F.lit(metric.label).alias("label"),
            value_of(*_values(metric)[0]).alias("value"),
            F.lit(metric.format).alias("format"),
            value_of(*_values(metric)[1]).alias("delta_base"),
            F.lit(metric.alert_threshold).cast("double").alias("alert_threshold"),
        )
        for metric in metrics
    ]
    alert = F.coalesce(F.col("value") > F.col("alert_threshold"), F.lit(False))
    return (
        session.spark.range(1)
        .select("id", *shared)
        .select(F.inline(F.array(*rows)))
        .withColumns(
            {"alert": alert, "text": display_text(F.col("value"), F.col("format"))}
        )
        .drop("alert_threshold")
    )
