"""Chart-ready frames computed from the views.

Frames keep ``tenant_id`` in their keys: a tenant-scoped view gives that tenant's
chart, an unscoped view gives every tenant's chart in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginflow.functions.calendar import month_start
from marginflow.functions.display import grouped_integer, millions
from marginflow.functions.numeric import (
    CENT_PLACES,
    PERCENT_PLACES,
    avg_share_as_percent,
    cents,
    from_units,
    ratio_percent,
    round_half_up,
    sum_money,
    units,
)
from marginflow.model import ATTENTION_STATUSES, RISK_STATUSES
from marginflow.operators.predicates import ALL
from marginflow.operators.views import WATERFALL_MEASURES, waterfall_average

#: Up to how many rows of a group Spark cuts ranks before a shuffle.
_RANK_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"

_WATERFALL_MEASURES = tuple(WATERFALL_MEASURES)

# Label, kind of step, source column, sign (0 for a running total).
WATERFALL_STEPS = (
    ("List Price", "absolute", "avg_list_price", 1),
    ("Contract Discount", "relative", "avg_contract_discount", -1),
    ("GPO Admin Fee", "relative", "avg_gpo_fee", -1),
    ("Rebates", "relative", "avg_rebate", -1),
    ("Lowest Net", "total", "avg_lowest_net", 0),
    ("Unit Cost", "relative", "avg_cost", -1),
    ("Margin", "total", "avg_margin", 0),
)

# Column titles of the display tables.
DISPLAY_TITLES = {
    "attention": {
        "contract_id": "Contract",
        "idn_name": "Customer",
        "deal_structure": "Structure",
        "device_category": "Category",
        "avg_margin_pct": "Margin %",
        "total_revenue": "Revenue",
        "risk_status": "Risk",
        "aks_risk_flag": "AKS Flag",
    },
    "contracts": {
        "contract_id": "Contract",
        "deal_structure": "Structure",
        "device_category": "Category",
        "status": "Status",
        "base_discount_pct": "Base Discount",
        "market_share_commitment": "Share Commit",
        "avg_margin_pct": "Margin %",
        "total_revenue": "Revenue",
        "risk_status": "Risk",
        "end_date": "Expires",
    },
    "pricing": {
        "device_category": "Category",
        "avg_list": "Avg List ($)",
        "avg_invoice": "Avg Invoice ($)",
        "avg_lowest_net": "Avg Lowest Net ($)",
        "avg_margin_pct": "Margin %",
        "avg_total_discount": "Total Discount %",
        "txn_count": "Transactions",
    },
    "recent": {
        "transaction_id": "TXN ID",
        "transaction_date": "Date",
        "product_name": "Product",
        "category": "Category",
        "quantity": "Qty",
        "list_price": "List ($)",
        "invoice_price": "Invoice ($)",
        "lowest_net_price": "Lowest Net ($)",
        "margin_pct": "Margin %",
        "deal_structure": "Structure",
    },
    "rebates": {
        "rebate_id": "Rebate ID",
        "contract_id": "Contract",
        "rebate_type": "Type",
        "rebate_pct": "Rate",
        "trigger_type": "Trigger",
        "trigger_threshold": "Threshold",
        "orientation": "Orientation",
        "earned": "Earned?",
    },
}


def _mean(column: str, places: int) -> Column:
    """Plain mean of rounded values: an exact unit total divided once."""
    value = units(column, places)
    return F.sum(value).cast("double") / (F.count(value) * F.lit(10**places)).cast("double")


def _revenue_weighted(margin: str, revenue: str) -> Column:
    """Margin percent weighted by revenue, one decimal; products are exact decimals."""
    weight = cents(revenue)
    product = units(margin, PERCENT_PLACES).cast("decimal(18,0)") * weight.cast("decimal(19,0)")
    mean = F.sum(product).cast("decimal(38,0)").cast("double") / F.nullif(
        F.sum(weight).cast("double"), F.lit(0.0)
    )
    return round_half_up(mean / F.lit(10.0), 1)


def waterfall_category(view: DataFrame, category: str) -> DataFrame:
    """Rows of one category; empty when the category is unknown."""
    return view.filter(F.col("device_category") == F.lit(category))


def waterfall_all(view: DataFrame) -> DataFrame:
    """Unweighted mean over the categories."""
    return view.groupBy("tenant_id").agg(
        F.lit(ALL).alias("device_category"),
        *[_mean(name, CENT_PLACES).alias(name) for name in _WATERFALL_MEASURES],
    )


def waterfall_weighted(view: DataFrame, transactions: DataFrame) -> DataFrame:
    """Mean weighted by the number of transactions of each category, for a finished view.

    ``waterfall_by_lines`` gives the same from one scan.
    """
    weights = transactions.groupBy("tenant_id", "device_category").agg(F.count(F.lit(1)).alias("lines"))
    return _weighted_by_lines(view.join(weights, ["tenant_id", "device_category"]))


def waterfall_by_lines(states: DataFrame) -> DataFrame:
    """Mean weighted by the number of transactions of each category, from ``waterfall_states``."""
    averages = [waterfall_average(name) for name in _WATERFALL_MEASURES]
    return _weighted_by_lines(states.select("tenant_id", "device_category", "lines", *averages))


def _weighted_by_lines(view: DataFrame) -> DataFrame:
    means = [
        (
            F.sum(cents(name) * F.col("lines")).cast("double")
            / (F.sum("lines") * F.lit(10**CENT_PLACES)).cast("double")
        ).alias(name)
        for name in _WATERFALL_MEASURES
    ]
    return view.groupBy("tenant_id").agg(F.lit(ALL).alias("device_category"), *means)


def waterfall_steps(view: DataFrame) -> DataFrame:
    """Seven ordered steps per row of the waterfall view, with running total and label."""

    def label(amount: Column, sign: int) -> Column:
        text = F.concat(F.lit("$"), grouped_integer(round_half_up(amount, 0)))
        return F.concat(F.lit("-"), text) if sign < 0 else text

    steps = [
        F.struct(
            F.lit(position).alias("step"),
            F.lit(name).alias("label"),
            F.lit(kind).alias("measure"),
            (F.col(source) * sign if sign else F.lit(None).cast("double")).alias("value"),
            label(F.col(source), sign).alias("text"),
        )
        for position, (name, kind, source, sign) in enumerate(WATERFALL_STEPS, start=1)
    ]
    upto = (
        Window.partitionBy("tenant_id", "device_category")
        .orderBy("step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = F.sum(F.coalesce(units("value", 6), F.lit(0))).over(upto)
    return (
        view.select("tenant_id", "device_category", F.explode(F.array(*steps)).alias("s"))
        .select("tenant_id", "device_category", "s.*")
        .withColumn("running_total", from_units(running, 6))
    )


def margin_band(margin: Column) -> Column:
    """Colour band the value falls in; NULL outside the drawn range."""
    return (
        F.when((margin >= 0) & (margin < 15), F.lit("red"))
        .when((margin >= 15) & (margin < 25), F.lit("amber"))
        .when((margin >= 25) & (margin <= 60), F.lit("green"))
    )


def margin_trend(view: DataFrame, weighted: bool = False) -> DataFrame:
    """Per month: mean of the category averages and total revenue, oldest first.

    ``weighted`` weighs each category average by its revenue.
    """
    return (
        view.groupBy("tenant_id", "year", "month")
        .agg(
            _margin("revenue", weighted).alias("avg_margin"),
            sum_money("revenue").alias("revenue"),
        )
        .withColumn("date", month_start(F.col("year"), F.col("month")))
        .orderBy("date", "tenant_id")
    )


def _margin(revenue: str, weighted: bool) -> Column:
    """Mean of the rows' average margins, plain or weighted by their revenue."""
    if weighted:
        return _revenue_weighted("avg_margin_pct", revenue)
    return _mean("avg_margin_pct", PERCENT_PLACES)


def margin_alerts(trend: DataFrame) -> DataFrame:
    """Band of every month and whether it misses the minimum and reaches the target."""
    margin = F.col("avg_margin")
    return trend.select(
        "tenant_id",
        "date",
        "avg_margin",
        margin_band(margin).alias("band"),
        (margin < 15).alias("below_minimum"),
        (margin >= 25).alias("on_target"),
    )


def revenue_by_category(view: DataFrame, weighted: bool = False) -> DataFrame:
    return (
        view.groupBy("tenant_id", "device_category")
        .agg(
            sum_money("total_revenue").alias("total_revenue"),
            _margin("total_revenue", weighted).alias("avg_margin"),
        )
        .withColumn("label", millions(F.col("total_revenue")))
        .orderBy("total_revenue", "device_category", "tenant_id")
    )


def deal_structure_mix(view: DataFrame) -> DataFrame:
    """Contracts per deal structure and share of the tenant's total, over aggregated rows."""
    total = F.sum("contract_count").over(Window.partitionBy("tenant_id"))
    return (
        view.groupBy("tenant_id", "deal_structure")
        .agg(F.sum("contract_count").alias("contract_count"))
        .withColumn("share_pct", ratio_percent(F.col("contract_count"), total))
        .orderBy(F.desc("contract_count"), "deal_structure", "tenant_id")
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group, by one plan for every ``n``.

    The rank filter cuts a group to ``n`` rows in each map task and again behind the one
    exchange.  Spark does so up to a limit of its session, which is raised where it is below ``n``.
    """
    conf = df.sparkSession.conf
    if -1 < int(conf.get(_RANK_LIMIT)) < n:
        conf.set(_RANK_LIMIT, str(n))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def top_customers(view: DataFrame, n: int = 20) -> DataFrame:
    return top_per_group(
        view, ["tenant_id"], [F.desc_nulls_last("total_revenue"), F.asc("idn_id")], n
    )


def concentration(view: DataFrame, n: int = 20) -> DataFrame:
    """Two-level hierarchy of the top customers: buying group, then customer.

    Size is revenue; colour is the margin percent weighted by revenue.
    """
    top = top_customers(view, n)
    tenant, group, customer = F.col("tenant_id"), F.col("gpo_name"), F.col("idn_name")
    return top.groupingSets(
        [[tenant, group, customer], [tenant, group]], tenant, group, customer
    ).agg(
        F.when(F.grouping("idn_name") == 1, "gpo").otherwise("idn").alias("level"),
        sum_money("total_revenue").alias("total_revenue"),
        _revenue_weighted("avg_margin_pct", "total_revenue").alias("avg_margin_pct"),
    )


def risk_distribution(view: DataFrame, tenant: str | None = None) -> DataFrame:
    """Contracts per risk class in fixed order, zero where a class is empty.

    One aggregation with a counter per class; a named tenant gets its four rows even
    without contracts.
    """
    counters = [
        F.count_if(F.col("risk_status") == status).alias(f"n{i}")
        for i, status in enumerate(RISK_STATUSES, start=1)
    ]
    if tenant is None:
        counted = view.groupBy("tenant_id").agg(*counters)
    else:
        counted = view.filter(F.col("tenant_id") == tenant).agg(
            F.lit(tenant).alias("tenant_id"), *counters
        )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(status).alias("risk_status"),
                F.col(f"n{i}").alias("contract_count"),
            )
            for i, status in enumerate(RISK_STATUSES, start=1)
        ]
    )
    return counted.select("tenant_id", F.explode(rows).alias("r")).select("tenant_id", "r.*")


def revenue_by_region(view: DataFrame, weighted: bool = False) -> DataFrame:
    return (
        view.groupBy("tenant_id", "region")
        .agg(
            sum_money("total_revenue").alias("total_revenue"),
            _margin("total_revenue", weighted).alias("avg_margin"),
            F.sum("active_contracts").alias("contracts"),
        )
        .withColumn("label", millions(F.col("total_revenue")))
        .orderBy(F.desc("total_revenue"), "region", "tenant_id")
    )


def needing_attention(view: DataFrame, n: int = 10, by_severity: bool = False) -> DataFrame:
    """First ``n`` contracts per tenant that are Critical or At Risk.

    The default order is the text of the class, so At Risk precedes Critical;
    ``by_severity`` puts Critical first.
    """
    risk = F.col("risk_status")
    first = F.when(risk == "Critical", 1).otherwise(2) if by_severity else risk
    return top_per_group(
        view.filter(risk.isin(*ATTENTION_STATUSES)),
        ["tenant_id"],
        [first.asc(), F.desc_nulls_last("total_revenue"), F.asc("contract_id")],
        n,
    )


def display_table(df: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project and title the columns of a display table; ``keep`` passes keys through."""
    titles = DISPLAY_TITLES[kind]
    return df.select(*keep, *[F.col(name).alias(title) for name, title in titles.items()])


def value_counts(df: DataFrame, column: str, keys: tuple[str, ...] = ("tenant_id", "idn_id")) -> DataFrame:
    """Rows per value of ``column`` within each customer, most frequent first."""
    return (
        df.groupBy(*keys, column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column, *keys)
    )


def price_series(pricing: DataFrame) -> DataFrame:
    """Long form of the three price levels per category."""
    return pricing.withColumnsRenamed(
        {"avg_list": "List Price", "avg_invoice": "Invoice Price", "avg_lowest_net": "Lowest Net"}
    ).unpivot(
        ["tenant_id", "idn_id", "device_category"],
        ["List Price", "Invoice Price", "Lowest Net"],
        "series",
        "price",
    )


def rebate_summary(rebates: DataFrame) -> DataFrame:
    """Earned programs, earn rate in whole percent and average rate per customer."""
    earned, total = F.count_if("earned"), F.count(F.lit(1))
    return rebates.groupBy("tenant_id", "idn_id").agg(
        earned.alias("earned_count"),
        total.alias("total_programs"),
        round_half_up(earned.cast("double") * 100 / total.cast("double"), 0).alias("earn_rate_pct"),
        avg_share_as_percent("rebate_pct").alias("avg_rebate_pct"),
    )
