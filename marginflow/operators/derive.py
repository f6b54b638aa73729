"""Pricing derivations: from list price to lowest net price, margin and discount.

Each rule takes a DataFrame and adds its columns, so rules chain with ``transform``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginflow.functions.calendar import contract_end, contract_status, with_calendar
from marginflow.functions.numeric import (
    CENT_PLACES,
    PERCENT_PLACES,
    RATE_PLACES,
    SHARE_PLACES,
    cents,
    div_half_up,
    from_units,
    units,
)
from marginflow.model import (
    BILLABLE_STATUSES,
    COMMITMENT_BANDS,
    DISCOUNT_CEILING,
    DISCOUNT_FLOOR,
    LARGE_ABOVE,
    MEDIUM_ABOVE,
    QUANTITY_MAX,
    QUANTITY_MIN,
    REBATE_RULES,
    STRUCTURE_DISCOUNT,
    TIER_DISCOUNT,
    lookup,
)

#: Why a line is not priced, in the order of the checks, and that it is.
LINE_OUTCOMES = (
    "unknown contract",
    "contract not billable",
    "unknown product",
    "unknown buying group",
    "priced",
)


def _share_of_price(price: str, rate: Column) -> Column:
    """``price * rate`` to the cent, with the rate given in units of ``RATE_PLACES``."""
    one = F.lit(10**RATE_PLACES).cast("bigint")
    return from_units(div_half_up(cents(price) * rate, one), CENT_PLACES)


def with_invoice_price(df: DataFrame) -> DataFrame:
    kept = F.lit(10**RATE_PLACES) - units("base_discount_pct", RATE_PLACES)
    return df.withColumn("invoice_price", _share_of_price("list_price", kept))


def with_gpo_admin_fee(df: DataFrame, gpos: DataFrame) -> DataFrame:
    """Look the fee rate up by ``gpo_id``; a row whose buying group is unknown is dropped.
    ``line_outcomes`` counts those.

    The rate table carries its own size statistics, so Catalyst broadcasts it when
    it is small and falls back to a shuffle join when it is not.
    """
    rates = gpos.select("gpo_id", F.col("admin_fee_pct").alias("_fee_rate"))
    fee = _share_of_price("invoice_price", units("_fee_rate", RATE_PLACES))
    return df.join(rates, "gpo_id").withColumn("gpo_admin_fee", fee).drop("_fee_rate")


def with_rebate_amount(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "rebate_amount", _share_of_price("invoice_price", units("rebate_pct", RATE_PLACES))
    )


def with_lowest_net(df: DataFrame) -> DataFrame:
    net = cents("invoice_price") - cents("gpo_admin_fee") - cents("rebate_amount")
    return df.withColumn("lowest_net_price", from_units(net, CENT_PLACES))


def with_margin(df: DataFrame) -> DataFrame:
    """Unit margin and margin percent of the net price (0 when the net is not positive)."""
    net = cents("lowest_net_price")
    margin = net - cents("unit_cost")
    percent = from_units(div_half_up(margin * F.lit(1000), net), PERCENT_PLACES)
    return df.withColumns(
        {
            "margin": from_units(margin, CENT_PLACES),
            "margin_pct": F.when(net > 0, percent).otherwise(F.lit(0.0)),
        }
    )


def with_total_discount(df: DataFrame) -> DataFrame:
    """Share of the list price given away down to the net price (0 without a list price)."""
    list_price, net = cents("list_price"), cents("lowest_net_price")
    share = from_units(div_half_up((list_price - net) * F.lit(1000), list_price), SHARE_PLACES)
    return df.withColumn(
        "total_discount_pct", F.when(list_price > 0, share).otherwise(F.lit(0.0))
    )


def with_whole_quantity(df: DataFrame, column: str = "quantity") -> DataFrame:
    """Whole part of the quantity; NULL stays NULL, a return stays negative."""
    return df.withColumn(column, F.floor(F.col(column)).cast("int"))


def with_quantity_clamped(
    df: DataFrame, column: str = "quantity", least: int = QUANTITY_MIN, most: int = QUANTITY_MAX
) -> DataFrame:
    """A line's whole quantity kept within bounds; NULL stays NULL.

    For made-up lines.  Sales are never clamped.
    """
    whole = F.floor(F.col(column)).cast("bigint")
    clamped = F.greatest(F.lit(least), F.least(whole, F.lit(most)))
    return df.withColumn(column, F.when(whole.isNotNull(), clamped).cast("int"))


def with_idn_tier(df: DataFrame, column: str = "tier") -> DataFrame:
    count = F.col("facility_count")
    tier = (
        F.when(count > LARGE_ABOVE, F.lit("Large"))
        .when(count > MEDIUM_ABOVE, F.lit("Medium"))
        .otherwise(F.lit("Small"))
    )
    return df.withColumn(column, tier)


def with_end_date(df: DataFrame) -> DataFrame:
    return df.withColumn("end_date", contract_end(F.col("start_date"), F.col("duration_months")))


def with_status(df: DataFrame, renewed: Column, as_of: dt.date) -> DataFrame:
    status = contract_status(F.col("start_date"), F.col("end_date"), renewed, as_of)
    return df.withColumn("status", status)


def with_base_discount(df: DataFrame, adjustment: Column) -> DataFrame:
    """Structure discount plus size discount plus adjustment, clipped, three decimals.

    Expects ``deal_structure`` and ``idn_tier``; ``adjustment`` is a share.  An unknown
    structure or size has no discount: NULL, not a bound.
    """

    def thousandths(share: float) -> int:
        return round(share * 10**SHARE_PLACES)

    structure = lookup(
        F.col("deal_structure"), {k: thousandths(v) for k, v in STRUCTURE_DISCOUNT.items()}
    )
    size = lookup(F.col("idn_tier"), {k: thousandths(v) for k, v in TIER_DISCOUNT.items()})
    total = structure + size + units(adjustment, SHARE_PLACES)
    clipped = F.greatest(
        F.lit(thousandths(DISCOUNT_FLOOR)), F.least(total, F.lit(thousandths(DISCOUNT_CEILING)))
    )
    known = F.when(total.isNotNull(), clipped)
    return df.withColumn("base_discount_pct", from_units(known, SHARE_PLACES))


def with_commitment_check(df: DataFrame) -> DataFrame:
    """Band of the deal structure and whether the commitment lies inside it."""
    low = lookup(F.col("deal_structure"), {k: v[0] for k, v in COMMITMENT_BANDS.items()})
    high = lookup(F.col("deal_structure"), {k: v[1] for k, v in COMMITMENT_BANDS.items()})
    return df.withColumns({"commitment_low": low, "commitment_high": high}).withColumn(
        "commitment_in_band",
        F.coalesce(
            F.col("market_share_commitment").between(F.col("commitment_low"), F.col("commitment_high")),
            F.lit(False),
        ),
    )


def trigger_for(rebate_type: Column) -> Column:
    return lookup(rebate_type, {k: v[0] for k, v in REBATE_RULES.items()})


def with_rebate_check(df: DataFrame) -> DataFrame:
    """Expected trigger and rate band of the rebate type, and whether the row conforms."""
    kind = F.col("rebate_type")
    return df.withColumns(
        {
            "expected_trigger": trigger_for(kind),
            "rebate_low": lookup(kind, {k: v[1] for k, v in REBATE_RULES.items()}),
            "rebate_high": lookup(kind, {k: v[2] for k, v in REBATE_RULES.items()}),
        }
    ).withColumn(
        "rebate_conforms",
        F.coalesce(
            (F.col("trigger_type") == F.col("expected_trigger"))
            & F.col("rebate_pct").between(F.col("rebate_low"), F.col("rebate_high")),
            F.lit(False),
        ),
    )


def surrogate_id(prefix: str, key: Column, width: int) -> Column:
    """``PREFIX-000123`` from a natural key; longer keys are kept whole, never cut."""
    text = key.cast("string")
    return F.concat(
        F.lit(f"{prefix}-"), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))
    )


def eligible_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts that can be billed."""
    return contracts.filter(F.col("status").isin(*BILLABLE_STATUSES))


def denormalise(
    lines: DataFrame,
    customer_contracts: DataFrame,
    products: DataFrame,
    contract_key: str = "contract_id",
    product_key: str = "product_id",
) -> DataFrame:
    """Put contract, customer and product attributes on every line.

    Contracts come first: the eligible ones drop lines before the product join.
    Each join is followed by an exchange on another key, so adaptive execution is
    free to split a contract or product that holds a large share of the lines.
    """
    return lines.join(customer_contracts, contract_key).join(products, product_key)


def line_outcomes(
    lines: DataFrame,
    customer_contracts: DataFrame,
    products: DataFrame,
    gpos: DataFrame,
    contract_key: str = "contract_id",
    product_key: str = "product_id",
) -> DataFrame:
    """What becomes of the lines in the derivation: ``outcome, lines``, a row for each outcome.

    The first outcome that applies counts, so the counts add up to all lines.
    """
    contracts = customer_contracts.select(
        contract_key, "gpo_id", "status", F.lit(True).alias("_contract")
    )
    items = products.select(product_key, F.lit(True).alias("_product"))
    groups = gpos.select("gpo_id", F.lit(True).alias("_group"))
    known = (
        lines.select(contract_key, product_key)
        .join(contracts, contract_key, "left")
        .join(items, product_key, "left")
        .join(groups, "gpo_id", "left")
    )
    outcome = (
        F.when(F.col("_contract").isNull(), LINE_OUTCOMES[0])
        .when(~F.coalesce(F.col("status").isin(*BILLABLE_STATUSES), F.lit(False)), LINE_OUTCOMES[1])
        .when(F.col("_product").isNull(), LINE_OUTCOMES[2])
        .when(F.col("_group").isNull(), LINE_OUTCOMES[3])
        .otherwise(LINE_OUTCOMES[4])
    )
    counted = known.select(outcome.alias("_outcome")).agg(
        *[F.count_if(F.col("_outcome") == name).alias(name) for name in LINE_OUTCOMES]
    )
    rows = F.array(
        *[F.struct(F.lit(name).alias("outcome"), F.col(f"`{name}`").alias("lines")) for name in LINE_OUTCOMES]
    )
    return counted.select(F.inline(rows))


def waterfall(df: DataFrame, gpos: DataFrame) -> DataFrame:
    """All price steps of a line that has list price, discount, rebate rate and cost."""
    return (
        df.transform(with_invoice_price)
        .transform(with_gpo_admin_fee, gpos)
        .transform(with_rebate_amount)
        .transform(with_lowest_net)
        .transform(with_margin)
        .transform(with_total_discount)
    )


def price_transactions(
    lines: DataFrame,
    customer_contracts: DataFrame,
    products: DataFrame,
    gpos: DataFrame,
    contract_key: str = "contract_id",
    product_key: str = "product_id",
) -> DataFrame:
    """The whole derivation: eligible contracts, denormalised lines, waterfall, calendar."""
    return (
        denormalise(lines, eligible_contracts(customer_contracts), products, contract_key, product_key)
        .transform(with_whole_quantity)
        .transform(waterfall, gpos)
        .transform(with_calendar, "transaction_date")
    )
