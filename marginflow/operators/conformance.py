"""Rules that rows must meet, and how many break each.

A rule says to which rows it applies and what holds for those.  All rules of a table are counted in one
pass: a row may break several.  A condition that is NULL does not hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginflow.functions.numeric import RATE_PLACES, cents, units
from marginflow.model import (
    COMMITMENT_BANDS,
    DISCOUNT_CEILING,
    DISCOUNT_FLOOR,
    QUANTITY_MAX,
    QUANTITY_MIN,
    REBATE_RULES,
)


@dataclass(frozen=True)
class Rule:
    """``holds`` must be true for every row for which ``applies`` is."""

    name: str
    applies: Column
    holds: Column

    @property
    def broken(self) -> Column:
        return F.coalesce(self.applies, F.lit(False)) & ~F.coalesce(self.holds, F.lit(False))


def violation_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule, checked, violations``: a row for each rule, from one aggregate."""
    counted = df.agg(
        *[F.count_if(F.coalesce(rule.applies, F.lit(False))).alias(f"c{i}") for i, rule in enumerate(rules)],
        *[F.count_if(rule.broken).alias(f"v{i}") for i, rule in enumerate(rules)],
    )
    rows = [
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.col(f"c{i}").alias("checked"),
            F.col(f"v{i}").alias("violations"),
        )
        for i, rule in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*rows)))


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break a rule, with the names of all ``broken`` ones."""
    names = F.filter(F.array(*[F.when(rule.broken, F.lit(rule.name)) for rule in rules]), lambda n: n.isNotNull())
    return df.withColumn("broken", names).filter(F.size("broken") > 0)


def _rate(value: float) -> int:
    return round(value * 10**RATE_PLACES)


def commitment_rules() -> list[Rule]:
    """The share of a contract's units that its largest product holds keeps to the band of its structure.

    Expects ``deal_structure``, ``most_units`` and ``all_units``; shares are compared in whole numbers.
    """
    rules = []
    for structure, (low, high) in COMMITMENT_BANDS.items():
        if high > 0:  # the other structures commit to nothing
            share = F.col("most_units") * F.lit(10**RATE_PLACES)
            holds = share.between(F.col("all_units") * _rate(low), F.col("all_units") * _rate(high))
            applies = (F.col("deal_structure") == structure) & (F.col("all_units") > 0)
            rules.append(Rule(f"{structure} commitment", applies, holds))
    return rules


def rebate_rules() -> list[Rule]:
    """The average rate that a program's contract grants on its lines keeps to the band of the program's type.

    Expects ``rebate_type``, ``rate_units`` (sum of the lines' rates) and ``rate_count``.
    """
    return [
        Rule(
            f"{kind} rate",
            (F.col("rebate_type") == kind) & (F.col("rate_count") > 0),
            F.col("rate_units").between(F.col("rate_count") * _rate(low), F.col("rate_count") * _rate(high)),
        )
        for kind, (_, low, high) in REBATE_RULES.items()
    ]


def line_rules() -> list[Rule]:
    """Rules of a sold line with its order: discount, quantity, dates and amount."""
    discount, quantity = units("discount", RATE_PLACES), F.col("quantity")
    always = F.lit(True)
    return [
        Rule("discount in bounds", always, discount.between(_rate(DISCOUNT_FLOOR), _rate(DISCOUNT_CEILING))),
        Rule("quantity in bounds", always, quantity.between(QUANTITY_MIN, QUANTITY_MAX)),
        Rule("quantity whole", always, quantity == F.floor(quantity)),
        Rule("sold after ordered", F.col("ordered").isNotNull(), F.col("sold") >= F.col("ordered")),
        Rule("within order total", F.col("order_total").isNotNull(), cents("amount") <= cents("order_total")),
    ]


def unit_shares(lines: DataFrame, key: str, product: str) -> DataFrame:
    """``most_units, all_units`` per ``key``: units of its largest product, and of all.

    Units are totalled per product first, so a heavy contract is spread over its products.
    """
    quantity = units("quantity", RATE_PLACES)
    per_product = lines.groupBy(key, product).agg(F.sum(quantity).alias("_units"))
    return per_product.groupBy(key).agg(F.max("_units").alias("most_units"), F.sum("_units").alias("all_units"))


def average_rates(lines: DataFrame, key: str, rate: str) -> DataFrame:
    """``rate_units, rate_count`` per ``key``."""
    amount = units(rate, RATE_PLACES)
    return lines.groupBy(key).agg(F.sum(amount).alias("rate_units"), F.count(amount).alias("rate_count"))
