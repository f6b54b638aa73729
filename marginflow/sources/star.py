"""Pricing tables derived from an order-entry star schema.

Customers become hospital networks, orders become contracts, order lines become
transactions and parts become products.  Everything stays lazy; each table is
planned only when it is first asked for.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginflow.functions.keys import has_id, key_of, text_of
from marginflow.functions.numeric import CENT_PLACES, cents, div_half_up, from_units
from marginflow.functions.totals import contract_totals
from marginflow.model import DEVICE_CATEGORIES, PricingTables, REBATE_RULES, conform, lookup
from marginflow.operators import derive

AS_OF = dt.date(2000, 1, 15)

# Columns of the order-entry tables.  Declared, so that opening a table reads no file.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
}

#: Orders of one customer up to which they are sent to the lines, not the lines to them.
FEW_ORDERS = 100_000

# Buying group id, customer segment it stands for, fee rate.
BUYING_GROUPS = (
    ("GPO-001", "AUTOMOBILE", 0.03),
    ("GPO-002", "BUILDING", 0.025),
    ("GPO-003", "FURNITURE", 0.02),
    ("GPO-004", "HOUSEHOLD", 0.015),
    ("GPO-005", "MACHINERY", 0.02),
)

# Deal structure per order priority.
STRUCTURE_BY_PRIORITY = {
    "1-URGENT": "PV",
    "2-HIGH": "DV",
    "3-MEDIUM": "TV",
    "4-NOT SPECIFIED": "Access",
    "5-LOW": "All Play",
}

# Lowest rate and step per rebate type.
REBATE_RATES = {
    "Volume": (0.020, 0.006),
    "Loyalty": (0.010, 0.004),
    "Bundle": (0.010, 0.002),
    "Growth": (0.005, 0.002),
}


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    """Element of a short fixed list by position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _hundredths(value: Column) -> Column:
    return from_units(value, 2)


class StarTables(PricingTables):
    """The seven tables of a directory.

    ``schemas``: columns of its raw tables; those not declared are read from the files.
    ``idn_id``: the one customer to read, see ``of_customer``.
    """

    def __init__(
        self,
        spark: SparkSession,
        directory: str,
        as_of: dt.date = AS_OF,
        schemas: dict[str, str] | None = None,
        idn_id: str | None = None,
    ):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self.as_of = as_of
        self.schemas = RAW_SCHEMAS if schemas is None else schemas
        self.idn_id = idn_id

    def raw(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.parquet(f"{self.directory}/{name}.parquet")

    def of_customer(self, idn_id: str) -> PricingTables:
        """As in the base class; the id becomes a predicate on the keys of the raw tables."""
        if self.idn_id not in (None, idn_id):
            raise ValueError("these tables already hold one other customer")
        return StarTables(self.spark, self.directory, self.as_of, self.schemas, idn_id)

    def _own(self, name: str, key: str) -> DataFrame:
        """Rows of a raw table whose customer ``key`` is the one asked for."""
        rows = self.raw(name)
        return rows if self.idn_id is None else rows.filter(has_id(F.col(key), self.idn_id))

    @cached_property
    def _few_orders(self) -> bool:
        """Whether the customer's orders are few enough to be sent to every task.

        Counted by a scan of one column with the key pushed down.
        """
        if self.idn_id is None or key_of(self.idn_id) is None:
            return False
        own = self._own("orders", "o_custkey").select("o_custkey")
        return own.limit(FEW_ORDERS + 1).count() <= FEW_ORDERS

    @cached_property
    def _rate_card(self) -> DataFrame:
        rows = ", ".join(f"('{gpo}', '{name}', {rate}D)" for gpo, name, rate in BUYING_GROUPS)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS card(gpo_id, name, admin_fee_pct)")

    @cached_property
    def gpos(self) -> DataFrame:
        """Five groups; the member count join is pruned when no one reads the count."""
        members = (
            self.raw("customer")
            .groupBy(F.col("c_mktsegment").alias("name"))
            .agg(F.count(F.lit(1)).alias("members"))
        )
        return conform(
            self._rate_card.join(members, "name", "left").withColumn(
                "member_count", F.coalesce(F.col("members"), F.lit(0))
            ),
            "gpos",
        )

    @cached_property
    def _places(self) -> DataFrame:
        """State and region per nation key.

        Grouping by the key tells the optimizer that it is unique, so the left join to
        these rows disappears from every query that asks for no place.
        """
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(F.col("n_nationkey").alias("nation_key"))
            .agg(F.first("n_name").alias("state"), F.first("r_name").alias("region"))
        )

    @cached_property
    def _customers(self) -> DataFrame:
        balance = cents("c_acctbal")
        facility_count = (
            F.when(balance > 650000, F.floor((balance - 650000) / 10000) + 31)
            .when(balance > 250000, F.floor((balance - 250000) / 25000) + 11)
            .otherwise(F.floor((balance + 100000) / 50000) + 2)
        )
        groups = {name: gpo for gpo, name, _ in BUYING_GROUPS}
        return (
            self._own("customer", "c_custkey")
            .select(
                F.col("c_custkey").alias("idn_key"),
                F.col("c_name").alias("name"),
                lookup(F.col("c_mktsegment"), groups).alias("gpo_id"),
                facility_count.cast("int").alias("facility_count"),
                F.col("c_nationkey").alias("nation_key"),
            )
            .join(self._places, "nation_key", "left")
            .transform(derive.with_idn_tier)
        )

    @cached_property
    def idns(self) -> DataFrame:
        spend = F.col("facility_count").cast("bigint") * (F.col("idn_key") % 6000000 + 2000000)
        return conform(
            self._customers.withColumns(
                {"idn_id": text_of(F.col("idn_key")), "annual_spend": spend}
            ),
            "idns",
        )

    @cached_property
    def facilities(self) -> DataFrame:
        key = F.col("s_suppkey")
        kind = _pick(key % 3, ("Hospital", "ASC", "Clinic"))
        beds = (
            F.when(key % 3 == 0, key % 750 + 50).when(key % 3 == 1, key % 16 + 4).otherwise(F.lit(0))
        )
        return conform(
            self.raw("supplier")
            .join(self._places, F.col("s_nationkey") == F.col("nation_key"), "left")
            .withColumns(
                {
                    "facility_id": derive.surrogate_id("FAC", key, 5),
                    "idn_id": text_of(key),
                    "facility_type": kind,
                    "name": F.concat(F.col("s_name"), F.lit(" - "), kind),
                    "bed_count": beds,
                }
            ),
            "facilities",
        )

    @cached_property
    def _parts(self) -> DataFrame:
        list_price = cents("p_retailprice")
        cost = div_half_up(list_price * (F.col("p_size") + 25), F.lit(100).cast("bigint"))
        return self.raw("part").select(
            F.col("p_partkey").alias("product_key"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            from_units(list_price, CENT_PLACES).alias("list_price"),
            from_units(cost, CENT_PLACES).alias("cost"),
            F.upper(F.concat_ws("-", F.lit("SKU"), F.col("p_brand"), F.col("p_partkey"))).alias("sku"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return conform(
            self._parts.withColumn("product_id", text_of(F.col("product_key"))), "products"
        )

    @cached_property
    def _deals(self) -> DataFrame:
        """Contracts on numeric keys, with the customer attributes the fact table repeats."""
        key = F.col("contract_key")
        commitment = (
            F.when(F.col("deal_structure") == "PV", _hundredths(key % 16 + 80))
            .when(F.col("deal_structure") == "DV", _hundredths(key % 21 + 40))
            .when(F.col("deal_structure") == "TV", _hundredths(key % 11 + 25))
            .otherwise(F.lit(0.0))
        )
        months = F.when(key % 10 < 3, 12).when(key % 10 < 8, 24).otherwise(36)
        flag = F.when(key % 19 == 0, "High").when(key % 19 <= 5, "Medium").otherwise("Low")
        customers = self._customers.select(
            "idn_key", "gpo_id", F.col("name").alias("idn_name"), F.col("tier").alias("idn_tier"), "region"
        )
        return (
            self._own("orders", "o_custkey")
            .select(
                F.col("o_orderkey").alias("contract_key"),
                F.col("o_custkey").alias("idn_key"),
                F.col("o_orderdate").cast("date").alias("start_date"),
                (F.col("o_orderstatus") != "F").alias("renewed"),
                lookup(F.col("o_orderpriority"), STRUCTURE_BY_PRIORITY).alias("deal_structure"),
            )
            .withColumns(
                {
                    "tenant_id": F.when(key % 7 < 4, "tenant_a").otherwise("tenant_b"),
                    "device_category": _pick(key % 4, DEVICE_CATEGORIES),
                    "duration_months": months,
                    "market_share_commitment": commitment,
                    "annual_volume_target": key % 4900 + 100,
                    "safe_harbor_compliant": F.lit(True),
                    "aks_risk_flag": flag,
                }
            )
            .transform(derive.with_end_date)
            .transform(derive.with_status, F.col("renewed"), self.as_of)
            .join(customers, "idn_key", "left")  # an order without a customer stays a contract
            .transform(derive.with_base_discount, _hundredths(key % 9 - 4))
        )

    @staticmethod
    def _named(deals: DataFrame) -> DataFrame:
        return deals.withColumns(
            {
                "contract_id": text_of(F.col("contract_key")),
                "idn_id": text_of(F.col("idn_key")),
            }
        )

    @cached_property
    def contracts(self) -> DataFrame:
        return conform(self._named(self._deals), "contracts")

    @cached_property
    def customer_contracts(self) -> DataFrame:
        """As in the base class, without joining the customers a second time."""
        return self._named(self._deals).select(
            *self.contracts.columns,
            "idn_name",
            "idn_tier",
            "region",
            F.col("idn_name").isNotNull().alias("customer_known"),
        )

    @cached_property
    def totalled_contracts(self) -> DataFrame:
        """As in the base class, joined on the numeric key; ids become text last."""
        totals = contract_totals(self._priced, "contract_key")
        contracts = self._named(self._deals.join(totals, ["tenant_id", "contract_key"], "left"))
        totals_kept = [name for name in totals.columns if name not in ("tenant_id", "contract_key")]
        return contracts.select(
            *self.contracts.columns,
            "idn_name",
            "idn_tier",
            "region",
            F.col("idn_name").isNotNull().alias("customer_known"),
            *totals_kept,
        )

    @cached_property
    def rebate_programs(self) -> DataFrame:
        """One to three programs per order, made by exploding a short array in place."""
        key, slot = F.col("o_orderkey"), F.col("slot").cast("bigint")
        types = tuple(REBATE_RULES)
        kind = _pick((key % 11 + slot) % 4, types)
        low = lookup(F.col("rebate_type"), {k: round(v[0] * 1000) for k, v in REBATE_RATES.items()})
        step = lookup(F.col("rebate_type"), {k: round(v[1] * 1000) for k, v in REBATE_RATES.items()})
        return conform(
            self._own("orders", "o_custkey")
            .select("o_orderkey", F.explode(F.sequence(F.lit(0), (key % 3).cast("int"))).alias("slot"))
            .withColumn("rebate_type", kind)
            .withColumns(
                {
                    "rebate_id": F.concat_ws("-", key, F.col("slot")),
                    "contract_id": text_of(key),
                    "rebate_pct": from_units(low + step * (key % 6), 3),
                    "trigger_type": derive.trigger_for(F.col("rebate_type")),
                    "trigger_threshold": _hundredths((key + slot) % 41 + 50),
                    "orientation": F.when((key % 17 + slot) % 5 < 2, "Offensive").otherwise("Defensive"),
                    "earned": (key % 23 + slot) % 20 < 13,
                }
            ),
            "rebate_programs",
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines before pricing, on numeric keys."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("contract_key"),
            F.col("l_partkey").alias("product_key"),
            "l_suppkey",
            "l_linenumber",
            F.col("l_quantity").alias("quantity"),
            F.col("l_tax").alias("rebate_pct"),
            F.col("l_shipdate").cast("date").alias("transaction_date"),
        )

    @property
    def numbered_deals(self) -> DataFrame:
        """Contracts with the numeric key that ``lines`` carry."""
        return self._deals

    @property
    def numbered_products(self) -> DataFrame:
        """Products with the numeric key that ``lines`` carry."""
        return self._parts

    @cached_property
    def _priced(self) -> DataFrame:
        """The derivation joined on the numeric keys, without text ids.

        Orders and their lines grow together, so neither side is ever a broadcast side.
        The merge hint says so where the estimate of a few pruned columns does not, and
        keeps the join able to spill and to split a heavy order.  The orders of one
        customer are counted first: while they are few, the lines stay where they are.
        """
        products = self._parts.select("product_key", "list_price", F.col("cost").alias("unit_cost"))
        deals = self._deals.drop("duration_months", "idn_name")
        return derive.price_transactions(
            self.lines,
            deals.hint("broadcast" if self._few_orders else "merge"),
            products,
            self.gpos,
            "contract_key",
            "product_key",
        )

    @cached_property
    def priced_lines(self) -> DataFrame:
        """Every column of the derivation."""
        return self._priced.withColumns(
            {
                "transaction_id": F.concat_ws(
                    "-", "contract_key", "l_linenumber", "product_key", "l_suppkey", "quantity"
                ),
                "contract_id": text_of(F.col("contract_key")),
                "idn_id": text_of(F.col("idn_key")),
                "product_id": text_of(F.col("product_key")),
            }
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return conform(self.priced_lines, "transactions")
