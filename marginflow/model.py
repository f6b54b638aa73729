"""The seven pricing tables: schemas, fixed domains and the table container."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginflow.functions.totals import TOTALS, contract_totals

# Column names and types of the seven tables.
SCHEMAS: dict[str, str] = {
    "gpos": "gpo_id string, name string, admin_fee_pct double, member_count int",
    "idns": (
        "idn_id string, name string, gpo_id string, facility_count int, annual_spend bigint, "
        "region string, state string, tier string"
    ),
    "facilities": (
        "facility_id string, idn_id string, name string, facility_type string, bed_count int, "
        "state string, region string"
    ),
    "products": (
        "product_id string, name string, category string, list_price double, cost double, sku string"
    ),
    "contracts": (
        "contract_id string, tenant_id string, idn_id string, gpo_id string, deal_structure string, "
        "device_category string, start_date date, end_date date, duration_months int, "
        "base_discount_pct double, market_share_commitment double, status string, "
        "annual_volume_target int, safe_harbor_compliant boolean, aks_risk_flag string"
    ),
    "rebate_programs": (
        "rebate_id string, contract_id string, rebate_type string, rebate_pct double, "
        "trigger_type string, trigger_threshold double, orientation string, earned boolean"
    ),
    "transactions": (
        "transaction_id string, tenant_id string, contract_id string, idn_id string, gpo_id string, "
        "product_id string, transaction_date date, quantity int, list_price double, "
        "invoice_price double, gpo_admin_fee double, rebate_amount double, lowest_net_price double, "
        "unit_cost double, margin double, margin_pct double, total_discount_pct double, "
        "deal_structure string, device_category string, region string, idn_tier string, "
        "quarter string, year int, month int"
    ),
}

TABLE_NAMES = tuple(SCHEMAS)

#: Totals per contract, which a store keeps beside the tables.
TOTALS_TABLE = "contract_totals"
SCHEMAS[TOTALS_TABLE] = f"tenant_id string, contract_id string, {TOTALS}"

# Domains of the categorical columns.
DEAL_STRUCTURES = ("PV", "DV", "TV", "Access", "All Play")
DEVICE_CATEGORIES = ("Orthopedic Implants", "Cardiovascular", "Surgical Instruments", "Consumables")
CONTRACT_STATUSES = ("Active", "Renewed", "Expired", "Pending")
BILLABLE_STATUSES = ("Active", "Renewed")
RISK_STATUSES = ("Critical", "At Risk", "Watch", "Healthy")
ATTENTION_STATUSES = ("Critical", "At Risk")

# Discount granted per deal structure and per customer size.
STRUCTURE_DISCOUNT = {"PV": 0.20, "DV": 0.15, "TV": 0.12, "Access": 0.05, "All Play": 0.03}
TIER_DISCOUNT = {"Large": 0.08, "Medium": 0.04, "Small": 0.0}
DISCOUNT_FLOOR, DISCOUNT_CEILING = 0.02, 0.40

# Market share a customer commits to, per deal structure (low, high).
COMMITMENT_BANDS = {
    "PV": (0.80, 0.95),
    "DV": (0.40, 0.60),
    "TV": (0.25, 0.35),
    "Access": (0.0, 0.0),
    "All Play": (0.0, 0.0),
}

# Trigger and allowed rate per rebate type.
REBATE_RULES = {
    "Volume": ("units_threshold", 0.02, 0.05),
    "Loyalty": ("market_share_threshold", 0.01, 0.03),
    "Bundle": ("cross_category_purchase", 0.01, 0.02),
    "Growth": ("yoy_volume_increase", 0.005, 0.015),
}

# Facility counts above which a customer is Large or Medium.
LARGE_ABOVE, MEDIUM_ABOVE = 30, 10

# Quantity per transaction line.
QUANTITY_MIN, QUANTITY_MAX = 1, 200


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast the columns of ``table`` in declared order."""
    fields = [field.strip().rsplit(" ", 1) for field in SCHEMAS[table].split(",")]
    return df.select([F.col(name).cast(kind).alias(name) for name, kind in fields])


def lookup(key: Column, values: dict[str, object]) -> Column:
    """Value of a short fixed mapping, NULL for an unknown key."""
    (name, value), *others = values.items()
    chain = F.when(key == name, value)
    for name, value in others:
        chain = chain.when(key == name, value)
    return chain


class PricingTables:
    """The seven tables by attribute; each is a lazy DataFrame."""

    gpos: DataFrame
    idns: DataFrame
    facilities: DataFrame
    products: DataFrame
    contracts: DataFrame
    rebate_programs: DataFrame
    transactions: DataFrame

    def _with_customers(self, contracts: DataFrame) -> DataFrame:
        customers = self.idns.select(
            "idn_id",
            F.col("name").alias("idn_name"),
            F.col("tier").alias("idn_tier"),
            "region",
            F.lit(True).alias("_known"),
        )
        return (
            contracts.join(customers, "idn_id", "left")
            .withColumn("customer_known", F.coalesce("_known", F.lit(False)))
            .drop("_known")
        )

    @cached_property
    def customer_contracts(self) -> DataFrame:
        """Contracts with ``idn_name``, ``idn_tier`` and ``region`` of their customer.

        ``customer_known`` is false where the customer is missing.  Catalyst picks the
        join: customers are broadcast only while their size is known to be under the
        session's broadcast threshold.
        """
        return self._with_customers(self.contracts)

    @cached_property
    def contract_totals(self) -> DataFrame:
        """Totals of the lines of each contract that has any."""
        return contract_totals(self.transactions)

    @cached_property
    def totalled_contracts(self) -> DataFrame:
        """``customer_contracts`` with the totals of their lines; NULL without lines.

        The join key includes the tenant, which lets a tenant predicate reach both scans.
        Both sides have one row per contract by then, so no key can be heavy.  Contracts meet their
        totals first, as both may be stored by contract.
        """
        return self._with_customers(self.contracts.join(self.contract_totals, ["tenant_id", "contract_id"], "left"))

    def of_customer(self, idn_id: str) -> PricingTables:
        """The same tables with one customer, its contracts, their rebates and transactions."""
        return CustomerTables(self, idn_id)


class CustomerTables(PricingTables):
    """One customer's part of a table set, by a predicate on the text id."""

    def __init__(self, tables: PricingTables, idn_id: str):
        self._tables = tables
        self.idn_id = idn_id
        self.gpos, self.facilities, self.products = tables.gpos, tables.facilities, tables.products

    def _own(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("idn_id") == F.lit(self.idn_id))

    @cached_property
    def idns(self) -> DataFrame:
        return self._own(self._tables.idns)

    @cached_property
    def contracts(self) -> DataFrame:
        return self._own(self._tables.contracts)

    @cached_property
    def customer_contracts(self) -> DataFrame:
        return self._own(self._tables.customer_contracts)

    @cached_property
    def transactions(self) -> DataFrame:
        return self._own(self._tables.transactions)

    @cached_property
    def rebate_programs(self) -> DataFrame:
        rebates = self._tables.rebate_programs
        own = self.contracts.select("contract_id")
        return rebates.join(own, "contract_id", "left_semi").select(rebates.columns)


class FrameTables(PricingTables):
    """Tables given as DataFrames, for example read from a store or built in a test."""

    def __init__(self, **frames: DataFrame):
        unknown = set(frames) - set(TABLE_NAMES)
        if unknown:
            raise ValueError(f"not pricing tables: {sorted(unknown)}")
        for name, frame in frames.items():
            setattr(self, name, frame)
