"""Tenant scoping of whole table sets, and ad-hoc SQL inside one tenant."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from marginflow.model import TABLE_NAMES, PricingTables
from marginflow.operators.predicates import for_tenant
from marginflow.operators.resolved import check_resolved
from marginflow.operators.views import VIEWS, register_views


class ScopedTables(PricingTables):
    """One tenant's part of a table set, or one customer's; reference tables are shared."""

    def __init__(self, tables: PricingTables, tenant: str, idn_id: str | None = None):
        self._tables = tables if idn_id is None else tables.of_customer(idn_id)
        self.tenant = tenant
        self.idn_id = idn_id

    def _own(self, df: DataFrame) -> DataFrame:
        return for_tenant(df, self.tenant)

    def of_customer(self, idn_id: str) -> PricingTables:
        if self.idn_id not in (None, idn_id):
            raise ValueError("these tables already hold one other customer")
        return ScopedTables(self._tables, self.tenant, idn_id)

    @contextmanager
    def held(self) -> Iterator[ScopedTables]:
        """Keep the transactions of the scope while several reports read them.

        Kept blocks spill to disk and are recomputed from their source when an
        executor is lost.
        """
        self.transactions.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield self
        finally:
            self.transactions.unpersist()

    @property
    def gpos(self) -> DataFrame:
        return self._tables.gpos

    @property
    def idns(self) -> DataFrame:
        return self._tables.idns

    @property
    def facilities(self) -> DataFrame:
        return self._tables.facilities

    @property
    def products(self) -> DataFrame:
        return self._tables.products

    @cached_property
    def contracts(self) -> DataFrame:
        return self._own(self._tables.contracts)

    @cached_property
    def customer_contracts(self) -> DataFrame:
        return self._own(self._tables.customer_contracts)

    @cached_property
    def contract_totals(self) -> DataFrame:
        return self._own(self._tables.contract_totals)

    @cached_property
    def totalled_contracts(self) -> DataFrame:
        return self._own(self._tables.totalled_contracts)

    @cached_property
    def transactions(self) -> DataFrame:
        return self._own(self._tables.transactions)

    @cached_property
    def rebate_programs(self) -> DataFrame:
        own = self.contracts.select("contract_id")
        return self._tables.rebate_programs.join(own, "contract_id", "left_semi").select(
            self._tables.rebate_programs.columns
        )


class TenantSession:
    """A child session that sees one tenant's tables and views and nothing else.

    Isolation does not depend on the text of a query: relations are filtered before
    they are registered.  The text runs as a sub-query, which admits one SELECT and
    rejects settings, DDL and writes; reading files by path is switched off.  What the
    text resolves to is checked before it is returned: registered relations only, no call
    of Java methods, scripts or user functions, however they are spelled.  This is a guard
    for honest queries, not a substitute for storage permissions.
    """

    def __init__(
        self, spark: SparkSession, open_tables: Callable[[SparkSession], PricingTables], tenant: str
    ):
        self.spark = spark.newSession()
        for name, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(name) and self.spark.conf.get(name, None) != value:
                self.spark.conf.set(name, value)
        self.tables = ScopedTables(open_tables(self.spark), tenant)
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self._registered: set[str] = set()

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        lowered = text.lower()
        mentioned = [n for n in (*TABLE_NAMES, *VIEWS) if n in lowered and n not in self._registered]
        if mentioned:
            self._registered.update(register_views(self.tables, tuple(mentioned)))
        body = text.strip().rstrip(";")
        answer = self.spark.sql(f"SELECT * FROM (\n{body}\n) AS answer", args)
        check_resolved(answer, self._registered)
        return answer

    def value(self, text: str, args: dict | list | None = None) -> Column:
        """First column of the first row as a scalar sub-query, in its own type.

        NULL stays NULL; without a row a number is 0 and any other value NULL.
        """
        answer = self.sql(text, args)
        kind = answer.schema[0].dataType
        missing = F.lit(0 if isinstance(kind, NumericType) else None).cast(kind)
        found = answer.toDF(*[f"c{n}" for n in range(len(answer.columns))]).limit(1)
        row_found = F.count(F.lit(1)) > 0
        return found.agg(F.when(row_found, F.first("c0")).otherwise(missing).alias("value")).scalar()

    def scalar(self, text: str, args: dict | list | None = None) -> DataFrame:
        """The value of a scalar query as a one-row frame."""
        return self.spark.range(1).select(self.value(text, args).alias("value"))
