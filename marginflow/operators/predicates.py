"""Tenant and dimension predicates, composed as separate filters.

Values are always literals bound into column expressions, so quotes in a name or
an OR inside an extra condition cannot widen the result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"

# Filter dimensions each page element honours.
VIEW_DIMENSIONS = {
    "kpis": ("category", "region", "structure", "gpo"),
    "portfolio": ("category", "structure"),
    "waterfall": ("category",),
    "trends": ("category",),
    "customers": ("region", "gpo"),
    "risk": ("category", "structure"),
}

_COLUMN_OF = {"category": "device_category", "region": "region", "structure": "deal_structure"}


@dataclass(frozen=True)
class Filters:
    """Page selections; ``None`` or "All" leaves a dimension open."""

    category: str | None = None
    region: str | None = None
    structure: str | None = None
    gpo: str | None = None

    def selected(self, dims: Iterable[str]) -> dict[str, str]:
        chosen = {name: getattr(self, name) for name in dims}
        return {name: value for name, value in chosen.items() if value not in (None, ALL)}


def for_tenant(df: DataFrame, tenant: str | None, *conditions: Column) -> DataFrame:
    """Rows of one tenant (all tenants for ``None``) that meet every extra condition."""
    if tenant is not None:
        df = df.filter(F.col("tenant_id") == F.lit(tenant))
    for condition in conditions:
        df = df.filter(condition)
    return df


def dimension_condition(filters: Filters, dims: Iterable[str]) -> Column:
    """Equality on the chosen plain dimensions (everything but the buying group)."""
    condition = F.lit(True)
    for name, value in filters.selected(dims).items():
        if name in _COLUMN_OF:
            condition = condition & (F.col(_COLUMN_OF[name]) == F.lit(value))
    return condition


def in_gpo(df: DataFrame, gpos: DataFrame, name: str) -> DataFrame:
    """Keep rows whose ``gpo_id`` belongs to a buying group of that name."""
    return df.join(gpos.filter(F.col("name") == F.lit(name)).select("gpo_id"), "gpo_id", "left_semi")


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose ``column`` lies within the bounds, both included; NULL lies nowhere.

    For columns that are computed.  A plain filter moves below the projections and joins that
    compute its column, and each mention is spelled out there again: for a margin that makes a
    condition too long to be compiled.  A generated column stays where it is, computed once a row.
    """
    once = [F.explode(F.array(column)).alias(column) if c == column else F.col(c) for c in df.columns]
    return df.select(*once).filter(F.col(column).between(low, high))


def apply_filters(
    df: DataFrame, filters: Filters | None, dims: Iterable[str], gpos: DataFrame | None = None
) -> DataFrame:
    """Apply the chosen dimensions among ``dims``.

    The buying group is matched on ``gpo_name`` where the frame has it, otherwise
    through a semi join on ``gpo_id``.
    """
    if filters is None:
        return df
    dims = tuple(dims)
    if {d for d in filters.selected(dims) if d in _COLUMN_OF}:
        df = df.filter(dimension_condition(filters, dims))
    gpo = filters.selected(dims).get("gpo")
    if gpo is None:
        return df
    if "gpo_name" in df.columns:
        return df.filter(F.col("gpo_name") == F.lit(gpo))
    if gpos is None:
        raise ValueError("a buying-group filter on a table needs the gpos table")
    return in_gpo(df, gpos, gpo)
