"""Roles: which column of a frame holds the balance, the worker, the aging label ..."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.fixed_values import ROLE_CANDIDATES
from arledger.functions.cells import normalize_bucket

SHEET_KEYS = ("sheet_name", "sheet_pos")
# Columns that say where a row came from; they are no data of the row.
LINEAGE = (*SHEET_KEYS, "snapshot_date", "row_pos", "batch_id")


def first_present(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """First candidate that is among the columns."""
    present = set(columns)
    return next((name for name in candidates if name in present), None)


def resolve(df: DataFrame, role: str, required: bool = False) -> str | None:
    """Column name that plays a role; reads the schema only."""
    candidates = ROLE_CANDIDATES[role]
    found = first_present(df.columns, candidates)
    if found is None and required:
        raise KeyError(f"no column for role '{role}'; expected one of: {', '.join(candidates)}")
    return found


def role_column(df: DataFrame, role: str) -> Column:
    """Column of a role that must be there."""
    return F.col(resolve(df, role, required=True))


def sheet_keys(df: DataFrame) -> list[str]:
    """The sheet-identifying columns this frame carries."""
    return [name for name in SHEET_KEYS if name in df.columns]


# Schema note that cleaning leaves on columns whose labels it has made canonical.
NORMALIZED = {"arledger.normalized": True}


def canonical_bucket(df: DataFrame, name: str) -> Column:
    """Canonical bucket of a label column. Cleaned columns are marked in the schema and are
    taken as they are: doing it again changes nothing and is the costliest expression."""
    if df.schema[name].metadata.get("arledger.normalized"):
        return F.col(name)
    return normalize_bucket(F.col(name))
