"""Additive measures of claim rows.

Every sum and count of the metric tables is a sum of the columns made here. Rows can be
condensed early: ``condense`` adds the measures up per sheet, bucket and worker, and the
metric functions accept claims, measures or condensed measures alike. So one pass over
the claims serves any number of metric tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.functions.cells import number_or_zero
from arledger.operators.columns import resolve, sheet_keys

MEASURES = ("n_claims", "n_open", "n_done", "n_worked", "sum_outstanding", "sum_recovered")
_DIMENSIONS = ("aging_bucket", "worked_by")


def recovered_amount(df: DataFrame) -> Column:
    """Money got back per row: the recovered column if there is one (it may be negative),
    else what the balance is below the amount, never less than zero; else zero."""
    if name := resolve(df, "recovered"):
        return number_or_zero(F.col(name))
    amount, balance = resolve(df, "amount"), resolve(df, "balance")
    if amount and balance:
        paid = number_or_zero(F.col(amount)) - number_or_zero(F.col(balance))
        # inf - inf is no number and adds nothing.
        return F.greatest(F.nanvl(paid, F.lit(0.0)), F.lit(0.0))
    return F.lit(0.0)


def is_done(balance: Column) -> Column:
    """Balance at or below zero; an unknown balance is not done."""
    return F.coalesce(balance.try_cast("double") <= 0, F.lit(False))


def claim_measures(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Claims -> sheet keys, ``more`` columns, aging_bucket and worked_by (where present) and
    measures.

    Frames that hold measures already pass through. A measure whose column is missing is
    left out, so that ``need`` can name it.
    """
    if "n_claims" in df.columns:
        return df
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    cells = [F.col(name) for name in (*sheet_keys(df), *more)]
    for role in _DIMENSIONS:
        if name := resolve(df, role):
            cells.append(F.col(name).alias(role))
    cells.append(one.alias("n_claims"))
    if name := resolve(df, "balance"):
        balance = number_or_zero(F.col(name))
        cells += [
            F.when(balance > 0, one).otherwise(zero).alias("n_open"),
            F.when(is_done(F.col(name)), one).otherwise(zero).alias("n_done"),
            balance.alias("sum_outstanding"),
        ]
    if name := resolve(df, "worked_by"):
        cells.append(F.when(F.col(name).isNotNull(), one).otherwise(zero).alias("n_worked"))
    cells.append(recovered_amount(df).alias("sum_recovered"))
    return df.select(*cells)


def need(df: DataFrame, *roles: str) -> DataFrame:
    """Measures of ``df``; a KeyError names the columns one of the roles could have had."""
    measured = claim_measures(df)
    if measured is not df:
        for role in roles:
            resolve(df, role, required=True)
    return measured


def total(name: str) -> Column:
    """Sum of a measure, zero for no rows."""
    return F.coalesce(F.sum(name), F.lit(0))


def condense(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Measures added up per sheet, bucket, worker and ``more`` columns."""
    measured = claim_measures(df, more)
    keys = [c for c in measured.columns if c not in MEASURES]
    sums = [F.sum(c).alias(c) for c in measured.columns if c in MEASURES]
    return measured.groupBy(*keys).agg(*sums)
