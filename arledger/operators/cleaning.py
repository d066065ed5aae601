"""Cleaning of raw claim rows: exact duplicates out, then typed columns.

Raw frames hold text only. Cleaning is one duplicate drop (one shuffle) plus one
projection, so every later filter on a key column still moves down to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arledger.fixed_values import BUCKET_NAME_PARTS, DATE_NAME_PARTS, MONEY_NAME_PARTS
from arledger.functions.cells import (
    blank_to_null,
    money_or_zero,
    normalize_bucket,
    number_or_zero,
    parse_date,
)
from arledger.operators.columns import LINEAGE, NORMALIZED


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first of equal rows per sheet; nulls are equal, row position is no data.

    A grouped minimum combines copies before the shuffle, so one row copied a billion
    times costs one row per task, and the kept position does not depend on task order.
    """
    if "row_pos" not in df.columns:
        return df.dropDuplicates()
    keys = [name for name in df.columns if name != "row_pos"]
    return df.groupBy(*keys).agg(F.min("row_pos").alias("row_pos")).select(*df.columns)


def _named_like(name: str, parts: Iterable[str]) -> bool:
    return any(part in name for part in parts)


def _clean_cell(
    name: str,
    dtype: T.DataType,
    dates: Iterable[str] | None,
    money: Iterable[str] | None,
    buckets: Iterable[str] | None,
) -> Column:
    is_bucket = name in buckets if buckets is not None else _named_like(name, BUCKET_NAME_PARTS)
    is_date = name in dates if dates is not None else _named_like(name, DATE_NAME_PARTS)
    is_money = (
        name in money
        if money is not None
        else _named_like(name, MONEY_NAME_PARTS) and not is_bucket
    )
    cell = F.col(f"`{name}`")
    text = isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))
    if is_money and is_date:
        # A date is read first and is then no number, which counts as zero.
        clean = F.lit(0.0)
    elif is_money:
        clean = money_or_zero(cell) if text else number_or_zero(cell)
    elif is_date:
        clean = parse_date(cell) if text else cell.cast("timestamp")
    elif is_bucket:
        return blank_to_null(normalize_bucket(cell)).alias(name, metadata=NORMALIZED)
    else:
        clean = blank_to_null(cell) if text else cell
    return clean.alias(name)


def clean_claims(
    df: DataFrame,
    *,
    duplicates: str = "raw",
    dates: Iterable[str] | None = None,
    money: Iterable[str] | None = None,
    buckets: Iterable[str] | None = None,
) -> DataFrame:
    """Raw rows -> typed rows.

    ``duplicates="raw"`` drops copies by their raw text, so ``$100`` and ``100`` both stay.
    ``duplicates="keep"`` leaves copies in, for callers that drop them later by cleaned
    value: the distinct cleaned rows are the same with or without the raw drop, so doing
    both would shuffle all rows twice for nothing.

    Columns get their type from parts of their names unless the lists name them.
    """
    if duplicates not in ("raw", "keep"):
        raise ValueError("duplicates must be 'raw' or 'keep'")
    rows = drop_exact_duplicates(df) if duplicates == "raw" else df
    cells = [
        F.col(field.name)
        if field.name in LINEAGE
        else _clean_cell(field.name, field.dataType, dates, money, buckets)
        for field in rows.schema.fields
    ]
    return rows.select(*cells)
