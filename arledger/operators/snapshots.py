"""Snapshots: sheets, their dates, the newest one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.functions.cells import parse_date
from arledger.operators.columns import sheet_keys


def parse_snapshot_date(sheet_name: Column) -> Column:
    """Date in a sheet name; null for names that are no date."""
    return parse_date(sheet_name)


def snapshot_label(snapshot_date: Column) -> Column:
    """``2026-05-04``."""
    return F.date_format(snapshot_date, "yyyy-MM-dd")


def tag_snapshots(df: DataFrame) -> DataFrame:
    """Add ``snapshot_date`` and ``snapshot_label``."""
    if "snapshot_date" not in df.columns:
        df = df.withColumn("snapshot_date", parse_snapshot_date(F.col("sheet_name")))
    return df.withColumn("snapshot_label", snapshot_label(F.col("snapshot_date")))


def dated(df: DataFrame) -> DataFrame:
    """Rows of sheets whose name is a date. On a landed table this prunes partitions."""
    if "snapshot_date" in df.columns:
        return df.filter(F.col("snapshot_date").isNotNull())
    return df.filter(parse_snapshot_date(F.col("sheet_name")).isNotNull())


def date_grouped(df: DataFrame, count: str) -> DataFrame:
    """Add ``snapshot_date`` to rows grouped by sheet and keep dated ones.

    Tying the date to a count keeps the optimizer from moving the test below the grouping,
    where names would be parsed once per row instead of once per sheet.
    """
    date = F.when(F.col(count) > 0, parse_snapshot_date(F.col("sheet_name")))
    return df.withColumn("snapshot_date", date).filter(F.col("snapshot_date").isNotNull())


def sheet_list(df: DataFrame) -> DataFrame:
    """One row per dated sheet that has rows: sheet_name, sheet_pos, snapshot_date.

    Take the list from unfiltered rows: a sheet emptied by a filter is still a snapshot.
    """
    if "snapshot_date" in df.columns:
        return dated(df).select(*sheet_keys(df), "snapshot_date").distinct()
    counted = df.groupBy(*sheet_keys(df)).agg(F.count(F.lit(1)).alias("n_rows"))
    return date_grouped(counted, "n_rows").drop("n_rows")


def ordered_sheets(sheets: DataFrame) -> DataFrame:
    """Dated sheets, newest first; equal dates keep the sheet order."""
    return sheets.orderBy(F.desc("snapshot_date"), F.asc("sheet_pos"))


def latest_sheet(sheets: DataFrame) -> DataFrame:
    """One row, the newest sheet; of two sheets with one date the one that stands first."""
    newest = F.max_by(
        F.struct("sheet_name", "sheet_pos", "snapshot_date"),
        F.struct(F.col("snapshot_date"), (-F.col("sheet_pos")).alias("rank")),
    )
    return sheets.agg(newest.alias("s")).filter("s is not null").select("s.*")


def current_snapshot(df: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Rows of the newest dated sheet.

    The sheet is picked by a scalar subquery on sheet names alone, and the comparison
    moves below joins and grouping, so other snapshots are left out at the scan (on a
    landed table: as whole partitions). Pass ``sheets`` when ``df`` is already filtered.
    """
    newest = latest_sheet(sheet_list(df) if sheets is None else sheets)
    return df.filter(F.col("sheet_name") == newest.select("sheet_name").scalar())
