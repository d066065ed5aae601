"""The snapshot manifest: a row per dated sheet that answers what needs no claims.

It holds how many rows a sheet has, how many of them have a bucket and a filter date, and the first
and last of these days. Sheet lists, the newest sheet, date bounds and whether "everything ticked"
leaves rows out all follow from it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arledger.operators.cleaning import clean_claims
from arledger.operators.columns import resolve, sheet_keys
from arledger.operators.filters import filter_day
from arledger.operators.snapshots import date_grouped, dated

COLUMNS = (
    "sheet_name", "sheet_pos", "snapshot_date", "n_rows", "n_bucketed", "n_dated", "first_day", "last_day"
)


class Manifest(NamedTuple):
    """``sheets`` has ``COLUMNS``; the rest are its answers that plans are built with. ``names``
    are the dated sheets, where the rows are with the driver."""

    sheets: DataFrame
    newest: str | None
    has_bucket: bool
    has_day: bool
    names: tuple[str, ...] | None = None


def sheet_manifest(df: DataFrame) -> DataFrame:
    """Manifest rows of claims, raw or cleaned, in one pass over three columns.

    Rows are counted by their labels and dates as they stand, and only the different ones
    are read as buckets and days. Rows without a copy or with many count alike, so that raw rows
    need no duplicate drop first; ``n_rows`` then counts copies too.
    """
    bucket, day = resolve(df, "aging_bucket"), resolve(df, "filter_date")
    cells = [name for name in dict.fromkeys((bucket, day)) if name]
    keys = sheet_keys(df) + (["snapshot_date"] if "snapshot_date" in df.columns else [])
    rows = dated(df) if "snapshot_date" in df.columns else df
    counted = rows.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n"))
    read = clean_claims(counted, duplicates="keep")
    has_bucket = F.col(bucket).isNotNull() if bucket else F.lit(False)
    filled = filter_day(read) if day else F.lit(None).cast("date")
    table = read.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.when(has_bucket, F.col("_n")).otherwise(0)).alias("n_bucketed"),
        F.sum(F.when(filled.isNotNull(), F.col("_n")).otherwise(0)).alias("n_dated"),
        F.min(filled).alias("first_day"),
        F.max(filled).alias("last_day"),
    )
    table = table if "snapshot_date" in df.columns else date_grouped(table, "n_rows")
    return table.select(*COLUMNS)


def with_sheets(table: DataFrame, sheets: DataFrame) -> DataFrame:
    """Manifest of the given sheets (sheet_name, sheet_pos, snapshot_date); those without rows
    have zeros."""
    known = dated(sheets).select("sheet_name", "sheet_pos", "snapshot_date").distinct()
    counts = table.drop("sheet_pos", "snapshot_date")
    joined = known.join(counts, "sheet_name", "left").na.fill(0, ["n_rows", "n_bucketed", "n_dated"])
    return joined.select(*COLUMNS)


def read_manifest(table: DataFrame) -> Manifest:
    """The table with its answers, worked out once. One row comes to the driver."""
    newest = F.max_by("sheet_name", F.struct(F.col("snapshot_date"), (-F.col("sheet_pos")).alias("place")))
    row = table.agg(
        newest.alias("newest"), F.sum("n_bucketed").alias("bucketed"), F.sum("n_dated").alias("dated")
    ).first()
    return Manifest(table, row["newest"], bool(row["bucketed"]), bool(row["dated"]))


def collected_manifest(spark: SparkSession, table: DataFrame) -> Manifest:
    """``read_manifest`` with the rows, one per sheet like the sheet list, kept by the driver, so
    that no plan derives them again."""
    rows = table.collect()
    manifest = read_manifest(spark.createDataFrame(rows, table.schema))
    return manifest._replace(names=tuple(sorted(r["sheet_name"] for r in rows)))


def dated_rows(df: DataFrame, manifest: Manifest) -> DataFrame:
    """``dated`` without reading a sheet's name as a date in each of its rows."""
    if "snapshot_date" in df.columns or manifest.names is None:
        return dated(df)
    return df.where(F.col("sheet_name").isin(*manifest.names))


def manifest_bounds(manifest: Manifest) -> DataFrame:
    """``date_bounds`` of all rows: one row with the first and last day."""
    return manifest.sheets.agg(F.min("first_day").alias("min_date"), F.max("last_day").alias("max_date"))


def manifest_snapshot(df: DataFrame, manifest: Manifest) -> DataFrame:
    """Rows of the newest sheet. Its name is a literal, which moves down to the scan."""
    if manifest.newest is None:
        return df.where(F.lit(False))
    return df.where(F.col("sheet_name") == F.lit(manifest.newest))
