"""Trends over snapshots. There is no loop over sheets: the sheet is a grouping key."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arledger.fixed_values import TREND_DATES
from arledger.functions.text import count_text, delta_text, money_cents_text, money_millions_text
from arledger.operators.cleaning import drop_exact_duplicates
from arledger.operators.columns import SHEET_KEYS
from arledger.operators.filters import target_dates, week_labels
from arledger.operators.measures import MEASURES, condense, need
from arledger.operators.metrics import aging_table, bucket_rank
from arledger.operators.snapshots import (
    date_grouped,
    dated,
    latest_sheet,
    ordered_sheets,
    tag_snapshots,
)

SUMMARY_COLUMNS = (
    "snapshot_date",
    "sheet_name",
    "snapshot_label",
    "total_claims",
    "open_claims",
    "outstanding_balance",
    "claims_worked",
    "dollars_recovered",
)


class Trend(NamedTuple):
    """Lazy trend tables. ``sheets`` is newest first, ``latest`` has one row."""

    snapshot_summary: DataFrame
    aging_distribution: DataFrame
    sheets: DataFrame
    latest: DataFrame


def trend_cube(df: DataFrame) -> DataFrame:
    """Measures per (dated sheet, bucket, worker) of claims; both trend tables are sums of
    it, so they share one pass when it is written or cached.

    A trend drops equal rows by cleaned value, where ``$100`` and ``100`` are the same, so
    its counts can be below those of the same snapshot elsewhere.
    """
    if "snapshot_date" in df.columns:
        df = dated(df)
    rows = drop_exact_duplicates(df)
    cube = condense(need(rows, "balance", "worked_by", "aging_bucket"))
    return date_grouped(cube, "n_claims")


def _cube(df: DataFrame) -> DataFrame:
    return df if "n_claims" in df.columns else trend_cube(df)


def snapshot_summary(
    df: DataFrame, sheets: DataFrame | None = None, positions: bool = False
) -> DataFrame:
    """One row per dated sheet, oldest first. With ``sheets`` a sheet that a filter left
    without rows still shows, with zeros. ``df`` is claims or a ``trend_cube``. With
    ``positions`` the sheet's position is kept, which orders sheets of one date."""
    keys = (*SHEET_KEYS, "snapshot_date")
    sums = _cube(df).groupBy(*keys).agg(*(F.sum(m).alias(m) for m in MEASURES))
    if sheets is not None:
        counts = sums.drop("snapshot_date")
        sums = sheets.select(*keys).join(counts, list(SHEET_KEYS), "left")
        sums = sums.na.fill(0, list(MEASURES))
    table = tag_snapshots(sums).withColumnsRenamed(
        {
            "n_claims": "total_claims",
            "n_open": "open_claims",
            "sum_outstanding": "outstanding_balance",
            "n_worked": "claims_worked",
            "sum_recovered": "dollars_recovered",
        }
    )
    kept = (*SUMMARY_COLUMNS, "sheet_pos") if positions else SUMMARY_COLUMNS
    return table.orderBy("snapshot_date", "sheet_pos").select(*kept)


def aging_trend(
    df: DataFrame, keep_unknown: bool = False, positions: bool = False
) -> DataFrame:
    """Aging summary per dated sheet, newest first; shares are within the sheet. With
    ``positions`` the sheet's position is kept."""
    table = tag_snapshots(aging_table(_cube(df), (*SHEET_KEYS, "snapshot_date")))
    rank = bucket_rank(F.col("aging_bucket"))
    ordered = table.orderBy(
        F.desc("snapshot_date"),
        "sheet_pos",
        rank.asc_nulls_last(),
        F.col("aging_bucket").asc_nulls_last(),
    )
    ordered = ordered if positions else ordered.drop("sheet_pos")
    if keep_unknown:
        return ordered
    return ordered.withColumn("aging_bucket", F.when(rank.isNotNull(), F.col("aging_bucket")))


def build_trend(df: DataFrame, sheets: DataFrame) -> Trend:
    """All trend tables of filtered, cleaned claims. ``sheets`` is the list of dated sheets
    taken before filtering. Both tables keep the sheet's position, by which later tables
    order sheets of one date."""
    cube = trend_cube(df)
    return Trend(
        snapshot_summary(cube, sheets, positions=True),
        aging_trend(cube, positions=True),
        ordered_sheets(sheets),
        latest_sheet(sheets),
    )


def claims_trend_long(summary: DataFrame) -> DataFrame:
    """Total and open claims as one long series: (snapshot_date, variable, value)."""
    return summary.unpivot(
        ["snapshot_date"], ["total_claims", "open_claims"], "variable", "value"
    )


def series(summary: DataFrame, *values: str) -> DataFrame:
    """Points of a line over time: snapshot_date and the given columns."""
    return summary.select("snapshot_date", *values)


def outstanding_series(summary: DataFrame) -> DataFrame:
    return series(summary, "outstanding_balance")


def recovery_series(summary: DataFrame) -> DataFrame:
    return series(summary, "dollars_recovered")


def claims_worked_series(summary: DataFrame) -> DataFrame:
    return series(summary, "claims_worked")


def progression_series(summary: DataFrame, dates: Sequence[str] = TREND_DATES) -> DataFrame:
    """Outstanding balance per week, with its label text."""
    return week_labels(summary, dates).select(
        "week_label",
        "outstanding_balance",
        money_millions_text(F.col("outstanding_balance")).alias("outstanding_text"),
    )


def productivity_series(summary: DataFrame, dates: Sequence[str] = TREND_DATES) -> DataFrame:
    """Claims and outstanding balance per week (two axes), with label texts."""
    return week_labels(summary, dates).select(
        "week_label",
        "total_claims",
        count_text(F.col("total_claims")).alias("claims_text"),
        "outstanding_balance",
        money_millions_text(F.col("outstanding_balance")).alias("outstanding_text"),
    )


def progression_table(summary: DataFrame) -> DataFrame:
    """Summary under report headings."""
    return summary.select(
        F.col("snapshot_label").alias("Snapshot Date"),
        F.col("total_claims").alias("Total Claims"),
        F.col("open_claims").alias("Open Claims"),
        F.col("outstanding_balance").alias("Outstanding AR ($)"),
        F.col("dollars_recovered").alias("Balance Reductions ($)"),
        F.col("claims_worked").alias("Touches"),
    )


def _sheet_place(df: DataFrame) -> list[str]:
    """Columns that order snapshots: sheets of one date by position, by name without it."""
    return ["snapshot_date", "sheet_pos" if "sheet_pos" in df.columns else "sheet_name"]


def _first_and_last(summary: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row of structs ``b`` and ``e``: the values of the first and the last snapshot."""
    row = F.struct(*values)
    place = F.struct(*_sheet_place(summary))
    ends = summary.agg(F.min_by(row, place).alias("b"), F.max_by(row, place).alias("e"))
    return ends.filter("b is not null")


def snapshot_deltas(summary: DataFrame) -> DataFrame:
    """First against last snapshot: (metric, begin_value, end_value, diff, pct)."""
    values = (
        "outstanding_balance",
        "dollars_recovered",
        "claims_worked",
        "total_claims",
        "open_claims",
        "closed_claims",
    )
    with_closed = summary.withColumn(
        "closed_claims", F.col("total_claims") - F.col("open_claims")
    )
    pairs = F.array(
        *(
            F.struct(
                F.lit(v).alias("metric"),
                F.col(f"b.{v}").cast("double").alias("begin_value"),
                F.col(f"e.{v}").cast("double").alias("end_value"),
            )
            for v in values
        )
    )
    diff = F.col("end_value") - F.col("begin_value")
    pct = F.try_divide(diff, F.nullif(F.col("begin_value"), F.lit(0.0))) * 100
    return (
        _first_and_last(with_closed, values)
        .select(F.inline(pairs))
        .withColumn("diff", diff)
        .withColumn("pct", F.coalesce(pct, F.lit(0.0)))
    )


def delta_cards(deltas: DataFrame) -> DataFrame:
    """Delta rows as text: (metric, value_text, delta_text)."""
    money = F.col("metric").isin("outstanding_balance", "dollars_recovered")
    end, diff, pct = F.col("end_value"), F.col("diff"), F.col("pct")
    return deltas.select(
        "metric",
        F.when(money, money_cents_text(end)).otherwise(count_text(end)).alias("value_text"),
        F.when(money, delta_text(diff, pct, money=True))
        .otherwise(delta_text(diff, pct, money=False))
        .alias("delta_text"),
    )


def net_improvement(summary: DataFrame, dates: Sequence[str] = TREND_DATES) -> DataFrame:
    """What went down between the first and last given day: begin minus end. No row unless
    every given day has a snapshot."""
    values = ("total_claims", "outstanding_balance")
    ends = _first_and_last(target_dates(summary, dates, complete=True), values)
    return ends.select(
        F.col("b.total_claims").alias("begin_claims"),
        F.col("e.total_claims").alias("end_claims"),
        (F.col("b.total_claims") - F.col("e.total_claims")).alias("claims_reduction"),
        F.col("b.outstanding_balance").alias("begin_balance"),
        F.col("e.outstanding_balance").alias("end_balance"),
        (F.col("b.outstanding_balance") - F.col("e.outstanding_balance")).alias(
            "balance_reduction"
        ),
    )


def bucket_growth(aging: DataFrame) -> DataFrame:
    """Change of each bucket from one snapshot to the next; null for its first snapshot."""
    earlier = W.partitionBy("aging_bucket").orderBy(*_sheet_place(aging))
    return aging.select(
        "snapshot_date",
        "sheet_name",
        "aging_bucket",
        "claim_count",
        "outstanding_balance",
        (F.col("claim_count") - F.lag("claim_count").over(earlier)).alias("claim_change"),
        (F.col("outstanding_balance") - F.lag("outstanding_balance").over(earlier)).alias(
            "balance_change"
        ),
    )
