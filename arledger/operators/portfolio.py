"""Unique claim portfolio: the newest row of every claim over all snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arledger.functions.cells import composite_key
from arledger.operators.metrics import topline
from arledger.operators.snapshots import parse_snapshot_date


def with_claim_key(df: DataFrame) -> DataFrame:
    """Add ``composite_key``."""
    if "composite_key" in df.columns:
        return df
    return df.withColumn("composite_key", composite_key(F.col("patient_id"), F.col("claim_id")))


def latest_claims(df: DataFrame) -> DataFrame:
    """Newest row per claim; inside one date the last sheet, inside a sheet the last row.

    Keeping rank 1 only lets the plan cut each task down to one row per claim before the
    shuffle, so claims without ids, which share one key, do not end up in one big task.
    """
    if "snapshot_date" not in df.columns:
        df = df.withColumn("snapshot_date", parse_snapshot_date(F.col("sheet_name")))
    newest_first = W.partitionBy("composite_key").orderBy(
        F.desc("snapshot_date"), F.desc("sheet_pos"), F.desc("row_pos")
    )
    ranked = with_claim_key(df).withColumn("_rank", F.row_number().over(newest_first))
    return ranked.filter("_rank = 1").drop("_rank")


def portfolio_topline(df: DataFrame) -> DataFrame:
    """Topline over unique claims."""
    return topline(latest_claims(df))
