"""Follow-up analysis: the same claim worked again and again over the snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arledger.fixed_values import MISSING_ID
from arledger.functions.text import touch_label
from arledger.operators.columns import resolve
from arledger.operators.filters import worked_rows
from arledger.operators.metrics import bucket_rank
from arledger.operators.portfolio import with_claim_key

ROW_ORDER = ("sheet_pos", "row_pos")


def _known_position(name: str, order: Sequence[str]) -> Column:
    """Position of a row where the value is known, else null, which min_by and max_by
    pass over. Plain first/last would depend on the order rows arrive in after a shuffle."""
    return F.when(F.col(name).isNotNull(), F.struct(*order))


def _last_known(name: str, order: Sequence[str]) -> Column:
    return F.max_by(name, _known_position(name, order))


def _ids_of_key(key: str) -> tuple[Column, Column, Column]:
    """Whether a key can have come from one pair of ids only, and these: it has one ``_``, so there is
    none in the ids, and neither part is the mark of a missing id."""
    parts = F.substring_index(key, "_", 1), F.substring_index(key, "_", -1)
    single = F.char_length(key) - F.char_length(F.replace(F.col(key), F.lit("_"), F.lit(""))) == 1
    return single & (parts[0] != MISSING_ID) & (parts[1] != MISSING_ID), *parts


def follow_up_stats(df: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """One row per worked claim: touches, distinct workers and days, first and last values.

    "First" and "last" follow sheet order, then row order; pass
    ``order=("snapshot_date", "row_pos")`` to follow dates.

    One aggregate by claim, so rows are shuffled once, after tasks have added up theirs.
    Workers and days are collected as sets, which hold at most all workers and all days,
    also for the key that rows without ids share; counting two distinct columns would
    multiply the rows instead. First and last values are minima of (position, value). Ids that the
    key tells are read from it and not carried through the shuffle.
    """
    worked = with_claim_key(worked_rows(df))
    told, *of_key = _ids_of_key("composite_key")
    ids = {}
    if "composite_key" not in df.columns:
        ids = {n: c for n, c in zip(("patient_id", "claim_id"), of_key) if df.schema[n].dataType == T.StringType()}

    def value(name: str, pick: Callable[[Column], Column]) -> Column:
        known = F.col(name).isNotNull() & ~told if name in ids else F.col(name).isNotNull()
        found = pick(F.when(known, F.struct(*order, F.col(name).alias("_v"))))["_v"]
        return F.coalesce(found, F.when(told, ids[name])) if name in ids else found

    stats = worked.groupBy("composite_key").agg(
        F.count(F.lit(1)).alias("touch_count"),
        F.size(F.collect_set("report_worked_by")).cast("long").alias("unique_workers"),
        F.size(F.collect_set("report_worked_date")).cast("long").alias("worked_dates"),
        value("claim_status", F.max).alias("latest_status"),
        value("claim_balance", F.max).alias("latest_balance"),
        value("claim_balance", F.min).alias("initial_balance"),
        value("patient_id", F.min).alias("patient_id"),
        value("claim_id", F.min).alias("claim_id"),
        value("plan_name", F.min).alias("plan_name"),
        value("report_worked_by", F.max).alias("report_worked_by"),
    )
    recovered = F.greatest(F.col("initial_balance") - F.col("latest_balance"), F.lit(0.0))
    return stats.withColumn("recovered_amount", recovered)


def multi_touch(stats: DataFrame) -> DataFrame:
    """Claims worked more than once."""
    return stats.filter("touch_count > 1")


def follow_up_kpis(stats: DataFrame) -> DataFrame:
    """One row: claims worked, followed up, rate, mean touches and money of follow-ups."""
    again = F.col("touch_count") > 1
    worked, followed = F.count(F.lit(1)), F.count_if(again)
    rate = F.try_divide(followed * 100.0, worked)
    return stats.agg(
        worked.alias("claims_worked"),
        followed.alias("claims_followed_up"),
        F.coalesce(rate, F.lit(0.0)).alias("follow_up_rate"),
        F.coalesce(F.avg(F.when(again, F.col("touch_count"))), F.lit(0.0)).alias(
            "average_touches"
        ),
        F.coalesce(F.sum(F.when(again, F.col("recovered_amount"))), F.lit(0.0)).alias(
            "recovered_amount"
        ),
    )


def touch_frequency(stats: DataFrame) -> DataFrame:
    """Claims per number of touches; labels sort as text, so ``10x`` comes before ``2x``."""
    counts = stats.groupBy("touch_count").agg(F.count(F.lit(1)).alias("claim_count"))
    return counts.select(
        touch_label(F.col("touch_count")).alias("touch_count"), "claim_count"
    ).orderBy("touch_count")


def touch_counts(df: DataFrame) -> DataFrame:
    """Touches per worked claim alone: what frequency and rate need, without the values
    that ``follow_up_stats`` carries through its shuffle."""
    worked = with_claim_key(worked_rows(df))
    return worked.groupBy("composite_key").agg(F.count(F.lit(1)).alias("touch_count"))


def follow_up_registry(stats: DataFrame, display: bool = True) -> DataFrame:
    """Claims worked more than once, under report headings. ``display`` sorts them by
    touches; exports leave the order open and save that sort."""
    table = multi_touch(stats).select(
        F.col("patient_id").alias("Patient ID"),
        F.col("claim_id").alias("Claim ID"),
        F.col("plan_name").alias("Plan Name"),
        F.col("touch_count").alias("Total Touches"),
        F.col("initial_balance").alias("Initial Balance ($)"),
        F.col("latest_balance").alias("Latest Balance ($)"),
        F.col("recovered_amount").alias("Recovered Amount ($)"),
        F.col("latest_status").alias("Latest Status"),
        F.col("report_worked_by").alias("Last Action By"),
    )
    if not display:
        return table
    return table.orderBy(F.desc("Total Touches"), "Patient ID", "Claim ID")


def follow_up_by_bucket(df: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Claims worked more than once per aging bucket; a claim counts for its last known
    bucket."""
    bucket = resolve(df, "aging_bucket", required=True)
    worked = with_claim_key(worked_rows(df))
    claims = worked.groupBy("composite_key").agg(
        F.count(F.lit(1)).alias("touch_count"),
        _last_known(bucket, order).alias("aging_bucket"),
    )
    counts = multi_touch(claims).groupBy("aging_bucket").agg(
        F.count(F.lit(1)).alias("follow_up_count")
    )
    return counts.orderBy(
        bucket_rank(F.col("aging_bucket")).asc_nulls_last(),
        F.col("aging_bucket").asc_nulls_last(),
    )


def follow_up_by_employee(df: DataFrame) -> DataFrame:
    """Touches on claims worked more than once, per worker.

    Rows are added up per (claim, worker) first. The window that finds multi-touch claims
    then sees at most one row per worker of a claim, also for the key shared by all rows
    without ids.
    """
    worker = resolve(df, "worked_by", required=True)
    per_worker = (
        with_claim_key(worked_rows(df))
        .groupBy("composite_key", F.col(worker).alias("worked_by"))
        .agg(F.count(F.lit(1)).alias("touches"))
    )
    of_claim = F.sum("touches").over(W.partitionBy("composite_key"))
    multi = per_worker.withColumn("_claim_touches", of_claim).filter("_claim_touches > 1")
    return (
        multi.groupBy("worked_by")
        .agg(F.sum("touches").alias("follow_up_touches"))
        .orderBy("worked_by")
    )
