"""Metric tables: topline, aging, collection, productivity.

``by`` adds leading keys (for example the sheet), so one function serves the current
snapshot, all snapshots together and the trend. Keys are few and rows are many: all
tables are hash aggregates that combine inside each task before the shuffle, which also
takes care of buckets or workers that hold a large part of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arledger.fixed_values import BUCKET_ORDER, TOPLINE_METRICS
from arledger.operators.columns import resolve
from arledger.operators.measures import need, recovered_amount, total


def _share(part: Column, whole: Column) -> Column:
    """Percent, zero for an empty whole."""
    return F.coalesce(F.try_divide(part, F.nullif(whole, F.lit(0.0))) * 100, F.lit(0.0))


def bucket_rank(bucket: Column) -> Column:
    """Place of a bucket in report order; null for other labels."""
    order = F.array(*(F.lit(b) for b in BUCKET_ORDER))
    return F.nullif(F.array_position(order, bucket), F.lit(0).cast("bigint"))


def bucket_sort(df: DataFrame, by: Sequence[str] = (), keep_unknown: bool = False) -> DataFrame:
    """Report order, unknown labels last. Their label becomes null (after grouping, so
    several null rows can remain) unless ``keep_unknown``."""
    rank = bucket_rank(F.col("aging_bucket"))
    ordered = df.orderBy(
        *by, rank.asc_nulls_last(), F.col("aging_bucket").asc_nulls_last()
    )
    if keep_unknown:
        return ordered
    label = F.when(F.col("aging_bucket").isin(*BUCKET_ORDER), F.col("aging_bucket"))
    return ordered.withColumn("aging_bucket", label)


def topline_wide(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by``): claims, open, closed, outstanding, recovered. No rows in, no
    row out."""
    sums = need(df, "balance").groupBy(*by).agg(
        total("n_claims").alias("total_claims"),
        total("n_open").alias("open_claims"),
        total("sum_outstanding").alias("outstanding_balance"),
        total("sum_recovered").alias("dollars_recovered"),
    )
    return sums.filter("total_claims > 0").select(
        *by,
        "total_claims",
        "open_claims",
        (F.col("total_claims") - F.col("open_claims")).alias("closed_claims"),
        "outstanding_balance",
        "dollars_recovered",
    )


def topline(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Topline as a long table: (metric, value)."""
    wide = topline_wide(df, by)
    values = [c for c in wide.columns if c not in by]
    named = wide.select(
        *by,
        *(F.col(c).cast("double").alias(m) for c, m in zip(values, TOPLINE_METRICS)),
    )
    return named.unpivot(list(by), list(TOPLINE_METRICS), "metric", "value")


def aging_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``aging_summary`` without order, labels as they are."""
    sums = need(df, "aging_bucket", "balance").groupBy(*by, "aging_bucket").agg(
        total("n_claims").alias("claim_count"),
        total("n_done").alias("done_count"),
        total("sum_outstanding").alias("outstanding_balance"),
        total("sum_recovered").alias("recovered_amount"),
    )
    # The window runs over a handful of bucket rows, not over claims.
    whole = F.sum("outstanding_balance").over(W.partitionBy(*by))
    return sums.withColumn(
        "total_claimed", F.col("recovered_amount") + F.col("outstanding_balance")
    ).withColumn(
        "percentage_of_total_balance",
        F.col("outstanding_balance") / F.when(whole == 0, F.lit(1.0)).otherwise(whole) * 100,
    )


def aging_summary(
    df: DataFrame, by: Sequence[str] = (), keep_unknown: bool = False
) -> DataFrame:
    """Per bucket (no bucket is a group too): counts, money and share of the balance."""
    return bucket_sort(aging_table(df, by), by, keep_unknown)


def collection_summary(
    df: DataFrame, by: Sequence[str] = (), keep_unknown: bool = False
) -> DataFrame:
    """Per bucket: recovered, outstanding and recovered as percent of what is still
    outstanding (so it can exceed 100)."""
    sums = need(df, "aging_bucket", "balance").groupBy(*by, "aging_bucket").agg(
        total("sum_recovered").alias("recovered_amount"),
        total("sum_outstanding").alias("outstanding_balance"),
    )
    pct = _share(F.col("recovered_amount"), F.col("outstanding_balance"))
    return bucket_sort(sums.withColumn("recovery_percentage", pct), by, keep_unknown)


def claims_done_summary(
    df: DataFrame, by: Sequence[str] = (), keep_unknown: bool = False
) -> DataFrame:
    """Per bucket: number of done claims, money recovered over all claims."""
    sums = need(df, "aging_bucket", "balance").groupBy(*by, "aging_bucket").agg(
        total("n_done").alias("done_count"),
        total("sum_recovered").alias("recovered_amount"),
    )
    return bucket_sort(sums, by, keep_unknown)


def _touch_aggregates(df: DataFrame) -> list[Column]:
    claim_id = resolve(df, "claim_id")
    touches = F.count(F.lit(1))
    unique = F.count_distinct(F.col(claim_id)) if claim_id else touches
    return [unique.alias("unique_claims_touched"), touches.alias("total_touches")]


def average_touches() -> Column:
    """Touches per claim from the two counts, zero for none."""
    per_claim = F.try_divide(F.col("total_touches"), F.col("unique_claims_touched"))
    return F.coalesce(per_claim, F.lit(0.0)).alias("average_touches_per_claim")


def employee_productivity(
    df: DataFrame, by: Sequence[str] = (), per_bucket: bool = False
) -> DataFrame:
    """Per worker: distinct claims, touches, touches per claim. Rows without a worker are
    left out; touches without a claim id count as touches. ``per_bucket`` adds the bucket.

    Distinct claims are counted exactly: first per (worker, claim), then per worker, so
    the work of a busy worker is spread over all tasks.
    """
    worker = resolve(df, "worked_by", required=True)
    keys = [F.col(name) for name in by] + [F.col(worker).alias("worked_by")]
    if per_bucket:
        keys.append(F.col(resolve(df, "aging_bucket", required=True)).alias("aging_bucket"))
    counted = (
        df.filter(F.col(worker).isNotNull()).groupBy(*keys).agg(*_touch_aggregates(df))
    )
    return counted.select("*", average_touches())


def aging_worked(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Touches per (worker, bucket); missing workers and buckets are groups too."""
    measured = need(df, "worked_by", "aging_bucket")
    return measured.groupBy(*by, "worked_by", "aging_bucket").agg(
        total("n_claims").alias("touches")
    )


def employee_collection(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recovered money per worker, most first; rows without a worker are a group."""
    sums = need(df, "worked_by").groupBy(*by, "worked_by").agg(
        total("sum_recovered").alias("recovered_amount")
    )
    return sums.orderBy(*by, F.desc("recovered_amount"), "worked_by")


def claims_worked(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows that have a worker."""
    return need(df, "worked_by").groupBy(*by).agg(total("n_worked").alias("claims_worked"))


def employee_recovery(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recovery percentage per worker (rows without a worker are a group)."""
    sums = need(df, "worked_by", "balance").groupBy(*by, "worked_by").agg(
        total("sum_recovered").alias("recovered_amount"),
        total("sum_outstanding").alias("outstanding_balance"),
    )
    pct = _share(F.col("recovered_amount"), F.col("outstanding_balance"))
    return sums.withColumn("recovery_percentage", pct).orderBy(*by, "worked_by")


def overall_recovery(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recovery percentage of all rows."""
    sums = need(df, "balance").groupBy(*by).agg(
        total("sum_recovered").alias("recovered_amount"),
        total("sum_outstanding").alias("outstanding_balance"),
    )
    pct = _share(F.col("recovered_amount"), F.col("outstanding_balance"))
    return sums.withColumn("recovery_percentage", pct)


def worked_vs_recovered(productivity: DataFrame, collection: DataFrame) -> DataFrame:
    """Touches next to recovered money for workers in both tables. Both are one row per
    worker; the join strategy is left to the sizes seen at run time."""
    return productivity.join(collection, "worked_by", "inner").select(
        "worked_by", "total_touches", "unique_claims_touched", "recovered_amount"
    )


def touches_and_recovery(df: DataFrame) -> DataFrame:
    """``worked_vs_recovered`` of one claims frame, in a single pass without the join."""
    worker = resolve(df, "worked_by", required=True)
    unique, touches = _touch_aggregates(df)
    return (
        df.filter(F.col(worker).isNotNull())
        .withColumn("_recovered", recovered_amount(df))
        .groupBy(F.col(worker).alias("worked_by"))
        .agg(touches, unique, F.sum("_recovered").alias("recovered_amount"))
    )


def kpi_cards(df: DataFrame) -> DataFrame:
    """The six headline numbers of one snapshot in one row; zeros for no rows."""
    return need(df, "balance", "worked_by").agg(
        total("n_claims").alias("total_claims"),
        total("n_open").alias("open_claims"),
        (total("n_claims") - total("n_open")).alias("closed_claims"),
        total("sum_outstanding").alias("outstanding_balance"),
        total("sum_recovered").alias("dollars_recovered"),
        total("n_worked").alias("claims_worked"),
    )
