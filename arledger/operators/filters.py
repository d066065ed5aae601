"""Row filters of the dashboard and the option lists behind them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arledger.fixed_values import MISSING_STATUS, MISSING_WORKER, TREND_DATES
from arledger.functions.cells import parse_date
from arledger.operators.columns import canonical_bucket, resolve


@dataclass(frozen=True)
class FilterSpec:
    """A selection; an empty or missing part filters nothing."""

    aging_buckets: Sequence[str] = ()
    workers: Sequence[str] = ()
    statuses: Sequence[str] = ()
    date_range: tuple[date, date] | None = None


def worker_label(worker: Column) -> Column:
    return F.coalesce(worker.cast("string"), F.lit(MISSING_WORKER))


def status_label(status: Column) -> Column:
    return F.coalesce(status.cast("string"), F.lit(MISSING_STATUS))


def filter_day(df: DataFrame) -> Column | None:
    """Day of the column that date filters look at; text is parsed leniently."""
    name = resolve(df, "filter_date")
    if name is None:
        return None
    text = isinstance(df.schema[name].dataType, T.StringType)
    return F.to_date(parse_date(F.col(name)) if text else F.col(name))


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Rows that pass every part of the selection whose column exists."""
    bucket, worker, status = (resolve(df, r) for r in ("aging_bucket", "worked_by", "status"))
    day = filter_day(df)
    if bucket and spec.aging_buckets:
        df = df.filter(canonical_bucket(df, bucket).isin(*spec.aging_buckets))
    if worker and spec.workers:
        df = df.filter(worker_label(F.col(worker)).isin(*spec.workers))
    if status and spec.statuses:
        df = df.filter(status_label(F.col(status)).isin(*spec.statuses))
    if day is not None and spec.date_range:
        df = df.filter(day.between(*(F.lit(d) for d in spec.date_range)))
    return df


def default_filters(
    df: DataFrame, all_rows: DataFrame | None = None, known: tuple[bool, bool] | None = None
) -> DataFrame:
    """The selection with everything ticked.

    It is not a no-op: "all buckets" leaves out rows without a bucket and "all dates" rows
    without a date, unless no row at all has one. ``known`` says whether any row has a bucket and
    a date (``plans.manifest`` knows). Without it, both are asked by an EXISTS that stops at
    the first hit of ``all_rows``, by default ``df``; give the rows before their duplicate
    drop, which has the same answer without its shuffle.
    """
    all_rows = df if all_rows is None else all_rows
    bucket, day = resolve(df, "aging_bucket"), filter_day(df)
    present = [F.col(bucket).isNotNull() if bucket else None, None if day is None else day.isNotNull()]
    for i, has_one in enumerate(present):
        if has_one is None:
            continue
        if known is None:
            df = df.filter(has_one | ~all_rows.filter(has_one).exists())
        elif known[i]:
            df = df.filter(has_one)
    return df


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct choices per filter, sorted: (filter, option).

    All three lists come from one scan; each task keeps distinct pairs before the shuffle.
    """
    parts = []
    if bucket := resolve(df, "aging_bucket"):
        parts.append(("aging_bucket", canonical_bucket(df, bucket)))
    if worker := resolve(df, "worked_by"):
        parts.append(("employee", worker_label(F.col(worker))))
    if status := resolve(df, "status"):
        parts.append(("claim_status", status_label(F.col(status))))
    pairs = F.array(*(F.struct(F.lit(n).alias("filter"), c.alias("option")) for n, c in parts))
    return (
        df.select(F.inline(pairs))
        .filter(F.col("option").isNotNull())
        .distinct()
        .orderBy("filter", "option")
    )


def date_bounds(df: DataFrame) -> DataFrame:
    """One row: first and last day of the filter date."""
    day = filter_day(df)
    if day is None:
        day = F.lit(None).cast("date")
    return df.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))


def worked_rows(df: DataFrame) -> DataFrame:
    """Rows somebody worked on."""
    return df.filter(F.col(resolve(df, "worked_by", required=True)).isNotNull())


def target_dates(
    df: DataFrame, dates: Sequence[str] = TREND_DATES, complete: bool = False
) -> DataFrame:
    """Rows whose snapshot day is one of the given days. With ``complete``, no rows unless
    each of the days has one."""
    days = [F.to_date(F.lit(d)) for d in dates]
    chosen = df.filter(F.to_date("snapshot_date").isin(*days))
    if not complete:
        return chosen
    found = chosen.agg(F.count_distinct(F.to_date("snapshot_date")).alias("n"))
    return chosen.filter(found.select("n").scalar() == len(set(dates)))


def week_labels(df: DataFrame, dates: Sequence[str] = TREND_DATES) -> DataFrame:
    """Add ``week_label`` (Week 1 ..) for the given days; other days drop out."""
    pairs = [
        part
        for n, d in enumerate(dates, start=1)
        for part in (F.to_date(F.lit(d)), F.lit(f"Week {n}"))
    ]
    weeks = F.create_map(*pairs)
    tagged = df.withColumn("week_label", F.try_element_at(weeks, F.to_date("snapshot_date")))
    return tagged.filter(F.col("week_label").isNotNull())
