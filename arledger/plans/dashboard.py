"""The dashboard: three datasets of the same filtered claims and their tables.

* current: the newest snapshot (headline cards, aging, collection)
* portfolio: the newest row of every claim over all snapshots
* operational: all snapshots together, where a row is one touch (productivity)
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from arledger.operators.cleaning import clean_claims
from arledger.operators.filters import (
    FilterSpec,
    apply_filters,
    default_filters,
    filter_options,
)
from arledger.operators.followup import (
    follow_up_kpis,
    follow_up_registry,
    follow_up_stats,
    touch_frequency,
)
from arledger.operators.metrics import (
    aging_summary,
    aging_worked,
    claims_done_summary,
    collection_summary,
    employee_collection,
    employee_productivity,
    kpi_cards,
    topline,
    worked_vs_recovered,
)
from arledger.operators.portfolio import latest_claims
from arledger.operators.snapshots import dated
from arledger.plans.manifest import (
    Manifest,
    collected_manifest,
    dated_rows,
    manifest_bounds,
    manifest_snapshot,
    read_manifest,
    sheet_manifest,
    with_sheets,
)
from arledger.plans.trend import Trend, build_trend
from arledger.sources.landing import materialize


class Dashboard(NamedTuple):
    """Lazy tables; nothing runs until one of them is used."""

    filter_options: DataFrame
    date_bounds: DataFrame
    # current snapshot
    cards: DataFrame
    topline: DataFrame
    aging_summary: DataFrame
    collection_summary: DataFrame
    claims_done: DataFrame
    current_productivity: DataFrame
    # unique claims
    portfolio_topline: DataFrame
    # all snapshots
    productivity: DataFrame
    aging_worked: DataFrame
    employee_collection: DataFrame
    worked_vs_recovered: DataFrame
    # follow-up
    follow_up_kpis: DataFrame
    touch_frequency: DataFrame
    registry: DataFrame
    # history
    trend: Trend


def _chosen(cleaned: DataFrame, spec: FilterSpec | None, manifest: Manifest) -> DataFrame:
    if spec is not None:
        return apply_filters(cleaned, spec)
    return default_filters(cleaned, known=(manifest.has_bucket, manifest.has_day))


def filtered_claims(
    raw: DataFrame, spec: FilterSpec | None = None, manifest: Manifest | None = None
) -> DataFrame:
    """Raw rows -> dated, cleaned rows that pass the selection (default: all ticked). Without
    a manifest of ``raw`` one is made first, in a job of its own."""
    if manifest is None:
        manifest = collected_manifest(raw.sparkSession, sheet_manifest(raw))
    return _chosen(clean_claims(dated_rows(raw, manifest)), spec, manifest)


def dashboard(
    raw: DataFrame,
    spec: FilterSpec | None = None,
    sheets: DataFrame | None = None,
    path: str | None = None,
) -> Dashboard:
    """All dashboard tables of raw snapshot rows.

    ``sheets`` (``sources.snapshots.list_sheets``) also knows sheets without rows; by
    default the sheets are those that have rows. With ``path``, a folder all executors
    reach, ``raw`` is scanned once: the cleaned rows, the filtered ones and the manifest
    are landed there, and every table reads its columns and partitions from them. Without it,
    the manifest is made first, by one pass over three columns, and every table is a plan
    over ``raw``.
    """
    spark = raw.sparkSession
    if path is None:
        table = sheet_manifest(raw)
        table = table if sheets is None else with_sheets(table, sheets)
        manifest = collected_manifest(spark, table)
        cleaned = clean_claims(dated_rows(raw, manifest))
        return dashboard_tables(cleaned, _chosen(cleaned, spec, manifest), manifest)
    # The duplicate drop has spread the rows, and the filtered ones are read from landed files.
    cleaned = materialize(clean_claims(dated(raw)), f"{path}/cleaned", spread=False)
    table = sheet_manifest(cleaned)
    table = table if sheets is None else with_sheets(table, sheets)
    table.write.mode("overwrite").parquet(f"{path}/manifest")
    manifest = read_manifest(spark.read.schema(table.schema).parquet(f"{path}/manifest"))
    chosen = materialize(_chosen(cleaned, spec, manifest), f"{path}/filtered", spread=False)
    return dashboard_tables(cleaned, chosen, manifest)


def dashboard_tables(cleaned: DataFrame, claims: DataFrame, manifest: Manifest) -> Dashboard:
    """Dashboard tables from cleaned rows, the filtered part of them and the manifest.

    Every table is its own plan over ``claims``. On landed claims each plan reads only its
    columns, and the current-snapshot tables only one partition.
    """
    current = manifest_snapshot(claims, manifest)
    sheets = manifest.sheets.select("sheet_name", "sheet_pos", "snapshot_date")
    productivity = employee_productivity(claims)
    collection = employee_collection(claims)
    stats = follow_up_stats(claims)
    return Dashboard(
        filter_options=filter_options(cleaned),
        date_bounds=manifest_bounds(manifest),
        cards=kpi_cards(current),
        topline=topline(current),
        aging_summary=aging_summary(current),
        collection_summary=collection_summary(current),
        claims_done=claims_done_summary(current),
        current_productivity=employee_productivity(current),
        portfolio_topline=topline(latest_claims(claims)),
        productivity=productivity,
        aging_worked=aging_worked(claims),
        employee_collection=collection,
        worked_vs_recovered=worked_vs_recovered(productivity, collection),
        follow_up_kpis=follow_up_kpis(stats),
        touch_frequency=touch_frequency(stats),
        registry=follow_up_registry(stats),
        trend=build_trend(claims, sheets),
    )
