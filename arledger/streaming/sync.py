"""Snapshot folders whose files change in place.

``refresh`` takes in files once, by name. Here a store follows a folder's present state: the
listing (path, size, time of change) is compared with the one of the last call, and a sheet with a new,
changed or removed file is read and landed again as a whole, others are not touched.

A call writes, under a new version name, the rows and measures of the changed sheets, then the
listing, and last one row per present sheet with the version in which its rows stand. This last
table makes the call count: readers take the newest one, so a call that fails changes nothing, and
the next one does its work again. Superseded versions stay as files.

A file that is replaced by one of equal size and time of change is not noticed. Empty files
count as absent.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arledger.fixed_values import ROLE_CANDIDATES
from arledger.operators.cleaning import clean_claims
from arledger.operators.columns import LINEAGE, resolve
from arledger.operators.filters import filter_day
from arledger.operators.measures import MEASURES, condense
from arledger.operators.metrics import (
    average_touches,
    aging_summary,
    aging_worked,
    claims_done_summary,
    collection_summary,
    employee_collection,
    kpi_cards,
    topline,
    worked_vs_recovered,
)
from arledger.operators.snapshots import date_grouped, parse_snapshot_date
from arledger.plans.trend import aging_trend, snapshot_summary, trend_cube
from arledger.sources.files import list_files
from arledger.sources.landing import PARTITIONS
from arledger.sources.snapshots import place_files, read_files

_LISTING = "uri string, path string, length bigint, modified timestamp, sheet_name string"
_SHEETS = "sheet_name string, version string, columns array<string>"
_NUMBER = "sync_id bigint"
_KEYS = ("sheet_name", "aging_bucket", "worked_by")
_SUMS = (
    "n_claims bigint, n_open bigint, n_done bigint, n_worked bigint, sum_outstanding double, "
    "sum_recovered double, version string"
)
_CUBE = f"sheet_name string, aging_bucket string, worked_by string, {_SUMS}"
_TOUCHES = f"sheet_name string, aging_bucket string, worked_by string, _has_day boolean, _claim string, {_SUMS}"


def _newest(spark: SparkSession, store: str) -> int:
    """Number of the last call that counts; -1 before the first one."""
    try:
        table = spark.read.schema(f"{_SHEETS}, {_NUMBER}").parquet(f"{store}/sheets")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return -1
        raise
    newest = table.agg(F.max("sync_id")).first()[0]
    return -1 if newest is None else newest


def _of(spark: SparkSession, store: str, name: str, schema: str, number: int) -> DataFrame:
    if number < 0:
        return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).parquet(f"{store}/{name}/sync_id={number}")
    return table.where("sheet_name is not null")


def _listed(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    """The folder's files and their sheets, fixed at this moment."""
    try:
        found = list_files(spark, root, glob).collect()
    except FileNotFoundError:
        found = []
    placed = place_files(spark, [(r["uri"], r["path"]) for r in found], root).collect() if found else []
    sheet_of = {r["uri"]: r["sheet_name"] for r in placed}
    rows = [(r["uri"], r["path"], r["length"], r["modificationTime"], sheet_of[r["uri"]]) for r in found]
    return spark.createDataFrame(rows, _LISTING)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sheet_name, uri, change) of two listings; change is ``new``, ``changed`` or ``removed``."""
    a, b = old.alias("a"), new.alias("b")
    same = F.col("a.length").eqNullSafe(F.col("b.length")) & F.col("a.modified").eqNullSafe(F.col("b.modified"))
    change = F.when(F.col("a.uri").isNull(), "new").when(F.col("b.uri").isNull(), "removed").otherwise("changed")
    return a.join(b, F.col("a.uri") == F.col("b.uri"), "full").where(
        F.col("a.uri").isNull() | F.col("b.uri").isNull() | ~same
    ).select(
        F.coalesce("b.sheet_name", "a.sheet_name").alias("sheet_name"),
        F.coalesce("b.uri", "a.uri").alias("uri"),
        change.alias("change"),
    )


def sync_files(
    spark: SparkSession,
    root: str,
    store: str,
    fmt: str = "csv",
    *,
    glob: str | None = None,
    on_error: str = "raise",
) -> list[str]:
    """Bring ``store`` to the state of the files below ``root``; returns the names of sheets that
    were landed again or went. ``on_error`` is that of ``read_snapshots``. One call at a time may
    write to a store."""
    last = _newest(spark, store)
    number = last + 1
    now = _listed(spark, root, glob)
    before = _of(spark, store, "listing", _LISTING, last)
    touched = sorted(r["sheet_name"] for r in changed_files(before, now).select("sheet_name").distinct().collect())
    if not touched and last >= 0:
        return []
    files = [(r["uri"], r["path"]) for r in now.where(F.col("sheet_name").isin(*touched)).collect()] if touched else []
    placed = place_files(spark, files, root) if files else None
    rows = read_files(spark, placed, fmt, on_error=on_error) if files else None
    version, columns = uuid.uuid4().hex, []
    if rows is not None:
        columns = [c for c in rows.columns if c not in LINEAGE]
        _land(rows, columns, store, version)
    present = placed.select("sheet_name").distinct() if placed is not None else now.select("sheet_name").limit(0)
    kept = _of(spark, store, "sheets", _SHEETS, last).where(~F.col("sheet_name").isin(*touched))
    names = F.array(*(F.lit(c) for c in columns)).cast("array<string>")
    fresh = present.select("sheet_name", F.lit(version).alias("version"), names.alias("columns"))
    # A row per file and per sheet: one small file each, which appears as a whole.
    now.coalesce(1).write.mode("overwrite").parquet(f"{store}/listing/sync_id={number}")
    # The row without a name makes a call count that leaves no sheet.
    mark = spark.createDataFrame([(None, None, None)], _SHEETS)
    kept.unionByName(fresh).unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{store}/sheets/sync_id={number}")
    return touched


def _land(rows: DataFrame, columns: list[str], store: str, version: str) -> None:
    spark = rows.sparkSession
    place = f"{store}/rows/version={version}"
    text = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    rows.select("row_pos", *text, "snapshot_date", "sheet_name").hint("rebalance", "sheet_name").write.mode("overwrite").partitionBy(*PARTITIONS).parquet(place)
    schema = ["row_pos decimal(38,0)", *(f"`{c}` string" for c in columns), "snapshot_date timestamp, sheet_name string"]
    landed = spark.read.schema(", ".join(schema)).parquet(place)
    for role in ("balance", "worked_by", "aging_bucket"):
        # In a union of all sheets, a column that one of them lacks is a column of nulls.
        if resolve(landed, role) is None:
            landed = landed.withColumn(ROLE_CANDIDATES[role][0], F.lit(None).cast("string"))
    cube = trend_cube(clean_claims(landed, duplicates="keep"))
    cube = cube.select(*(c for c in (*_KEYS, *MEASURES) if c in cube.columns))
    cube.write.mode("overwrite").parquet(f"{store}/cube/version={version}")
    _touches(clean_claims(landed)).write.mode("overwrite").parquet(f"{store}/touches/version={version}")


def _touches(claims: DataFrame) -> DataFrame:
    """Measures per (sheet, bucket, worker, has a filter date, claim), of which the dashboard's
    tables are sums and distinct counts."""
    day, claim_id = filter_day(claims), resolve(claims, "claim_id")
    marked = claims.withColumns(
        {
            "_has_day": F.lit(False) if day is None else day.isNotNull(),
            "_claim": (F.lit(None) if claim_id is None else F.col(claim_id)).cast("string"),
        }
    )
    sums = condense(marked, ("_has_day", "_claim"))
    return sums.select(*_KEYS, "_has_day", "_claim", *MEASURES)


def synced_sheets(spark: SparkSession, store: str) -> DataFrame:
    """Present sheets: sheet_name, sheet_pos (by date, undated ones last), snapshot_date, version,
    landed (false if nothing could be read)."""
    table = _of(spark, store, "sheets", _SHEETS, _newest(spark, store))
    rows = table.withColumn("snapshot_date", parse_snapshot_date(F.col("sheet_name"))).collect()
    undated = [r for r in rows if r["snapshot_date"] is None]
    rows = sorted((r for r in rows if r["snapshot_date"]), key=lambda r: (r["snapshot_date"], r["sheet_name"]))
    rows += sorted(undated, key=lambda r: r["sheet_name"])
    return spark.createDataFrame(
        [(r["sheet_name"], i, r["snapshot_date"], r["version"], bool(r["columns"])) for i, r in enumerate(rows)],
        "sheet_name string, sheet_pos int, snapshot_date timestamp, version string, landed boolean",
    )


def _live(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows that stand under their sheet's version, with the sheet's place."""
    versions = [r["version"] for r in sheets.select("version").distinct().collect()]
    places = sheets.select("sheet_name", "version", "sheet_pos")
    return rows.where(F.col("version").isin(*versions)).join(places, ["sheet_name", "version"]).drop("version")


def read_synced(spark: SparkSession, store: str) -> DataFrame:
    """Raw rows of all present sheets: text columns under standard names, and where each row stands."""
    sheets = synced_sheets(spark, store)
    noted = _of(spark, store, "sheets", _SHEETS, _newest(spark, store)).orderBy("sheet_name")
    columns = list(dict.fromkeys(c for r in noted.select("columns").collect() for c in r["columns"]))
    schema = ["row_pos decimal(38,0)", *(f"`{c}` string" for c in columns)]
    schema.append("version string, snapshot_date timestamp, sheet_name string")
    if not columns:
        return spark.createDataFrame([], ", ".join(schema)).drop("version").withColumn("sheet_pos", F.lit(0))
    return _live(spark.read.schema(", ".join(schema)).parquet(f"{store}/rows"), sheets)


def _synced_cube(spark: SparkSession, store: str, sheets: DataFrame) -> DataFrame:
    if sheets.where("landed").isEmpty():
        empty = spark.createDataFrame([], _CUBE).drop("version").withColumn("sheet_pos", F.lit(0))
        return date_grouped(empty, "n_claims")
    cube = _live(spark.read.schema(_CUBE).parquet(f"{store}/cube"), sheets)
    return date_grouped(cube, "n_claims")


def synced_summary(spark: SparkSession, store: str) -> DataFrame:
    """``snapshot_summary`` of the present state, from measures; no claim is read."""
    sheets = synced_sheets(spark, store)
    dated = sheets.where("snapshot_date is not null").drop("version", "landed")
    return snapshot_summary(_synced_cube(spark, store, sheets), dated)


def synced_aging(spark: SparkSession, store: str) -> DataFrame:
    """``aging_trend`` of the present state, from measures."""
    return aging_trend(_synced_cube(spark, store, synced_sheets(spark, store)))


class SyncedBoard(NamedTuple):
    """Tables of ``plans.dashboard`` with everything ticked, under the same names."""

    cards: DataFrame
    topline: DataFrame
    aging_summary: DataFrame
    collection_summary: DataFrame
    claims_done: DataFrame
    current_productivity: DataFrame
    productivity: DataFrame
    aging_worked: DataFrame
    employee_collection: DataFrame
    worked_vs_recovered: DataFrame


def _productivity(touches: DataFrame) -> DataFrame:
    counted = touches.where("worked_by is not null").groupBy("worked_by").agg(
        F.count_distinct("_claim").alias("unique_claims_touched"), F.sum("n_claims").alias("total_touches")
    )
    return counted.select("*", average_touches())


def synced_board(spark: SparkSession, store: str) -> SyncedBoard:
    """Dashboard tables of the present state, from sums per claim and worker that were made when a
    sheet was landed; no claim is cleaned again. Each sheet's own columns play the roles."""
    sheets = synced_sheets(spark, store).where("snapshot_date is not null")
    if sheets.where("landed").isEmpty():
        touches = spark.createDataFrame([], _TOUCHES).drop("version").withColumn("sheet_pos", F.lit(0))
    else:
        touches = _live(spark.read.schema(_TOUCHES).parquet(f"{store}/touches"), sheets)
    # "Everything ticked" leaves out rows without a bucket or a date, unless no row has one.
    bucketed, dated = F.col("aging_bucket").isNotNull(), F.col("_has_day")
    found = touches.agg(F.bool_or(bucketed), F.bool_or(dated)).first()
    for present, has_one in zip(found, (bucketed, dated)):
        touches = touches.where(has_one) if present else touches
    newest = sheets.agg(F.max_by("sheet_name", F.struct("snapshot_date", -F.col("sheet_pos")))).first()[0]
    current = touches.where(F.col("sheet_name") == F.lit(newest).cast("string"))
    productivity, collection = _productivity(touches), employee_collection(touches)
    return SyncedBoard(
        cards=kpi_cards(current),
        topline=topline(current),
        aging_summary=aging_summary(current),
        collection_summary=collection_summary(current),
        claims_done=claims_done_summary(current),
        current_productivity=_productivity(current),
        productivity=productivity,
        aging_worked=aging_worked(touches),
        employee_collection=collection,
        worked_vs_recovered=worked_vs_recovered(productivity, collection),
    )
