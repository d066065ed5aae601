"""Registered queries: name -> (Spark query, SQL restatement or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arledger.functions import text
from arledger.operators import filters, followup, metrics, portfolio, snapshots
from arledger.operators.cleaning import clean_claims
from arledger.plans import trend
from arledger.plans.dashboard import Dashboard, dashboard, filtered_claims
from arledger.plans.manifest import sheet_manifest
from arledger.session import lean_writes
from arledger.sources import files, grid, landing, reports
from arledger.sources import snapshots as sheets
from arledger.streaming import refresh, sync
from checks import sql
from checks.claims_raw import DATA_COLUMNS, claims_raw, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, restated: str | None = None):
    def add(query: Query) -> Query:
        REGISTRY[name] = (query, restated)
        return query

    return add


def presented(df: DataFrame) -> DataFrame:
    """Doubles rounded (shares to 4 digits, money to 2) and times as days, for comparing."""
    cells = []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            fine = any(part in field.name for part in ("percentage", "pct", "rate", "average"))
            cell = F.round(cell, 4 if fine else 2)
        elif isinstance(field.dataType, (T.TimestampType, T.DateType)):
            cell = F.date_format(cell, "yyyy-MM-dd")
        cells.append(cell.alias(field.name))
    return df.select(*cells)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_claims(claims_raw(spark, sf_dir))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest snapshot, cleaned. The sheet is picked before the duplicate drop."""
    return clean_claims(snapshots.current_snapshot(claims_raw(spark, sf_dir)))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_claims(claims_raw(spark, sf_dir))


def boards(spark: SparkSession, sf_dir: str):
    """The dashboard as plans over the raw rows, nothing landed."""
    return dashboard(claims_raw(spark, sf_dir))


def trend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows for trends, which drop duplicates themselves, by cleaned value."""
    return clean_claims(claims_raw(spark, sf_dir), duplicates="keep")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.snapshot_summary(trend_rows(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followup.follow_up_stats(claims(spark, sf_dir))


# --- cleaning -----------------------------------------------------------------------

_ROW_SQL = """sheet_name, CAST(sheet_pos AS INTEGER) AS sheet_pos, row_pos, patient_id, claim_id, plan_name,
  report_worked_by, strftime(report_worked_date, '%Y-%m-%d') AS report_worked_date,
  strftime(submission_date, '%Y-%m-%d') AS submission_date, claim_status,
  round(claim_amount, 2) AS claim_amount, round(claim_balance, 2) AS claim_balance,
  bucket AS claim_balance_aging"""


@register("clean_claims", sql.claims_query(f"SELECT {_ROW_SQL} FROM claims"))
def _(spark, sf_dir):
    return presented(claims(spark, sf_dir))


@register(
    "drop_exact_duplicates",
    sql.claims_query(
        "SELECT sheet_name, count(*) AS rows_kept, count(DISTINCT row_pos) AS positions "
        "FROM dedup GROUP BY sheet_name"
    ),
)
def _(spark, sf_dir):
    from arledger.operators.cleaning import drop_exact_duplicates

    kept = drop_exact_duplicates(claims_raw(spark, sf_dir))
    return kept.groupBy("sheet_name").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.count_distinct("row_pos").alias("positions")
    )


@register(
    "normalize_bucket",
    sql.claims_query(
        "SELECT label, bucket AS aging_bucket, count(*) AS n FROM claims GROUP BY label, bucket"
    ),
)
def _(spark, sf_dir):
    from arledger.functions.cells import normalize_bucket
    from arledger.operators.cleaning import drop_exact_duplicates

    labels = drop_exact_duplicates(claims_raw(spark, sf_dir)).groupBy(
        F.col("claim_balance_aging").alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))
    return labels.withColumn("aging_bucket", normalize_bucket(F.col("label")))


@register(
    "composite_key",
    sql.claims_query(
        "SELECT composite_key, count(*) AS n, strftime(min(snapshot_date), '%Y-%m-%d') AS first_seen "
        "FROM priced GROUP BY composite_key"
    ),
)
def _(spark, sf_dir):
    tagged = snapshots.tag_snapshots(portfolio.with_claim_key(claims(spark, sf_dir)))
    return presented(
        tagged.groupBy("composite_key").agg(
            F.count(F.lit(1)).alias("n"), F.min("snapshot_date").alias("first_seen")
        )
    )


@register(
    "recovered_column",
    sql.claims_query(
        "SELECT bucket AS aging_bucket, round(sum(claim_amount / 4 - 500), 2) AS recovered_amount "
        "FROM priced GROUP BY bucket"
    ),
)
def _(spark, sf_dir):
    """An explicit recovered column wins over the derived one and may be negative."""
    rows = claims(spark, sf_dir).withColumn(
        "recovered_amount", F.col("claim_amount") / 4 - 500
    )
    return presented(
        metrics.collection_summary(rows, keep_unknown=True).select(
            "aging_bucket", "recovered_amount"
        )
    )


# --- sources ------------------------------------------------------------------------


@register(
    "standardize_columns",
    "SELECT c_custkey AS cust_key, c_name AS name, c_nationkey AS nation_2, "
    "c_acctbal AS acct_balance, c_mktsegment AS nation FROM customer",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"
    )
    return sheets.standardize_columns(
        rows.toDF("  Cust Key", "(Name)", "NATION", "% Nation ", "Acct  - Balance")
    )


_GRID_SQL = """
SELECT o_orderpriority AS sheet_name, o_orderkey + 1 AS row_pos, CAST(o_orderkey AS STRING) AS claim_id,
  o_orderstatus AS column_1,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS STRING) END AS column_2
FROM orders"""


@register("grid_to_table", _GRID_SQL)
def _(spark, sf_dir):
    """One sheet per order priority; every second row is longer than its header."""
    orders = table(spark, sf_dir, "orders")
    cells = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))
    longer = F.array_append(cells, F.col("o_custkey").cast("string"))
    rows = orders.select(
        F.col("o_orderpriority").alias("sheet_name"),
        (F.col("o_orderkey") + 1).alias("row_pos"),
        F.when(F.col("o_orderkey") % 2 == 0, longer).otherwise(cells).alias("cells"),
    )
    heads = orders.select(F.col("o_orderpriority").alias("sheet_name")).distinct().select(
        "sheet_name",
        F.lit(0).cast("bigint").alias("row_pos"),
        F.array(F.lit("Claim ID"), F.lit(" # ")).alias("cells"),
    )
    return grid.grid_to_table(heads.unionByName(rows))


_TABLE_FILES = "{region,nation,customer,supplier,part,orders,lineitem}.parquet"


@register(
    "read_snapshots_row_counts",
    " UNION ALL ".join(
        f"SELECT '{t}' AS sheet_name, count(*) AS rows FROM {t}"
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    ),
)
def _(spark, sf_dir):
    """Every table file is a sheet; columns are matched by name."""
    rows = sheets.read_snapshots(spark, sf_dir, "parquet", glob=_TABLE_FILES)
    return sheets.snapshot_row_counts(rows, sheets.list_sheets(spark, sf_dir, _TABLE_FILES))


@register(
    "snapshot_row_counts",
    sql.raw_query(
        "SELECT sheet_name, count(*) AS rows FROM claims_raw GROUP BY sheet_name "
        "UNION ALL SELECT 'Notes', 0"
    ),
)
def _(spark, sf_dir):
    """Counted over all columns. Every row also comes as a copy of blanks, and an undated
    sheet has such rows alone."""
    raw = claims_raw(spark, sf_dir)
    blanks = {c: F.when(F.col("row_pos") % 2 == 0, F.lit("")) for c in DATA_COLUMNS}
    blank = raw.withColumns(blanks)
    notes = blank.withColumn("sheet_name", F.lit("Notes"))
    return sheets.snapshot_row_counts(raw.unionByName(blank).unionByName(notes))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{files.shared_folder(spark)}/arledger/{name}-{uuid.uuid4().hex}"


@register(
    "write_report",
    sql.claims_query(
        "SELECT report_worked_by AS worked_by, bucket AS aging_bucket, count(*) AS touches "
        "FROM priced GROUP BY report_worked_by, bucket"
    ),
)
def _(spark, sf_dir):
    """Exported as CSV and read back."""
    path = _scratch(spark, "report")
    reports.write_report(metrics.aging_worked(claims(spark, sf_dir)), path)
    return spark.read.option("header", "true").schema(
        "worked_by string, aging_bucket string, touches long"
    ).csv(path)


@register("landed_topline", sql.claims_query(sql.topline("cur")))
def _(spark, sf_dir):
    """Cleaned rows landed by snapshot; the newest one is then read as one partition."""
    landed = landing.materialize(claims(spark, sf_dir), _scratch(spark, "landed"))
    return presented(metrics.topline(snapshots.current_snapshot(landed)))


# --- filters ------------------------------------------------------------------------


def _filter_query(name: str, spec: filters.FilterSpec, where: str) -> None:
    @register(f"apply_filters_{name}", sql.claims_query(f"SELECT {_ROW_SQL} FROM priced WHERE {where}"))
    def _(spark, sf_dir):
        return presented(filters.apply_filters(claims(spark, sf_dir), spec))


_filter_query("aging", filters.FilterSpec(aging_buckets=("60+", "90-120")), "bucket IN ('60+', '90-120')")
_filter_query(
    "employee",
    filters.FilterSpec(workers=("EMP3", "Unassigned")),
    "coalesce(report_worked_by, 'Unassigned') IN ('EMP3', 'Unassigned')",
)
_filter_query(
    "status",
    filters.FilterSpec(statuses=("Blank",)),
    "coalesce(claim_status, 'Blank') = 'Blank'",
)
_filter_query(
    "dates",
    filters.FilterSpec(date_range=(date(1995, 3, 1), date(1996, 2, 29))),
    "filter_day BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'",
)
_filter_query(
    "combined",
    filters.FilterSpec(("0-30", "31-45"), ("EMP1", "EMP2", "EMP5"), ("F", "O"), (date(1994, 1, 1), date(1997, 12, 31))),
    "bucket IN ('0-30', '31-45') AND report_worked_by IN ('EMP1', 'EMP2', 'EMP5') "
    "AND claim_status IN ('F', 'O') AND filter_day BETWEEN DATE '1994-01-01' AND DATE '1997-12-31'",
)


@register("default_filters", sql.claims_query(f"SELECT {_ROW_SQL} FROM filtered"))
def _(spark, sf_dir):
    return presented(filtered(spark, sf_dir))


@register(
    "filter_options",
    sql.claims_query(
        "SELECT DISTINCT 'aging_bucket' AS filter, bucket AS option FROM priced WHERE bucket IS NOT NULL "
        "UNION SELECT 'employee', coalesce(report_worked_by, 'Unassigned') FROM priced "
        "UNION SELECT 'claim_status', coalesce(claim_status, 'Blank') FROM priced"
    ),
)
def _(spark, sf_dir):
    # Options are distinct values: dropping duplicate rows first would change nothing.
    return filters.filter_options(trend_rows(spark, sf_dir))


@register(
    "date_bounds",
    sql.claims_query(
        "SELECT strftime(min(filter_day), '%Y-%m-%d') AS min_date, "
        "strftime(max(filter_day), '%Y-%m-%d') AS max_date FROM priced"
    ),
)
def _(spark, sf_dir):
    return presented(filters.date_bounds(trend_rows(spark, sf_dir)))


@register(
    "worked_rows",
    sql.claims_query(f"SELECT {_ROW_SQL} FROM priced WHERE report_worked_by IS NOT NULL"),
)
def _(spark, sf_dir):
    return presented(filters.worked_rows(claims(spark, sf_dir)))


@register(
    "ordered_sheets",
    sql.claims_query(
        "SELECT DISTINCT sheet_name, CAST(sheet_pos AS INTEGER) AS sheet_pos, "
        "strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date FROM claims WHERE snapshot_date IS NOT NULL"
    ),
)
def _(spark, sf_dir):
    return presented(snapshots.ordered_sheets(snapshots.sheet_list(claims_raw(spark, sf_dir))))


@register(
    "latest_sheet",
    sql.claims_query(
        "SELECT sheet_name, CAST(sheet_pos AS INTEGER) AS sheet_pos, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date "
        "FROM claims GROUP BY sheet_name, sheet_pos, snapshot_date ORDER BY claims.snapshot_date DESC, claims.sheet_pos LIMIT 1"
    ),
)
def _(spark, sf_dir):
    return presented(snapshots.latest_sheet(snapshots.sheet_list(claims_raw(spark, sf_dir))))


# --- metrics of the newest snapshot and of all snapshots --------------------------------


@register("topline_current", sql.claims_query(sql.topline("cur")))
def _(spark, sf_dir):
    return presented(metrics.topline(current(spark, sf_dir)))


@register("aging_summary", sql.claims_query(sql.aging_summary("cur")))
def _(spark, sf_dir):
    return presented(metrics.aging_summary(current(spark, sf_dir)))


@register("employee_productivity", sql.claims_query(sql.productivity("priced")))
def _(spark, sf_dir):
    return presented(metrics.employee_productivity(claims(spark, sf_dir)))


@register("employee_productivity_current", sql.claims_query(sql.productivity("cur")))
def _(spark, sf_dir):
    return presented(metrics.employee_productivity(current(spark, sf_dir)))


@register(
    "productivity_by_bucket",
    sql.claims_query(
        sql.productivity(
            "priced",
            "report_worked_by AS worked_by, bucket AS aging_bucket",
            "report_worked_by, bucket",
        )
    ),
)
def _(spark, sf_dir):
    return presented(metrics.employee_productivity(claims(spark, sf_dir), per_bucket=True))


@register(
    "aging_worked",
    sql.claims_query(
        "SELECT report_worked_by AS worked_by, bucket AS aging_bucket, count(*) AS touches "
        "FROM priced GROUP BY report_worked_by, bucket"
    ),
)
def _(spark, sf_dir):
    return metrics.aging_worked(claims(spark, sf_dir))


@register(
    "collection_summary",
    sql.claims_query(
        f"SELECT {sql.SORTED_BUCKET} AS aging_bucket, round(sum(recovered), 2) AS recovered_amount, "
        "round(sum(claim_balance), 2) AS outstanding_balance, "
        "round(coalesce(sum(recovered) / nullif(sum(claim_balance), 0), 0) * 100, 4) AS recovery_percentage "
        "FROM cur GROUP BY bucket"
    ),
)
def _(spark, sf_dir):
    return presented(metrics.collection_summary(current(spark, sf_dir)))


@register(
    "employee_collection",
    sql.claims_query(
        "SELECT report_worked_by AS worked_by, round(sum(recovered), 2) AS recovered_amount "
        "FROM priced GROUP BY report_worked_by"
    ),
)
def _(spark, sf_dir):
    return presented(metrics.employee_collection(claims(spark, sf_dir)))


@register(
    "claims_done_summary",
    sql.claims_query(
        f"SELECT {sql.SORTED_BUCKET} AS aging_bucket, count(*) FILTER (WHERE claim_balance <= 0) AS done_count, "
        "round(sum(recovered), 2) AS recovered_amount FROM cur GROUP BY bucket"
    ),
)
def _(spark, sf_dir):
    return presented(metrics.claims_done_summary(current(spark, sf_dir)))


@register("claims_worked", sql.claims_query("SELECT count(report_worked_by) AS claims_worked FROM cur"))
def _(spark, sf_dir):
    return metrics.claims_worked(current(spark, sf_dir))


_RECOVERY = (
    "round(sum(recovered), 2) AS recovered_amount, round(sum(claim_balance), 2) AS outstanding_balance, "
    "round(coalesce(sum(recovered) / nullif(sum(claim_balance), 0), 0) * 100, 4) AS recovery_percentage"
)


@register(
    "employee_recovery",
    sql.claims_query(
        f"SELECT report_worked_by AS worked_by, {_RECOVERY} FROM priced GROUP BY report_worked_by"
    ),
)
def _(spark, sf_dir):
    return presented(metrics.employee_recovery(claims(spark, sf_dir)))


@register("overall_recovery", sql.claims_query(f"SELECT {_RECOVERY} FROM priced"))
def _(spark, sf_dir):
    return presented(metrics.overall_recovery(claims(spark, sf_dir)))


_WORKED_VS_RECOVERED = sql.claims_query(
    "SELECT report_worked_by AS worked_by, count(*) AS total_touches, "
    "count(DISTINCT claim_id) AS unique_claims_touched, round(sum(recovered), 2) AS recovered_amount "
    "FROM priced WHERE report_worked_by IS NOT NULL GROUP BY report_worked_by"
)


@register("worked_vs_recovered", _WORKED_VS_RECOVERED)
def _(spark, sf_dir):
    rows = claims(spark, sf_dir)
    return presented(
        metrics.worked_vs_recovered(
            metrics.employee_productivity(rows), metrics.employee_collection(rows)
        )
    )


@register("touches_and_recovery", _WORKED_VS_RECOVERED)
def _(spark, sf_dir):
    return presented(metrics.touches_and_recovery(claims(spark, sf_dir)))


@register(
    "money_texts",
    sql.claims_query(
        f"""SELECT {sql.SORTED_BUCKET} AS aging_bucket,
  CASE WHEN sum(recovered) >= 1000 THEN format('${{:,.1f}}K', sum(recovered) / 1000)
       ELSE format('${{:,.0f}}', sum(recovered)) END AS recovered_text,
  format('${{:.3f}}M', sum(claim_balance) / 1e6) AS outstanding_text,
  format('${{:,.0f}}', sum(claim_balance)) AS balance_text,
  format('{{:,.0f}}', CAST(count(*) AS DOUBLE)) AS claims_text
FROM cur GROUP BY bucket"""
    ),
)
def _(spark, sf_dir):
    table_ = metrics.aging_summary(current(spark, sf_dir))
    return table_.select(
        "aging_bucket",
        text.money_short_text(F.col("recovered_amount")).alias("recovered_text"),
        text.money_millions_text(F.col("outstanding_balance")).alias("outstanding_text"),
        text.money_text(F.col("outstanding_balance")).alias("balance_text"),
        text.count_text(F.col("claim_count")).alias("claims_text"),
    )


# --- unique claims -----------------------------------------------------------------------

_NEWEST_ROW = (
    "SELECT *, row_number() OVER (PARTITION BY composite_key "
    "ORDER BY snapshot_date DESC, sheet_pos DESC, row_pos DESC) AS rn FROM priced"
)


@register(
    "latest_claims",
    sql.claims_query(
        f"SELECT {_ROW_SQL}, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, composite_key "
        f"FROM ({_NEWEST_ROW}) t WHERE rn = 1"
    ),
)
def _(spark, sf_dir):
    return presented(portfolio.latest_claims(claims(spark, sf_dir)))


@register(
    "topline_portfolio",
    sql.claims_query(sql.topline("uniq"), f"uniq AS (SELECT * FROM ({_NEWEST_ROW}) t WHERE rn = 1)"),
)
def _(spark, sf_dir):
    return presented(portfolio.portfolio_topline(claims(spark, sf_dir)))


# --- trends ------------------------------------------------------------------------------

_SUMMARY_SQL = """SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, sheet_name, snapshot_label,
  total_claims, open_claims, round(outstanding_balance, 2) AS outstanding_balance, claims_worked,
  round(dollars_recovered, 2) AS dollars_recovered FROM trend"""


@register("snapshot_summary", sql.trend_query(_SUMMARY_SQL))
def _(spark, sf_dir):
    return presented(summary(spark, sf_dir))


@register("snapshot_summary_filtered", sql.trend_query(_SUMMARY_SQL, "filtered"))
def _(spark, sf_dir):
    raw = claims_raw(spark, sf_dir)
    rows = filters.default_filters(clean_claims(raw, duplicates="keep"))
    return presented(trend.snapshot_summary(rows, snapshots.sheet_list(raw)))


@register(
    "snapshot_summary_emptied",
    sql.trend_query(
        """SELECT strftime(s.snapshot_date, '%Y-%m-%d') AS snapshot_date, s.sheet_name,
  strftime(s.snapshot_date, '%Y-%m-%d') AS snapshot_label,
  coalesce(total_claims, 0) AS total_claims, coalesce(open_claims, 0) AS open_claims,
  round(coalesce(outstanding_balance, 0), 2) AS outstanding_balance,
  coalesce(claims_worked, 0) AS claims_worked, round(coalesce(dollars_recovered, 0), 2) AS dollars_recovered
FROM (SELECT DISTINCT sheet_name, snapshot_date FROM claims) s LEFT JOIN trend t ON s.sheet_name = t.sheet_name""",
        "(SELECT * FROM priced WHERE report_worked_date > DATE '1998-11-15' AND claim_balance > 90000) x",
    ),
)
def _(spark, sf_dir):
    """A filter so narrow that sheets can lose all rows; they stay, with zeros."""
    raw = claims_raw(spark, sf_dir)
    rows = clean_claims(raw, duplicates="keep").filter(
        "report_worked_date > DATE '1998-11-15' AND claim_balance > 90000"
    )
    return presented(trend.snapshot_summary(rows, snapshots.sheet_list(raw)))


@register(
    "aging_trend",
    sql.trend_query(
        f"""SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, snapshot_label, sheet_name,
  {sql.SORTED_BUCKET} AS aging_bucket, claim_count, done_count,
  round(outstanding_balance, 2) AS outstanding_balance, round(recovered_amount, 2) AS recovered_amount,
  round(recovered_amount + outstanding_balance, 2) AS total_claimed,
  round(outstanding_balance / coalesce(nullif(sum(outstanding_balance) OVER (PARTITION BY sheet_name), 0), 1) * 100, 4)
    AS percentage_of_total_balance FROM trend_aging"""
    ),
)
def _(spark, sf_dir):
    return presented(trend.aging_trend(trend_rows(spark, sf_dir)))


@register(
    "bucket_growth",
    sql.trend_query(
        """SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, sheet_name, bucket AS aging_bucket,
  claim_count, round(outstanding_balance, 2) AS outstanding_balance,
  claim_count - lag(claim_count) OVER w AS claim_change,
  round(outstanding_balance - lag(outstanding_balance) OVER w, 2) AS balance_change
FROM trend_aging WINDOW w AS (PARTITION BY bucket ORDER BY trend_aging.snapshot_date, sheet_name)"""
    ),
)
def _(spark, sf_dir):
    aging = trend.aging_trend(trend_rows(spark, sf_dir), keep_unknown=True)
    return presented(trend.bucket_growth(aging))


_DELTAS = ",".join(
    f"('{m}')"
    for m in (
        "outstanding_balance",
        "dollars_recovered",
        "claims_worked",
        "total_claims",
        "open_claims",
        "closed_claims",
    )
)


def _pick(alias: str) -> str:
    return f"""CAST(CASE m.metric WHEN 'outstanding_balance' THEN {alias}.outstanding_balance
      WHEN 'dollars_recovered' THEN {alias}.dollars_recovered WHEN 'claims_worked' THEN {alias}.claims_worked
      WHEN 'total_claims' THEN {alias}.total_claims WHEN 'open_claims' THEN {alias}.open_claims
      ELSE {alias}.total_claims - {alias}.open_claims END AS DOUBLE)"""


_DELTA_SQL = f"""(SELECT m.metric, {_pick('b')} AS b, {_pick('e')} AS e
  FROM (SELECT * FROM trend ORDER BY snapshot_date LIMIT 1) b,
    (SELECT * FROM trend ORDER BY snapshot_date DESC LIMIT 1) e, (VALUES {_DELTAS}) AS m(metric)) d"""


@register(
    "snapshot_deltas",
    sql.trend_query(
        "SELECT metric, round(b, 2) AS begin_value, round(e, 2) AS end_value, round(e - b, 2) AS diff, "
        f"round(CASE WHEN b = 0 THEN 0 ELSE (e - b) / b * 100 END, 4) AS pct FROM {_DELTA_SQL}"
    ),
)
def _(spark, sf_dir):
    return presented(trend.snapshot_deltas(summary(spark, sf_dir)))


@register(
    "delta_cards",
    sql.trend_query(
        f"""SELECT metric,
  CASE WHEN money THEN format('${{:,.2f}}', e) ELSE format('{{:,.0f}}', e) END AS value_text,
  concat(CASE WHEN money THEN concat('$', CASE WHEN e >= b THEN '+' ELSE '' END, format('{{:,.2f}}', e - b)) ELSE concat(CASE WHEN e >= b THEN '+' ELSE '' END, format('{{:,.0f}}', e - b)) END,
    ' (', CASE WHEN e >= b THEN '+' ELSE '' END, format('{{:.1f}}%)', CASE WHEN b = 0 THEN 0 ELSE (e - b) / b * 100 END)) AS delta_text
FROM (SELECT *, metric IN ('outstanding_balance', 'dollars_recovered') AS money FROM {_DELTA_SQL})"""
    ),
)
def _(spark, sf_dir):
    return trend.delta_cards(trend.snapshot_deltas(summary(spark, sf_dir)))


@register(
    "net_improvement",
    sql.trend_query(
        """SELECT b.total_claims AS begin_claims, e.total_claims AS end_claims,
  b.total_claims - e.total_claims AS claims_reduction,
  round(b.outstanding_balance, 2) AS begin_balance, round(e.outstanding_balance, 2) AS end_balance,
  round(b.outstanding_balance - e.outstanding_balance, 2) AS balance_reduction
FROM (SELECT * FROM trend WHERE snapshot_label = '2026-05-04') b, (SELECT * FROM trend WHERE snapshot_label = '2026-05-26') e"""
    ),
)
def _(spark, sf_dir):
    return presented(trend.net_improvement(summary(spark, sf_dir)))


@register(
    "target_dates",
    sql.trend_query(
        _SUMMARY_SQL + " WHERE snapshot_label IN ('2026-05-04', '2026-05-11', '2026-05-18', '2026-05-26')"
    ),
)
def _(spark, sf_dir):
    return presented(filters.target_dates(summary(spark, sf_dir)))


@register(
    "claims_trend_long",
    sql.trend_query(
        "SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, 'total_claims' AS variable, total_claims AS value FROM trend "
        "UNION ALL SELECT strftime(snapshot_date, '%Y-%m-%d'), 'open_claims', open_claims FROM trend"
    ),
)
def _(spark, sf_dir):
    return presented(trend.claims_trend_long(summary(spark, sf_dir)))


def _series_query(name: str, build: Callable[[DataFrame], DataFrame], column: str) -> None:
    shown = column if column == "claims_worked" else f"round({column}, 2)"

    @register(
        name,
        sql.trend_query(
            f"SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, {shown} AS {column} FROM trend"
        ),
    )
    def _(spark, sf_dir):
        return presented(build(summary(spark, sf_dir)))


_series_query("outstanding_series", trend.outstanding_series, "outstanding_balance")
_series_query("recovery_series", trend.recovery_series, "dollars_recovered")
_series_query("claims_worked_series", trend.claims_worked_series, "claims_worked")

_WEEK = (
    "CASE snapshot_label WHEN '2026-05-04' THEN 'Week 1' WHEN '2026-05-11' THEN 'Week 2' "
    "WHEN '2026-05-18' THEN 'Week 3' WHEN '2026-05-26' THEN 'Week 4' END"
)


@register(
    "progression_series",
    sql.trend_query(
        f"SELECT {_WEEK} AS week_label, round(outstanding_balance, 2) AS outstanding_balance, "
        f"format('${{:.3f}}M', outstanding_balance / 1e6) AS outstanding_text FROM trend WHERE {_WEEK} IS NOT NULL"
    ),
)
def _(spark, sf_dir):
    return presented(trend.progression_series(summary(spark, sf_dir)))


@register(
    "productivity_series",
    sql.trend_query(
        f"SELECT {_WEEK} AS week_label, total_claims, format('{{:,.0f}}', CAST(total_claims AS DOUBLE)) AS claims_text, "
        "round(outstanding_balance, 2) AS outstanding_balance, "
        f"format('${{:.3f}}M', outstanding_balance / 1e6) AS outstanding_text FROM trend WHERE {_WEEK} IS NOT NULL"
    ),
)
def _(spark, sf_dir):
    return presented(trend.productivity_series(summary(spark, sf_dir)))


@register(
    "progression_table",
    sql.trend_query(
        'SELECT snapshot_label AS "Snapshot Date", total_claims AS "Total Claims", open_claims AS "Open Claims", '
        'round(outstanding_balance, 2) AS "Outstanding AR ($)", round(dollars_recovered, 2) AS "Balance Reductions ($)", '
        'claims_worked AS "Touches" FROM trend'
    ),
)
def _(spark, sf_dir):
    return presented(trend.progression_table(summary(spark, sf_dir)))


# --- follow-up ---------------------------------------------------------------------------


@register(
    "follow_up_stats",
    sql.follow_query(
        """SELECT composite_key, touch_count, unique_workers, worked_dates, latest_status,
  round(latest_balance, 2) AS latest_balance, round(initial_balance, 2) AS initial_balance, patient_id, claim_id,
  plan_name, report_worked_by, round(recovered_amount, 2) AS recovered_amount FROM follow"""
    ),
)
def _(spark, sf_dir):
    return presented(stats(spark, sf_dir))


@register(
    "follow_up_kpis",
    sql.follow_query(
        """SELECT count(*) AS claims_worked, count(*) FILTER (WHERE touch_count > 1) AS claims_followed_up,
  round(count(*) FILTER (WHERE touch_count > 1) * 100.0 / count(*), 4) AS follow_up_rate,
  round(avg(touch_count) FILTER (WHERE touch_count > 1), 4) AS average_touches,
  round(sum(recovered_amount) FILTER (WHERE touch_count > 1), 2) AS recovered_amount FROM follow"""
    ),
)
def _(spark, sf_dir):
    return presented(followup.follow_up_kpis(stats(spark, sf_dir)))


@register(
    "touch_frequency",
    sql.follow_query(
        "SELECT concat(CAST(touch_count AS STRING), 'x') AS touch_count, count(*) AS claim_count "
        "FROM follow GROUP BY follow.touch_count"
    ),
)
def _(spark, sf_dir):
    return followup.touch_frequency(followup.touch_counts(claims(spark, sf_dir)))


@register(
    "follow_up_registry",
    sql.follow_query(
        """SELECT patient_id AS "Patient ID", claim_id AS "Claim ID", plan_name AS "Plan Name",
  touch_count AS "Total Touches", round(initial_balance, 2) AS "Initial Balance ($)",
  round(latest_balance, 2) AS "Latest Balance ($)", round(recovered_amount, 2) AS "Recovered Amount ($)",
  latest_status AS "Latest Status", report_worked_by AS "Last Action By" FROM follow WHERE touch_count > 1"""
    ),
)
def _(spark, sf_dir):
    return presented(followup.follow_up_registry(stats(spark, sf_dir)))


@register(
    "multi_touch",
    sql.follow_query("SELECT composite_key, touch_count FROM follow WHERE touch_count > 1"),
)
def _(spark, sf_dir):
    return followup.multi_touch(followup.touch_counts(claims(spark, sf_dir)))


@register(
    "follow_up_by_bucket",
    sql.follow_query(
        "SELECT bucket AS aging_bucket, count(*) AS follow_up_count FROM follow WHERE touch_count > 1 GROUP BY bucket"
    ),
)
def _(spark, sf_dir):
    return followup.follow_up_by_bucket(claims(spark, sf_dir))


@register(
    "follow_up_by_employee",
    sql.claims_query(
        """SELECT report_worked_by AS worked_by, count(*) AS follow_up_touches FROM (
  SELECT report_worked_by, count(*) OVER (PARTITION BY composite_key) AS n FROM priced
  WHERE report_worked_by IS NOT NULL) t WHERE n > 1 GROUP BY report_worked_by"""
    ),
)
def _(spark, sf_dir):
    return followup.follow_up_by_employee(claims(spark, sf_dir))


# --- dashboard (everything ticked) ----------------------------------------------------------


@register(
    "dashboard_cards",
    sql.claims_query(
        """SELECT count(*) AS total_claims, count(*) FILTER (WHERE claim_balance > 0) AS open_claims,
  count(*) FILTER (WHERE claim_balance <= 0) AS closed_claims, round(sum(claim_balance), 2) AS outstanding_balance,
  round(sum(recovered), 2) AS dollars_recovered, count(report_worked_by) AS claims_worked FROM cur_filtered"""
    ),
)
def _(spark, sf_dir):
    return presented(boards(spark, sf_dir).cards)


@register("dashboard_topline", sql.claims_query(sql.topline("cur_filtered")))
def _(spark, sf_dir):
    return presented(boards(spark, sf_dir).topline)


@register("dashboard_aging_summary", sql.claims_query(sql.aging_summary("cur_filtered")))
def _(spark, sf_dir):
    return presented(boards(spark, sf_dir).aging_summary)


@register("dashboard_productivity", sql.claims_query(sql.productivity("filtered")))
def _(spark, sf_dir):
    return presented(metrics.employee_productivity(filtered(spark, sf_dir)))


@register(
    "dashboard_portfolio",
    sql.claims_query(
        sql.topline("uniq"),
        f"uniq AS (SELECT * FROM ({_NEWEST_ROW.replace('FROM priced', 'FROM filtered')}) t WHERE rn = 1)",
    ),
)
def _(spark, sf_dir):
    return presented(portfolio.portfolio_topline(filtered(spark, sf_dir)))


# --- streaming -----------------------------------------------------------------------------


def _streamed_store(spark: SparkSession, sf_dir: str) -> str:
    """Raw rows written as snapshot files, then taken in by the stream until all is read."""
    store = _scratch(spark, "stream")
    source = f"{store}/in"
    with lean_writes(spark):
        raw = claims_raw(spark, sf_dir).select("sheet_name", *DATA_COLUMNS)
        (
            raw.withColumn("sheet", F.replace(F.col("sheet_name"), F.lit("/"), F.lit("-")))
            .drop("sheet_name")
            .write.partitionBy("sheet")
            .parquet(f"{source}", compression=landing.CODEC)
        )
    stream = refresh.stream_snapshots(spark, source, DATA_COLUMNS, "parquet")
    stream = stream.withColumn("sheet_name", F.regexp_replace("sheet_name", "^sheet=", ""))
    query = refresh.refresh_metrics(stream, store, every=None)
    query.awaitTermination()
    return store


def _by_sheet(spark: SparkSession, rows: DataFrame, path: str, *more: str) -> DataFrame:
    """Rows under sheet names that folders can have, written once, so that files of one sheet are
    made from that sheet's rows alone."""
    with lean_writes(spark):
        named = rows.withColumn("sheet", F.replace(F.col("sheet_name"), F.lit("/"), F.lit("-")))
        named.write.partitionBy("sheet", *more).parquet(path, compression=landing.CODEC)
    return spark.read.schema(named.schema).parquet(path)


_STREAM_NAME = "replace(sheet_name, '/', '-') AS sheet_name"


@register(
    "stream_snapshot_summary",
    sql.trend_query(_SUMMARY_SQL.replace(" sheet_name,", f" {_STREAM_NAME},")),
)
def _(spark, sf_dir):
    """Trend rows kept by the stream equal the trend of all rows."""
    store = _streamed_store(spark, sf_dir)
    return presented(refresh.read_summary(spark, store).select(*trend.SUMMARY_COLUMNS))


@register(
    "stream_aging_trend",
    sql.trend_query(
        f"""SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, snapshot_label, {_STREAM_NAME},
  {sql.SORTED_BUCKET} AS aging_bucket, claim_count, round(outstanding_balance, 2) AS outstanding_balance
FROM trend_aging"""
    ),
)
def _(spark, sf_dir):
    """Aging kept by the stream equals the aging trend of all rows."""
    aging = refresh.read_aging(spark, _streamed_store(spark, sf_dir))
    return presented(
        aging.select(
            "snapshot_date", "snapshot_label", "sheet_name", "aging_bucket", "claim_count",
            "outstanding_balance",
        )
    )


@register(
    "stream_differing_headers",
    sql.trend_query(_SUMMARY_SQL.replace(" sheet_name,", f" {_STREAM_NAME},")),
)
def _(spark, sf_dir):
    """Files of three headers in two batches: names spelled otherwise, columns in another order,
    a column more. Their trend rows equal the trend of all rows."""
    store = _scratch(spark, "headers")
    kind = F.pmod(F.floor(F.col("row_pos") / 1000000), F.lit(3)).cast("int")
    raw = _by_sheet(spark, claims_raw(spark, sf_dir).withColumn("kind", kind), f"{store}/rows", "kind")
    spelled = [F.col(c).alias(c.replace("_", " ").title()) for c in DATA_COLUMNS]
    kinds = (spelled, [*reversed(spelled)], [*map(F.col, DATA_COLUMNS), F.lit(None).cast("string").alias("Note")])
    names = [r["sheet"] for r in raw.select("sheet").distinct().collect()]

    def write(name: str, i: int) -> None:
        mine = raw.where((F.col("sheet") == name) & (F.col("kind") == i))
        reports.write_report(mine.select(*kinds[i]).coalesce(1), f"{store}/in/{name}/{i}", compression="bzip2")

    # Each of these is one file and so one task.
    with ThreadPoolExecutor(len(names) * len(kinds)) as pool:
        list(pool.map(write, *zip(*((name, i) for i in range(len(kinds)) for name in names))))
    files.discard(spark, f"{store}/rows")
    query = refresh.refresh_files(spark, f"{store}/in", f"{store}/out", every=None, max_files=7, on_error="raise")
    query.awaitTermination()
    return presented(refresh.read_summary(spark, f"{store}/out").select(*trend.SUMMARY_COLUMNS))


def _synced_store(spark: SparkSession, sf_dir: str) -> str:
    """Files of all sheets, one of which is replaced after a first call: it held other rows."""
    store = _scratch(spark, "synced")
    raw = claims_raw(spark, sf_dir).withColumn("sheet", F.replace(F.col("sheet_name"), F.lit("/"), F.lit("-")))
    for name in ("5-4-2026", "2026-05-11", "5-18-2026", "2026-05-26"):
        mine = raw.where(F.col("sheet") == name)
        first = mine.where("claim_status IS NULL").withColumn("claim_balance", F.lit("1")) if name == "5-18-2026" else mine
        reports.write_report(first.select(*DATA_COLUMNS), f"{store}/in/{name}/claims")
    sync.sync_files(spark, f"{store}/in", f"{store}/out", glob="part-*")
    replaced = raw.where("sheet = '5-18-2026'").select(*DATA_COLUMNS)
    reports.write_report(replaced, f"{store}/in/5-18-2026/claims")
    sync.sync_files(spark, f"{store}/in", f"{store}/out", glob="part-*")
    return f"{store}/out"


@register(
    "synced_summary",
    sql.trend_query(_SUMMARY_SQL.replace(" sheet_name,", f" {_STREAM_NAME},")),
)
def _(spark, sf_dir):
    """Trend rows of a folder after a file of it was replaced equal the trend of all rows."""
    return presented(sync.synced_summary(spark, _synced_store(spark, sf_dir)))


# --- snapshot folders: files of one sheet that differ ------------------------------------------

_FILES_SQL = """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Notes' ELSE '2026-05-04' END AS sheet_name,
  CAST(o_orderkey AS STRING) AS claim_id, concat('say "', o_orderstatus, '", ok, ', o_orderpriority) AS status,
  CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_custkey AS STRING) END AS cust_id FROM orders"""


def _folder(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    """A dated and an undated sheet of two files each, with other column orders, names, types
    and, in the second, one column more."""
    root = _scratch(spark, f"folder-{fmt}")
    orders = table(spark, sf_dir, "orders")
    status = F.concat(
        F.lit('say "'), "o_orderstatus", F.lit('", ok, '), "o_orderpriority"
    ).alias("Status")
    claim = F.col("o_orderkey")
    for sheet, rows in (("Notes", orders.where("o_orderkey % 3 = 0")), ("2026-05-04", orders.where("o_orderkey % 3 <> 0"))):
        first = rows.where("o_orderkey % 2 = 0").select(claim.alias("Claim ID"), status)
        second = rows.where("o_orderkey % 2 = 1").select(
            status, F.col("o_custkey").cast("string").alias("Cust - Id"), claim.cast("string").alias("claim_id")
        )
        for part, data in (("a", first), ("b", second)):
            if fmt == "csv":
                reports.write_report(data, f"{root}/{sheet}/{part}")
            else:
                data.write.format(fmt).save(f"{root}/{sheet}/{part}")
    return root


def _read_folder(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    rows = sheets.read_snapshots(spark, _folder(spark, sf_dir, fmt), fmt, glob="part-*")
    return rows.select("sheet_name", "claim_id", "status", "cust_id")


@register("read_snapshots_csv", _FILES_SQL)
def _(spark, sf_dir):
    return _read_folder(spark, sf_dir, "csv")


@register("read_snapshots_json", _FILES_SQL)
def _(spark, sf_dir):
    return _read_folder(spark, sf_dir, "json")


@register("read_snapshots_mixed", _FILES_SQL)
def _(spark, sf_dir):
    """Parquet files of one sheet with differing types."""
    return _read_folder(spark, sf_dir, "parquet")


@register(
    "write_report_collection",
    sql.claims_query(
        "SELECT report_worked_by AS worked_by, round(sum(recovered), 2) AS recovered_amount "
        "FROM priced GROUP BY report_worked_by"
    ),
)
def _(spark, sf_dir):
    """A collection table exported as CSV and read back as a snapshot folder."""
    path = _scratch(spark, "collection")
    reports.write_report(metrics.employee_collection(claims(spark, sf_dir)), f"{path}/2026-05-04")
    rows = sheets.read_snapshots(spark, path, glob="part-*")
    return presented(rows.select("worked_by", F.col("recovered_amount").cast("double")))


# --- cells with line breaks, broken records --------------------------------------------------


@register(
    "read_snapshots_linebreaks",
    "SELECT '2026-05-04' AS sheet_name, CAST(o_orderkey AS STRING) AS claim_id, CASE WHEN o_orderkey % 3 = 0 "
    "THEN concat(o_orderstatus, chr(10), '\"', o_orderpriority, '\", ', chr(13), chr(10), ' end') "
    "ELSE o_orderpriority END AS note, CAST(o_custkey AS STRING) AS cust_id FROM orders",
)
def _(spark, sf_dir):
    """A table whose cells hold line breaks, quotes and commas, exported as CSV and read again."""
    root = _scratch(spark, "linebreaks")
    broken = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('", \r\n end'))
    note = F.when(F.col("o_orderkey") % 3 == 0, broken).otherwise(F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders")
    reports.write_report(
        orders.select(F.col("o_orderkey").alias("Claim ID"), note.alias("Note"), F.col("o_custkey").alias("Cust ID")),
        f"{root}/2026-05-04",
    )
    return sheets.read_snapshots(spark, root, glob="part-*").select("sheet_name", "claim_id", "note", "cust_id")


@register(
    "rejected_rows",
    """SELECT 'csv' AS fmt, '2026-05-04' AS sheet_name, concat(o_orderkey, ',"', o_orderpriority, ', x"') AS text,
  '2 of 3 cells' AS reason FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'json', '2026-05-11', concat('{"claim_id": ', o_orderkey, ', "status": "', o_orderstatus), 'no JSON object'
FROM orders WHERE o_orderkey % 7 = 0""",
)
def _(spark, sf_dir):
    """CSV rows that are too short and JSON lines that break off, in files that hold others too."""
    root = _scratch(spark, "rejected")
    key, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    short = F.concat(key.cast("string"), F.lit(',"'), "o_orderpriority", F.lit(', x"'))
    csv = F.when(key % 5 == 0, short).otherwise(F.concat(short, F.lit(","), "o_orderstatus"))
    half = F.concat(F.lit('{"claim_id": '), key.cast("string"), F.lit(', "status": "'), "o_orderstatus")
    json = F.when(key % 7 == 0, half).otherwise(F.concat(half, F.lit('"}')))
    header = spark.range(1).select(F.lit("claim_id,priority,status").alias("value"))
    header.unionByName(orders.select(csv.alias("value"))).coalesce(1).write.text(f"{root}/csv/2026-05-04")
    orders.select(json.alias("value")).write.text(f"{root}/json/2026-05-11")
    found = [
        sheets.rejected_rows(spark, f"{root}/{fmt}", fmt, glob="part-*").select(F.lit(fmt).alias("fmt"), "sheet_name", "text", "reason")
        for fmt in ("csv", "json")
    ]
    return found[0].unionByName(found[1])


# --- dates ---------------------------------------------------------------------------------

_STYLES = (
    "M/d/yyyy h:mm a", "d-MMM-yyyy", "d-MMM-yy", "M.d.yyyy", "yyyy.MM.dd", "EEE, MMM d, yyyy",
    "MMMM d, yyyy", "yyyy-MM-dd h:mm a",
)


@register(
    "clean_claims_dates",
    "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders",
)
def _(spark, sf_dir):
    """Order dates written in eight spellings and read again."""
    from arledger.functions.cells import parse_date

    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d")
    )
    text = F.lit(None).cast("string")
    for i, style in enumerate(_STYLES):
        text = F.when(F.col("o_orderkey") % len(_STYLES) == i, F.date_format("d", style)).otherwise(text)
    written = orders.select("o_orderkey", text.alias("text"))
    return presented(written.select("o_orderkey", F.to_date(parse_date(F.col("text"))).alias("day")))


# --- ties and missing weeks --------------------------------------------------------------------


@register(
    "snapshot_deltas_tied",
    sql.claims_query(
        "SELECT 'total_claims' AS metric, CAST(count(*) FILTER (WHERE sheet_pos = 1) AS DOUBLE) AS begin_value, "
        "CAST(count(*) FILTER (WHERE sheet_pos = 2) AS DOUBLE) AS end_value FROM "
        "(SELECT DISTINCT * EXCLUDE (row_pos) FROM claims)"
    ),
)
def _(spark, sf_dir):
    """Two sheets of one date: their order in the workbook decides which is first, although
    their names sort the other way."""
    raw = trend_rows(spark, sf_dir).where("sheet_pos IN (1, 2)")
    name = F.when(F.col("sheet_pos") == 1, "5/4/2026").otherwise("2026-05-04")
    tied = trend.snapshot_summary(raw.withColumn("sheet_name", name), positions=True)
    deltas = trend.snapshot_deltas(tied).where("metric = 'total_claims'")
    return presented(deltas.select("metric", "begin_value", "end_value"))


@register(
    "net_improvement_incomplete",
    sql.trend_query(
        "SELECT count(*) AS n FROM trend WHERE snapshot_label = '2026-05-04' AND "
        "(SELECT count(DISTINCT snapshot_label) FROM trend WHERE snapshot_label <> '2026-05-11' AND snapshot_label IN "
        "('2026-05-04', '2026-05-11', '2026-05-18', '2026-05-26')) = 4"
    ),
)
def _(spark, sf_dir):
    """With a week missing there is no result."""
    short = summary(spark, sf_dir).where("snapshot_label <> '2026-05-11'")
    return trend.net_improvement(short).agg(F.count(F.lit(1)).alias("n"))


# --- the dashboard as one landed build ----------------------------------------------------------


def board(spark: SparkSession, sf_dir: str) -> Dashboard:
    """The dashboard of the claims and an undated sheet, landed by the query that asks for it, so
    that what a query costs and reads does not depend on those that ran before."""
    raw = claims_raw(spark, sf_dir)
    notes = raw.where("sheet_pos = 1").withColumns({"sheet_name": F.lit("Notes"), "sheet_pos": F.lit(9)})
    return dashboard(raw.unionByName(notes), path=_scratch(spark, "board"))


_BOARD_FOLLOW = sql.FOLLOW.replace("FROM priced", "FROM filtered")

_BOARD = {
    "filter_options": REGISTRY["filter_options"][1],
    "date_bounds": REGISTRY["date_bounds"][1],
    "cards": REGISTRY["dashboard_cards"][1],
    "topline": sql.claims_query(sql.topline("cur_filtered")),
    "aging_summary": sql.claims_query(sql.aging_summary("cur_filtered")),
    "collection_summary": sql.claims_query(
        f"SELECT {sql.SORTED_BUCKET} AS aging_bucket, round(sum(recovered), 2) AS recovered_amount, "
        "round(sum(claim_balance), 2) AS outstanding_balance, "
        "round(coalesce(sum(recovered) / nullif(sum(claim_balance), 0), 0) * 100, 4) AS recovery_percentage "
        "FROM cur_filtered GROUP BY bucket"
    ),
    "claims_done": sql.claims_query(
        f"SELECT {sql.SORTED_BUCKET} AS aging_bucket, count(*) FILTER (WHERE claim_balance <= 0) AS done_count, "
        "round(sum(recovered), 2) AS recovered_amount FROM cur_filtered GROUP BY bucket"
    ),
    "current_productivity": sql.claims_query(sql.productivity("cur_filtered")),
    "portfolio_topline": REGISTRY["dashboard_portfolio"][1],
    "productivity": sql.claims_query(sql.productivity("filtered")),
    "aging_worked": sql.claims_query(
        "SELECT report_worked_by AS worked_by, bucket AS aging_bucket, count(*) AS touches "
        "FROM filtered GROUP BY report_worked_by, bucket"
    ),
    "employee_collection": sql.claims_query(
        "SELECT report_worked_by AS worked_by, round(sum(recovered), 2) AS recovered_amount "
        "FROM filtered GROUP BY report_worked_by"
    ),
    "follow_up_kpis": sql.claims_query(
        """SELECT count(*) AS claims_worked, count(*) FILTER (WHERE touch_count > 1) AS claims_followed_up,
  round(count(*) FILTER (WHERE touch_count > 1) * 100.0 / count(*), 4) AS follow_up_rate,
  round(avg(touch_count) FILTER (WHERE touch_count > 1), 4) AS average_touches,
  round(sum(recovered_amount) FILTER (WHERE touch_count > 1), 2) AS recovered_amount FROM follow""",
        _BOARD_FOLLOW,
    ),
    "touch_frequency": sql.claims_query(
        "SELECT concat(CAST(touch_count AS STRING), 'x') AS touch_count, count(*) AS claim_count "
        "FROM follow GROUP BY follow.touch_count",
        _BOARD_FOLLOW,
    ),
    "registry": sql.claims_query(
        """SELECT patient_id AS "Patient ID", claim_id AS "Claim ID", plan_name AS "Plan Name",
  touch_count AS "Total Touches", round(initial_balance, 2) AS "Initial Balance ($)",
  round(latest_balance, 2) AS "Latest Balance ($)", round(recovered_amount, 2) AS "Recovered Amount ($)",
  latest_status AS "Latest Status", report_worked_by AS "Last Action By" FROM follow WHERE touch_count > 1""",
        _BOARD_FOLLOW,
    ),
}


def _register_board(field: str, restated: str) -> None:
    @register(f"board_{field}", restated)
    def _(spark, sf_dir):
        return presented(getattr(board(spark, sf_dir), field))


for _field, _restated in _BOARD.items():
    _register_board(_field, _restated)


@register("board_snapshot_summary", sql.trend_query(_SUMMARY_SQL, "filtered"))
def _(spark, sf_dir):
    return presented(board(spark, sf_dir).trend.snapshot_summary.select(*trend.SUMMARY_COLUMNS))


@register(
    "board_aging_distribution",
    sql.trend_query(
        f"""SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, sheet_name,
  {sql.SORTED_BUCKET} AS aging_bucket, claim_count, round(outstanding_balance, 2) AS outstanding_balance
FROM trend_aging""",
        "filtered",
    ),
)
def _(spark, sf_dir):
    table = board(spark, sf_dir).trend.aging_distribution
    return presented(table.select("snapshot_date", "sheet_name", "aging_bucket", "claim_count", "outstanding_balance"))


@register("board_sheets", REGISTRY["ordered_sheets"][1])
def _(spark, sf_dir):
    return presented(board(spark, sf_dir).trend.sheets)


@register("board_latest", REGISTRY["latest_sheet"][1])
def _(spark, sf_dir):
    return presented(board(spark, sf_dir).trend.latest)


@register(
    "board_worked_vs_recovered",
    sql.claims_query(
        "SELECT report_worked_by AS worked_by, count(*) AS total_touches, "
        "count(DISTINCT claim_id) AS unique_claims_touched, round(sum(recovered), 2) AS recovered_amount "
        "FROM filtered WHERE report_worked_by IS NOT NULL GROUP BY report_worked_by"
    ),
)
def _(spark, sf_dir):
    return presented(board(spark, sf_dir).worked_vs_recovered)


def _tied(spark: SparkSession, sf_dir: str) -> Dashboard:
    """A dashboard of two sheets of one date, whose names sort the other way than they stand."""
    raw = claims_raw(spark, sf_dir).where("sheet_pos IN (1, 2)")
    name = F.when(F.col("sheet_pos") == 1, "5/4/2026").otherwise("2026-05-04")
    return dashboard(raw.withColumn("sheet_name", name))


@register(
    "board_deltas_tied",
    sql.claims_query(
        "SELECT 'total_claims' AS metric, CAST(count(*) FILTER (WHERE sheet_pos = 1) AS DOUBLE) AS begin_value, "
        "CAST(count(*) FILTER (WHERE sheet_pos = 2) AS DOUBLE) AS end_value FROM "
        "(SELECT DISTINCT * EXCLUDE (row_pos, label) FROM filtered)"
    ),
)
def _(spark, sf_dir):
    deltas = trend.snapshot_deltas(_tied(spark, sf_dir).trend.snapshot_summary)
    return presented(deltas.where("metric = 'total_claims'").select("metric", "begin_value", "end_value"))


@register(
    "board_growth_tied",
    sql.claims_query(
        f"SELECT {sql.SORTED_BUCKET} AS aging_bucket, count(*) FILTER (WHERE sheet_pos = 2) - "
        "count(*) FILTER (WHERE sheet_pos = 1) AS claim_change FROM "
        "(SELECT DISTINCT * EXCLUDE (row_pos, label) FROM filtered WHERE sheet_pos IN (1, 2)) GROUP BY bucket "
        "HAVING count(*) FILTER (WHERE sheet_pos = 2) > 0 AND count(*) FILTER (WHERE sheet_pos = 1) > 0"
    ),
)
def _(spark, sf_dir):
    growth = trend.bucket_growth(_tied(spark, sf_dir).trend.aging_distribution)
    return presented(growth.where("claim_change IS NOT NULL").select("aging_bucket", "claim_change"))


@register(
    "sheet_manifest",
    sql.claims_query(
        "SELECT sheet_name, CAST(sheet_pos AS INTEGER) AS sheet_pos, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, "
        "count(*) AS n_rows, count(bucket) AS n_bucketed, count(filter_day) AS n_dated, "
        "strftime(min(filter_day), '%Y-%m-%d') AS first_day, strftime(max(filter_day), '%Y-%m-%d') AS last_day "
        "FROM priced WHERE snapshot_date IS NOT NULL GROUP BY priced.sheet_name, priced.sheet_pos, priced.snapshot_date"
    ),
)
def _(spark, sf_dir):
    """What a landed dashboard knows of its sheets without reading claims."""
    return presented(sheet_manifest(claims(spark, sf_dir)))
