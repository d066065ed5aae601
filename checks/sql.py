"""SQL restatement of the check input, of cleaning and of every query (DuckDB dialect).

Nothing here is used by the library. Each query starts from the given tables.
"""

from __future__ import annotations

RAW = """
line AS (
  SELECT l.*, o.o_custkey, o.o_orderkey, o.o_orderdate, o.o_orderstatus, c.c_mktsegment,
    CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amt,
    CAST(l.l_extendedprice AS DECIMAL(18,2)) + CAST(CASE
        WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice
        WHEN l.l_returnflag = 'A' THEN -10 * l.l_quantity
        WHEN l.l_linestatus = 'F' THEN 50
        ELSE 0 END AS DECIMAL(18,2)) AS bal
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey),
raw_once AS (
  SELECT
    CASE l_linenumber % 4 WHEN 0 THEN '5/4/2026' WHEN 1 THEN '2026-05-11'
                          WHEN 2 THEN '5/18/2026' ELSE '2026-05-26' END AS sheet_name,
    l_linenumber % 4 AS sheet_pos,
    l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS row_pos,
    CAST(o_custkey AS STRING) AS patient_id,
    CAST(l_orderkey AS STRING) AS claim_id,
    c_mktsegment AS plan_name,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL
         ELSE concat('EMP', CAST(l_suppkey % 12 AS STRING)) END AS report_worked_by,
    CAST(CAST(l_shipdate AS DATE) AS STRING) AS report_worked_date,
    CASE WHEN l_orderkey % 50 = 0 THEN 'not a date'
         ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS submission_date,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus
         WHEN l_orderkey % 3 = 0 THEN '' WHEN l_orderkey % 3 = 1 THEN 'None'
         ELSE NULL END AS claim_status,
    CASE WHEN l_partkey % 97 = 0 THEN 'N/A'
         WHEN amt >= 1000 THEN concat('$', CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING), ',',
              lpad(CAST(CAST(amt - CAST(floor(l_extendedprice / 1000) AS BIGINT) * 1000 AS DECIMAL(18,2)) AS STRING), 6, '0'))
         ELSE CAST(amt AS STRING) END AS claim_amount,
    concat('$', CAST(bal AS STRING)) AS claim_balance,
    CASE WHEN l_quantity <= 15 THEN '0 - 30 Days' WHEN l_quantity <= 25 THEN '31 to 45'
         WHEN l_quantity <= 35 THEN '46_60' WHEN l_quantity <= 45 THEN '60 plus'
         WHEN l_quantity <= 48 THEN '90-120' ELSE NULL END AS claim_balance_aging
  FROM line),
claims_raw AS (
  SELECT * FROM raw_once
  UNION ALL
  SELECT * FROM raw_once WHERE row_pos % 10 = 3)"""

_DATA = (
    "patient_id, claim_id, plan_name, report_worked_by, report_worked_date, submission_date, "
    "claim_status, claim_amount, claim_balance, claim_balance_aging"
)


def _text(name: str) -> str:
    return f"CASE WHEN {name} NOT IN ('', 'nan', 'None') THEN {name} END AS {name}"


def _money(name: str) -> str:
    return f"coalesce(TRY_CAST(regexp_replace({name}, '[$,]', '', 'g') AS DOUBLE), 0) AS {name}"


CLEAN = f"""
dedup AS (
  SELECT sheet_name, sheet_pos, min(row_pos) AS row_pos, {_DATA}
  FROM claims_raw GROUP BY sheet_name, sheet_pos, {_DATA}),
labels_lower AS (
  SELECT *, replace(lower(trim(claim_balance_aging)), 'days', '') AS t FROM dedup),
labels_bare AS (
  SELECT *, replace(replace(regexp_replace(t, '\\s+', '', 'g'), 'to', '-'), 'plus', '+') AS b
  FROM labels_lower),
claims AS (
  SELECT sheet_name, sheet_pos, row_pos,
    coalesce(try_strptime(sheet_name, '%m/%d/%Y'), try_strptime(sheet_name, '%Y-%m-%d')) AS snapshot_date,
    {_text('patient_id')}, {_text('claim_id')}, {_text('plan_name')}, {_text('report_worked_by')},
    try_strptime(report_worked_date, '%Y-%m-%d') AS report_worked_date,
    try_strptime(submission_date, '%Y-%m-%d') AS submission_date,
    {_text('claim_status')}, {_money('claim_amount')}, {_money('claim_balance')},
    CASE WHEN claim_balance_aging IS NULL THEN NULL
      WHEN regexp_matches(t, '0\\s*[-_]?\\s*30|0\\s*to\\s*30') THEN '0-30'
      WHEN regexp_matches(t, '31\\s*[-_]?\\s*45|31\\s*to\\s*45') THEN '31-45'
      WHEN regexp_matches(t, '46\\s*[-_]?\\s*60|46\\s*to\\s*60') THEN '46-60'
      WHEN regexp_matches(t, '60\\s*\\+|60\\s*plus|60\\s*over') THEN '60+'
      WHEN b IN ('0-30', '0_30', '030') THEN '0-30'
      WHEN b IN ('31-45', '31_45', '3145') THEN '31-45'
      WHEN b IN ('46-60', '46_60', '4660') THEN '46-60'
      WHEN b IN ('60+', '60over', '60') THEN '60+'
      WHEN claim_balance_aging IN ('', 'nan', 'None') THEN NULL
      ELSE claim_balance_aging END AS bucket,
    claim_balance_aging AS label
  FROM labels_bare),
priced AS (
  SELECT *, greatest(claim_amount - claim_balance, 0) AS recovered,
    concat(coalesce(patient_id, '<NA>'), '_', coalesce(claim_id, '<NA>')) AS composite_key,
    CAST(submission_date AS DATE) AS filter_day
  FROM claims),
filtered AS (
  SELECT * FROM priced WHERE bucket IS NOT NULL AND filter_day IS NOT NULL),
newest AS (
  SELECT sheet_name FROM claims WHERE snapshot_date IS NOT NULL
  GROUP BY sheet_name, sheet_pos, snapshot_date ORDER BY snapshot_date DESC, sheet_pos LIMIT 1),
cur AS (SELECT * FROM priced WHERE sheet_name = (SELECT sheet_name FROM newest)),
cur_filtered AS (SELECT * FROM filtered WHERE sheet_name = (SELECT sheet_name FROM newest))"""


def _trend(name: str, source: str) -> str:
    """Trend rows of a claims relation: equal cleaned rows count once."""
    return f"""
{name}_rows AS (
  SELECT DISTINCT sheet_name, sheet_pos, snapshot_date, patient_id, claim_id, plan_name,
    report_worked_by, report_worked_date, submission_date, claim_status, claim_amount,
    claim_balance, bucket, recovered FROM {source}),
{name} AS (
  SELECT snapshot_date, sheet_name, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_label,
    count(*) AS total_claims, count(*) FILTER (WHERE claim_balance > 0) AS open_claims,
    sum(claim_balance) AS outstanding_balance, count(report_worked_by) AS claims_worked,
    sum(recovered) AS dollars_recovered
  FROM {name}_rows GROUP BY snapshot_date, sheet_name),
{name}_aging AS (
  SELECT snapshot_date, sheet_name, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_label, bucket,
    count(*) AS claim_count, count(*) FILTER (WHERE claim_balance <= 0) AS done_count,
    sum(claim_balance) AS outstanding_balance, sum(recovered) AS recovered_amount
  FROM {name}_rows GROUP BY snapshot_date, sheet_name, bucket)"""


FOLLOW = """
stats AS (
  SELECT composite_key, count(*) AS touch_count,
    count(DISTINCT report_worked_by) AS unique_workers,
    count(DISTINCT report_worked_date) AS worked_dates,
    last(claim_status ORDER BY sheet_pos, row_pos) FILTER (WHERE claim_status IS NOT NULL) AS latest_status,
    last(claim_balance ORDER BY sheet_pos, row_pos) AS latest_balance,
    first(claim_balance ORDER BY sheet_pos, row_pos) AS initial_balance,
    first(patient_id ORDER BY sheet_pos, row_pos) FILTER (WHERE patient_id IS NOT NULL) AS patient_id,
    first(claim_id ORDER BY sheet_pos, row_pos) FILTER (WHERE claim_id IS NOT NULL) AS claim_id,
    first(plan_name ORDER BY sheet_pos, row_pos) FILTER (WHERE plan_name IS NOT NULL) AS plan_name,
    last(report_worked_by ORDER BY sheet_pos, row_pos) AS report_worked_by,
    last(bucket ORDER BY sheet_pos, row_pos) FILTER (WHERE bucket IS NOT NULL) AS bucket
  FROM priced WHERE report_worked_by IS NOT NULL GROUP BY composite_key),
follow AS (
  SELECT *, greatest(initial_balance - latest_balance, 0) AS recovered_amount FROM stats)"""

SORTED_BUCKET = "CASE WHEN bucket IN ('0-30', '31-45', '46-60', '60+') THEN bucket END"


def claims_query(select: str, *more: str) -> str:
    return "WITH " + ",".join((RAW, CLEAN, *more)) + "\n" + select


def raw_query(select: str) -> str:
    return "WITH " + RAW + "\n" + select


def trend_query(select: str, source: str = "priced") -> str:
    return claims_query(select, _trend("trend", source))


def follow_query(select: str) -> str:
    return claims_query(select, FOLLOW)


def topline(source: str) -> str:
    return f"""
SELECT m.metric, round(CASE m.metric
    WHEN 'Total Claims' THEN n WHEN 'Open Claims' THEN open_n WHEN 'Closed Claims' THEN n - open_n
    WHEN 'Total Outstanding Balance' THEN outstanding ELSE recovered END, 2) AS value
FROM (SELECT CAST(count(*) AS DOUBLE) AS n,
        CAST(count(*) FILTER (WHERE claim_balance > 0) AS DOUBLE) AS open_n,
        sum(claim_balance) AS outstanding, sum(recovered) AS recovered FROM {source}) t,
  (VALUES ('Total Claims'), ('Open Claims'), ('Closed Claims'), ('Total Outstanding Balance'),
          ('Total Balance Reductions')) AS m(metric)
WHERE n > 0"""


def aging_summary(source: str) -> str:
    return f"""
SELECT {SORTED_BUCKET} AS aging_bucket, count(*) AS claim_count,
  count(*) FILTER (WHERE claim_balance <= 0) AS done_count,
  round(sum(claim_balance), 2) AS outstanding_balance, round(sum(recovered), 2) AS recovered_amount,
  round(sum(recovered) + sum(claim_balance), 2) AS total_claimed,
  round(sum(claim_balance) / coalesce(nullif((SELECT sum(claim_balance) FROM {source}), 0), 1) * 100, 4)
    AS percentage_of_total_balance
FROM {source} GROUP BY bucket"""


def productivity(source: str, keys: str = "report_worked_by AS worked_by", group: str = "report_worked_by") -> str:
    return f"""
SELECT {keys}, count(DISTINCT claim_id) AS unique_claims_touched, count(*) AS total_touches,
  round(coalesce(count(*) / nullif(CAST(count(DISTINCT claim_id) AS DOUBLE), 0), 0), 4) AS average_touches_per_claim
FROM {source} WHERE report_worked_by IS NOT NULL GROUP BY {group}"""
