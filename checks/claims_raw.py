"""Claim snapshots derived from lineitem, orders and customer, as text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA_COLUMNS = (
    "patient_id",
    "claim_id",
    "plan_name",
    "report_worked_by",
    "report_worked_date",
    "submission_date",
    "claim_status",
    "claim_amount",
    "claim_balance",
    "claim_balance_aging",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with sheet_name, sheet_pos and row_pos.

    Lines and orders grow together, so they are joined by shuffle; for customers the sizes
    decide at run time. Orders get their customers first, so that lines, the most rows, are shuffled
    once. That is by the text that becomes the claim's id: rows are then dealt by a column they keep,
    and grouping them by it and others, as the duplicate drop does, needs no second shuffle.
    Repeated rows come from one explode, so the joins run once. It yields the aging label,
    which keeps conditions on the cleaned label from being written out in terms of the
    label's own CASE.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .join(
            table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "inner"
        )
        .withColumn("order_claim", F.col("o_orderkey").cast("string"))
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("claim_id", F.col("l_orderkey").cast("string"))
    joined = lines.join(orders.hint("merge"), F.col("claim_id") == F.col("order_claim"), "inner")
    once = joined.selectExpr(*_LINE).selectExpr(*_ROW)
    copies = "array_repeat(claim_balance_aging, if(row_pos % 10 = 3, 2, 1))"
    return once.selectExpr(
        "sheet_name",
        "sheet_pos",
        "row_pos",
        *DATA_COLUMNS[:-1],
        f"explode({copies}) AS claim_balance_aging",
    )


_LINE = (
    "l_orderkey",
    "claim_id",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_shipdate",
    "o_custkey",
    "o_orderdate",
    "o_orderstatus",
    "c_mktsegment",
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS amt",
    """CAST(l_extendedprice AS DECIMAL(18,2)) + CAST(CASE
         WHEN l_returnflag = 'R' THEN -l_extendedprice
         WHEN l_returnflag = 'A' THEN -10 * l_quantity
         WHEN l_linestatus = 'F' THEN 50
         ELSE 0 END AS DECIMAL(18,2)) AS bal""",
    "CAST(floor(l_extendedprice / 1000) AS BIGINT) AS thousands",
)

_ROW = (
    """CASE l_linenumber % 4 WHEN 0 THEN '5/4/2026' WHEN 1 THEN '2026-05-11'
         WHEN 2 THEN '5/18/2026' ELSE '2026-05-26' END AS sheet_name""",
    "CAST(l_linenumber % 4 AS INT) AS sheet_pos",
    "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS row_pos",
    "CAST(o_custkey AS STRING) AS patient_id",
    "claim_id",
    "c_mktsegment AS plan_name",
    """CASE WHEN l_suppkey % 7 <> 0
         THEN concat('EMP', CAST(l_suppkey % 12 AS STRING)) END AS report_worked_by""",
    "CAST(CAST(l_shipdate AS DATE) AS STRING) AS report_worked_date",
    """CASE WHEN l_orderkey % 50 = 0 THEN 'not a date'
         ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS submission_date""",
    """CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus
         WHEN l_orderkey % 3 = 0 THEN '' WHEN l_orderkey % 3 = 1 THEN 'None' END AS claim_status""",
    """CASE WHEN l_partkey % 97 = 0 THEN 'N/A'
         WHEN amt >= 1000 THEN concat('$', CAST(thousands AS STRING), ',',
           lpad(CAST(CAST(amt - thousands * 1000 AS DECIMAL(18,2)) AS STRING), 6, '0'))
         ELSE CAST(amt AS STRING) END AS claim_amount""",
    "concat('$', CAST(bal AS STRING)) AS claim_balance",
    """CASE WHEN l_quantity <= 15 THEN '0 - 30 Days' WHEN l_quantity <= 25 THEN '31 to 45'
         WHEN l_quantity <= 35 THEN '46_60' WHEN l_quantity <= 45 THEN '60 plus'
         WHEN l_quantity <= 48 THEN '90-120' END AS claim_balance_aging""",
)
