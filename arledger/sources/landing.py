"""Landed snapshots: Parquet, one partition per snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arledger.operators.snapshots import parse_snapshot_date
from arledger.session import lean_writes

PARTITIONS = ("snapshot_date", "sheet_name")
#: Of landed files: about a quarter smaller than with Spark's default.
CODEC = "zstd"


def land_snapshots(df: DataFrame, path: str, mode: str = "overwrite", spread: bool = True) -> None:
    """Write rows partitioned by snapshot date and sheet.

    Later reads prune whole snapshots and, being columnar, skip unused columns. Rebalancing
    by sheet lets the adaptive planner split a sheet that holds most rows over many tasks
    and merge small ones, so neither one task nor thousands of tiny files appear.
    ``spread=False`` leaves rows in their tasks and saves that shuffle: for rows which a shuffle
    has spread already, or which come from landed files, whose tasks hold few sheets each.
    """
    tagged = df
    if "snapshot_date" not in df.columns:
        tagged = df.withColumn("snapshot_date", parse_snapshot_date(F.col("sheet_name")))
    with lean_writes(df.sparkSession):
        rows = tagged.hint("rebalance", "sheet_name") if spread else tagged.select("*")
        rows.write.mode(mode).partitionBy(*PARTITIONS).parquet(path, compression=CODEC)


def landed_schema(df: DataFrame) -> T.StructType:
    """Schema of a landed frame: partition columns last, as they come back."""
    fields = [f for f in df.schema.fields if f.name not in PARTITIONS]
    return T.StructType(
        [
            *fields,
            T.StructField("snapshot_date", T.TimestampType()),
            T.StructField("sheet_name", T.StringType()),
        ]
    )


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed rows. The schema is given because a sheet named ``2026`` or ``2026-05-11``
    would otherwise come back as a number or a date."""
    return spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, path: str, spread: bool = True) -> DataFrame:
    """Land a frame and read it back: later plans start from files that survive lost
    executors instead of from the whole lineage."""
    schema = landed_schema(df)
    land_snapshots(df, path, spread=spread)
    return read_landed(df.sparkSession, path, schema)
