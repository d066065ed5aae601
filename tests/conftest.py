from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from arledger.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


CLAIM_SCHEMA = (
    "sheet_name string, sheet_pos int, row_pos long, patient_id string, claim_id string, "
    "plan_name string, report_worked_by string, report_worked_date string, "
    "submission_date string, claim_status string, claim_amount string, claim_balance string, "
    "claim_balance_aging string"
)


@pytest.fixture(scope="session")
def make_claims(spark):
    """Raw claim rows from dicts; missing fields are null."""
    fields = [part.split()[0] for part in CLAIM_SCHEMA.split(", ")]

    def make(*rows: dict, partitions: int = 2):
        data = [
            tuple({"sheet_pos": 0, "row_pos": i, **row}.get(f) for f in fields)
            for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(data, CLAIM_SCHEMA).repartition(partitions)

    return make
