"""What keeps the files of a query, landed ones and those of shuffles, few."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from test_large import plan_of, write_tables

from arledger.operators.cleaning import clean_claims
from arledger.operators.followup import follow_up_stats
from arledger.operators.measures import MEASURES
from arledger.session import lean_writes
from arledger.sources import files, reports
from arledger.sources.landing import materialize
from arledger.sources.snapshots import read_snapshots
from arledger.streaming import refresh
from checks import queries
from checks.claims_raw import claims_raw


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {
        name for folder in folders for _, _, names in os.walk(folder.getPath()) for name in names
        if name.startswith("shuffle_")
    }


def eventually(check):
    """Removal is asked for when a query ends and done soon after."""
    import time

    until = time.time() + 20
    while not check() and time.time() < until:
        time.sleep(0.1)
    return check()


def test_landing_leaves_no_shuffle_files(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("row_pos"), F.lit("2026-05-04").alias("sheet_name"))
    before = shuffle_files(spark)
    kept = materialize(rows.groupBy("sheet_name", "row_pos").count(), str(tmp_path / "landed"))
    assert eventually(lambda: shuffle_files(spark) <= before)
    assert kept.count() == 1000
    before = shuffle_files(spark)  # counting has left some
    refresh._replace_partitions(rows.dropDuplicates(), str(tmp_path / "replaced"), ["sheet_name"])
    assert eventually(lambda: shuffle_files(spark) <= before)
    names = [n for _, _, files in os.walk(tmp_path) for n in files if n.startswith("part-")]
    assert names and all(".zstd." in n for n in names)


def test_the_session_keeps_its_own_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with lean_writes(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


def test_lines_are_shuffled_once(spark, tmp_path):
    write_tables(spark, tmp_path, [(1, 100.0), (2, 200.0)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cleaned = clean_claims(claims_raw(spark, str(tmp_path)))
        # Orders and customers by customer; lines and orders by order; no fourth or fifth one of lines.
        assert plan_of(cleaned).count("Exchange hashpartitioning") == 4
        both = claims_raw(spark, str(tmp_path))
        twice = clean_claims(both.unionByName(both).unionByName(both.withColumn("sheet_name", F.lit("2026-01-01"))))
        assert sorted(r["sheet_name"] for r in twice.collect()) == ["2026-01-01"] * 2 + ["2026-05-11", "5/18/2026"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert cleaned.count() == 2


def test_the_state_gets_measures_only(spark, make_claims):
    rows = make_claims({"sheet_name": "2026-05-04", "claim_balance": "5", "claim_status": "F", "report_worked_by": "ann"})
    keyed = refresh._keyed_measures(clean_claims(rows, duplicates="keep"))
    assert set(keyed.columns) - {"sheet_pos"} == {"sheet_name", "_key", "aging_bucket", "worked_by", *MEASURES}


def test_streamed_rows_are_dealt_out_to_the_state_alone(spark, tmp_path):
    """Neither the files that the stream reads nor the rows it lands are shuffled for their writing."""
    write_tables(spark, tmp_path, [(n, 100.0 + n) for n in range(1, 9)])
    made = []
    shuffled = type(spark.range(0)).hint

    def hint(self, name, *parameters):
        made.append(name)
        return shuffled(self, name, *parameters)

    try:
        type(spark.range(0)).hint = hint
        rows = queries.REGISTRY["stream_snapshot_summary"][0](spark, str(tmp_path)).collect()
    finally:
        type(spark.range(0)).hint = shuffled
    assert sum(r["total_claims"] for r in rows) == 8 and "rebalance" not in made


def test_follow_up_ids_are_read_from_the_key(spark, make_claims):
    """Ids with underscores, empty ones, missing ones and the mark of a missing one, in every pairing."""
    ids = ["p", "p_q", "q", "", "_", "<NA>", None]
    rows = [
        {"sheet_name": "2026-05-04", "patient_id": p, "claim_id": c, "report_worked_by": "ann", "claim_balance": "5"}
        for p in ids for c in ids for _ in range(2)
    ]
    claims = make_claims(*rows, partitions=3).withColumn("claim_balance", F.col("claim_balance").cast("double"))
    stats = follow_up_stats(claims)
    assert "named_struct(at" not in plan_of(stats)
    got = {r["composite_key"]: (r["touch_count"], r["patient_id"], r["claim_id"]) for r in stats.collect()}
    want = {}
    for row in rows:
        p, c = row["patient_id"], row["claim_id"]
        key = f"{'<NA>' if p is None else p}_{'<NA>' if c is None else c}"
        n, first_p, first_c = want.get(key, (0, None, None))
        want[key] = (n + 1, p if first_p is None else first_p, c if first_c is None else first_c)
    assert got == want
    # A key that was given may hold anything.
    given = follow_up_stats(claims.withColumn("composite_key", F.lit("x_y"))).collect()
    assert [(r["touch_count"], r["patient_id"], r["claim_id"]) for r in given] == [(98, "p", "p")]


def test_compressed_files_are_read_in_splits(spark, tmp_path):
    """Rows of a bzip2 file read by many tasks keep their order and are all there."""
    rows = spark.range(60_000).select(F.col("id").alias("Claim ID"), F.md5(F.col("id").cast("string")).alias("Note"))
    reports.write_report(rows.coalesce(1), str(tmp_path / "2026-05-04"), compression="bzip2")
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for name in before:
        spark.conf.set(name, "300k")
    try:
        read = read_snapshots(spark, str(tmp_path), glob="part-*")
        assert read.rdd.getNumPartitions() > 2
        got = [(int(r["claim_id"]), r["note"]) for r in read.orderBy("row_pos").collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == [(r[0], r[1]) for r in rows.orderBy("Claim ID").collect()]


def test_files_of_headers_are_compressed_and_their_rows_go(spark, tmp_path):
    write_tables(spark, tmp_path, [(n, 100.0 + n) for n in range(1, 9)])
    shared = files.shared_folder(spark)
    before = set(os.listdir(f"{shared}/arledger")) if os.path.isdir(f"{shared}/arledger") else set()
    rows = queries.REGISTRY["stream_differing_headers"][0](spark, str(tmp_path)).collect()
    assert sum(r["total_claims"] for r in rows) == 8
    (store,) = (n for n in set(os.listdir(f"{shared}/arledger")) - before if n.startswith("headers-"))
    assert sorted(os.listdir(f"{shared}/arledger/{store}")) == ["in", "out"]
    names = [n for _, _, found in os.walk(f"{shared}/arledger/{store}/in") for n in found if n.startswith("part-")]
    assert names and all(n.endswith(".csv.bz2") for n in names)
    with pytest.raises(ValueError):
        files.discard(spark, str(tmp_path))
