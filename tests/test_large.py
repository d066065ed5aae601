"""What keeps shuffles, sorts and repeated work from growing faster than the input."""

from __future__ import annotations

import pytest

from arledger.functions.cells import parse_date
from arledger.sources import profile
from arledger.sources.landing import materialize
from arledger.sources.snapshots import read_snapshots
from arledger.streaming import refresh
from checks import queries
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def write_tables(spark, folder, lines):
    """One order and one customer, and lines as (line number, price)."""
    spark.createDataFrame([(1, "AUTO")], "c_custkey long, c_mktsegment string").write.mode("overwrite").parquet(
        f"{folder}/customer.parquet"
    )
    spark.createDataFrame(
        [(1, 1, "1995-01-02", "O")], "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string"
    ).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        [(1, 10 + n, 5, n, 20.0, price, "1995-03-04", "N", "O") for n, price in lines],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, "
        "l_extendedprice double, l_shipdate string, l_returnflag string, l_linestatus string",
    ).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")


def test_a_board_query_lands_what_is_there_when_it_is_asked(spark, tmp_path):
    query, _ = queries.REGISTRY["board_snapshot_summary"]
    write_tables(spark, tmp_path, [(1, 100.0), (2, 200.0)])
    first = query(spark, str(tmp_path)).collect()
    assert [(r["snapshot_date"], r["total_claims"]) for r in first] == [("2026-05-11", 1), ("2026-05-18", 1)]
    write_tables(spark, tmp_path, [(1, 100.0), (5, 300.0), (2, 200.0)])
    second = query(spark, str(tmp_path)).collect()
    assert [(r["snapshot_date"], r["total_claims"]) for r in second] == [("2026-05-11", 2), ("2026-05-18", 1)]


def test_landing_without_a_shuffle_keeps_all_rows(spark, tmp_path):
    rows = spark.range(100, numPartitions=3).select(
        F.col("id").alias("row_pos"),
        F.when(F.col("id") % 3 == 0, "5/4/2026").when(F.col("id") % 3 == 1, "Notes").otherwise("2026-05-11").alias("sheet_name"),
    )
    kept = materialize(rows, str(tmp_path / "kept"), spread=False)
    spread = materialize(rows, str(tmp_path / "spread"))
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, spread.collect()))
    assert kept.count() == 100


def test_usual_dates(spark):
    texts = ["5/4/2026", "05-04-2026", "13/5/2026", "2/30/2026", "5/4-2026", "12-31-1999", "5/4/26", " 5/4/2026 "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_date(F.col("t")).cast("date").cast("string"))
    assert dict(got.collect()) == {
        "5/4/2026": "2026-05-04", "05-04-2026": "2026-05-04", "13/5/2026": "2026-05-13", "2/30/2026": None,
        "5/4-2026": None, "12-31-1999": "1999-12-31", "5/4/26": "2026-05-04", " 5/4/2026 ": "2026-05-04",
    }


def test_files_are_profiled_and_placed_without_sorting_their_lines(spark, tmp_path):
    for sheet in ("2026-05-04", "5%2F11%2F2026"):
        (tmp_path / sheet).mkdir()
        (tmp_path / sheet / "a.csv").write_text('Claim ID,Note\nc1,"a, b"\nc2\n')
    paths = [str(tmp_path / "2026-05-04" / "a.csv"), str(tmp_path / "5%2F11%2F2026" / "a.csv")]
    measures = profile._line_measures(spark, paths)
    assert "ObjectHashAggregate" in plan_of(measures) and "SortAggregate" not in plan_of(measures)
    assert [(r["first"], r["widest"], r["narrowest"], r["spans"], r["odd"]) for r in measures.collect()] == [
        ("Claim ID,Note", 2, 1, False, False)
    ] * 2
    rows = read_snapshots(spark, str(tmp_path))
    assert "SortMergeJoin" not in plan_of(rows) and "BroadcastHashJoin" in plan_of(rows)
    assert sorted((r["sheet_name"], r["claim_id"]) for r in rows.collect()) == [
        ("2026-05-04", "c1"), ("2026-05-04", "c2"), ("5/11/2026", "c1"), ("5/11/2026", "c2")
    ]


@pytest.mark.parametrize("name", ["2026-05-04", "5%252F4%252F2026", "a+b", "a%2520b"])
def test_sheet_names_of_streamed_files(spark, tmp_path, name):
    from urllib.parse import unquote

    folder = tmp_path / "in" / unquote(name)
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("Claim ID\nc1\n")
    stream = refresh.stream_snapshots(spark, str(tmp_path / "in"), ["Claim ID"])
    seen = []
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: seen.extend(r["sheet_name"] for r in batch.collect()))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert seen == [unquote(unquote(name))]


def test_a_file_with_rows_of_two_sheets_is_landed_once(spark, tmp_path):
    rows = [(sheet, "file:/x/a/a.csv", 0, i, f"c{i}") for i, sheet in enumerate(["2026-05-04", "2026-05-11", "2026-05-04"])]
    batch = spark.createDataFrame(rows, "sheet_name string, uri string, start long, index long, claim_id string")
    assert refresh._land_batch(batch, 0, str(tmp_path)) == ["2026-05-04", "2026-05-11"]
    landed = refresh.read_raw(spark, str(tmp_path), ["claim_id"]).collect()
    assert sorted((r["sheet_name"], r["claim_id"], r["snapshot_date"].day) for r in landed) == [
        ("2026-05-04", "c0", 4), ("2026-05-04", "c2", 4), ("2026-05-11", "c1", 11)
    ]


def test_files_of_a_sheet_read_that_sheet_alone(spark, tmp_path):
    raw = spark.createDataFrame([("5/4/2026", 1), ("2026-05-11", 2)], "sheet_name string, row_pos long")
    rows = queries._by_sheet(spark, raw, str(tmp_path / "rows"))
    one = rows.where(F.col("sheet") == "5-4-2026")
    assert [(r["sheet_name"], r["row_pos"]) for r in one.collect()] == [("5/4/2026", 1)]
    assert len(one.inputFiles()) == 2 and "PartitionFilters: [isnotnull(sheet" in plan_of(one)
    assert [r["sheet"] for r in rows.select("sheet").distinct().orderBy("sheet").collect()] == ["2026-05-11", "5-4-2026"]
