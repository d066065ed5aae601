"""Reading snapshot folders and grids, listing, export, landing."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from arledger.operators import metrics, snapshots
from arledger.operators.cleaning import clean_claims
from arledger.sources import files, grid, landing, reports
from arledger.sources import snapshots as sheets


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return path


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "5%2F4%2F2026.csv", "Claim ID,Claim Balance\nc1,$5\nc2,\n,\n")
    put(tmp_path, "2026-05-11/part-1.csv", "Claim ID,Claim Balance,% Paid\nc3,1,x\n")
    put(tmp_path, "2026-05-11/part-0.csv", "Claim ID,Claim Balance,% Paid\nc4,2,y\nc5,3,\n")
    put(tmp_path, "My Notes+1.csv", "Claim ID,Claim Balance\n")
    return tmp_path


def test_read_csv_sheets(spark, folder):
    df = sheets.read_snapshots(spark, str(folder))
    assert set(df.columns) == {
        "sheet_name", "sheet_pos", "snapshot_date", "row_pos", "claim_id", "claim_balance", "paid",
    }
    got = df.orderBy("sheet_pos", "row_pos").select("sheet_name", "claim_id", "claim_balance", "paid")
    assert [tuple(r) for r in got.collect()] == [
        ("5/4/2026", "c1", "$5", None), ("5/4/2026", "c2", None, None), ("5/4/2026", None, None, None),
        ("2026-05-11", "c4", "2", "y"), ("2026-05-11", "c5", "3", None), ("2026-05-11", "c3", "1", "x"),
    ]
    counts = sheets.snapshot_row_counts(df, sheets.list_sheets(spark, str(folder)))
    assert {tuple(r) for r in counts.collect()} == {("5/4/2026", 2), ("2026-05-11", 3), ("My Notes+1", 0)}
    only = sheets.read_snapshots(spark, str(folder), sheets=["5/4/2026"])
    assert only.count() == 3
    claims = clean_claims(df)
    assert metrics.topline(snapshots.current_snapshot(claims)).first()["value"] == 3


def test_sheet_order(spark, folder):
    order = ["2026-05-11", "5/4/2026"]
    listed = sheets.list_sheets(spark, str(folder), order=order).select("sheet_name", "sheet_pos").distinct()
    assert {tuple(r) for r in listed.collect()} == {("2026-05-11", 0), ("5/4/2026", 1), ("My Notes+1", 2)}


def test_row_order_over_many_splits(spark, tmp_path):
    lines = "".join(f"{i}\n" for i in range(20000))
    put(tmp_path, "2026-05-04.csv", "n\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = sheets.read_snapshots(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        got = [int(r["n"]) for r in df.orderBy("row_pos").select("n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == list(range(20000))


def test_parquet_and_json_sheets(spark, tmp_path):
    data = spark.createDataFrame([(1, "x"), (2, None)], "`Claim Id` int, status string")
    data.write.parquet(str(tmp_path / "pq" / "2026-05-04"))
    data.toDF("claim_id", "status").write.json(str(tmp_path / "js" / "2026-05-04"))
    for fmt, name in (("parquet", "pq"), ("json", "js")):
        df = sheets.read_snapshots(spark, str(tmp_path / name), fmt, glob="part-*")
        got = sorted((r["claim_id"], r["status"]) for r in df.collect())
        assert got == [("1", "x"), ("2", None)]


def test_missing_and_unreadable(spark, tmp_path, caplog):
    with pytest.raises(FileNotFoundError):
        sheets.read_snapshots(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no readable sheets"):
        sheets.read_snapshots(spark, str(tmp_path))
    put(tmp_path, "2026-05-04.parquet", "this is no parquet file")
    spark.range(2).write.parquet(str(tmp_path / "2026-05-11"))
    df = sheets.read_snapshots(spark, str(tmp_path), "parquet", glob="*.parquet", on_error="skip")
    assert {r["sheet_name"] for r in df.select("sheet_name").distinct().collect()} == {"2026-05-11"}


def test_standardize_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF(" Claim ID", "claim id", "#", "% Paid")
    assert sheets.standardize_columns(df).columns == ["claim_id", "claim_id_2", "column_2", "paid"]


def test_row_counts(spark):
    df = spark.createDataFrame(
        [("s", "", ""), ("s", "", None), ("s", "a", ""), ("t", None, "")], "sheet_name string, x string, y string"
    )
    assert {tuple(r) for r in sheets.snapshot_row_counts(df).collect()} == {("s", 1), ("t", 0)}


def test_grid(spark, tmp_path):
    put(tmp_path, "5%2F4%2F2026.json", json.dumps({"values": [["Claim ID", ""], ["1"], ["2", "x", "y"]]}))
    put(tmp_path, "2026-05-11.json", json.dumps({"range": "A1", "values": [["Paid", "Claim ID"], ["p", "3"]]}, indent=1))
    put(tmp_path, "empty.json", json.dumps({"range": "A1"}))
    table = grid.grid_to_table(grid.read_grids(spark, str(tmp_path)))
    got = table.select("sheet_name", "claim_id", "column_1", "column_2", "paid")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(
        [("5/4/2026", "1", None, None, None), ("5/4/2026", "2", "x", "y", None), ("2026-05-11", "3", None, None, "p")],
        key=repr,
    )


def test_latest_file(spark, tmp_path):
    old, new = put(tmp_path, "b.csv", "x\n"), put(tmp_path, "a.csv", "x\n")
    put(tmp_path, "c.txt", "x\n")
    os.utime(old, (1_000, 1_000))
    os.utime(new, (2_000, 2_000))
    assert files.latest_source_file(spark, str(tmp_path), "*.csv").endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        files.latest_source_file(spark, str(tmp_path), "*.xml")


def test_report(spark, tmp_path):
    table = spark.createDataFrame([("a,b", 1.5), ('say "x"', None), ("é", 2.0)], "name string, value double")
    reports.write_report(table, str(tmp_path / "csv"))
    back = spark.read.options(header="true", escape='"').schema(table.schema).csv(str(tmp_path / "csv"))
    assert set(back.collect()) == set(table.collect())
    reports.write_report(table, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3
    with pytest.raises(ValueError):
        reports.write_report(table, str(tmp_path / "x"), "xlsx")


def test_landed_snapshots_prune(spark, tmp_path, make_claims):
    raw = make_claims(
        {"sheet_name": "2026", "claim_id": "a", "claim_balance": "1"},
        {"sheet_name": "5/11/2026", "sheet_pos": 1, "claim_id": "b", "claim_balance": "2"},
        {"sheet_name": "Notes", "sheet_pos": 2, "claim_id": "c", "claim_balance": "3"},
    )
    landed = landing.materialize(clean_claims(raw), str(tmp_path / "landed"))
    assert {r["sheet_name"] for r in landed.collect()} == {"2026", "5/11/2026", "Notes"}
    current = snapshots.current_snapshot(landed).select("claim_id", F.col("claim_balance"))
    assert [tuple(r) for r in current.collect()] == [("b", 2.0)]
    plan = current._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "claim_balance" in line and "FileScan" in line)
    assert "PartitionFilters: [isnotnull(sheet_name" in scan
    assert "patient_id" not in scan


def test_files_of_one_sheet_by_their_own_headers(spark, tmp_path):
    put(tmp_path, "2026-05-04/a.csv", "Claim ID,Balance\nc1,1\n")
    put(tmp_path, "2026-05-04/b.csv", "Balance,Claim ID,Status\n2,c2,open\n")
    got = sheets.read_snapshots(spark, str(tmp_path)).select("claim_id", "balance", "status")
    assert {tuple(r) for r in got.collect()} == {("c1", "1", None), ("c2", "2", "open")}


def test_cells_beyond_the_header_and_quotes(spark, tmp_path):
    put(tmp_path, "2026-05-04.csv", 'Plan,Balance\n"say ""x"", ok",1\nshort\nlong,2,3,"4, four"\n')
    df = sheets.read_snapshots(spark, str(tmp_path))
    got = {tuple(r) for r in df.select("plan", "balance", "column_2", "column_3").collect()}
    assert got == {('say "x", ok', "1", None, None), ("short", None, None, None), ("long", "2", "3", "4, four")}
    narrow = sheets.read_snapshots(spark, str(tmp_path), widen=False)
    assert "column_2" not in narrow.columns and narrow.count() == 3


def test_parquet_files_of_differing_types_and_columns(spark, tmp_path):
    spark.createDataFrame([("c1", 1)], "claim_id string, balance int").write.parquet(str(tmp_path / "2026-05-04" / "a"))
    more = spark.createDataFrame([("c2", "2", "open")], "claim_id string, balance string, status string")
    more.write.parquet(str(tmp_path / "2026-05-04" / "b"))
    got = sheets.read_snapshots(spark, str(tmp_path), "parquet", glob="part-*")
    rows = {tuple(r) for r in got.select("claim_id", "balance", "status").collect()}
    assert rows == {("c1", "1", None), ("c2", "2", "open")}


def test_damaged_files_are_errors(spark, tmp_path):
    import gzip

    data = gzip.compress(("n,m\n" + "".join(f"{i},{i * 7919 % 10007}\n" for i in range(200_000))).encode())
    (tmp_path / "2026-05-04.csv.gz").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception):  # noqa: B017 - the engine's own error
        sheets.read_snapshots(spark, str(tmp_path)).count()
    other = tmp_path / "pq"
    put(other, "2026-05-11.parquet", "no parquet at all")
    spark.range(3).write.parquet(str(other / "2026-05-04"))
    with pytest.raises(ValueError, match="cannot be read"):
        sheets.read_snapshots(spark, str(other), "parquet", glob="*.parquet")
    kept = sheets.read_snapshots(spark, str(other), "parquet", glob="*.parquet", on_error="skip")
    assert kept.count() == 3
    bad = sheets.rejected_files(spark, str(other), "parquet", glob="*.parquet").collect()
    assert [r["sheet_name"] for r in bad] == ["2026-05-11"]


def test_report_reads_back(spark, tmp_path):
    rows = spark.createDataFrame([('say "x", ok', 1), ("a\\b", 2)], "plan string, n long")
    reports.write_report(rows, str(tmp_path / "2026-05-04"))
    got = sheets.read_snapshots(spark, str(tmp_path), glob="part-*").select("plan", "n")
    assert {tuple(r) for r in got.collect()} == {('say "x", ok', "1"), ("a\\b", "2")}


CELLS = ["plain", "line one\nline two", 'say "x",\r\nok', "lone\rreturn", " blanks ", '"', "\n", ",", 'a "b', "end\n"]


def test_report_with_line_breaks_reads_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, cell, i * 9) for i, cell in enumerate(CELLS)], "`Claim ID` int, note string, n int")
    reports.write_report(rows.repartition(3), str(tmp_path / "2026-05-04"))
    got = sheets.read_snapshots(spark, str(tmp_path), glob="part-*").select("claim_id", "note", "n")
    assert {tuple(r) for r in got.collect()} == {(str(i), cell, str(i * 9)) for i, cell in enumerate(CELLS)}


def test_only_files_with_spanning_records_are_read_whole(spark, tmp_path):
    put(tmp_path, "2026-05-04/a.csv", 'Claim ID,Note\n1,"two\nlines"\n2,"x, y",beyond\n')
    put(tmp_path, "2026-05-04/b.csv", 'Claim ID,Note\n3,5" pipe\n\n4,"say ""hi"""\n')
    put(tmp_path, "2026-05-11.csv", '"Claim\nID","No, te"\n5,z\n')
    profile = sheets._profiled(spark, "csv", sheets.list_sheets(spark, str(tmp_path)).collect())
    spans = {f.path.rsplit("/", 1)[1]: f.spans_lines for f in profile.files}
    assert spans == {"a.csv": True, "b.csv": False, "2026-05-11.csv": True}
    df = sheets.read_snapshots(spark, str(tmp_path))
    got = {tuple(r) for r in df.select("claim_id", "note", "column_2", "no_te").collect()}
    assert got == {
        ("1", "two\nlines", None, None), ("2", "x, y", "beyond", None), ("3", '5" pipe', None, None),
        ("4", 'say "hi"', None, None), ("5", None, None, "z"),
    }
    order = [r["claim_id"] for r in df.orderBy("sheet_pos", "row_pos").select("claim_id").collect()]
    assert order == ["1", "2", "3", "4", "5"]


def test_a_quote_that_is_never_closed_is_refused(spark, tmp_path):
    put(tmp_path, "2026-05-04.csv", 'n,m\n1,"open\n2,x\n')
    put(tmp_path, "2026-05-11.csv", "n,m\n3,y\n")
    with pytest.raises(ValueError, match="not closed"):
        sheets.read_snapshots(spark, str(tmp_path))
    assert [r["n"] for r in sheets.read_snapshots(spark, str(tmp_path), on_error="skip").collect()] == ["3"]
    assert [tuple(r)[1:] for r in sheets.rejected_files(spark, str(tmp_path)).collect()] == [("2026-05-04", "a quoted cell is not closed")]


def test_broken_json_records(spark, tmp_path):
    put(tmp_path, "2026-05-04.json", '{"Claim ID": "1", "b": {"c": [1, 2]}}\n{"Claim ID": "2", "b"\n\n7\n[{"Claim ID": 3}, {"d": "x"}, 4]\n')
    put(tmp_path, "2026-05-11.json", "broken\n")
    with pytest.raises(ValueError, match="4 broken records in 2 files"):
        sheets.read_snapshots(spark, str(tmp_path), "json")
    df = sheets.read_snapshots(spark, str(tmp_path), "json", on_error="skip")
    assert set(df.columns) - {"sheet_name", "sheet_pos", "snapshot_date", "row_pos"} == {"claim_id", "b", "d"}
    got = [tuple(r) for r in df.orderBy("row_pos").select("claim_id", "b", "d").collect()]
    assert got == [("1", '{"c":[1,2]}', None), ("3", None, None), (None, None, "x")]
    bad = sheets.rejected_rows(spark, str(tmp_path), "json").orderBy("sheet_name", "row_pos").collect()
    assert [(r["sheet_name"], r["text"]) for r in bad] == [
        ("2026-05-04", '{"Claim ID": "2", "b"'), ("2026-05-04", "7"), ("2026-05-04", "4"), ("2026-05-11", "broken"),
    ]
    assert {r["reason"] for r in bad} == {"no JSON object"}


def test_short_rows(spark, tmp_path):
    put(tmp_path, "2026-05-04.csv", 'a,b,c\n1,"x, y",3\n2\n3,"p, q"\n4,5,6,7\n')
    put(tmp_path, "2026-05-11.csv", 'a,b,c\n5,"two\nlines"\n6,7,8\n')
    assert sheets.read_snapshots(spark, str(tmp_path)).count() == 6  # filled with nulls
    with pytest.raises(ValueError, match="fewer cells"):
        sheets.read_snapshots(spark, str(tmp_path), short_rows="reject")
    kept = sheets.read_snapshots(spark, str(tmp_path), short_rows="reject", on_error="skip")
    assert sorted(r["a"] for r in kept.collect()) == ["1", "4", "6"]
    bad = sheets.rejected_rows(spark, str(tmp_path)).orderBy("sheet_name", "row_pos")
    assert [(r["text"], r["reason"]) for r in bad.collect()] == [
        ("2", "1 of 3 cells"), ('3,"p, q"', "2 of 3 cells"), ('5,"two\nlines"', "2 of 3 cells"),
    ]


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_jobs_do_not_grow_with_files(spark, tmp_path, fmt):
    few, many = tmp_path / "few", tmp_path / "many"
    if fmt == "parquet":
        for root, n in ((few, 2), (many, 24)):
            spark.range(96).selectExpr("id AS n", "'x' AS m").repartition(n).write.parquet(str(root / "2026-05-04"))
    else:
        for root, n in ((few, 2), (many, 24)):
            for i in range(n):
                text = f"n,m\n{i},x\n" if fmt == "csv" else json.dumps({"n": str(i), "m": "x"}) + "\n"
                put(root, f"2026-05-04/part-{i}.{fmt}", text)
    made = [
        _jobs(spark, f"{fmt}-{root.name}", lambda root=root: sheets.read_snapshots(spark, str(root), fmt, glob="part-*"))
        for root in (few, many)
    ]
    assert made[0] == made[1] > 0
