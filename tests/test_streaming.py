"""The stream's tables equal the batch tables over the same files."""

from __future__ import annotations

import pytest

from arledger.operators.cleaning import clean_claims
from arledger.plans import trend
from arledger.sources.snapshots import read_snapshots
from arledger.streaming import refresh

COLUMNS = ["Patient ID", "Claim ID", "Report Worked By", "Claim Amount", "Claim Balance", "Claim Balance Aging"]
HEADER = ",".join(COLUMNS) + "\n"


def put(root, sheet, name, *lines):
    folder = root / sheet
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(HEADER + "".join(line + "\n" for line in lines))


def run(spark, source, store, max_files=1):
    stream = refresh.stream_snapshots(spark, str(source), COLUMNS, max_files=max_files)
    query = refresh.refresh_metrics(stream, str(store), every=None)
    query.awaitTermination()
    return query


def compare(spark, source, store):
    batch = clean_claims(read_snapshots(spark, str(source)), duplicates="keep")
    want = [tuple(r) for r in trend.snapshot_summary(batch).collect()]
    got = refresh.read_summary(spark, str(store)).select(*trend.SUMMARY_COLUMNS)
    assert [tuple(r) for r in got.collect()] == want
    aging = trend.aging_trend(batch)
    stored = refresh.read_aging(spark, str(store)).select(*aging.columns)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, aging.collect()))
    return want


def test_stream_equals_batch(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    put(source, "5%2F4%2F2026", "a.csv", "p1,c1,ann,$100,$40,0 to 30", "p2,c2,,10,0,60 plus")
    put(source, "5%2F4%2F2026", "b.csv", "p1,c1,ann,100,40,0-30", "p3,c3,bob,7,7,")
    put(source, "2026-05-11", "a.csv", "p1,c1,ann,100,20,31-45")
    put(source, "Notes", "a.csv", "p9,c9,ann,1,1,60")
    run(spark, source, store)
    want = compare(spark, source, store)
    # The copy in the second file of the sheet is dropped although it came in a later batch.
    assert [r[3] for r in want] == [3, 1]
    first = refresh.last_refresh(spark, str(store)).first()[0]

    # Restart from the checkpoint: only the new file is taken in, its sheet is recomputed.
    put(source, "2026-05-11", "b.csv", "p2,c2,bob,10,5,60", "p1,c1,ann,100,20,31-45")
    put(source, "2026-05-18", "a.csv", "p1,c1,ann,100,0,46_60")
    run(spark, source, store)
    want = compare(spark, source, store)
    assert [r[3] for r in want] == [3, 2, 1]
    assert refresh.last_refresh(spark, str(store)).first()[0] > first
    names = ["patient_id", "claim_id", "report_worked_by", "claim_amount", "claim_balance", "claim_balance_aging"]
    landed = refresh.read_raw(spark, str(store), names)
    assert landed.count() == 9
    ordered = landed.filter("sheet_name = '2026-05-11'").orderBy("row_pos").select("claim_id")
    assert [r[0] for r in ordered.collect()] == ["c1", "c2", "c1"]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    put(source, "2026-05-04", "a.csv", "p1,c1,ann,100,40,0-30")
    columns = [c for c in refresh.stream_snapshots(spark, str(source), COLUMNS).columns if c not in refresh._TRACE]
    rows = [("2026-05-04", "file:/x/2026-05-04/a.csv", 0, i, "p", f"c{i}", "ann", "9", "5", "60+") for i in range(3)]
    batch = spark.createDataFrame(
        rows, "sheet_name string, uri string, start long, index long, " + ", ".join(f"{c} string" for c in columns)
    )
    for _ in range(2):
        touched = refresh._land_batch(batch, 4, store)
        refresh.refresh_snapshots(spark, store, columns, touched)
    assert refresh.read_raw(spark, store, columns).count() == 3
    assert refresh.read_summary(spark, store).first()["total_claims"] == 3


def test_filter_that_empties_a_sheet(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    put(source, "2026-05-04", "a.csv", "p1,c1,ann,100,40,0-30")
    stream = refresh.stream_snapshots(spark, str(source), COLUMNS)
    query = refresh.refresh_metrics(stream, store, every=None, keep=lambda df: df.filter("claim_balance > 50"))
    query.awaitTermination()
    row = refresh.read_summary(spark, store).first()
    assert (row["total_claims"], row["outstanding_balance"]) == (0, 0.0)


def test_bounds(spark, tmp_path):
    with pytest.raises(ValueError):
        refresh.stream_snapshots(spark, str(tmp_path), COLUMNS, max_files=0)


def test_first_load_in_one_refresh(spark, tmp_path):
    """Several batches of one sheet, landed first and computed once."""
    source, store = tmp_path / "in", tmp_path / "store"
    for i in range(3):
        put(source, "2026-05-04", f"{i}.csv", f"p{i},c{i},ann,10,{i},0-30", "p9,c9,bob,5,5,60 plus")
    stream = refresh.stream_snapshots(spark, str(source), COLUMNS, max_files=1)
    refresh.refresh_metrics(stream, str(store), every=None, land_only=True).awaitTermination()
    names = ["patient_id", "claim_id", "report_worked_by", "claim_amount", "claim_balance", "claim_balance_aging"]
    refresh.refresh_landed(spark, str(store), names)
    assert [r[3] for r in compare(spark, source, store)] == [4]


def test_emptied_sheet_leaves_no_old_aging(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    put(source, "2026-05-04", "a.csv", 'p1,"c ""1""",ann,10,5,0-30')
    run(spark, source, store)
    assert refresh.read_aging(spark, str(store)).count() == 1
    names = ["patient_id", "claim_id", "report_worked_by", "claim_amount", "claim_balance", "claim_balance_aging"]
    refresh.refresh_landed(spark, str(store), names, keep=lambda df: df.filter("claim_balance > 100"))
    assert refresh.read_aging(spark, str(store)).count() == 0
    row = refresh.read_summary(spark, str(store)).first()
    assert row["total_claims"] == 0
    assert refresh.read_raw(spark, str(store), names).first()["claim_id"] == 'c "1"'


def put_text(root, sheet, name, text):
    folder = root / sheet
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_stream_equals_batch_over_three_headers(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    put(source, "2026-05-04", "a.csv", "p1,c1,ann,$100,$40,0 to 30", "p2,c2,,10,0,60 plus")
    put_text(
        source, "2026-05-04", "b.csv",
        "Claim Balance Aging,claim_id,Note,Patient ID,Claim Amount,Claim Balance,Report Worked By\n"
        '0-30,c1,,p1,100,40,ann\n46-60,c3,"two\nlines",p3,9,-0,bob\n',
    )
    run_files(spark, source, store)
    put_text(
        source, "2026-05-11", "c.csv",
        "Patient ID,Claim ID,Report Worked By,Claim Amount,Claim Balance,Claim Balance Aging,Plan\n"
        "p1,c1,ann,100,20,31-45,gold\np1,c1,ann,100,20,31-45,silver\np4,c4\n",
    )
    put(source, "2026-05-04", "d.csv", "p3,c3,bob,9,0,46-60", "p5,c5,ann,1,1,")
    run_files(spark, source, store)
    want = compare(spark, source, store)
    # c1 and c3 come again without a note; c3 with one is another row.
    assert [r[3] for r in want] == [5, 3]
    assert set(refresh.landed_columns(spark, str(store))) >= {"note", "plan", "claim_id"}


def run_files(spark, source, store, **options):
    query = refresh.refresh_files(spark, str(source), str(store), every=None, max_files=1, **options)
    query.awaitTermination()


def test_broken_records_stop_the_stream_or_are_left_out(spark, tmp_path):
    source = tmp_path / "in"
    good = '{"Patient ID": "p1", "Claim ID": "c1", "Report Worked By": "ann", "Claim Balance": 5, "Claim Balance Aging": "60"}\n'
    put_text(source, "2026-05-04", "a.json", good + "{broken\n")
    with pytest.raises(Exception, match="broken records"):
        run_files(spark, source, tmp_path / "one", fmt="json")
    run_files(spark, source, tmp_path / "two", fmt="json", on_error="skip")
    assert refresh.read_summary(spark, str(tmp_path / "two")).first()["total_claims"] == 1


def test_a_merge_reads_only_new_rows(spark, tmp_path, monkeypatch):
    """Ten batches of one sheet: each merge reads its own rows, so the cost is linear."""
    monkeypatch.setattr(refresh, "_FOLD", 3)
    source, store = tmp_path / "in", str(tmp_path / "store")
    read, columns = [], refresh.stream_snapshots(spark, str(source.parent), COLUMNS).columns
    names = [c for c in columns if c not in refresh._TRACE]
    for i in range(10):
        lines = [f"p{i},c{k},ann,10,{i},0-30" for k in range(20)] + ["p0,c0,ann,10,0,0-30"]
        put(source, "2026-05-04", f"{i}.csv", *lines)
        stream = refresh.stream_snapshots(spark, str(source), COLUMNS)
        refresh.refresh_metrics(stream, store, every=None, land_only=True).awaitTermination()
        query = refresh.merge_landed(spark, store)
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert read == [21] * 10
    assert [r[3] for r in compare(spark, source, store)] == [200]
    kinds = spark.read.parquet(f"{store}/cube").groupBy("kind").count().collect()
    assert {r["kind"] for r in kinds} == {"increment", "fold"}
    # Landing a batch again brings no new rows.
    refresh._land_batch(_again(spark, names), 4, store)
    refresh.merge_landed(spark, store, ["2026-05-04"])
    assert refresh.read_summary(spark, store).first()["total_claims"] == 200


def _again(spark, names):
    rows = [("2026-05-04", "file:/x/2026-05-04/a.csv", 0, k, "p4", f"c{k}", "ann", "10", "4", "0-30") for k in range(20)]
    schema = "sheet_name string, uri string, start long, index long, " + ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame(rows, schema)
