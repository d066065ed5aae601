"""A store that follows a folder whose files change in place."""

from __future__ import annotations

import os

import pytest

from arledger.operators.cleaning import clean_claims
from arledger.plans import trend
from arledger.plans.dashboard import dashboard
from arledger.sources.snapshots import read_snapshots
from arledger.streaming import sync

FULL = (
    "Patient ID,Claim ID,Report Worked By,Report Worked Date,Claim Amount,Claim Balance,Claim Balance Aging,"
    "Plan Name,Claim Status\n"
)
HEADER = "Patient ID,Claim ID,Report Worked By,Claim Amount,Claim Balance,Claim Balance Aging\n"


def put(root, sheet, name, *lines, header=HEADER):
    folder = root / sheet
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(header + "".join(line + "\n" for line in lines))


def same_as_batch(spark, source, store):
    raw = read_snapshots(spark, str(source))
    batch = clean_claims(raw, duplicates="keep")
    want = [tuple(r) for r in trend.snapshot_summary(batch).collect()]
    assert [tuple(r) for r in sync.synced_summary(spark, str(store)).collect()] == want
    aging = trend.aging_trend(batch)
    got = sync.synced_aging(spark, str(store)).select(*aging.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, aging.collect()))
    rows = sync.read_synced(spark, str(store))
    columns = ["sheet_name", *(c for c in raw.columns if c not in ("row_pos", "sheet_pos", "sheet_name", "snapshot_date"))]
    assert sorted(map(repr, rows.select(columns).collect())) == sorted(map(repr, raw.select(columns).collect()))
    return want


def versions(spark, store):
    return {r["sheet_name"]: r["version"] for r in sync.synced_sheets(spark, str(store)).collect()}


def test_only_changed_sheets_are_landed_again(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    put(source, "5%2F4%2F2026", "a.csv", "p1,c1,ann,$100,$40,0 to 30", "p2,c2,,10,0,60 plus", "p2,c2,,10,0,60 plus")
    put(source, "2026-05-11", "a.csv", "p1,c1,ann,100,20,31-45")
    put(source, "2026-05-11", "b.csv", "p2,c2,bob,10,5,60")
    put(source, "Notes", "a.csv", "p9,c9,ann,1,1,60")
    names = ["2026-05-11", "5/4/2026", "Notes"]
    assert sync.sync_files(spark, str(source), str(store)) == names
    assert [r[3] for r in same_as_batch(spark, source, store)] == [2, 2]
    first = versions(spark, store)
    assert sync.sync_files(spark, str(source), str(store)) == []

    # One file replaced, with fewer rows and another header: its whole sheet is read again.
    put(source, "2026-05-11", "a.csv", "70,p1,c1,new", header="Claim Balance,Patient ID,Claim ID,Note\n")
    assert sync.sync_files(spark, str(source), str(store)) == ["2026-05-11"]
    second = versions(spark, store)
    assert {n for n in names if first[n] != second[n]} == {"2026-05-11"}
    assert same_as_batch(spark, source, store)[1][5] == 75.0

    # A file goes, a sheet goes, a sheet comes.
    os.remove(source / "2026-05-11" / "b.csv")
    os.remove(source / "Notes" / "a.csv")
    put(source, "2026-05-18", "a.csv", "p1,c1,ann,100,0,46_60")
    assert sync.sync_files(spark, str(source), str(store)) == ["2026-05-11", "2026-05-18", "Notes"]
    assert [r[3] for r in same_as_batch(spark, source, store)] == [2, 1, 1]
    assert set(versions(spark, store)) == {"5/4/2026", "2026-05-11", "2026-05-18"}


def test_a_failed_call_changes_nothing(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    put(source, "2026-05-11", "a.csv", "p1,c1,ann,100,20,31-45")
    sync.sync_files(spark, str(source), str(store))
    before = [tuple(r) for r in sync.synced_summary(spark, str(store)).collect()]
    put(source, "2026-05-18", "a.csv", 'p1,c1,"never closed,100,20,31-45')
    put(source, "2026-05-11", "a.csv", "p1,c1,ann,100,10,31-45", "p2,c2,ann,1,1,60")
    with pytest.raises(ValueError):
        sync.sync_files(spark, str(source), str(store))
    assert [tuple(r) for r in sync.synced_summary(spark, str(store)).collect()] == before
    # Left out on demand, the sheet shows with zeros, and the other one is current.
    assert sync.sync_files(spark, str(source), str(store), on_error="skip") == ["2026-05-11", "2026-05-18"]
    assert [(r["sheet_name"], r["total_claims"]) for r in sync.synced_summary(spark, str(store)).collect()] == [
        ("2026-05-11", 2), ("2026-05-18", 0)
    ]


def test_empty_folder_and_store(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    assert sync.sync_files(spark, str(source), str(store)) == []
    assert sync.synced_summary(spark, str(store)).count() == 0
    assert sync.synced_aging(spark, str(store)).count() == 0
    assert sync.read_synced(spark, str(store)).count() == 0
    put(source, "2026-05-11", "a.csv", "p1,c1,ann,100,20,31-45")
    sync.sync_files(spark, str(source), str(store))
    os.remove(source / "2026-05-11" / "a.csv")
    assert sync.sync_files(spark, str(source), str(store)) == ["2026-05-11"]
    assert sync.synced_summary(spark, str(store)).count() == 0
    assert sync.read_synced(spark, str(store)).count() == 0


def test_board_of_sums_equals_the_dashboard(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"

    def check():
        sync.sync_files(spark, str(source), str(store))
        want = dashboard(read_snapshots(spark, str(source)))
        got = sync.synced_board(spark, str(store))
        for name in got._fields:
            a, b = getattr(got, name), getattr(want, name)
            assert sorted(a.columns) == sorted(b.columns), name
            columns = sorted(a.columns)
            assert rounded(a.select(columns)) == rounded(b.select(columns)), name
        return got

    def rounded(frame):
        return sorted(
            repr([round(v, 6) if isinstance(v, float) else v for v in row]) for row in frame.collect()
        )

    put(
        source, "5%2F4%2F2026", "a.csv",
        "p1,c1,ann,2026-05-01,$100,$40,0 to 30", "p1,c1,ann,2026-05-01,$100,$40,0 to 30",
        "p1,c1,ann,2026-05-01,100,40,0 to 30", "p2,c2,,2026-05-02,10,0,60 plus", "p3,,ann,,10,4,60 plus",
        header=FULL,
    )
    put(source, "2026-05-11", "a.csv", "p1,c1,ann,2026-05-01,100,20,31-45", "p4,c4,bob,2026-05-03,5,9,", header=FULL)
    put(source, "2026-05-11", "b.csv", "p1,c1,bob,2026-05-03,100,-3,31-45", "p1,,bob,2026-05-04,1,1,odd", header=FULL)
    put(source, "Notes", "a.csv", "p9,c9,ann,2026-05-01,1,1,60", header=FULL)
    assert [r["total_claims"] for r in check().cards.collect()] == [3]
    # The newest sheet is replaced by one without workers or buckets.
    put(source, "2026-05-18", "a.csv", "2026-05-09,7,p1,c1", header="Report Worked Date,Claim Balance,Patient ID,Claim ID\n")
    check()
    # A sheet without dates leaves "everything ticked" as it is.
    put(source, "2026-05-18", "a.csv", "p1,c1,eve,,100,20,31-45", "p1,c1,eve,2026-05-12,100,20,31-45", header=FULL)
    assert [r["worked_by"] for r in check().current_productivity.collect()] == ["eve"]


def test_board_of_an_empty_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sync.sync_files(spark, str(tmp_path / "in"), str(tmp_path / "store"))
    board = sync.synced_board(spark, str(tmp_path / "store"))
    assert [tuple(r) for r in board.cards.collect()] == [(0, 0, 0, 0.0, 0.0, 0)]
    assert board.productivity.count() == board.topline.count() == board.worked_vs_recovered.count() == 0
