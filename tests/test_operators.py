"""Edge cases of cleaning, filters, metrics, portfolio and follow-up."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from arledger.fixed_values import TREND_DATES
from arledger.operators import filters, followup, metrics, portfolio, snapshots
from arledger.operators.cleaning import clean_claims, drop_exact_duplicates
from arledger.operators.columns import resolve
from arledger.operators.measures import condense
from arledger.plans import dashboard, trend


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


S1 = {"sheet_name": "5/4/2026", "sheet_pos": 0}
S2 = {"sheet_name": "2026-05-11", "sheet_pos": 1}


@pytest.fixture(scope="module")
def sample(make_claims):
    a = {"patient_id": "p1", "claim_id": "c1", "plan_name": "gold", "report_worked_by": "ann"}
    b = {"patient_id": "p2", "claim_id": "c2", "report_worked_by": "bob"}
    return make_claims(
        {**S1, **a, "claim_amount": "$100", "claim_balance": "$100", "claim_balance_aging": "0 to 30",
         "report_worked_date": "2026-05-01", "submission_date": "2026-04-01", "claim_status": "A"},
        {**S1, **b, "claim_amount": "50", "claim_balance": "0", "claim_balance_aging": "90-120",
         "report_worked_date": "2026-05-02", "submission_date": "2026-04-02"},
        {**S1, "claim_amount": "7", "claim_balance": "9", "submission_date": "bad"},
        {**S2, **a, "claim_amount": "100", "claim_balance": "80", "claim_balance_aging": "31-45",
         "report_worked_date": "2026-05-01", "submission_date": "2026-04-01", "claim_status": "None"},
        {**S2, **b, "report_worked_by": "ann", "claim_amount": "50", "claim_balance": "120",
         "claim_balance_aging": "60", "report_worked_date": "5/6/2026", "submission_date": "4/2/2026"},
        {"sheet_name": "Notes", "sheet_pos": 2, **a, "claim_balance": "1"},
    )


@pytest.fixture(scope="module")
def claims(sample):
    return clean_claims(snapshots.dated(sample))


def test_duplicates_are_raw_and_keep_first(make_claims):
    raw = make_claims(
        {**S1, "row_pos": 5, "claim_balance": "100"},
        {**S1, "row_pos": 2, "claim_balance": "100"},
        {**S1, "row_pos": 9, "claim_balance": "$100"},
        {**S2, "row_pos": 1, "claim_balance": "100"},
    )
    kept = drop_exact_duplicates(raw).select("sheet_name", "row_pos")
    assert rows(kept) == sorted([("5/4/2026", 2), ("5/4/2026", 9), ("2026-05-11", 1)], key=repr)
    assert trend.snapshot_summary(clean_claims(raw)).first()["total_claims"] == 1


def test_trend_is_the_same_with_raw_duplicates_kept(sample):
    once = trend.snapshot_summary(clean_claims(sample))
    twice = trend.snapshot_summary(clean_claims(sample, duplicates="keep"))
    assert rows(once) == rows(twice)


def test_columns_get_types_by_name(spark):
    raw = spark.createDataFrame(
        [("2026-05-01", "2026-05-01", "2026-05-01", "0 to 30", "0 to 30", "$5")],
        "paid_date string, submission_date string, date_of_service string, "
        "imaging_type string, pm_chasing string, charges string",
    )
    clean = clean_claims(raw).first()
    assert clean["paid_date"] == 0.0  # "paid" makes it money
    assert str(clean["submission_date"])[:10] == "2026-05-01"
    assert clean["date_of_service"] == "2026-05-01"
    assert clean["imaging_type"] == "0-30"  # "aging" inside
    assert clean["pm_chasing"] == "0 to 30"
    assert clean["charges"] == 5.0
    named = clean_claims(raw, money=["charges"], buckets=["pm_chasing"]).first()
    assert (named["paid_date"], named["imaging_type"], named["pm_chasing"]) == ("2026-05-01", "0 to 30", "0-30")


def test_resolve(spark, claims):
    assert resolve(claims, "balance") == "claim_balance"
    assert resolve(claims, "recovered") is None
    with pytest.raises(KeyError, match="dollars_recovered"):
        resolve(claims, "recovered", required=True)
    odd = spark.createDataFrame([(1, 2)], "owner int, employee int")
    assert resolve(odd, "worked_by") == "employee"
    with pytest.raises(KeyError, match="claim_balance"):
        metrics.topline(odd)


def test_latest_sheet_ties_and_undated(make_claims):
    raw = make_claims(
        {"sheet_name": "2026-05-11", "sheet_pos": 3}, {"sheet_name": "5/11/2026", "sheet_pos": 1},
        {"sheet_name": "2026", "sheet_pos": 0}, {"sheet_name": "Sheet1", "sheet_pos": 2},
    )
    sheets = snapshots.sheet_list(raw)
    assert [r["sheet_name"] for r in snapshots.ordered_sheets(sheets).collect()] == ["5/11/2026", "2026-05-11", "2026"]
    assert snapshots.current_snapshot(raw).first()["sheet_name"] == "5/11/2026"
    assert rows(snapshots.dated(raw).select("sheet_name")) == [("2026",), ("2026-05-11",), ("5/11/2026",)]


def test_topline(claims):
    got = {r["metric"]: r["value"] for r in metrics.topline(claims).collect()}
    assert got == {
        "Total Claims": 5, "Open Claims": 4, "Closed Claims": 1,
        "Total Outstanding Balance": 309, "Total Balance Reductions": 70,
    }
    assert metrics.topline(claims.limit(0)).count() == 0
    assert metrics.kpi_cards(claims.limit(0)).first()["total_claims"] == 0


def test_recovered_column_wins(spark):
    table = spark.createDataFrame(
        [(-5.0, 100.0, 40.0, "0-30")],
        "recovered_amount double, claim_amount double, claim_balance double, bucket string",
    )
    value = lambda df: metrics.collection_summary(df).first()["recovered_amount"]
    assert value(table) == -5
    assert value(table.drop("recovered_amount")) == 60
    assert value(table.drop("recovered_amount").withColumn("claim_balance", F.lit(130.0))) == 0
    assert value(table.drop("recovered_amount", "claim_amount")) == 0


def test_null_balance_is_closed_but_not_done(spark):
    table = spark.createDataFrame([(None, "0-30")], "claim_balance double, bucket string")
    got = {r["metric"]: r["value"] for r in metrics.topline(table).collect()}
    assert got["Closed Claims"] == 1
    assert metrics.aging_summary(table).first()["done_count"] == 0


def test_bucket_order_and_unknown_labels(claims):
    table = metrics.aging_summary(claims).collect()
    assert [r["aging_bucket"] for r in table] == ["0-30", "31-45", "60+", None, None]
    kept = metrics.aging_summary(claims, keep_unknown=True).collect()
    assert [r["aging_bucket"] for r in kept] == ["0-30", "31-45", "60+", "90-120", None]
    assert sum(r["percentage_of_total_balance"] for r in table) == pytest.approx(100)


def test_zero_balances(spark):
    table = spark.createDataFrame([(0.0, 10.0, "0-30")], "balance double, amount double, bucket string")
    assert metrics.aging_summary(table).first()["percentage_of_total_balance"] == 0
    assert metrics.collection_summary(table).first()["recovery_percentage"] == 0


def test_missing_workers(claims):
    productivity = metrics.employee_productivity(claims)
    assert rows(productivity) == [("ann", 2, 3, 1.5), ("bob", 1, 1, 1.0)]
    assert rows(metrics.employee_collection(claims)) == sorted([("ann", 20.0), ("bob", 50.0), (None, 0.0)], key=repr)
    assert metrics.claims_worked(claims).first()[0] == 4
    assert (None, None, 1) in rows(metrics.aging_worked(claims))
    joined = metrics.worked_vs_recovered(productivity, metrics.employee_collection(claims))
    assert rows(joined) == rows(metrics.touches_and_recovery(claims)) == [("ann", 3, 2, 20.0), ("bob", 1, 1, 50.0)]


def test_productivity_without_claim_ids(claims):
    assert rows(metrics.employee_productivity(claims.drop("claim_id"))) == [("ann", 3, 3, 1.0), ("bob", 1, 1, 1.0)]
    none = claims.withColumn("claim_id", F.lit(None).cast("string"))
    assert rows(metrics.employee_productivity(none)) == [("ann", 0, 3, 0.0), ("bob", 0, 1, 0.0)]


def test_condensed_measures_give_the_same_tables(claims):
    cube = condense(claims)
    for build in (metrics.topline, metrics.aging_summary, metrics.collection_summary,
                  metrics.claims_done_summary, metrics.aging_worked, metrics.employee_collection,
                  metrics.employee_recovery, metrics.overall_recovery, metrics.kpi_cards):
        assert rows(build(cube)) == rows(build(claims)), build


def test_filters(claims):
    def kept(**parts):
        return filters.apply_filters(claims, filters.FilterSpec(**parts)).count()

    assert kept() == 5
    assert kept(aging_buckets=["60+", "90-120"]) == 2
    assert kept(workers=["Unassigned"]) == 1
    assert kept(statuses=["Blank"]) == 4
    assert kept(date_range=(date(2026, 4, 1), date(2026, 4, 1))) == 2
    assert kept(workers=["ann"], statuses=["A"]) == 1


def test_default_filters(claims):
    assert filters.default_filters(claims).count() == 4
    unlabelled = claims.withColumn("claim_balance_aging", F.lit(None).cast("string"))
    assert filters.default_filters(unlabelled).count() == 4
    bare = unlabelled.drop("submission_date", "report_worked_date")
    assert filters.default_filters(bare).count() == 5


def test_options_and_bounds(claims):
    options = [(r["filter"], r["option"]) for r in filters.filter_options(claims).collect()]
    assert options == [
        ("aging_bucket", "0-30"), ("aging_bucket", "31-45"), ("aging_bucket", "60+"), ("aging_bucket", "90-120"),
        ("claim_status", "A"), ("claim_status", "Blank"),
        ("employee", "Unassigned"), ("employee", "ann"), ("employee", "bob"),
    ]
    assert tuple(filters.date_bounds(claims).first()) == (date(2026, 4, 1), date(2026, 4, 2))


def test_follow_up(claims):
    stats = {r["composite_key"]: r for r in followup.follow_up_stats(claims).collect()}
    one, two = stats["p1_c1"], stats["p2_c2"]
    assert (one["touch_count"], one["unique_workers"], one["worked_dates"]) == (2, 1, 1)
    assert (one["latest_status"], one["initial_balance"], one["latest_balance"], one["recovered_amount"]) == ("A", 100, 80, 20)
    assert (two["unique_workers"], two["report_worked_by"], two["recovered_amount"]) == (2, "ann", 0)
    assert rows(followup.follow_up_by_employee(claims)) == [("ann", 3), ("bob", 1)]
    assert rows(followup.follow_up_by_bucket(claims)) == [("31-45", 1), ("60+", 1)]
    kpis = followup.follow_up_kpis(followup.follow_up_stats(claims)).first()
    assert tuple(kpis) == (2, 2, 100.0, 2.0, 20.0)
    none = followup.follow_up_kpis(followup.follow_up_stats(claims.limit(0))).first()
    assert tuple(none) == (0, 0, 0.0, 0.0, 0.0)
    registry = followup.follow_up_registry(followup.follow_up_stats(claims))
    assert len(registry.columns) == 9 and registry.count() == 2


def test_touch_labels_sort_as_text(spark):
    stats = spark.createDataFrame([(n,) for n in (1, 2, 10, 10)], "touch_count long")
    got = [tuple(r) for r in followup.touch_frequency(stats).collect()]
    assert got == [("10x", 2), ("1x", 1), ("2x", 1)]


def test_latest_claims_ties(make_claims):
    raw = make_claims(
        {**S1, "row_pos": 1, "patient_id": "p", "claim_id": "c", "claim_balance": "1"},
        {**S2, "row_pos": 1, "patient_id": "p", "claim_id": "c", "claim_balance": "2"},
        {**S2, "row_pos": 7, "patient_id": "p", "claim_id": "c", "claim_balance": "3"},
        {**S1, "row_pos": 2, "claim_balance": "4"},
        {**S1, "row_pos": 3, "claim_balance": "5"},
    )
    got = portfolio.latest_claims(clean_claims(raw)).select("composite_key", "claim_balance")
    assert rows(got) == [("<NA>_<NA>", 5.0), ("p_c", 3.0)]


def test_latest_claims_cuts_hot_keys_before_the_shuffle(claims):
    plan = portfolio.latest_claims(claims)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_results_do_not_depend_on_partitions(sample):
    for build in (followup.follow_up_stats, portfolio.latest_claims, trend.snapshot_summary):
        one = rows(build(clean_claims(snapshots.dated(sample.repartition(1)))))
        many = rows(build(clean_claims(snapshots.dated(sample.repartition(8)))))
        assert one == many


def test_snapshot_summary(sample):
    raw = clean_claims(sample, duplicates="keep")
    summary = trend.snapshot_summary(raw, snapshots.sheet_list(sample))
    assert [tuple(r)[1:] for r in summary.collect()] == [
        ("5/4/2026", "2026-05-04", 3, 2, 109.0, 2, 50.0),
        ("2026-05-11", "2026-05-11", 2, 2, 200.0, 2, 20.0),
    ]
    emptied = trend.snapshot_summary(raw.filter("sheet_pos = 1"), snapshots.sheet_list(sample))
    assert [tuple(r)[3:] for r in emptied.collect()][0] == (0, 0, 0.0, 0, 0.0)
    deltas = {r["metric"]: (r["diff"], r["pct"]) for r in trend.snapshot_deltas(summary).collect()}
    assert deltas["total_claims"] == (-1, pytest.approx(-100 / 3))
    assert deltas["closed_claims"] == (-1, -100)
    assert deltas["claims_worked"] == (0, 0)
    assert trend.net_improvement(summary).count() == 0
    better = trend.net_improvement(summary, TREND_DATES[:2]).first()
    assert (better["claims_reduction"], better["balance_reduction"]) == (1, -91)
    assert filters.target_dates(summary).count() == 2
    weeks = [r["week_label"] for r in filters.week_labels(summary).collect()]
    assert weeks == ["Week 1", "Week 2"]
    assert trend.snapshot_deltas(summary.limit(0)).count() == 0


def test_sheets_of_one_date_stand_in_sheet_order(make_claims):
    raw = make_claims(
        {"sheet_name": "5/4/2026", "sheet_pos": 0, "claim_id": "a", "claim_balance": "1"},
        {"sheet_name": "2026-05-04", "sheet_pos": 1, "claim_id": "b", "claim_balance": "5"},
    )
    summary = trend.snapshot_summary(clean_claims(raw), positions=True)
    first = {r["metric"]: r["begin_value"] for r in trend.snapshot_deltas(summary).collect()}
    assert first["outstanding_balance"] == 1


def test_bucket_growth(sample):
    aging = trend.aging_trend(clean_claims(sample, duplicates="keep"), keep_unknown=True)
    got = {(r["sheet_name"], r["aging_bucket"]): r["claim_change"] for r in trend.bucket_growth(aging).collect()}
    assert got[("5/4/2026", "0-30")] is None
    assert len(got) == 5


def test_landed_dashboard(spark, sample, tmp_path):
    sheets = spark.createDataFrame(
        [("5/4/2026", 0), ("2026-05-11", 1), ("2026-05-18", 2)], "sheet_name string, sheet_pos int"
    )
    board = dashboard.dashboard(sample, path=str(tmp_path / "board"))
    assert tuple(board.cards.first()) == tuple(dashboard.dashboard(sample).cards.first())
    plan = board.cards._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sheet_name" in plan or "sheet_name#" in plan.split("PartitionFilters")[1]
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan  # nothing starts from the raw rows
    # A sheet that has a header alone is the newest one, with zeros.
    known = dashboard.dashboard(sample, sheets=snapshots.tag_snapshots(sheets), path=str(tmp_path / "known"))
    assert known.cards.first()["total_claims"] == 0
    totals = [r["total_claims"] for r in dashboard.dashboard(sample).trend.snapshot_summary.collect()]
    assert [r["total_claims"] for r in known.trend.snapshot_summary.collect()] == [*totals, 0]


def test_dashboard(sample):
    board = dashboard.dashboard(sample)
    assert tuple(board.cards.first()) == (2, 2, 0, 200.0, 20.0, 2)
    got = {r["metric"]: r["value"] for r in board.portfolio_topline.collect()}
    assert got["Total Claims"] == 2
    assert rows(board.productivity.select("worked_by", "total_touches")) == [("ann", 3), ("bob", 1)]
    assert board.trend.latest.first()["sheet_name"] == "2026-05-11"
    assert [r["sheet_name"] for r in board.trend.sheets.collect()] == ["2026-05-11", "5/4/2026"]
    assert board.registry.count() == 2
    narrow = dashboard.dashboard(sample, filters.FilterSpec(workers=["bob"]))
    assert narrow.topline.count() == 0
    assert narrow.cards.first()["total_claims"] == 0
