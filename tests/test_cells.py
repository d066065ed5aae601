"""Case tables for headers, dates, money, labels and display text."""

from __future__ import annotations

import math
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from arledger.functions import text
from arledger.functions.cells import (
    blank_to_null,
    composite_key,
    money_or_zero,
    normalize_bucket,
    number_or_zero,
    parse_date,
)
from arledger.functions.headers import distinct_names, standard_name

BUCKETS = {
    " 0 - 30 Days ": "0-30", "0 to 30": "0-30", "0_30": "0-30", "030": "0-30", "0 3 0": "0-30",
    "100-300": "0-30", "60-30": "0-30", "0 t o 3 0": "0-30", "31 to 45": "31-45",
    "3145": "31-45", "31\xa0-\xa045": "31-45", "46_60": "46-60", "46-60+": "46-60",
    "4 6 t o 6 0": "46-60", "60": "60+", "60 days": "60+", "60 plus": "60+", "60over": "60+",
    "160+": "60+", "6 0 p l u s": "60+", "60\x1cover": "60+", "90-120": "90-120", "61+": "61+",
    "over 60": "over 60", "31-60": "31-60", "31–45": "31–45", "0--30": "0--30",
    " 90-120 ": " 90-120 ", "10 3 0": "10 3 0", "": "", None: None, "60+": "60+",
}

MONEY = {
    "$1,234.50": 1234.5, " 12 ": 12, "1e3": 1000, "+3": 3, "5.": 5, ".5": 0.5, "-7": -7,
    "$-5": -5, "inf": math.inf, "-inf": -math.inf, "(5)": 0, "N/A": 0, "True": 0, "nan": 0,
    "1_0": 0, "0x10": 0, "0x1p3": 0, "1.5d": 0, "1f": 0, "1 2": 0, "": 0, None: 0,
}

DATES = [
    "5/4/2026", "2026-05-11", "5-18-26", "20260504", "May 2026", "2026", "13/5/2026", "Sheet1",
    "Week 1", "5/26", "05042026", "1", " 2026-05-11 ", "5-18-2026", "13-5-2026", "5/4/26",
    "May 4, 2026", "September 5, 2026", "Sep 5 2026", "4 May 2026", "2026/05/04",
    "2026-05-11 10:20:30", "2026-05-11T10:20:30", "5/4/2026 14:30", "5/4/2026 14:30:05",
    "2026-13-01", "31/12/2026", "2/30/2026", "2026-5-4", "2026-05", "not a date", "", "May",
    "5/26/2026 3:15 PM", "2026-05-04 3:15 PM", "4-May-2026", "4-May-26", "5.4.2026", "2026.05.04",
    "Mon, May 4, 2026", "May 4th, 2026", "Sept 4, 2026", "05/2026", "26-May-2026 10:00",
    "5/26/2026 10:15:22.5", "5/4/99", "5/4/2026 12:00 am", "tuesday 5 may 2026", "5/26/2026 3PM",
    "Week 2026", "2026-02-30", "2024-02-29", "20261301", None,
]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    got = rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in got]


def test_buckets(spark):
    assert column(spark, list(BUCKETS), normalize_bucket) == list(BUCKETS.values())


def test_bucket_twice_is_once(spark):
    once = column(spark, list(BUCKETS), normalize_bucket)
    assert column(spark, once, normalize_bucket) == once


def test_money(spark):
    assert column(spark, list(MONEY), money_or_zero) == list(MONEY.values())


def test_dates_as_pandas_reads_them(spark):
    got = column(spark, DATES, lambda c: F.date_format(parse_date(c), "yyyy-MM-dd HH:mm:ss"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parsed = [pd.to_datetime(v, errors="coerce") for v in DATES]
    want = [None if v is None or pd.isna(v) else v.strftime("%Y-%m-%d %H:%M:%S") for v in parsed]
    assert got == want


def test_numbers(spark):
    values = [None, math.nan, 2.5, -1.0]
    assert column(spark, values, number_or_zero, "double") == [0.0, 0.0, 2.5, -1.0]


def test_null_markers(spark):
    values = ["", "nan", "None", " ", "NaN", "none", "x", None]
    assert column(spark, values, blank_to_null) == [None, None, None, " ", "NaN", "none", "x", None]


def test_composite_key(spark):
    rows = spark.createDataFrame(
        [("a", "1"), (None, "1"), ("a", None), (None, None)], "p string, c string"
    )
    got = [r[0] for r in rows.select(composite_key(F.col("p"), F.col("c"))).collect()]
    assert got == ["a_1", "<NA>_1", "a_<NA>", "<NA>_<NA>"]


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        (" Claim Balance Aging ", "claim_balance_aging"),
        ("% Paid", "paid"),
        ("A - B", "a_b"),
        ("a-_b", "a_b"),
        ("__x  y__", "x_y"),
        ("#", ""),
        (5, "5"),
    ],
)
def test_standard_name(raw, name):
    assert standard_name(raw) == name


def test_distinct_names():
    assert distinct_names(["a", "a", "a_2", "b", "a"]) == ["a", "a_3", "a_2", "b", "a_4"]


NUMBERS = [0.0, 0.5, 1.5, 999.4, 999.5, 1000.0, 1234.56, 1250.0, 987654.321, 2.5e6, 1234567890.0]


def test_number_texts_as_python_formats_them(spark):
    def check(expression, python):
        assert column(spark, NUMBERS, expression, "double") == [python(x) for x in NUMBERS]

    check(text.money_short_text, lambda x: f"${x / 1e3:,.1f}K" if x >= 1000 else f"${x:,.0f}")
    check(text.money_millions_text, lambda x: f"${x / 1e6:.3f}M")
    check(text.money_text, lambda x: f"${x:,.0f}")
    check(text.count_text, lambda x: f"{x:,.0f}")
    check(text.money_cents_text, lambda x: f"${x:,.2f}")


def test_text_of_no_number(spark):
    assert column(spark, ["n/a", "1234"], text.money_text) == ["n/a", "$1,234"]
    assert column(spark, ["n/a", "1234"], text.count_text) == ["n/a", "1,234"]


def test_delta_text(spark):
    values = [-1234.5, 0.0, 17.25, 4321.0]
    got = column(spark, values, lambda c: text.delta_text(c, c / 10, True), "double")
    assert got == [f"${x:+,.2f} ({x / 10:+.1f}%)" for x in values]
    got = column(spark, [-1234, 0, 17], lambda c: text.delta_text(c, c / 10, False), "int")
    assert got == [f"{x:+,} ({x / 10:+.1f}%)" for x in (-1234, 0, 17)]


def test_touch_label(spark):
    assert column(spark, [1, 10], text.touch_label, "int") == ["1x", "10x"]
