"""Display text for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def touch_label(touch_count: Column) -> Column:
    """``3`` -> ``3x``."""
    return F.concat(touch_count.cast("string"), F.lit("x"))


def money_short_text(amount: Column) -> Column:
    """``$12.3K`` from one thousand on, else whole dollars."""
    return F.when(
        amount >= 1000, F.concat(F.lit("$"), F.format_number(amount / 1000, 1), F.lit("K"))
    ).otherwise(F.concat(F.lit("$"), F.format_number(amount, 0)))


def money_millions_text(amount: Column) -> Column:
    """``$1.234M``, without digit grouping."""
    grouped = F.format_number(amount / 1e6, 3)
    return F.concat(F.lit("$"), F.translate(grouped, ",", ""), F.lit("M"))


def count_text(value: Column) -> Column:
    """``12,345``; a value that is no number shows as its own text."""
    number = value.try_cast("double")
    return F.coalesce(F.format_number(number, 0), value.cast("string"))


def money_text(value: Column) -> Column:
    """``$12,345``; a value that is no number shows as its own text."""
    number = value.try_cast("double")
    return F.coalesce(F.concat(F.lit("$"), F.format_number(number, 0)), value.cast("string"))


def money_cents_text(amount: Column) -> Column:
    """``$12,345.60``."""
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def _signed(amount: Column, digits: int) -> Column:
    text = F.format_number(amount, digits)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def delta_text(diff: Column, pct: Column, money: bool) -> Column:
    """``$+1,234.50 (+1.2%)`` for money, ``+1,234 (+1.2%)`` for counts."""
    head = F.concat(F.lit("$"), _signed(diff, 2)) if money else _signed(diff, 0)
    grouped = F.translate(_signed(pct, 1), ",", "")
    return F.concat(head, F.lit(" ("), grouped, F.lit("%)"))
