"""Cell-level expressions: dates, money, aging labels, null markers, claim keys.

All are native column expressions, so they stay inside whole-stage codegen. Lenient
parsing uses the ``try_*`` forms because ANSI mode is on by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from arledger.fixed_values import (
    BUCKET_EXACT,
    BUCKET_ORDER,
    BUCKET_SEARCH,
    MISSING_ID,
    NULL_MARKERS,
)

# All Unicode blanks, listed: a plain character class is several times faster than the
# regex engine's Unicode mode.
_BLANK = (
    r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
_EDGE_CHARS = " \t\n\r\f\v\u00a0"

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# The shape is tested before parsing, which keeps the parser away from text it would only
# reject by raising an exception per row. ISO text, the usual case, is a plain cast.
_TIME = r"([ T]\d{1,2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?( ?[AaPp]\.?[Mm]\.?)?)?"
_DAY_SHAPE = (
    r"^(\d{1,2}([-/.])\d{1,2}\2(\d{4}|\d{2})|\d{4}([-/.])\d{1,2}\4\d{1,2}|\d{8}"
    r"|\d{1,2}[ -][A-Za-z]{3,9}\.?,?[ -](\d{4}|\d{2})|[A-Za-z]{3,9}\.? \d{1,2},? \d{4})"
)
# Nearly all dates that are not ISO text; read without the rewriting that other spellings need.
_USUAL_SHAPE = r"^\d{1,2}([-/])\d{1,2}\1\d{4}$"
_USUAL_STYLES = "[M/d/yyyy][M-d-yyyy]"
_MONTH_SHAPE = r"^(\d{1,2}[-/]\d{4}|[A-Za-z]{3,9}[ -]\d{4}|\d{4})$"
_WEEKDAY = r"^(?i:(mon|tues?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(day)?)\.?,? +"
# All styles in one pattern of optional sections: one parser call instead of one per style.
_DAY_STYLES = (
    "[M/d/yyyy][M-d-yyyy][M.d.yyyy][yyyy/M/d][yyyy-M-d][yyyy.M.d][yyyyMMdd]"
    "[d MMM yyyy][d MMMM yyyy][MMM d yyyy][MMMM d yyyy]"
)
_DAY_FIRST_STYLES = "[d/M/yyyy][d-M-yyyy][d.M.yyyy]"
_MONTH_STYLES = "[M/yyyy][MMM yyyy][MMMM yyyy][yyyy]"
_TIME_STYLES = "[ h:mm:ss a][ h:mm a][ h a][ H:mm:ss][ H:mm]"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used. It also keeps
    long expressions out of the generated code of the usual case."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plain_date(text: Column) -> Column:
    """One spelling for many: no weekday, ordinal endings, commas and fractions of seconds,
    ``Sep`` for ``Sept``, capital AM and PM after a blank, four-digit years."""
    text = F.regexp_replace(text, _WEEKDAY, "")
    text = F.regexp_replace(text, r"(?i)(?<=\b\d{1,2})(st|nd|rd|th)\b", "")
    text = F.regexp_replace(text, r"(?i)\bsept\b", "Sep")
    text = F.regexp_replace(text, r"(?<=[A-Za-z])\.|,", "")
    text = F.regexp_replace(text, r"(\d{1,2})[ -]([A-Za-z]{3,9})[ -](\d{2,4})", "$1 $2 $3")
    text = F.regexp_replace(text, r"^([A-Za-z]{3,9})-(\d{4})$", "$1 $2")
    text = F.regexp_replace(text, r"(?<=\d)T(?=\d)", " ")
    text = F.regexp_replace(text, r"(:\d{2}:\d{2})\.\d+", "$1")
    text = F.regexp_replace(text, r"(?i) ?([ap])\.?m\.?$", " $1M")
    # Month names and the half of the day are read in one spelling only.
    return _once(F.regexp_replace(F.initcap(text), "([AP])m$", "$1M"), _with_whole_year)


def _with_whole_year(text: Column) -> Column:
    """Two-digit years become those less than fifty years ahead."""
    short = r"^(\d{1,2}([-/. ])(\d{1,2}|[A-Za-z]{3,9})\2)(\d{2})(?!\d)"
    year = F.regexp_extract(text, short, 4)
    far = year.try_cast("int") + 2000 >= F.year(F.curdate()) + 50
    rest = F.regexp_replace(text, short, "")
    whole = F.concat(F.regexp_extract(text, short, 1), F.when(far, "19").otherwise("20"), year, rest)
    return F.when(year != "", whole).otherwise(text)


def _fraction(text: Column) -> Column:
    """Microseconds behind the seconds; zero without any."""
    digits = F.regexp_extract(text, r":\d{2}:\d{2}\.(\d{1,6})", 1)
    return F.coalesce(F.rpad(digits, 6, "0").try_cast("bigint"), F.lit(0))


def _other_date(text: Column) -> Column:
    """Date in any style but ISO."""
    bare = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), r"(?i)(?<=\d)(st|nd|rd|th)\b", "")

    def day(plain: Column) -> Column:
        parsed = F.coalesce(
            F.try_to_timestamp(plain, F.lit(_DAY_STYLES + _TIME_STYLES)),
            F.try_to_timestamp(plain, F.lit(_DAY_FIRST_STYLES + _TIME_STYLES)),
        )
        return F.timestamp_micros(F.unix_micros(parsed) + _fraction(text))

    def month(plain: Column) -> Column:
        return F.try_to_timestamp(plain, F.lit(_MONTH_STYLES))

    usual = F.when(text.rlike(_USUAL_SHAPE), F.try_to_timestamp(text, F.lit(_USUAL_STYLES)))
    other = _once(
        bare,
        lambda shape: F.when(shape.rlike(_DAY_SHAPE + _TIME + "$"), _once(_plain_date(text), day)).when(
            shape.rlike(_MONTH_SHAPE), _once(_plain_date(text), month)
        ),
    )
    return F.coalesce(usual, other)


def parse_date(text: Column) -> Column:
    """Timestamp of a date written in any of the known styles; null when none fits. Where
    day and month could be swapped, the month comes first."""
    text = F.btrim(text.cast("string"), F.lit(_EDGE_CHARS))
    # Whatever the cast rejects is tried as another style.
    iso = F.when(F.substring(text, 5, 1) == "-", text.try_cast("timestamp"))
    return F.coalesce(iso, _once(text, _other_date))


def money_or_zero(text: Column) -> Column:
    """Number in a money text without ``$`` and ``,``; anything else counts as zero. The
    cast alone would also read ``1d`` and ``0x1p3``, which are no amounts."""
    bare = F.replace(F.replace(text.cast("string"), F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    amount = F.when(bare.rlike(_NUMBER), F.trim(bare).try_cast("double"))
    return F.coalesce(amount, F.lit(0.0))


def number_or_zero(value: Column) -> Column:
    """Double value; null, NaN and text that is no number count as zero."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))


# Text that every hit of a bucket's searched pattern contains: a cheap first look.
_BUCKET_TOKEN = {"0-30": "30", "31-45": "31", "46-60": "46", "60+": "60"}


def _whole_label_pattern() -> str:
    """Accepted whole spellings of any bucket, with blanks between characters and with
    ``to`` and ``plus`` in place of the signs. Their first digit tells the bucket. Spellings of
    a bucket share one pattern, so a label is searched once per bucket and not per spelling."""
    signs = {"-": rf"(-|t{_BLANK}*o)", "+": rf"(\+|p{_BLANK}*l{_BLANK}*u{_BLANK}*s)"}
    spellings = (
        rf"{_BLANK}*".join(signs.get(char, char) for char in spelling)
        for _, group in BUCKET_EXACT
        for spelling in group
    )
    return rf"^{_BLANK}*({'|'.join(spellings)}){_BLANK}*$"


def normalize_bucket(label: Column) -> Column:
    """Canonical aging bucket of a free label; a label that fits none stays as it is."""
    label = label.cast("string")
    text = F.replace(F.lower(label), F.lit("days"), F.lit(""))
    # Canonical labels map to themselves, so they skip the patterns.
    bucket = F.when(label.isNull() | label.isin(*BUCKET_ORDER), label)
    for name, pattern in BUCKET_SEARCH:
        found = text.rlike(pattern.replace(r"\s", _BLANK))
        bucket = bucket.when(text.contains(_BUCKET_TOKEN[name]) & found, F.lit(name))
    digits = F.create_map(*(F.lit(part) for name in BUCKET_ORDER for part in (name[0], name)))
    whole = F.try_element_at(digits, F.regexp_extract(text, r"\d", 0))
    return bucket.when(text.rlike(_whole_label_pattern()), whole).otherwise(label)


def blank_to_null(text: Column) -> Column:
    """Null for a cell that holds exactly one of the null markers."""
    return F.when(~text.isin(*NULL_MARKERS), text)


def composite_key(patient_id: Column, claim_id: Column) -> Column:
    """Text key of a claim over all snapshots; missing ids share one marker text."""
    missing = F.lit(MISSING_ID)
    return F.concat_ws(
        "_",
        F.coalesce(patient_id.cast("string"), missing),
        F.coalesce(claim_id.cast("string"), missing),
    )
