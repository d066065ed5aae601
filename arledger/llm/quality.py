"""Quality rules as a short-circuit cascade.

Each rule says when a text is rejected. Cost and rejection rate of every rule are estimated on
a sample; the cascade is one ``CASE`` whose branches stand in the order of rejections per
second, so a text leaves it at the first rule that rejects it and costly rules see only what
cheap ones let through. The order changes the run time and the reported rule, never ``kept``.

Defined cases: null, empty and blank texts have no words and fail ``short``; equal rows get
equal results; an empty table gives an empty result; other columns are passed through, except
that ``failed_rule`` and ``kept`` are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.llm.common import SPACE_CHARS, stored, words

# Limits of the rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_SYMBOLS_PER_100_WORDS = 30
MOST_DUPLICATE_LINES_PERCENT = 50
WORD_CHARS_RANGE = (2, 14)
MOST_CAPITALS_PERCENT = 60
SYMBOLS = "[#*$%&|<>]"


def _parts(docs: DataFrame, text: str) -> DataFrame:
    """Adds the split text that the rules share."""
    lines = F.filter(F.split("__text", "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("__words") - 3, F.lit(0))),
        lambda i: F.xxhash64(
            F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)
        ),
    )
    return (
        docs.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
        .withColumn("__words", words(F.col("__text")))
        .withColumn("__lines", lines)
        .withColumn("__windows", windows)
    )


def n_words() -> Column:
    return F.size("__words").cast("long")


def word_chars() -> Column:
    """Code points in words."""
    return F.char_length(F.array_join("__words", "")).cast("long")


def n_symbols() -> Column:
    bare = F.regexp_replace("__text", f"{SYMBOLS}+", "")
    return (F.char_length("__text") - F.char_length(bare)).cast("long")


def n_duplicate_lines() -> Column:
    """Lines with a word that equal an earlier line."""
    return (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")


def n_repeated_words() -> Column:
    """Words in windows of three words that the text holds twice or more.

    Most texts have no such window and stop at the distinct count. In others, windows are
    sorted by hash, those equal to a neighbour are kept, and their lengths are added up in
    text order without what overlaps.
    """
    ranked = F.array_sort(
        F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )

    def covered(ordered: Column) -> Column:
        hashes = ordered["h"]
        none = F.array(F.lit(None).cast("long"))
        before = F.concat(none, F.slice(hashes, 1, F.size(hashes) - 1))
        after = F.concat(F.slice(hashes, 2, F.size(hashes) - 1), none)
        near = F.arrays_zip(ordered.alias("w"), before.alias("b"), after.alias("a"))
        repeated = F.filter(
            near, lambda z: z["w"]["h"].eqNullSafe(z["b"]) | z["w"]["h"].eqNullSafe(z["a"])
        )
        starts = F.array_sort(F.transform(repeated, lambda z: z["w"]["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            zero,
            lambda acc, i: F.struct(
                (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end")
            ),
            lambda acc: acc["n"],
        )

    # The lambda over a one-element array keeps the sorted windows from being sorted again
    # at each of their uses.
    counted = F.get(F.transform(F.array(ranked), covered), F.lit(0))
    some = (F.size("__words") > 3) & (F.size(F.array_distinct("__windows")) < F.size("__windows"))
    return F.when(some, counted).otherwise(0).cast("long")


def rules() -> dict[str, Column]:
    """Name and rejection of each rule, over the split text."""
    letters = F.length(F.regexp_replace("__text", r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace("__text", r"[^\p{Lu}]+", ""))
    low, high = WORD_CHARS_RANGE
    return {
        "short": n_words() < LEAST_WORDS,
        "repeats": 100 * n_repeated_words() > MOST_REPEATED_PERCENT * n_words(),
        "symbols": 100 * n_symbols() > MOST_SYMBOLS_PER_100_WORDS * n_words(),
        "duplicate_lines": 100 * n_duplicate_lines()
        > MOST_DUPLICATE_LINES_PERCENT * F.size("__lines"),
        "word_length": (word_chars() < low * n_words()) | (word_chars() > high * n_words()),
        "capitals": 100 * capitals > MOST_CAPITALS_PERCENT * letters,
    }


def cascade_order(
    docs: DataFrame, text: str = "text", sample_rows: int = 1000, seed: int = 7
) -> list[str]:
    """Rule names by estimated rejections per second, highest first.

    Rates and run times come from a sample of about ``sample_rows`` rows, drawn over the
    whole table; a bound on the sample bounds this step, whatever the table's size.
    """
    total = docs.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    sample = stored(docs.select(text).sample(withReplacement=False, fraction=share, seed=seed))
    parts = _parts(sample, text)
    rate: dict[str, float] = {}
    for name, rejected in rules().items():
        seconds = []
        for _ in range(2):
            start = time.perf_counter()
            row = parts.agg(F.count_if(rejected).alias("n"), F.count("*").alias("of")).first()
            seconds.append(time.perf_counter() - start)
        rate[name] = (row["n"] + 1) / (row["of"] + 2) / min(seconds)
    return sorted(rate, key=rate.get, reverse=True)


def _verdict(order: Sequence[str], found: Mapping[str, Column]) -> Column:
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(found[name], F.lit(name)).otherwise(verdict)
    return verdict


def apply_quality_rules(
    docs: DataFrame,
    text: str = "text",
    order: Sequence[str] | None = None,
    measures: bool = False,
) -> DataFrame:
    """All columns plus ``failed_rule`` (null if none) and ``kept``.

    ``order`` skips the estimate. ``measures`` adds the base measures of every text
    (``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``), which
    then cost their time for rejected texts too; the rules read the measured columns.
    """
    found = rules()
    order = list(order) if order is not None else cascade_order(docs, text)
    if sorted(order) != sorted(found):
        raise ValueError(f"order must name each of {sorted(found)} once")
    parts = _parts(docs, text)
    extra: dict[str, Column] = {}
    if measures:
        extra = {
            "n_words": n_words(),
            "word_chars": word_chars(),
            "n_symbols": n_symbols(),
            "n_dup_lines": n_duplicate_lines(),
            "n_repeat_words": n_repeated_words(),
        }
        parts = parts.withColumns(extra)
        low, high = WORD_CHARS_RANGE
        count = F.col("n_words")
        found |= {
            "short": count < LEAST_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * count,
            "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS_PER_100_WORDS * count,
            "duplicate_lines": 100 * F.col("n_dup_lines")
            > MOST_DUPLICATE_LINES_PERCENT * F.size("__lines"),
            "word_length": (F.col("word_chars") < low * count)
            | (F.col("word_chars") > high * count),
        }
    kept_columns = [c for c in docs.columns if c not in {"failed_rule", "kept", *extra}]
    return (
        parts.withColumn("failed_rule", _verdict(order, found))
        .withColumn("kept", F.col("failed_rule").isNull())
        .select(*(F.col(f"`{c}`") for c in kept_columns), *extra, "failed_rule", "kept")
    )


def quality_digest(docs: DataFrame) -> DataFrame:
    """Per document: base measures, ``base_failed`` and ``kept``. Which rule rejects a text first
    depends on measured times and is left out."""
    judged = apply_quality_rules(docs.select("doc_id", "text"), measures=True)
    base = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return judged.withColumn("base_failed", base).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )
