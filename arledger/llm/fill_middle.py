"""Fill-in-middle transformation of texts.

A text is cut at two unit boundaries into prefix, middle and suffix, and written with the middle
last, behind marks, so that a model that reads from left to right learns to fill gaps. A unit is
a run of ASCII letters or any other single code point. The boundaries of a text are kept as a
set in array, bitmap and run containers (see ``boundaries``), and both cut offsets are selected
from it by rank. Everything random comes from a hash of the document's id, so that a document is
cut alike wherever and how often it is worked on.

Only the two offsets come from Python; texts are put together and taken apart by expressions.

Defined cases: null and empty texts stay plain, as the empty text; so do texts that hold a mark
themselves; a null id is hashed as no digits; texts have no length limit; repeated rows are
cut alike; an empty table gives an empty result; other columns pass through ``fill_middle``,
where ``output`` and ``form`` replace columns of those names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.llm.boundaries import BoundarySet
from arledger.llm.common import narrowed

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that stay plain, and of the others that have the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20

_LETTER = np.zeros(128, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_boundaries(text: str) -> BoundarySet:
    """Starts of the units of a text, in code points, and its length."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    letter = _LETTER[np.minimum(points, 127)]
    starts = np.ones(len(points) + 1, dtype=bool)
    starts[1:-1] = ~(letter[1:] & letter[:-1])
    return BoundarySet(np.flatnonzero(starts))


def _draws(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from an id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _cuts() -> Column:
    @F.arrow_udf("struct<units: bigint, first: bigint, second: bigint>")
    def cuts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        found = np.zeros((len(texts), 3), dtype=np.int64)
        draws = zip(one.to_pylist(), two.to_pylist())
        for i, (text, pair) in enumerate(zip(texts, draws)):
            bounds = unit_boundaries(text.as_py())
            low, high = sorted(h % len(bounds) for h in pair)
            found[i] = len(bounds) - 1, bounds.select(low), bounds.select(high)
        return pa.StructArray.from_arrays(
            [pa.array(found[:, k]) for k in range(3)], ["units", "first", "second"]
        )

    return cuts


def _transformed(
    rows: DataFrame, doc_id: Column, text: Column, plain_percent: int, suffix_first_percent: int
) -> DataFrame:
    """Adds __text, __cut, __form and __output."""
    text = F.coalesce(text, F.lit(""))
    h1, h2, h3, h4 = _draws(doc_id)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(mark)
    plain = (text == "") | marked | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    cut = rows.withColumns({"__text": text, "__form": form, "__cut": _cuts()(text, h1, h2)})
    whole, first, second = F.col("__text"), F.col("__cut.first"), F.col("__cut.second")
    prefix = F.concat(F.lit(PREFIX), F.substring(whole, F.lit(1), first.cast("int")))
    middle = F.concat(F.lit(MIDDLE), F.substring(whole, (first + 1).cast("int"), (second - first).cast("int")))
    suffix = F.concat(F.lit(SUFFIX), F.substring(whole, (second + 1).cast("int"), F.char_length(whole)))
    output = (
        F.when(F.col("__form") == "psm", F.concat(prefix, suffix, middle))
        .when(F.col("__form") == "spm", F.concat(suffix, prefix, middle))
        .otherwise(whole)
    )
    return cut.withColumn("__output", output)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    # Parts hold no mark, and no mark begins inside another, so this finds the three marks.
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, third = (parts[i] for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, third, second))
        .when(form == "spm", F.concat(second, third, first))
        .otherwise(output)
    )


def fill_middle(
    docs: DataFrame,
    plain_percent: int = PLAIN_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """All columns of ``docs``, with ``output`` (the transformed text) and ``form``."""
    kept = [c for c in docs.columns if c not in ("output", "form")]
    names = [f"__c{i}" for i in range(len(kept))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)))
    at = dict(zip(kept, names))
    made = _transformed(rows, F.col(at["doc_id"]), F.col(at["text"]), plain_percent, suffix_first_percent)
    return made.select(
        *(F.col(n).alias(c) for c, n in at.items()),
        F.col("__output").alias("output"),
        F.col("__form").alias("form"),
    )


def fill_middle_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256."""
    rows = narrowed(docs, "doc_id", "text")
    made = _transformed(rows, F.col("doc_id"), F.col("text"), PLAIN_PERCENT, SUFFIX_FIRST_PERCENT)
    cut_up = F.col("__form") != "plain"
    first, second = F.col("__cut.first"), F.col("__cut.second")
    return made.select(
        "doc_id",
        F.col("__cut.units").alias("n"),
        F.col("__form").alias("form"),
        F.when(cut_up, first).alias("prefix_chars"),
        F.when(cut_up, second - first).alias("middle_chars"),
        F.sha2("__output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("__output"), F.col("__form")), 256).alias("restored_sha256"),
    )
