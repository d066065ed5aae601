"""Fill-in-middle: containers against plain lists, cuts against a plain restatement."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arledger.llm import boundaries
from arledger.llm.boundaries import BoundarySet
from arledger.llm.fill_middle import fill_middle, fill_middle_digest, restored, unit_boundaries


def plain_row(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, output = "plain", text
    elif h4 % 100 < 20:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (output, text)]
    return (doc_id, len(units), form, *sizes, *sha)


SHAPES = {
    "array": np.arange(0, 60000, 37),
    "bitmap": np.flatnonzero(np.random.default_rng(1).random(1 << 16) < 0.4),
    "runs": np.concatenate([np.arange(10, 30000), np.arange(40000, 65536)]),
    "all": np.arange(0, 200_000),
    "mixed": np.concatenate([[0, 65535, 65536], np.arange(140_000, 190_000), 200_000 + 3 * np.arange(9000)]),
    "one": np.array([131072]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_select_in_containers(name):
    positions = SHAPES[name]
    made = BoundarySet(positions)
    assert len(made) == len(positions)
    ranks = np.unique(np.linspace(0, len(positions) - 1, 3000).astype(int))
    assert [made.select(int(k)) for k in ranks] == positions[ranks].tolist()
    with pytest.raises(IndexError):
        made.select(len(positions))


def test_every_form_is_chosen():
    assert isinstance(BoundarySet(SHAPES["array"]).containers[0], boundaries.ArrayContainer)
    assert isinstance(BoundarySet(SHAPES["bitmap"]).containers[0], boundaries.BitmapContainer)
    assert isinstance(BoundarySet(SHAPES["runs"]).containers[0], boundaries.RunContainer)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abZ <P>SM|.\n"), st.characters(codec="utf-8")), max_size=60))
def test_boundaries_are_those_of_the_units(text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    ends = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(int)
    made = unit_boundaries(text)
    assert [made.select(k) for k in range(len(made))] == ends.tolist()


TEXTS = [
    None, "", "a", " ", "one two, three!", "été \U0001f600 naïve", "holds <S> itself", "<<P", "a<P", "M>x<",
    "line\nline\r\n\n", "x" * 200_000, "ab, " * 60_000, "<" * 70_000 + "word " * 9000, "中" * 66_000 + "z",
]


def test_rows_equal_the_plain_restatement(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no id"), (-7, "minus"), (3, "one two"), (3, "one two")]
    frame = documents(*rows).withColumn("n", F.lit("clash")).withColumn("__cut", F.lit(1)).repartition(3)
    got = sorted(map(tuple, fill_middle_digest(frame).collect()), key=str)
    assert got == sorted((plain_row(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_general_form(spark, documents):
    frame = documents(*[(i, f"text number {i}, with é") for i in range(60)])
    odd = frame.withColumn("form", F.lit(1)).withColumn("__text", F.lit("x")).withColumn("a.b", F.lit(2))
    out = fill_middle(odd, plain_percent=0, suffix_first_percent=100)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__text", "a.b", "output", "form"]
    assert out.where("form = 'spm'").count() == 60
    assert out.where(restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert fill_middle(frame, plain_percent=100).where("output = text").count() == 60
    assert fill_middle(frame.where("1 = 0")).count() == fill_middle_digest(frame.where("1 = 0")).count() == 0
