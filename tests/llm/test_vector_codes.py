"""Vector codes against plain rounds, and what the balls spare."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arledger.llm.vector_codes import Balls, compress_vectors, vector_code_digest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Every distance, in Python integers."""
    kept = [
        (i, [math.floor(4096 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = [(i, [(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)], n) for i, v, n in kept]
    cut.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[list(r[1][p]) for r in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, x, _ in cut:
                members[nearest(x[p], books[p])[1]].append(x[p])
            for e, own in members.items():
                books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    found, by_label = [], defaultdict(int)
    for i, x, label in cut:
        best = [nearest(x[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        found.append((i, "".join(f"{e:02x}" for _, e in best), error, label))
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted(((i, c, e, by_label[n], digest) for i, c, e, n in found), key=str)


def digest(frame):
    return sorted(map(tuple, vector_code_digest(frame).collect()), key=str)


def test_digest_equals_plain_rounds(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(0, 0.2, 16)).astype(np.float32).tolist(), i % 3 or None) for i in range(400)]
    rows += [(7, rows[8][1], 1), rows[9], rows[9], (None, rows[10][1], 2), (-5, [0.5] * 9, 0)]  # ties, repeats, short
    rows += [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("-inf")] + [0.0] * 15, None)]
    rows += [(910 + i, [0.25] * 16, None) for i in range(40)]  # equal vectors under one label
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("own", F.lit(1))
    assert digest(frame.repartition(5)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, [], 1), (2, [], None)], [(1, None, 1)], [(3, [0.1, -0.2, 0.3], 5), (3, [9.0], 5)]])
def test_small_tables(spark, rows):
    assert digest(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_large_components_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30], 1)], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        vector_code_digest(frame).collect()


def test_general_form(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 6).astype(np.float32).tolist(), str(i % 2)) for i in range(90)]
    coded, books = compress_vectors(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string"), parts=3, entries=5, rounds=2
    )
    assert books.shape == (3, 5, 2) and coded.columns == ["vec_id", "label", "code", "error"]
    got = sorted((r["vec_id"], bytes(r["code"]).hex(), r["error"]) for r in coded.collect())
    assert got == sorted((i, c, e) for i, c, e, _, _ in plain(rows, 3, 5, 2))
    assert coded.schema["label"].dataType.simpleString() == "string"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 9), st.integers(1, 5))
def test_balls_find_the_nearest_entry(seed, dims, entries, spread):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (50, dims))
    before, book = (rng.integers(-spread, spread + 1, (entries, dims)) for _ in range(2))
    book[: entries // 2] = before[: entries // 2]  # some entries stay

    def nearest(b):
        return ((points[:, None] - b[None]) ** 2).sum(axis=2)

    own = nearest(before).argmin(axis=1)
    got, gap, _ = Balls(book, before).assign(points, own)
    assert (got == nearest(book).argmin(axis=1)).all() and (gap == nearest(book).min(axis=1)).all()


def test_balls_spare_distances():
    rng = np.random.default_rng(3)
    book = rng.integers(-5000, 5000, (16, 4))
    points = book[rng.integers(0, 16, 2000)] + rng.integers(-300, 300, (2000, 4))
    own = ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    _, _, compared = Balls(book, None).assign(points, own)
    assert compared < 0.05 * 2000 * 15  # stable cores and rings
    assert Balls(book, book).assign(points, own)[2] == 0  # nothing moved
