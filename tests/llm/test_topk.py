"""Top-k products against all products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arledger.llm import topk


def brute_force(rows: list) -> list[tuple]:
    vectors = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (q, a) in enumerate(vectors):
        if q % 50 == 0:
            scores = sorted(
                (-sum(x * y for x, y in zip(a, b)), i) for k, (i, b) in enumerate(vectors) if k != at
            )
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:5], 1)]
    return sorted(out)


def test_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 120)
    monkeypatch.setattr(topk, "_GROUPS", 2)
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows: list = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(700)]
    rows += [(700 + i, centres[0]) for i in range(150)]  # one vector very often
    rows += [(900, None), (901, [None] * 8), (950, [float("nan")] * 8), (951, [float("inf")] * 8), (-50, centres[1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in topk.top_products(frame).collect())
    assert got == brute_force(rows)


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-3.0, 0.5]), (7, [1.0, 2.0]), (7, [2.0, 2.0]), (50, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    frame = frame.withColumn("key", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("block", F.lit(0))
    got = sorted(tuple(r) for r in topk.top_products(frame).collect())
    assert got == brute_force(rows) and len(got) == 20


def test_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [200_000.5, -3.0]), (1, [150_000.25, 7.0]), (2, [-1.0, 1.0])]
    got = sorted(tuple(r) for r in topk.top_products(spark.createDataFrame(rows, schema)).collect())
    assert got == brute_force(rows)
    with pytest.raises(ValueError):
        topk.top_products(spark.createDataFrame([*rows, (3, [1e30, 0.0])], schema))


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    two = spark.createDataFrame([(0, [1.0, 2.0], 1), (3, [1.0, 0.5], 1)], schema)
    assert [tuple(r) for r in topk.top_products(two).collect()] == [(0, 1, 3, 256 * 256 + 512 * 128)]
    assert topk.top_products(two.where("1 = 0")).count() == 0
    assert topk.top_products(two.where("vec_id = 0")).count() == 0


def test_tree_covers_its_points():
    points = np.random.default_rng(1).normal(size=(900, 5))
    tree = topk.CoverTree(points)
    assert sorted(tree.order) == list(range(900))
    for centre, radius, (low, high) in zip(tree.centre, tree.radius, tree.range):
        gaps = np.sqrt(((points[tree.order[low:high]] - centre) ** 2).sum(axis=1))
        assert gaps.max() <= radius + 1e-9
