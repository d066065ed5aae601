"""Quality model: statistics and trees against plain restatements, held-out accuracy."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arledger.llm import quality_model as model

SF_DIR = "/root/testdata/sf0.01"


def plain_statistics(text):
    data = (text or "").encode()
    words = [w for w in data.replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\n", b" ").split(b" ") if w]
    lower = [w.lower() for w in words]
    lines = data.split(b"\n")
    worded = [x.lower() for x in lines if x.strip(b" \t\r\x0b\x0c")]
    triples = list(zip(lower, lower[1:], lower[2:]))
    some, any_word = max(len(data), 1), max(len(words), 1)
    counts = Counter(data)
    out = {
        "bytes": math.log1p(len(data)),
        "words": math.log1p(len(words)),
        "lines": math.log1p(len(worded)),
        "mean_word": sum(map(len, words)) / any_word,
        "long_word": sum(len(w) > 12 for w in words) / any_word,
        "short_words": sum(len(w) <= 2 for w in words) / any_word,
        "distinct_words": len(set(lower)) / any_word,
        "top_word": max(Counter(lower).values(), default=0) / any_word,
        "repeated_triples": (len(triples) - len(set(triples))) / max(len(triples), 1),
        "repeated_lines": (len(worded) - len(set(worded))) / max(len(worded), 1),
        "blank_lines": (len(lines) - len(worded)) / len(lines),
        "line_bytes": math.log1p(len(data) / len(lines)),
        "longest_word": math.log1p(max(map(len, words), default=0)),
        "capital_words": sum(65 <= w[0] <= 90 for w in words) / any_word,
        "words_with_symbols": sum(any(c in b"#*$%&|<>" for c in w) for w in words) / any_word,
        "words_with_stop": sum(any(c in b".!?" for c in w) for w in words) / any_word,
        "entropy": -sum(c / some * math.log2(c / some) for c in counts.values()),
    }
    for name, members in model._CLASSES.items():
        out[f"share_{name}"] = sum(bool(members[c]) for c in data) / some
    return [out[name] for name in model.STATISTICS]


TEXTS = [
    None, "", " ", "\n\n", "one", "One two, THREE three THREE!", "a b c a b c a b c", "line\nline\n\nLINE\n x",
    "é ü 中文 \U0001f600", "#tag $$ <b> |", "supercalifragilistic word", "tab\tand\x0bvt\rcr", "x" * 3000,
    "some words here\n" * 400, "\nstarts empty", "ends empty\n", "a b", "a\nb c",
]


def test_statistics_equal_plain_ones():
    column = pa.array(TEXTS * 3, pa.string())
    got = model.statistics(column)
    assert np.allclose(got, [plain_statistics(t) for t in TEXTS * 3])
    sliced = model.statistics(column.slice(5, 9))
    assert np.allclose(sliced, got[5:14])
    assert model.statistics(column.slice(0, 0)).shape == (0, len(model.STATISTICS))


def test_a_text_beyond_a_chunk():
    text = "Some words, repeated. " * 60_000
    assert np.allclose(model.statistics(pa.array(["x", text, ""])), [plain_statistics(t) for t in ("x", text, "")])


def _plain_score(forest, row):
    total = forest.base
    for node in forest.roots:
        while np.isfinite(forest.threshold[node]):
            node = forest.left[node] + int(row[forest.statistic[node]] > forest.threshold[node])
        total += forest.value[node]
    return 1 / (1 + math.exp(-total))


def test_forest_learns_and_is_read_right():
    rng = np.random.default_rng(0)
    values = np.round(rng.normal(0, 1, (3000, 5)), 1)  # many ties
    good = ((values[:, 0] > 0) ^ (values[:, 3] > 0.5)).astype(float)
    forest = model.grow_forest(values[:2000], good[:2000], trees=40)
    scores = forest.scores(values)
    assert ((scores[2000:] >= 0.5) == good[2000:]).mean() > 0.97
    assert np.allclose(scores[:50], [_plain_score(forest, row) for row in values[:50]])
    assert forest.scores(values[:0]).shape == (0,)


def test_best_split_is_the_best():
    rng = np.random.default_rng(5)
    values, good = rng.integers(0, 6, (300, 3)).astype(float), rng.integers(0, 2, 300).astype(float)
    edges = model.bin_edges(values)
    grower = model._Grower(model.binned(values, edges), edges, 1, 1.0)
    slopes = np.stack([0.5 - good, np.full(300, 0.25)])
    gain, statistic, last = grower.best_split(grower.histogram(np.arange(300), slopes))

    def worth(rows):
        g, h = slopes[0][rows].sum(), slopes[1][rows].sum()
        return g * g / (h + model.PENALTY)

    tried = {}
    for k in range(3):
        for edge in edges[k]:
            left = values[:, k] <= edge
            if min(slopes[1][left].sum(), slopes[1][~left].sum()) >= model.LEAST_WEIGHT:
                tried[k, edge] = worth(left) + worth(~left) - worth(np.ones(300, bool))
    assert gain == pytest.approx(max(tried.values()))
    assert gain == pytest.approx(tried[statistic, edges[statistic][last]])


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    odd = spark.createDataFrame([(7001, None, None, None, None), (7002, "", "en", "s", 0), (None, "x", None, None, 1)], docs.schema)
    every = docs.unionByName(odd).unionByName(odd)
    got = model.quality_model_digest(every.withColumn("quality", F.lit(3)), labels).collect()
    assert len(got) == 1006 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r["held_out"] for i, r in by_id.items() if i is not None)
    assert by_id[7001]["score"] == by_id[7002]["score"] and not by_id[None]["held_out"]
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = [(by_id[r["doc_id"]], r["quality"]) for r in labels.collect()]
    held = [(row["predicted"], good) for row, good in truth if row["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.93
    # Labels of held-out documents, repeated and broken labels are not learned from.
    turned = labels.withColumn("quality", F.when(model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    broken = spark.createDataFrame([(3, None, 0), (5, 9, 0), (None, 1, 1)], labels.schema)
    again = model.quality_model_digest(every, turned.unionByName(turned).unionByName(broken)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {i: r["score"] for i, r in by_id.items()}


def test_frames(spark, documents):
    docs = documents("good text, fine.", None).withColumn("quality_score", F.lit("old")).withColumn("found", F.lit(1))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in model.quality_model_digest(docs, labels).collect()} == {0.5}
    scored = model.score_quality(docs, model.fit_quality(docs, labels))
    assert set(scored.columns) == set(docs.columns) and scored.schema["quality_score"].dataType.simpleString() == "double"
    assert model.quality_model_digest(docs.where("1 = 0"), labels).count() == 0
