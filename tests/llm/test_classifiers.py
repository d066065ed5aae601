"""Toxicity and language: held-out accuracy, defined results of odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arledger.llm import language, toxicity

SF_DIR = "/root/testdata/sf0.01"


def test_label_model_tells_good_voters_from_bad():
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.2
    good = [np.where(truth & (rng.random(3000) < 0.7), 1, 0) for _ in range(4)]
    noise = np.where(rng.random(3000) < 0.1, 1, 0)
    clean = np.where(np.sum(good, axis=0) == 0, -1, 0)
    votes = np.stack([*good, noise, noise, clean], axis=1).astype(np.int8)
    start = np.where(rng.random(3000) < 0.15, ~truth, truth).astype(float)
    posterior = toxicity.label_model(votes, start)
    assert ((posterior > 0.5) == truth).mean() > 0.95


def _insults(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        words = ["".join(rng.choice("aeioknst") for _ in range(rng.randrange(2, 8))) for _ in range(80)]
        bad = i % 8 == 0
        for _ in range(4 if bad else 0):
            words[rng.randrange(80)] = rng.choice(("zorfil", "Zorfan,", "brukk", "zorfuck"))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None, None, None, None), (2001, "", None, None, None), (None, "brukk", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = _insults(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    right = [got[i]["predicted"] == (i % 8 == 0) for i in range(1200) if got[i]["held_out"]]
    assert np.mean(right) > 0.97
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0 and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # Labels of held-out documents are not looked at.
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity_digest(docs, turned).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_frames(spark):
    docs, labels = _insults(spark)
    odd = docs.where("doc_id < 40").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(7))
    kept = toxicity.drop_toxic(odd.unionByName(odd), labels)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert all(ids.count(i) == 2 for i in range(40) if i % 8)  # repeated rows stay, clean ones too
    assert toxicity.drop_toxic(odd.where("1 = 0"), labels).count() == 0
    none = toxicity.toxicity_digest(odd, labels.where("1 = 0"))
    assert none.agg(F.max("score")).first()[0] < 1e-6


def test_voters_of_words_and_stems_are_apart():
    n, kinds = 100, np.repeat((0, *toxicity.STEMS), 25)
    entries = np.sort(toxicity.mix(np.arange(100, dtype=np.uint64)))
    docs = np.arange(n)
    votes = toxicity._votes(n, docs, docs, entries, kinds)
    says = votes == 1
    # No voter but the one that counts entries speaks for entries of two kinds.
    across = [len(set(kinds[says[:, i]])) for i in range(says.shape[1]) if says[:, i].any()]
    assert sorted(across)[-2:] == [1, len(toxicity.STEMS) + 1] and len(across) > 20
    assert (toxicity.majority(votes) > 0).all()


def test_a_word_is_one_entry():
    [chunk] = toxicity.chunks(pa.array(["zorfil zorfan", None, "zorf"]))
    rows, found, kinds, word = toxicity._features(chunk)
    first, second = np.flatnonzero(word == 0), np.flatnonzero(word == 1)
    assert list(kinds[first]) == [0, 4, 5, 6] and list(rows[first]) == [0] * 4
    entries = np.sort(np.concatenate([found[first], found[second][kinds[second] == 5]]))
    row, place = toxicity._entries_of(chunk, entries)
    # The word itself, the five-byte stem of the other one, the stem of the last one.
    expected = {(0, found[first[0]]), (0, found[second][kinds[second] == 5][0]), (2, found[first[1]])}
    assert {(r, entries[i]) for r, i in zip(row, place)} == expected


def test_counts_and_lexicon(spark):
    docs, labels = _insults(spark)
    sample = toxicity._sample(docs, labels, (2500, 7500))
    rows = sample.collect()
    counted = {r["feature"]: (r["bad"], r["of"]) for r in toxicity._counts(sample.repartition(3)).collect()}
    expected: dict = {}
    for row in rows:
        [chunk] = toxicity.chunks(pa.array([row["text"]]))
        for feature in set(toxicity._features(chunk)[1].view(np.int64).tolist()):
            bad, of = expected.get(feature, (0, 0))
            expected[feature] = (bad + row["toxic"], of + 1)
    assert counted == {f: c for f, c in expected.items() if c[0]}
    names, kinds = toxicity._lexicon(toxicity._counts(sample), 0.125, 1000)
    assert len(names) and (np.diff(names.astype(object)) > 0).all()
    few, _ = toxicity._lexicon(toxicity._counts(sample), 0.125, 3)
    assert len(few) == 3 and set(few) <= set(names)


def test_very_long_and_empty_texts(spark):
    docs, labels = _insults(spark)
    model = toxicity.fit_toxicity(docs, labels)
    clean = "na kesa " * 300_000
    scores = model.scores(pa.array([clean, clean + "zorfil brukk zorfuck zorfan", "", None, "123"]))
    assert scores[0] == scores[2] == scores[3] == scores[4] and scores[1] > 0.5 > scores[0]


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(
        [(5001, None, "en", "s", 0), (5002, "", "de", "s", 0), (5003, "123 --- 456", "fr", "s", 9), (None, "the", None, None, 3)],
        docs.schema,
    )
    got = language.language_digest(docs.unionByName(odd)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert [(by_id[i]["lang_pred"], by_id[i]["score"]) for i in (5001, 5002, 5003)] == [("und", 0.0)] * 3
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in lang if by_id[i]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == by_id[i]["held_out"] for i in lang)
    assert np.mean([by_id[i]["lang_pred"] == lang[i] for i in held]) > 0.97


def test_language_tables_give_the_filters(documents):
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (6, language.WINDOW)).astype(np.uint8)
    network = language.train(windows, np.array([0, 1, 0, 1, 0, 1]), ["a", "b"])
    pooled = network.pooled(windows, network._tables())
    embedded = network.embedding[windows]
    for i, kernel in enumerate(network.filters):
        size = language.WINDOW - len(kernel) + 1
        plain = sum(embedded[:, k : k + size] @ kernel[k] for k in range(len(kernel))).max(axis=1)
        own = pooled[:, i * language.FILTERS : (i + 1) * language.FILTERS]
        assert np.allclose(own, np.maximum(plain, 0), atol=1e-4)
    frame = documents("x", None).withColumn("score", F.lit("old")).withColumn("__letter", F.lit(1))
    out = language.identify_language(frame, network)
    assert {r["lang_pred"] for r in out.collect()} <= {"a", "b", "und"}
    assert language.identify_language(frame, None).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language.language_digest(documents().where("1 = 0")).count() == 0
