"""Packing: every id once, sequences without gaps, little padding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from arledger.llm import packing


def test_ids_are_those_of_whole_texts():
    words = packing.WordTokenizer(packing.default_tokenizer())
    texts = [
        "Don't stop, it's THE end's 12ab3 test_under \"'s ÄÖÜß naïve × ÷", "", " \n\t\x0b ", "<|endoftext|> a<|endoftext|>b",
        "ΑΣ İstanbul ½ ² 日本語 é  nbsp em \x1c ctl \x00 nul", "x" * 3000,
    ]
    whole = words._tokenizer.encode_batch(texts, add_special_tokens=False)
    assert words.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_least_squares_finds_exact_mixes():
    rng = np.random.default_rng(3)
    matrix = rng.integers(0, 3, (20, 60))
    truth = np.zeros(60)
    truth[[3, 10, 40]] = (5, 100, 17)
    found = packing.non_negative_least_squares(matrix, matrix @ truth)
    assert found.min() >= 0 and np.abs(matrix @ found - matrix @ truth).max() < 1e-4


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_places_all(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(257, dtype=np.int64)
    np.add.at(histogram, np.minimum(256, 1 + rng.exponential(60, 20_000).astype(int)), 1)
    plan = packing.plan_sequences(histogram)
    placed = np.zeros(257, dtype=np.int64)
    for b, low, high, *_ in plan.places:
        assert low == placed[b]
        placed[b] = high
    assert (placed == histogram).all()
    units = (histogram * np.arange(257)).sum()
    assert units <= plan.sequences * 256 < units * 1.01 + 512


def test_pieces(documents):
    rng = random.Random(3)
    texts: list = [None, "", "one", "one"] + [
        " ".join(rng.choice(("alpha", "beta", "zeta-9", "Öl")) for _ in range(rng.choice((5, 300, 900, 6000))))
        for _ in range(60)
    ]
    got = packing.pack_documents(documents(*texts)).collect()
    ids = packing.WordTokenizer(packing.default_tokenizer()).encode([t or "" for t in texts])
    ids = [i + (2).to_bytes(4, "little") for i in ids]
    seen, sequences = {}, {}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) // 4
        piece = own[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert len(piece) == 4 * r["length"] and zlib.crc32(piece) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc]) // 4
    assert len(seen) == len(texts)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(documents().where("1 = 0")).count() == 0


def test_another_tokenizer_is_used_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(packing.default_tokenizer(), encoding="utf-8") as file:
        other = json.load(file)
    other["normalizer"]["normalizers"].pop()  # keeps capitals
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    words = packing.WordTokenizer(str(path))
    texts = ["Capital LETTERS stay", "", "x y"]
    assert packing.WordTokenizer(packing.default_tokenizer()).known and not words.known
    whole = Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)
    assert words.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_runs_of_texts(documents, monkeypatch):
    """Texts beyond a run, clashing names, equal lengths: the same pieces whatever the runs."""
    from pyspark.sql import functions as F

    texts = [None, "", "word " * 9000, "a", "a", " lead", "tail ", "Ä ß " * 50, "x" * 5000] * 3
    frame = documents(*texts).withColumn("piece", F.lit("clash")).withColumn("start", F.lit("clash")).coalesce(1)

    def pieces():
        got = packing.document_pieces(frame, packing.default_tokenizer(), 512).drop("piece")
        return sorted(map(tuple, got.collect()))

    want = pieces()
    assert {r[0] for r in want} == set(range(27))
    words = packing.WordTokenizer(packing.default_tokenizer())
    assert [words.encode([t or ""])[0] for t in texts] == words.encode([t or "" for t in texts])
    whole = words._tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert {r[0]: r[4] for r in want} == {i: len(e.ids) + 1 for i, e in enumerate(whole)}
    assert [i for i, e in enumerate(words.encode([])) if e] == []
    assert sum(r[2] for r in want) == sum(len(e.ids) + 1 for e in whole)
