"""Repeated strings against a count of all of them."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arledger.llm import suffix_dedup
from arledger.llm.common import stored


def brute_force(texts: list[str | None]) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if count[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _texts() -> list:
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [word(n) for n in (390, 395, 400, 401, 450, 900)]
    texts: list = [None, "", "short", "short", "x" * 399, "x" * 1500, "ab" * 700]
    for _ in range(40):
        parts = [word(rng.randrange(0, 300)), rng.choice(passages), word(rng.randrange(0, 300))]
        if rng.random() < 0.4:
            cut = rng.choice(passages)
            at = rng.randrange(len(cut))
            parts.append(cut[:at] + "Z" + cut[at:])
        texts.append("".join(parts))
    return [*texts, texts[-1], texts[-1]]


@pytest.mark.parametrize("most", [1000, 3])
def test_against_a_count_of_all_strings(documents, monkeypatch, most):
    """With few neighbourhoods to an anchor, and with the way for very many."""
    monkeypatch.setattr(suffix_dedup, "_MOST", most)
    monkeypatch.setattr(suffix_dedup, "_BUCKET_BYTES", 20_000)
    texts = _texts()
    got = suffix_dedup.repeats_digest(documents(*texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_force(texts)


def test_merge_of_shards():
    rng = random.Random(5)
    for size in (1, 2, 30):
        base = [bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(380, 800))) for _ in range(4)]
        parts = []
        for _ in range(size):
            part = bytearray(rng.choice(base))
            if rng.random() < 0.6:
                part[rng.randrange(len(part))] = 65
            parts.append(bytes(part[rng.randrange(60) :]))
        parts += [b"a" * 500, b"a" * 30, b""]
        count = Counter(p[i : i + 400] for p in parts for i in range(len(p) - 399))
        want = [[i for i in range(len(p) - 399) if count[p[i : i + 400]] > 1] for p in parts]
        assert [list(x) for x in suffix_dedup.repeated_starts(parts)] == want


def test_frames(documents):
    passage = "".join(chr(97 + i * i % 26) for i in range(600)) + "é"
    frame = documents("start " + passage, passage + " end", None, (3, None)).withColumn("t", F.lit("x"))
    out = suffix_dedup.remove_repeats(frame.withColumn("copies", F.lit(5)))
    assert out.columns == [*frame.columns, "copies"]
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows] == ["start ", " end", None, None]
    assert suffix_dedup.repeats_digest(frame.where("1 = 0")).count() == 0


def test_copies_are_cut_once(documents):
    """Copies, and repeated rows, that share a passage with another text."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    passage = word(1500)
    copied = word(300) + passage
    texts = [copied, copied, copied, passage + word(200), (0, copied), (0, copied)]
    rows = stored(suffix_dedup._texts(documents(*texts)).coalesce(2))
    near = suffix_dedup._neighbourhoods(suffix_dedup._anchors(rows))
    places = near.groupBy("t", "pos").count().collect()
    assert places and {r["count"] for r in places} == {1}


def test_periodic_texts_have_few_neighbourhoods(documents):
    """Megabytes of a short period: a row per place in the period, and every byte goes."""
    texts = ["x" * 3_000_000, "ab" * 500_000, "abcdefghij " * 60_000, "x" * 399, "tail " + "x" * 500 + " end"]
    rows = suffix_dedup._texts(documents(*texts))
    assert suffix_dedup._anchors(rows).count() < 40
    got = suffix_dedup.repeats_digest(documents(*texts)).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got] == [
        (3_000_000, 3_000_000, 1), (1_000_000, 1_000_000, 1), (660_000, 660_000, 1), (399, 0, 0), (509, 500, 1),
    ]


def test_passage_at_even_distances(documents):
    """A passage that comes again and again in one text, nearer and farther than its length."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage = word(700)
    texts = [passage.join(word(n) for n in (5, 90, 90, 90, 3000, 3000, 3000, 7)), (passage + "Q") * 6, word(4000)]
    got = suffix_dedup.repeats_digest(documents(*texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_force(texts)
