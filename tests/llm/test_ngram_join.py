"""The n-gram join against a comparison of all pairs."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from arledger.llm.components import connected_components
from arledger.llm.ngram_join import drop_near_copies, ngram_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_against_all_pairs(documents):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünter", "the"]
    boiler = "this line is on very many pages of the site and means nothing".split()
    texts: dict[int, str | None] = {}
    for base in range(9):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((4, 5, 6, 20, 60, 150)))]
        for _ in range(9):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[len(texts)] = rng.choice((" ", "\t", " \n")).join(copy).upper() if base % 2 else " ".join(copy)
    for i in range(20):  # mostly boilerplate, not similar enough or just so
        texts[len(texts)] = " ".join([*boiler, *(f"x{i}" for _ in range(i % 4))])
    texts |= {200: None, 201: "", 202: " \t\n", 203: "one", 204: "ONE", 205: "one two"}
    got = ngram_components(documents(*texts.items())).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_force(texts)


def test_near_copies_keep_one(documents):
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words[:40], f"v{i}", *words[40:]])) for i in range(30)]
    rows += [(90, None), (91, ""), (91, ""), (None, " ".join(words)), (95, "something else")]
    frame = documents(*rows).withColumn("n", F.lit(1)).withColumn("component_id", F.lit("x"))
    out = drop_near_copies(frame)
    assert out.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["0", "90", "91", "91", "95", "None"]
    assert drop_near_copies(frame.where("1 = 0")).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90}
