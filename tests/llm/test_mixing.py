"""Source mixing: targets, quotas and what is taken."""

from __future__ import annotations

import heapq
import random

from pyspark.sql import functions as F

from arledger.llm.mixing import mix_sources, mixed_texts, sainte_lague


def test_quotas_are_those_of_highest_quotients(spark):
    rng = random.Random(2)
    for seats in (0, 1, 7, 100, 1003):
        votes = [rng.random() * 10 ** rng.randrange(4) for _ in range(25)] + [0.0, 5.0, 5.0, 5.0]
        frame = spark.createDataFrame(list(enumerate(votes)), "party int, votes double")
        got = {r["party"]: r["quota"] for r in sainte_lague(frame, seats, ["party"]).collect()}
        heap = [(-v, i, 1) for i, v in enumerate(votes) if v]
        heapq.heapify(heap)
        want = [0] * len(votes)
        for _ in range(seats):
            _, i, k = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * k + 1), i, k + 1))
        assert [got[i] for i in range(len(votes))] == want


def _docs(documents):
    rng = random.Random(4)
    rows = []
    for source, count in (("a", 400), ("b", 60), ("c", 5), (None, 30), ("empty", 3), ("ä", 1)):
        for _ in range(count):
            size = 0 if source == "empty" else rng.choice((1, 3, 40, 300))
            rows.append((len(rows), " \n".join(["word"] * size), "en", source))
    return documents(*rows, (len(rows), None, "en", "a"), (0, rows[0][1], "en", "a"))


def test_targets_and_takings(documents):
    frame = _docs(documents)
    got = mix_sources(frame, shard_docs=50).collect()
    assert len(got) == frame.count()
    of: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        total = of.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        total[0] += r["size"]
        total[1] += r["taken"]
    order = sorted((s for s in of if s is not None), key=lambda s: s.encode()) + [None]
    budget = 1.5 * sum(t[0] for t in of.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    level, capped = 0.0, set()
    while True:
        free = [s for s in order if s not in capped]
        level = (budget - sum(2 * of[s][0] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if 2 * of[s][0] <= level * weight[s]}
        if not over:
            break
        capped |= over
    for s in order:
        size, taken, source_size, target = of[s]
        want = min(2 * size, level * weight[s])
        assert source_size == size and abs(target - want) < 1e-6 * max(1, want)
        assert abs(taken - target) <= 1
    again = mix_sources(frame.repartition(7), shard_docs=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_texts_hold_what_is_taken(documents):
    frame = _docs(documents).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(None).cast("int"))
    out = mixed_texts(frame, shard_docs=50)
    assert out.columns == frame.columns
    words = sum(len(r["text"].split()) for r in out.collect())
    assert abs(words - 1.5 * sum(len((r["text"] or "").split()) for r in frame.collect())) <= 6
    assert mixed_texts(frame.where("1 = 0")).count() == 0
    only_empty = documents("", None)
    assert [r["taken"] for r in mix_sources(only_empty).collect()] == [0, 0]
