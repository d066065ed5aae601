"""The pipeline on a small table, and the registration of its queries."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from arledger.llm import packing
from arledger.llm.common import stored_at, table
from test_line_dedup import brute_force as line_brute_force
from test_ngram_join import brute_force as join_brute_force

SF_DIR = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = set(entry.queries())
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", name)) for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= names


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        kept = [r["doc_id"] for r in out.collect()]
        assert out.columns == columns and len(kept) == len(set(kept)) and set(kept) <= ids
        assert len(kept) >= 0.6 * len(ids), name
        docs, ids = out, set(kept)
    name, pack = corpus_pipeline.STAGES[-1]
    pieces = pack(spark, docs, SF_DIR).collect()
    assert {r["doc_id"] for r in pieces} == ids
    empty = docs.where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0, name


def _planted(spark, folder):
    """A small corpus with toxic texts, copies, repeated lines, nulls, odd rows and a clashing column."""
    rng = random.Random(12)

    def word():
        return "".join(rng.choice("aeioknst") for _ in range(rng.randrange(2, 8)))

    def prose(lines=3, size=25):
        return "\n".join(" ".join(word() for _ in range(size)) for _ in range(lines))

    rows, labels = [], []
    for i in range(540):
        text, bad = prose(), i % 9 == 0
        if bad:
            words = text.split(" ")
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(("zorfil", "brukk", "zorfuck"))
            text = " ".join(words)
        rows.append((i, text, "en", rng.choice(("a", "b", "c", None)), len(text)))
        labels.append((i, 1, int(bad)))
    clean = [r[1] for r in rows if r[0] % 9]
    boiler = "all rights of this long line are reserved by someone"
    texts: list = [clean[3], clean[3], clean[5] + "\n" + boiler, boiler + "s\nown words here\nShort.", "Short.\nother words", "", None, " \n\t"]
    for k in range(6):  # near copies: single words replaced in the middle of long lines
        parts = clean[11].split(" ")
        parts[10 + k] = "changed"
        texts.append(" ".join(parts))
    texts += ["long " + " ".join(word() for _ in range(9000)), "ä ß 東京\x00 end"]
    rows += [(2000 + i, t, "en", "a", None) for i, t in enumerate(texts)]
    rows += [rows[1], rows[-1], (None, prose(), None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("score", F.lit("clash")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame.write.parquet(f"{folder}/labels.parquet")


def _rows(frame):
    return [r.asDict() for r in frame.orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()]


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    _planted(spark, folder)
    kept: list = []

    def noted(frame):
        out, path = stored_at(frame)
        kept.append(_rows(out))
        return out, path

    monkeypatch.setattr(corpus_pipeline, "stored_at", noted)
    source = _rows(table(spark, folder, "documents"))
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert len(kept) == 4 and all(set(r) == set(source[0]) for stage in kept for r in stage)

    # Toxicity: planted documents go, held out or not, clean ones stay as they are.
    assert kept[0] == [r for r in source if r["doc_id"] is None or r["doc_id"] % 9 or r["doc_id"] >= 2000]

    # Lines: those of the earliest document stay; rows that are equal share their result.
    different = {(r["doc_id"], r["text"]): None for r in kept[0]}
    cut = dict(zip(different, line_brute_force([t for _, t in different], short_copies=True)))
    want = []
    for r in kept[0]:
        text = cut[r["doc_id"], r["text"]]
        if text == r["text"] or text.strip(" \t\n\x0b\x0c\r"):
            want.append((r["doc_id"], text))
    assert [(r["doc_id"], r["text"]) for r in kept[1]] == want
    assert len(want) < len(kept[0]) and any(a["text"] != cut[a["doc_id"], a["text"]] for a in kept[0])

    # Near copies: the smallest id of each component, rows without a shingle all stay.
    smallest = {}
    for i, (_, component) in join_brute_force({r["doc_id"]: r["text"] for r in kept[1] if r["doc_id"] is not None}).items():
        smallest[i] = component
    stay = {i for i, c in smallest.items() if i == c} | {None}
    assert {r["doc_id"] for r in kept[2]} == stay
    assert all(r in kept[1] for r in kept[2])

    # Mixing: each text is its whole copies and the words of the last one; sources meet their targets.
    text_of = {r["doc_id"]: r["text"] for r in kept[2]}
    before, after = Counter(), Counter()
    for r in kept[2]:
        before[r["source"]] += len(words_of(r["text"]))
    for r in kept[3]:
        own, taken = words_of(text_of[r["doc_id"]]), words_of(r["text"])
        assert taken == (own * 3)[: len(taken)] and 0 < len(taken) <= 2 * len(own)
        after[r["source"]] += len(taken)
    order = sorted(s for s in before if s is not None) + [None]
    targets = targets_of({s: before[s] for s in order}, order)
    assert all(abs(after[s] - targets[s]) <= 1 for s in order)

    # Packing: the pieces hold as many ids as the whole tokenizer gives, in windows of 4096.
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = Counter()
    for r in kept[3]:
        own = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        ids[r["doc_id"], len(own)] += 1
    assert {r["doc_id"] for r in pieces} == {i for i, _ in ids}
    by_doc: dict = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for i, parts in by_doc.items():
        of = [n for (d, n), k in ids.items() if d == i for _ in range(k)]
        assert sum(length for _, length, _ in parts) == sum(of) and {n for _, _, n in parts} == set(of)
    used = Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets_of(sizes, order):
    """Shares of 150% by weights 3, 1, 2, none above twice its size."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if 2 * sizes[s] < level * weight[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over
