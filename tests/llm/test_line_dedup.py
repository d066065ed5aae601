"""Line dedup against a comparison of all lines."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from arledger.llm.line_dedup import dedup_lines, line_dedup_digest


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion or substitution apart."""
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    return a[at:] == b[at + 1 :] or a[at + 1 :] == b[at:] or a[at + 1 :] == b[at + 1 :]


def brute_force(texts: list[str | None], least: int = 20, short_copies: bool = False) -> list[str | None]:
    seen: list[str] = []
    short: set[str] = set()
    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        kept = []
        for line in text.split("\n"):
            known = len(line) >= least and any(
                one_edit(line, s) for s in seen
            )
            if len(line) >= least:
                seen.append(line)
            elif short_copies and line.strip(" \t\n\x0b\x0c\r"):
                known = line in short
                short.add(line)
            if not known:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def edited(rng: random.Random, line: str) -> str:
    at = rng.randrange(len(line) + 1)
    kind = rng.randrange(4)
    if kind == 0:
        return line[:at] + rng.choice("abé") + line[at:]
    if kind == 1:
        return line[:at] + line[at + 1 :]
    if kind == 2:
        return line[:at] + "z" + line[at + 1 :]
    return line


def test_against_all_pairs(documents):
    rng = random.Random(3)
    lines = []
    for size in (19, 20, 21, 40, 63, 64, 65, 66, 127, 128, 129, 192, 300):
        base = "".join(rng.choice("abcdeé ") for _ in range(size))
        lines += [edited(rng, edited(rng, base)) if rng.random() < 0.3 else edited(rng, base) for _ in range(14)]
        lines += [base + "x", "x" + base, base[1:], base[:-1]]
    rng.shuffle(lines)
    texts: list = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]
    texts += [None, "", "\n\n", "short", "short"]
    out = dedup_lines(documents(*texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == brute_force(texts)


def test_copies_columns_and_odd_rows(spark, documents):
    line = "the same line of some length, again and again"
    frame = documents(line, f"{line}\nown", (7, line, "en"), (7, line, "en"), (None, line))
    frame = frame.withColumn("line", F.lit(1)).withColumn("h1", F.lit("x")).withColumn("place", F.lit(2))
    out = dedup_lines(frame)
    assert out.columns == frame.columns
    # The null id is the earliest; repeated rows share their document's result.
    rows = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert rows == [(0, ""), (1, "own"), (7, ""), (7, ""), (None, line)]
    kept = dedup_lines(frame, drop_emptied=True)
    assert kept.count() == 2


def test_empty_table_and_long_line(documents):
    assert dedup_lines(documents().where("1 = 0")).count() == 0
    assert line_dedup_digest(documents().where("1 = 0")).count() == 0
    long = "abcdefghij " * 20_000
    out = dedup_lines(documents(long, long[:50_000] + "!" + long[50_000:], long + "more than one")).orderBy("doc_id")
    assert [len(r["text"]) for r in out.collect()] == [len(long), 0, len(long) + 13]


def test_copies_of_short_lines(spark, documents):
    import corpus_pipeline

    long = "a line that is long enough to be compared with others"
    text = f"{long}\nMent que.\n \n\n}}\n"
    texts = [text, text, f"Ment quf.\n{long}\nMent que.\nown", " \n", f"\t\n{long}x\n}}", None]
    out = corpus_pipeline.line_dedup(spark, documents(*texts), "").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [
        (0, text), (2, "Ment quf.\nown"), (3, " \n"), (5, None)
    ]
    # Without it, short lines stay.
    kept = dedup_lines(documents(*texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in kept][1] == "Ment que.\n \n\n}\n"


def test_digest_drops_exact_repeats_of_short_lines(documents):
    rng = random.Random(8)
    words = ["short a", "short b", "short a ", " ", "", "x", "}", "a line that is long enough to be compared"]
    texts = ["\n".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(30)] + [None]
    want = brute_force(texts, short_copies=True)
    assert want != brute_force(texts)
    got = line_dedup_digest(documents(*texts)).orderBy("doc_id").collect()
    assert [r["kept_sha256"] for r in got] == [hashlib.sha256((t or "").encode()).hexdigest() for t in want]
