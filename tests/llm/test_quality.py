"""Quality rules against a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from arledger.llm.quality import apply_quality_rules, quality_digest, rules


def measures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def _texts() -> list:
    rng = random.Random(6)
    texts: list = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "a b c a b c", "\x0bx\x0c"]
    for _ in range(40):
        words = [rng.choice(("a", "b", "é", "##", "LOUD", "c|d", "日本")) for _ in range(rng.randrange(1, 120))]
        texts.append("".join(w + rng.choice((" ", "  ", "\n", "\n\n", "\t")) for w in words))
    texts.append("long " * 30_000)
    return texts


def test_measures(documents):
    texts = _texts()
    got = quality_digest(documents(*texts, (0, None))).orderBy("doc_id").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got[1:]:
        want = measures(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert len(got) == len(texts) + 1


def test_order_does_not_change_what_is_kept(documents):
    plain = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(80))
    texts = [plain, plain.upper(), plain.replace(" ", " ## "), (plain[:300] + "\n") * 4, "few words", "x " * 60]
    frame = documents(*texts).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit("old"))
    names = sorted(rules())
    kept = []
    for order in (names, names[::-1], None):
        out = apply_quality_rules(frame, order=order).orderBy("doc_id").collect()
        assert out[0]["n_words"] == "clash"
        kept.append([r["kept"] for r in out])
    assert kept[0] == kept[1] == kept[2] == [True, False, False, False, False, False]
    assert apply_quality_rules(frame.where("1 = 0")).count() == 0
