"""Packing token sequences by non-negative least squares.

A document's ids are cut into windows of ``window`` ids and a remainder. Full windows are
sequences by themselves. Remainders are counted in length bins; combinations of up to four
bins that fill a window are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left is packed greedily, longest bin
first, in patterns that repeat until a bin is used up. All of that works on the histogram, whose
size is fixed; documents meet their place by their rank within their bin.

Defined cases: null and empty texts have only the end id; equal rows are documents of their
own; texts have no length limit; an empty table gives an empty result; other columns do not
matter.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arledger.llm.common import narrowed, stored

WINDOW = 4096
END_ID = 2
#: Lengths are rounded up to multiples of window / BINS.
BINS = 256
#: Words and parts whose ids a worker remembers, at some 200 bytes each; beyond it, it starts
#: anew.
_REMEMBERED = 2_500_000
#: Bytes of texts that are worked on at once.
_RUN_BYTES = 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts, put together from the ids of their words.

    The known tokenizer drops white space and never joins across it, so the ids of a text are
    those of its words in order, and most words have been seen before. Texts are split and
    their different words found by Arrow; ids are looked up, or worked out, once per different
    word of a batch, and laid out by array operations. A new word of plain Latin letters, digits and
    signs is lowered and cut here by the tokenizer's own pattern, and its parts, which many words
    share, go to the tokenizer's model; any other word goes through the whole tokenizer.

    Of a file with another normalizer or pattern, whole texts go through the whole tokenizer.
    """

    # The known tokenizer's normalizer and pattern.
    _NORMALIZERS = [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ]
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # The pattern for words of these characters only.
    _PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    _PARTS = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]"
        r"|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
    )

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self.known = self._is_known(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self._as_bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        self._ids: dict[str, bytes] = {"": b""}
        self._part_ids: dict[str, bytes] = {}

    @classmethod
    def _is_known(cls, path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        split, *rest = (given["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        return (
            (given["normalizer"] or {}).get("normalizers") == cls._NORMALIZERS
            and split.get("pattern") == {"Regex": cls._PATTERN}
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
            and [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest]
            == [("ByteLevel", False, False)]
            # Special tokens are no parts of plain words, and hold no white space.
            and all(t["content"].startswith("<|") and not t["content"].split()[1:] for t in given["added_tokens"])
        )

    def _part(self, part: str) -> bytes:
        ids = self._part_ids.get(part)
        if ids is None:
            tokens = self._model.tokenize(part.translate(self._as_bytes))
            ids = self._part_ids[part] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids

    def _learn(self, words: set[str]) -> None:
        other = []
        for word in words:
            if "<|" not in word and self._PLAIN.fullmatch(word):
                self._ids[word] = b"".join(map(self._part, self._PARTS.findall(word.lower())))
            else:
                other.append(word)
        for word, got in zip(other, self._whole(other)):
            self._ids[word] = got

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(got.ids, dtype="<u4").tobytes() for got in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, ends = self.encode_array(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of all texts one after another, and where each text's ids end."""
        if not self.known:
            found = self._whole(texts.to_pylist())
            ends = np.cumsum([len(x) // 4 for x in found], dtype=np.int64)
            return np.frombuffer(b"".join(found), dtype="<u4"), ends
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_pylist()
        if len(self._ids) + len(self._part_ids) > _REMEMBERED:
            self._ids, self._part_ids = {"": b""}, {}
        self._learn({word for word in different if word not in self._ids})
        ids_of = [self._ids[word] for word in different]
        table = np.frombuffer(b"".join(ids_of), dtype="<u4")
        size = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        first = np.cumsum(size) - size
        at = words.indices.to_numpy(zero_copy_only=False)
        sizes = size[at]
        after = np.cumsum(sizes)
        place = np.arange(after[-1] if len(after) else 0) + np.repeat(first[at] - (after - sizes), sizes)
        bounds = split.offsets.to_numpy()
        ends = np.concatenate([[0], after])[bounds[1:] - bounds[0]]
        return table[place], ends


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows first to last (not included) of about ``_RUN_BYTES``; a longer text stands alone."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = size[first - 1] if first else 0
        last = max(int(np.searchsorted(size, before + _RUN_BYTES, side="right")), first + 1)
        yield first, last
        first = last


def document_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of each document: doc_id, start, length, ids_crc32, doc_tokens, and a piece id
    that is fixed with the stored table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordTokenizer(tokenizer)
        encode = _TOKENIZERS[tokenizer].encode_array
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            for low, high in _runs(texts):
                ids, ends = encode(texts.slice(low, high - low))
                ids = np.insert(ids, ends, END_ID).astype("<u4", copy=False)
                ends = ends + np.arange(1, len(ends) + 1)
                total = np.diff(ends, prepend=0)
                count = -(-total // window)
                row = np.repeat(np.arange(len(total)), count)
                start = window * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
                length = np.minimum(window, total[row] - start)
                at = (ends - total)[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at + length)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low).take(pa.array(row)),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row])),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    pieces = narrowed(docs, "doc_id", "text").mapInArrow(
        cut,
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint",
    )
    return stored(pieces.withColumn("piece", F.monotonically_increasing_id()))


def combinations(bins: int) -> np.ndarray:
    """Columns of bin counts that add up to ``bins``: all of up to three bins, and those of
    four that are multiples of a coarser step."""
    step = max(1, bins // 32)
    found: list[tuple[int, ...]] = [(b, bins - b) for b in range(1, bins // 2 + 1)]
    found += [
        (a, b, bins - a - b)
        for a in range(1, bins // 3 + 1)
        for b in range(a, (bins - a) // 2 + 1)
    ]
    coarse = range(step, bins // 2 + 1, step)
    found += [
        (*three, bins - sum(three))
        for three in combinations_with_replacement(coarse, 3)
        if bins - sum(three) >= three[-1]
    ]
    found += [(b,) for b in range(bins - bins // 64, bins + 1)]
    matrix = np.zeros((bins + 1, len(found)), dtype=np.int16)
    for column, parts in enumerate(found):
        for part in parts:
            matrix[part, column] += 1
    return matrix


def non_negative_least_squares(matrix: np.ndarray, target: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Minimizes ``|matrix @ x - target|`` over x >= 0 by the active-set method."""
    a = matrix.astype(np.float64)
    x = np.zeros(a.shape[1])
    active: list[int] = []
    enough = 1e-9 * max(1.0, float(np.abs(target).max()))
    for _ in range(rounds):
        slope = a.T @ (target - a[:, active] @ x[active])
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= enough * len(target):
            break
        active.append(best)
        while True:
            part = a[:, active]
            solved = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ target)
            low = solved <= 0
            if not low.any():
                x[active] = solved
                break
            now = x[active]
            step = np.min(now[low] / np.maximum(now[low] - solved[low], 1e-300))
            now = now + step * (solved - now)
            stay = now > 1e-10 * (1 + now.max())
            x[active] = np.where(stay, now, 0)
            active = [i for i, s in zip(active, stay) if s]
            if not active:
                break
    return x


@dataclass
class Plan:
    """Patterns of bins; per pattern and bin, the ranks of the bin that it takes."""

    sequences: int = 0
    places: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)

    def add(self, used: np.ndarray, pattern: dict[int, int], times: int) -> None:
        slot = 0
        for b, uses in pattern.items():
            first = int(used[b])
            self.places.append((b, first, first + uses * times, uses, self.sequences, slot))
            used[b] += uses * times
            slot += uses
        self.sequences += times


def plan_sequences(histogram: np.ndarray) -> Plan:
    """Packs a histogram over bins 0 .. BINS, bin b taking b units of the window's BINS."""
    bins = len(histogram) - 1
    left, used, plan = histogram.astype(np.int64).copy(), np.zeros(bins + 1, np.int64), Plan()
    matrix = combinations(bins)
    repeats = non_negative_least_squares(matrix, histogram.astype(np.float64))
    for column in np.argsort(-repeats, kind="stable"):
        if repeats[column] < 1 - 1e-6:
            break
        pattern = {int(b): int(matrix[b, column]) for b in np.flatnonzero(matrix[:, column])}
        times = min(int(repeats[column] + 1e-6), *(int(left[b]) // u for b, u in pattern.items()))
        if times > 0:
            plan.add(used, pattern, times)
            for b, uses in pattern.items():
                left[b] -= uses * times
    while left.any():
        pattern, room = {}, bins
        for b in range(bins, 0, -1):
            uses = min(room // b, int(left[b]))
            if uses:
                pattern[b] = uses
                room -= uses * b
        times = min(int(left[b]) // uses for b, uses in pattern.items())
        plan.add(used, pattern, times)
        for b, uses in pattern.items():
            left[b] -= uses * times
    return plan


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, bins: int = BINS
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window % bins:
        raise ValueError("bins must divide the window")
    pieces = document_pieces(docs, tokenizer or default_tokenizer(), window)
    unit = window // bins
    full = pieces.where(F.col("length") == window).select(
        "*", (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = (
        pieces.where(F.col("length") < window)
        .withColumn("bin", F.ceil(F.col("length") / unit).cast("int"))
        .withColumn("part", F.shiftright("piece", 33))
    )
    # Ranks within a bin: counted per writing task, so a bin is never sorted in one task.
    counts = stored(rest.groupBy("bin", "part").agg(F.count("*").alias("n")))
    histogram = np.zeros(bins + 1, dtype=np.int64)
    for row in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        histogram[row["bin"]] = row["n"]
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    own = F.row_number().over(Window.partitionBy("bin", "part").orderBy("piece"))
    ranked = rest.withColumn("own", own).join(starts, ["bin", "part"]).withColumn(
        "rank", F.col("first") + F.col("own") - 1
    )
    places = docs.sparkSession.createDataFrame(
        plan_sequences(histogram).places,
        "p_bin int, low bigint, high bigint, uses bigint, base bigint, slot bigint",
    )
    # The plan has some patterns per bin, whatever the number of documents.
    met = (
        (F.col("bin") == F.col("p_bin"))
        & (F.col("rank") >= F.col("low"))
        & (F.col("rank") < F.col("high"))
    )
    since = F.col("rank") - F.col("low")
    placed = (
        ranked.join(F.broadcast(places), met)
        .withColumn("sequence", F.col("base") + F.floor(since / F.col("uses")))
        .withColumn("place", F.col("slot") + since % F.col("uses"))
    )
    ahead = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    packed = placed.select(
        *pieces.columns,
        (F.col("sequence") * 2).alias("sequence_id"),
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"),
    )
    return full.unionByName(packed).drop("piece")
