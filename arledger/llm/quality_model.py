"""Quality scores from histogram gradient-boosted trees over document statistics.

1. Statistics of whole texts (sizes, shares of kinds of characters, word lengths, repeated words,
   lines and word triples, entropy) are worked out in tasks from the bytes of Arrow batches, by array
   operations over many texts at once.
2. The statistics of a bounded sample of labelled documents come to the driver, as rows of
   numbers. Each statistic is cut into at most ``BINS`` bins at its quantiles.
3. Trees are grown one after another on the gradients of the logistic loss: a node's histogram
   of gradients per statistic and bin gives the best split; of two children, the smaller one is
   counted and the other one is the difference.
4. All trees lie in flat arrays (statistic, threshold, left child, value). A batch goes down all
   trees side by side, one level per array operation.

Labels, language, source and id are no inputs of a score. Labels are only learned from documents
whose id is not held out.

Defined cases: null texts count as empty; empty texts get the score of their statistics; texts
have no length limit; equal texts get equal scores; a document that is labelled more than once
counts that often; labels that are null or neither 0 nor 1 are not learned from; without labelled
documents every score is 0.5; an empty table gives an empty result; other columns pass through
``score_quality``, where ``quality_score`` replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.llm.byte_text import IS_LETTER, IS_SPACE, LOWER, Chunk, Rolling, chunks, mix
from arledger.llm.common import narrowed

#: Bound on the labelled documents that trees are fitted on.
SAMPLE = 20_000
BINS = 64
TREES, DEPTH, RATE = 120, 4, 0.1
#: Least sum of second derivatives in a leaf, and the penalty on leaf values.
LEAST_WEIGHT, PENALTY = 5.0, 2.0
#: Score from which a document is predicted to be good.
THRESHOLD = 0.3

#: Byte classes whose share of a text is a statistic.
_CLASSES = {
    "space": IS_SPACE,
    "letter": IS_LETTER,
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "stop": np.isin(np.arange(256), [ord(c) for c in ".!?"]),
    "pause": np.isin(np.arange(256), [ord(c) for c in ",;:"]),
    "symbol": np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"]),
    "bracket": np.isin(np.arange(256), [ord(c) for c in "()[]{}"]),
    "shout": np.arange(256) == ord("!"),
    "bar": np.arange(256) == ord("|"),
    "beyond": np.arange(256) >= 128,
}
STATISTICS = (
    "bytes words lines mean_word long_word short_words distinct_words top_word repeated_triples repeated_lines "
    "blank_lines line_bytes longest_word capital_words words_with_symbols words_with_stop entropy"
).split() + [f"share_{name}" for name in _CLASSES]


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n).astype(np.float64)


def _groups(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and size of each group of equal hashes within a row."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return rows[first], np.diff(np.append(first, len(rows)))


def _largest(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, rows, values)
    return out


def _entropy(chunk: Chunk) -> np.ndarray:
    """Bits per byte of each row, from its byte counts; a few rows at a time."""
    n = len(chunk)
    out = np.zeros(n)
    for low in range(0, n, 4096):
        high = min(low + 4096, n)
        data = chunk.data[chunk.offsets[low] : chunk.offsets[high]]
        size = np.diff(chunk.offsets[low : high + 1])
        key = np.repeat(np.arange(high - low) * 256, size) + data
        counts = np.bincount(key, minlength=(high - low) * 256).reshape(-1, 256)
        share = counts / np.maximum(size, 1)[:, None]
        out[low:high] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    return out


def statistics_of(chunk: Chunk) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    n, data = len(chunk), chunk.data
    size = np.diff(chunk.offsets).astype(np.float64)
    some = np.maximum(size, 1)
    made: dict[str, np.ndarray] = {"bytes": np.log1p(size), "entropy": _entropy(chunk)}
    counted = {}
    for name, members in _CLASSES.items():
        before = np.concatenate([[0], np.cumsum(members[data])])
        counted[name] = before
        made[f"share_{name}"] = (before[chunk.offsets[1:]] - before[chunk.offsets[:-1]]) / some

    start, end = chunk.runs(~IS_SPACE[data])
    rows, length = chunk.rows_of(start), (end - start).astype(np.float64)
    words = _per_row(rows, n)
    any_word = np.maximum(words, 1)

    def inside(name: str) -> np.ndarray:
        return counted[name][end] > counted[name][start]

    first = data[start] if len(start) else data[:0]
    rolling = Rolling(LOWER[data])
    hashes = rolling.of(start, end)
    group_rows, group_sizes = _groups(rows, hashes)
    made["words"] = np.log1p(words)
    made["mean_word"] = _per_row(rows, n, length) / any_word
    made["long_word"] = _per_row(rows[length > 12], n) / any_word
    made["short_words"] = _per_row(rows[length <= 2], n) / any_word
    made["longest_word"] = np.log1p(_largest(rows, length, n))
    made["distinct_words"] = _per_row(group_rows, n) / any_word
    made["top_word"] = _largest(group_rows, group_sizes, n) / any_word
    made["capital_words"] = _per_row(rows[_CLASSES["upper"][first]], n) / any_word
    made["words_with_symbols"] = _per_row(rows[inside("symbol")], n) / any_word
    made["words_with_stop"] = _per_row(rows[inside("stop")], n) / any_word

    whole = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
    one, two, three = (hashes[whole + k] for k in range(3))
    triples = mix(mix(one) + two * np.uint64(3)) + three * np.uint64(5)
    triple_rows, triple_sizes = _groups(rows[whole], triples)
    extra = _per_row(triple_rows, n, triple_sizes - 1.0)
    made["repeated_triples"] = extra / np.maximum(_per_row(rows[whole], n), 1)

    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    split = breaks[chunk.offsets[1:]] - breaks[chunk.offsets[:-1]] + 1.0
    low, high = chunk.runs(data != 10)
    worded = counted["space"][high] - counted["space"][low] < high - low
    low, high = low[worded], high[worded]
    line_rows = chunk.rows_of(low)
    lines = _per_row(line_rows, n)
    same_rows, same_sizes = _groups(line_rows, rolling.of(low, high))
    made["lines"] = np.log1p(lines)
    made["line_bytes"] = np.log1p(size / split)
    made["blank_lines"] = (split - lines) / split
    made["repeated_lines"] = _per_row(same_rows, n, same_sizes - 1.0) / np.maximum(lines, 1)
    return np.stack([made[name] for name in STATISTICS], axis=1)


def statistics(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), len(STATISTICS)))
    for chunk in chunks(column):
        out[chunk.first : chunk.first + len(chunk)] = statistics_of(chunk)
    return out


def bin_edges(values: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per column, the values that bins end at (each value belongs to the bin that it ends)."""
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(v, quantiles, method="lower")) for v in values.T]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    found = [np.searchsorted(e, v, side="left") for e, v in zip(edges, values.T)]
    return np.stack(found, axis=1).astype(np.int64)


@dataclass
class Forest:
    """Trees in flat arrays. Node i goes to ``left[i]`` if its statistic is at most its threshold,
    else to ``left[i] + 1``; a leaf goes to itself (its threshold is infinite)."""

    roots: np.ndarray
    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def scores(self, values: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(values), len(self.roots))).copy()
        row = np.arange(len(values))[:, None]
        for _ in range(self.depth):
            at = self.left[at] + (values[row, self.statistic[at]] > self.threshold[at])
        total = self.base + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


class _Grower:
    """Nodes of all trees, grown on binned statistics."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], depth: int, rate: float):
        self.bins, self.edges, self.depth, self.rate = bins, edges, depth, rate
        self.width = max(len(e) for e in edges) + 1
        self.place = bins + self.width * np.arange(bins.shape[1])
        self.cells = self.width * bins.shape[1]
        self.nodes: list[list[float]] = []  # statistic, threshold, left, value

    def histogram(self, rows: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """Sums of first and second derivatives per statistic and bin."""
        place = self.place[rows].ravel()
        many = self.bins.shape[1]
        sums = [np.bincount(place, np.repeat(s[rows], many), self.cells) for s in slopes]
        return np.stack(sums).reshape(2, many, self.width)

    def best_split(self, histogram: np.ndarray) -> tuple[float, int, int]:
        """Gain, statistic and last bin of the left side."""
        first, second = histogram.cumsum(axis=2)
        all_first, all_second = first[:, -1:], second[:, -1:]
        right_first, right_second = all_first - first, all_second - second

        def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
            return g**2 / (h + PENALTY)

        gain = worth(first, second) + worth(right_first, right_second) - worth(all_first, all_second)
        gain[(second < LEAST_WEIGHT) | (right_second < LEAST_WEIGHT)] = -np.inf
        at = int(gain.argmax())
        return float(gain.ravel()[at]), at // self.width, at % self.width

    def grow(self, slopes: np.ndarray, output: np.ndarray) -> int:
        """Adds a tree and its values to ``output``; returns its root."""
        root = len(self.nodes)
        self.nodes.append([0, np.inf, root, 0.0])
        rows = np.arange(len(output))
        work = [(root, rows, self.histogram(rows, slopes), 0)]
        while work:
            node, rows, histogram, level = work.pop()
            gain, statistic, last = self.best_split(histogram)
            if level == self.depth or gain <= 1e-6:
                first, second = histogram[:, 0].sum(axis=1)
                self.nodes[node][3] = value = -self.rate * first / (second + PENALTY)
                output[rows] += value
                continue
            left = len(self.nodes)
            self.nodes[node][:3] = [statistic, self.edges[statistic][last], left]
            self.nodes += [[0, np.inf, left, 0.0], [0, np.inf, left + 1, 0.0]]
            goes_left = self.bins[rows, statistic] <= last
            sides = [rows[goes_left], rows[~goes_left]]
            small = int(len(sides[1]) < len(sides[0]))
            counted = self.histogram(sides[small], slopes)
            both = [counted, histogram - counted] if small == 0 else [histogram - counted, counted]
            work += [(left + k, sides[k], both[k], level + 1) for k in (1, 0)]
        return root


def grow_forest(
    values: np.ndarray, good: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE
) -> Forest:
    """Boosted trees for the chance that ``good`` is 1."""
    share = (good.sum() + 1) / (len(good) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(good):
        return Forest(*(np.zeros(1, np.int64) for _ in range(2)), np.full(1, np.inf), np.zeros(1, np.int64), np.zeros(1), 0, base)
    edges = bin_edges(values)
    grower = _Grower(binned(values, edges), edges, depth, rate)
    output, roots = np.full(len(good), base), []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-output))
        roots.append(grower.grow(np.stack([chance - good, chance * (1 - chance)]), output))
    statistic, threshold, left, value = zip(*grower.nodes)
    return Forest(
        np.array(roots), np.array(statistic, np.int64), np.array(threshold, np.float64),
        np.array(left, np.int64), np.array(value, np.float64), depth, base,
    )


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled documents, chosen by a hash of the id."""
    picked = (
        narrowed(labels, "doc_id", "quality")
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(most)
    )
    # Rows of a fixed number of columns and at most ``most`` labels are broadcast.
    joined = narrowed(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [row.tobytes() for row in statistics(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array(packed, pa.binary())],
                ["doc_id", "quality", "found"],
            )

    # One text for each label, also where rows share an id, so ``most`` rows at most.
    got = (
        joined.select("doc_id", "quality", "text")
        .mapInArrow(measure, "doc_id bigint, quality int, found binary")
        .groupBy("doc_id", "quality")
        .agg(F.min("found").alias("found"))
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    )
    values = np.frombuffer(b"".join(got.column("found").to_pylist()), np.float64)
    return values.reshape(-1, len(STATISTICS)), got.column("quality").to_numpy().astype(np.float64)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Forest:
    """Trees fitted on at most ``most`` labelled documents."""
    return grow_forest(*_sample(docs, labels, most))


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """All columns of ``docs`` and ``quality_score``."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(forest.scores(statistics(texts)), pa.float64())

    return docs.withColumn("quality_score", score(F.coalesce(F.col("text"), F.lit(""))))


def quality_model_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score_quality(narrowed(docs, "doc_id", "text"), fit_quality(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
