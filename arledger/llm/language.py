"""Language identification by a byte convolutional network.

Windows of ``WINDOW`` bytes go through a byte embedding, filters of several widths, a maximum
over the window and a softmax. The network is trained here, in numpy, on windows of a bounded
sample of labelled documents. It is applied to all windows of every whole text; a document's
prediction is the mean of its windows' log probabilities, weighted by their bytes.

When applied, the filters are read from tables of byte pairs, which gives the same sums as
multiplying embeddings and weights at each position.

Defined cases: ``und`` with score 0 for null texts and texts without a letter, and for all
texts if no labelled text with a letter exists; equal texts get equal predictions; texts have
no length limit; an empty table gives an empty result; other columns pass through
``identify_language``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arledger.llm.byte_text import chunks
from arledger.llm.common import narrowed

#: Bounds on what the network is fitted on: documents per language, and over all languages.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_TOTAL = 20000
WINDOW = 128
WINDOWS_PER_DOCUMENT = 4
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
EPOCHS = 8
_BATCH = 32


def held_out(doc_id: Column) -> Column:
    """Documents whose language is not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _windows_of(data: np.ndarray) -> np.ndarray:
    """All windows of a text, the last one filled up with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, EMBEDDING, FILTERS)
    dense: np.ndarray
    offset: np.ndarray

    def _tables(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """Per width: (place, bytes read there, summed contribution of those bytes)."""
        made = []
        for kernel in self.filters:
            single = [self.embedding @ part for part in kernel]
            parts = []
            for k in range(0, len(kernel) - 1, 2):
                pair = single[k][None, :, :] + single[k + 1][:, None, :]
                # Index low byte + 256 * high byte, as a little-endian pair reads.
                parts.append((k, 2, np.ascontiguousarray(pair.reshape(65536, -1), np.float32)))
            if len(kernel) % 2:
                parts.append((len(kernel) - 1, 1, single[-1].astype(np.float32)))
            made.append(parts)
        return made

    def pooled(self, windows: np.ndarray, tables: list) -> np.ndarray:
        """Largest filter values of each window."""
        pairs = windows[:, :-1].astype(np.uint16) + (windows[:, 1:].astype(np.uint16) << 8)
        best = []
        for parts, kernel in zip(tables, self.filters):
            places = WINDOW - len(kernel) + 1
            total = None
            for k, size, values in parts:
                index = (pairs if size == 2 else windows)[:, k : k + places]
                got = values.take(index, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            best.append(total.max(axis=1))
        return np.maximum(np.concatenate(best, axis=1), 0)

    def log_chances(self, windows: np.ndarray, tables: list) -> np.ndarray:
        out = []
        for at in range(0, len(windows), 256):
            logits = self.pooled(windows[at : at + 256], tables) @ self.dense + self.offset
            logits -= logits.max(axis=1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, column: pa.Array, tables: list) -> tuple[np.ndarray, np.ndarray]:
        """Language index and score of each text."""
        label = np.zeros(len(column), dtype=np.int64)
        score = np.zeros(len(column))
        for chunk in chunks(column):
            size = np.diff(chunk.offsets)
            per_row = np.maximum(1, -(-size // WINDOW))
            first = np.concatenate([[0], np.cumsum(per_row)])
            windows = np.zeros((first[-1], WINDOW), dtype=np.uint8)
            place = np.arange(len(chunk.data)) - np.repeat(chunk.offsets[:-1], size)
            windows.reshape(-1)[np.repeat(first[:-1] * WINDOW, size) + place] = chunk.data
            in_window = np.arange(first[-1]) - np.repeat(first[:-1], per_row)
            weight = np.clip(np.repeat(size, per_row) - in_window * WINDOW, 1, WINDOW)
            log = self.log_chances(windows, tables) * weight[:, None]
            mean = np.add.reduceat(log, first[:-1], axis=0)
            mean /= np.add.reduceat(weight, first[:-1])[:, None]
            chance = np.exp(mean)
            chance /= chance.sum(axis=1, keepdims=True)
            rows = slice(chunk.first, chunk.first + len(chunk))
            label[rows], score[rows] = chance.argmax(axis=1), chance.max(axis=1)
        return label, score


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 5) -> ByteNetwork:
    """Adam on the cross-entropy, gradients written out; only the place of each maximum passes
    a gradient back."""
    rng = np.random.default_rng(seed)
    values = {"embedding": rng.normal(0, 0.3, (256, EMBEDDING))}
    for w in WIDTHS:
        values[f"filter{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS))
    values["dense"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
    values["offset"] = np.zeros(len(languages))
    first = {k: np.zeros_like(v) for k, v in values.items()}
    second = {k: np.zeros_like(v) for k, v in values.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), _BATCH):
            batch, wanted = windows[order[at : at + _BATCH]], labels[order[at : at + _BATCH]]
            slopes = _slopes(values, batch, wanted)
            step += 1
            for k, slope in slopes.items():
                first[k] += 0.1 * (slope - first[k])
                second[k] += 0.001 * (slope**2 - second[k])
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                values[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return ByteNetwork(
        languages,
        values["embedding"],
        [values[f"filter{w}"] for w in WIDTHS],
        values["dense"],
        values["offset"],
    )


def _slopes(values: dict, batch: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
    n = len(batch)
    rows = np.arange(n)[:, None]
    embedded = values["embedding"][batch]
    pooled, places = [], []
    for w in WIDTHS:
        kernel = values[f"filter{w}"]
        size = WINDOW - w + 1
        total = sum(embedded[:, k : k + size] @ kernel[k] for k in range(w))
        places.append(total.argmax(axis=1))
        pooled.append(total.max(axis=1))
    hidden = np.concatenate(pooled, axis=1)
    active = hidden > 0
    hidden = hidden * active
    logits = hidden @ values["dense"] + values["offset"]
    chance = np.exp(logits - logits.max(axis=1, keepdims=True))
    chance /= chance.sum(axis=1, keepdims=True)
    chance[np.arange(n), wanted] -= 1
    chance /= n
    back = (chance @ values["dense"].T) * active
    slopes = {"dense": hidden.T @ chance, "offset": chance.sum(axis=0)}
    slopes["embedding"] = np.zeros_like(values["embedding"])
    for i, w in enumerate(WIDTHS):
        kernel, own = values[f"filter{w}"], back[:, i * FILTERS : (i + 1) * FILTERS]
        slope = np.empty_like(kernel)
        for k in range(w):
            seen = batch[rows, places[i] + k]
            slope[k] = np.einsum("nfe,nf->ef", values["embedding"][seen], own)
            np.add.at(slopes["embedding"], seen, own[:, :, None] * kernel[k].T[None])
        slopes[f"filter{w}"] = slope
    return slopes


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _sample(docs: DataFrame, per_language: int) -> pa.Table:
    rows = narrowed(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    hashed = F.xxhash64("doc_id")
    # The smallest hashes are taken. A language's size tells below which value they lie with plenty to
    # spare, so that ranking meets few rows of a large language. Sizes of the SAMPLE_TOTAL largest
    # ones are broadcast, rows of smaller ones all go on.
    sizes = rows.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__rows"))
    sizes = F.broadcast(sizes.orderBy(F.desc("__rows"), "__lang").limit(SAMPLE_TOTAL))
    place = hashed / F.lit(2.0**64) + 0.5
    low = F.col("__rows").isNull() | (place * F.col("__rows") < 4.0 * per_language)
    ranked = (
        rows.select("doc_id", "lang")
        .join(sizes, F.col("lang") == F.col("__lang"), "left")
        .where(low)
        .select("doc_id", "lang")
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id")))
        .where(F.col("rank") <= per_language)
        .orderBy("rank", "lang")
        .limit(SAMPLE_TOTAL)
    )
    picked = F.broadcast(ranked.select("doc_id").distinct())  # SAMPLE_TOTAL ids at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, made = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                windows = _windows_of(np.frombuffer(text.as_py().encode(), np.uint8))
                count = min(len(windows), WINDOWS_PER_DOCUMENT)
                for i in np.linspace(0, len(windows) - 1, count).astype(int):
                    languages.append(lang)
                    made.append(windows[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(languages, pa.string()), pa.array(made, pa.binary())],
                ["lang", "bytes"],
            )

    return (
        rows.where(_has_letter(F.col("text")))
        .join(picked, "doc_id", "left_semi")
        .select("lang", "text")
        .mapInArrow(cut, "lang string, bytes binary")
        .orderBy("lang", F.xxhash64("bytes"), "bytes")
        .toArrow()
    )


def fit_language(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> ByteNetwork | None:
    """The trained network; None if there is nothing to learn from."""
    sample = _sample(docs, per_language)
    if not sample.num_rows:
        return None
    languages = sorted(set(sample.column("lang").to_pylist()))
    index = {name: i for i, name in enumerate(languages)}
    labels = np.array([index[x] for x in sample.column("lang").to_pylist()])
    windows = np.frombuffer(b"".join(sample.column("bytes").to_pylist()), np.uint8)
    return train(windows.reshape(-1, WINDOW), labels, languages)


def identify_language(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (which replace columns of that name)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    names = [f"__c{i}" for i in range(len(kept))]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)),
        F.col("text").alias("__text"),
        _has_letter(F.col("text")).alias("__letter"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network._tables() if network else None
        for batch in batches:
            letter = batch.column("__letter").to_numpy(zero_copy_only=False)
            label = np.array(["und"] * batch.num_rows, dtype=object)
            score = np.zeros(batch.num_rows)
            if network and batch.num_rows:
                at, best = network.predict(batch.column("__text"), tables)
                label[letter] = np.array(network.languages, dtype=object)[at[letter]]
                score[letter] = best[letter]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array(label, pa.string()),
                    pa.array(score, pa.float64()),
                ],
                [*names, "__label", "__score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(names)])
    schema += ", __label string, __score double"
    return rows.mapInArrow(run, schema).select(
        *(F.col(n).alias(c) for c, n in zip(kept, names)),
        F.col("__label").alias("lang_pred"),
        F.col("__score").alias("score"),
    )


def language_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    found = identify_language(docs.select("doc_id", "text"), fit_language(docs))
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
