"""Toxicity by weak supervision.

1. From a bounded sample of labelled documents, words and word beginnings that go with toxic
   labels are collected. Spark counts them; only those that pass come to the driver.
2. They are dealt to many voters, each kind to its own: lexicon voters (whole words), pattern
   voters (words that begin with a stem, by the stem's length), voters on how many different
   entries a text holds, and voters that hold texts without any entry for clean. A voter says
   toxic, clean or nothing.
3. A generative label model starts at the share of voters that say toxic, not at the labels, and
   estimates by expectation maximization how often each voter says what for toxic and for clean
   texts, and how votes correlate given the label. A voter's evidence is divided by the number of
   voters that repeat it. A word counts as one entry only, itself or its longest stem.
4. A linear classifier on the presence of entries is trained on the posterior labels and
   scores whole texts, in tasks, from the bytes of Arrow batches.

Labels, language, source and id are no inputs of a score. Labels and lexicon come only from
documents whose id is not held out.

Defined cases: null, empty and letterless texts get the score of a text without entries; texts
have no length limit; equal rows get equal scores; without labelled documents, every score is
0; an empty table gives an empty result; other columns pass through ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.llm.byte_text import BYTE_VALUE, IS_LETTER, LOWER, Chunk, Rolling, chunks, mix
from arledger.llm.common import discard, narrowed, stored_at

#: Bounds on the labelled documents, toxic and clean, that lexicon and classifier are fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 7500
#: Word beginnings, in bytes, besides whole words.
STEMS = (4, 5, 6)
#: Bound on the entries of the classifier: those least likely by chance are taken.
ENTRIES = 20_000
_LEAST_PRECISION = 0.95
_LEAST_DOCUMENTS = 4
_VOTERS_PER_KIND = 12


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, kind, word) of each word (kind 0) and word beginning (kind: its bytes); the
    kind is part of the feature's hash, ``word`` numbers the words of the chunk."""
    data = LOWER[chunk.data]
    start, end = chunk.runs(IS_LETTER[data])
    rows, rolling = chunk.rows_of(start), Rolling(data)
    places, found = [np.arange(len(start))], [rolling.of(start, end) ^ BYTE_VALUE[0]]
    for size in STEMS:
        long = np.flatnonzero(end - start >= size)
        places.append(long)
        found.append(rolling.of(start[long], start[long] + size) ^ BYTE_VALUE[size])
    kinds = np.repeat(np.array((0, *STEMS), np.int8), [len(x) for x in found])
    word = np.concatenate(places)
    return rows[word], mix(np.concatenate(found)), kinds, word


def _entries_of(chunk: Chunk, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place among ``entries``) of a chunk. A word is one piece of evidence: it
    counts as the entry that it is, else as the longest stem that begins it."""
    rows, found, kinds, word = _features(chunk)
    flags = np.zeros(1 << 16, dtype=bool)
    flags[(entries & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = flags[(found & np.uint64(0xFFFF)).astype(np.int64)]
    rows, found, kinds, word = rows[maybe], found[maybe], kinds[maybe], word[maybe]
    at = np.minimum(np.searchsorted(entries, found), len(entries) - 1)
    hit = entries[at] == found
    rows, at, kinds, word = rows[hit], at[hit], kinds[hit], word[hit]
    order = np.lexsort((np.where(kinds == 0, -128, -kinds.astype(np.int64)), word))
    first = np.ones(len(order), dtype=bool)
    first[1:] = word[order][1:] != word[order][:-1]
    rows, at = rows[order][first], at[order][first]
    return np.divmod(np.unique(rows * len(entries) + at), len(entries))


@dataclass
class ToxicityModel:
    """Linear weights of lexicon entries, by feature hash in rising order."""

    entries: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        if len(self.entries):
            for chunk in chunks(column):
                row, entry = _entries_of(chunk, self.entries)
                np.add.at(out, chunk.first + row, self.weights[entry])
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int]) -> DataFrame:
    """(toxic, text) of the sampled documents."""
    labelled = (
        narrowed(labels, "doc_id", "toxic")
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    picked = labelled.where("toxic = 1").orderBy("order", "doc_id").limit(most[0]).unionByName(
        labelled.where("toxic = 0").orderBy("order", "doc_id").limit(most[1])
    )
    rows = narrowed(docs, "doc_id", "text").where(F.col("text").isNotNull())
    # As many ids as the sample's bounds say are broadcast.
    return rows.join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id").select(
        F.col("toxic").cast("int").alias("toxic"), "text"
    )


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, kind, bad, of): toxic and all documents that hold a feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                rows, found, kinds, _ = _features(chunk)
                order = np.lexsort((rows, found))
                rows, found, kinds = rows[order], found[order], kinds[order]
                new = np.ones(len(rows), dtype=bool)
                new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
                rows, found, kinds = rows[new], found[new], kinds[new]
                if not len(rows):
                    continue
                at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                bad = np.add.reduceat(toxic[chunk.first + rows].astype(np.int64), at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found[at].view(np.int64)),
                        pa.array(kinds[at].astype(np.int32)),
                        pa.array(bad),
                        pa.array(np.diff(np.append(at, len(found)))),
                    ],
                    ["feature", "kind", "bad", "of"],
                )

    parts = sample.mapInArrow(count, "feature bigint, kind int, bad bigint, of bigint")
    return parts.groupBy("feature").agg(
        F.min("kind").alias("kind"), F.sum("bad").alias("bad"), F.sum("of").alias("of")
    ).where("bad > 0")


def _lexicon(counts: DataFrame, usual: float, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that toxic documents hold more often than chance explains, and their kinds, by
    feature in rising order.

    The chance that ``bad`` of ``of`` documents are toxic by accident is bounded by
    Chernoff's inequality; the Benjamini-Hochberg rule keeps false entries under five in a
    hundred however many features are tried. It needs only how many features have which counts;
    these pairs of counts, of which the sample's bounds allow no more however long texts are, come
    to the driver, and features only if they pass.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pairs = counts.groupBy("bad", "of").agg(F.count("*").alias("n")).toArrow()
    bad, of, n = (pairs.column(c).to_numpy().astype(np.float64) for c in ("bad", "of", "n"))
    if not len(bad):
        return none
    usual = float(np.clip(usual, 1e-3, 0.999))
    share = bad / of
    with np.errstate(divide="ignore", invalid="ignore"):
        surplus = share * np.log(share / usual)
        surplus += np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - usual)), 0.0)
    log_chance = np.where((share > usual) & (of >= _LEAST_DOCUMENTS), -of * surplus, 0.0)
    order = np.lexsort((of, bad, log_chance))
    rank = np.cumsum(n[order])
    tried = max(1.0, n[of >= _LEAST_DOCUMENTS].sum())
    passed = np.flatnonzero(log_chance[order] <= np.log(0.05 * np.minimum(1, rank / tried)))
    best = order[: passed[-1] + 1 if len(passed) else 0]
    # An entry must speak for toxic by itself, not only shift the odds.
    best = best[share[best] >= _LEAST_PRECISION]
    if not len(best):
        return none
    spark = counts.sparkSession
    good = spark.createDataFrame(
        [(int(bad[i]), int(of[i]), float(log_chance[i])) for i in best],
        "bad bigint, of bigint, log_chance double",
    )
    got = (
        counts.join(F.broadcast(good), ["bad", "of"])
        .orderBy("log_chance", "feature")
        .limit(entries)
        .select("feature", "kind")
        .toArrow()
    )
    names = got.column("feature").to_numpy().view(np.uint64)
    rising = np.argsort(names)
    return names[rising], got.column("kind").to_numpy().astype(np.int64)[rising]


def _presence(sample: DataFrame, entries: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents and their (document, entry) pairs; documents stand in the order of their
    entries, so that the result does not depend on tasks."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                row, entry = _entries_of(chunk, entries)
                ends = np.searchsorted(row, np.arange(len(chunk) + 1))
                packed = [entry[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["entries"])

    got = sample.select("text").mapInArrow(find, "entries binary").toArrow().sort_by("entries")
    at = [np.frombuffer(x.as_buffer(), np.int64) for x in got.column("entries")]
    docs = np.repeat(np.arange(len(at)), [len(x) for x in at])
    return len(at), docs, np.concatenate(at) if at else np.zeros(0, np.int64)


def _votes(
    n: int, docs: np.ndarray, at: np.ndarray, entries: np.ndarray, kinds: np.ndarray
) -> np.ndarray:
    """Votes of all voters: 1 toxic, -1 clean, 0 nothing. Words and each length of stem have
    voters of their own."""
    every = (0, *STEMS)
    group = (mix(entries) % np.uint64(_VOTERS_PER_KIND)).astype(np.int64)
    group += np.searchsorted(every, kinds) * _VOTERS_PER_KIND
    found = np.zeros((n, len(every) * _VOTERS_PER_KIND), dtype=np.int8)
    found[docs, group[at]] = 1
    different = np.bincount(docs, minlength=n)
    counts = np.stack(
        [np.where(different >= k, 1, -1 if k == 1 else 0) for k in (1, 3, 6)]
        + [np.where(different == 0, -1, 0), np.where(different <= 1, -1, 0)],
        axis=1,
    ).astype(np.int8)
    votes = np.concatenate([found, counts], axis=1)
    return votes[:, (votes != 0).any(axis=0)]


def majority(votes: np.ndarray) -> np.ndarray:
    """Share of the voters with an opinion that say toxic; 0 without any."""
    return (votes == 1).sum(axis=1) / np.maximum((votes != 0).sum(axis=1), 1)


def label_model(votes: np.ndarray, guess: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of the toxic label from votes; ``guess`` only starts the first estimate.

    Accuracies: the chance of each vote given the label. Correlations: of votes given the
    label, weighted by the posterior; a voter's evidence counts 1 / (1 + sum of its
    correlations with others)."""
    n, m = votes.shape
    says = np.stack([votes == v for v in (-1, 0, 1)]).astype(np.float64)
    prior = float(np.clip(guess.mean(), 0.01, 0.99))
    posterior = np.clip(guess, 0.02, 0.98)
    weight = np.ones(m)
    for turn in range(rounds):
        evidence = np.zeros((2, n))
        for k, share in enumerate((1 - posterior, posterior)):
            chance = (says * share[None, :, None]).sum(axis=1) + 0.5
            chance /= chance.sum(axis=0)
            evidence[k] = sum((says[v] * np.log(chance[v])) @ weight for v in range(3))
        gap = evidence[1] - evidence[0] + np.log(prior / (1 - prior))
        fresh = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
        if turn % 5 == 0:
            related = np.zeros((m, m))
            for share in (1 - fresh, fresh):
                mean = (votes * share[:, None]).sum(axis=0) / max(share.sum(), 1e-9)
                centred = (votes - mean) * np.sqrt(share)[:, None]
                covariance = centred.T @ centred / max(share.sum(), 1e-9)
                scale = np.sqrt(np.maximum(np.diag(covariance), 1e-6))
                related += 0.5 * covariance / np.outer(scale, scale)
            np.fill_diagonal(related, 0)
            weight = 1 / (1 + np.where(np.abs(related) > 0.2, np.abs(related), 0).sum(axis=1))
        if np.abs(fresh - posterior).max() < 1e-4 and turn > 5:
            posterior = fresh
            break
        posterior = fresh
    return posterior


def _fit_linear(
    n: int, docs: np.ndarray, at: np.ndarray, entries: int, target: np.ndarray
) -> tuple[np.ndarray, float]:
    """Logistic regression on presence by accelerated gradient steps with an L2 penalty."""
    weights, bias = np.zeros(entries), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    second_w, second_b = np.full(entries, 1e-8), 1e-8
    for _ in range(400):
        score = bias + np.bincount(docs, weights=weights[at], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - target
        slope_w = np.bincount(at, weights=error[docs], minlength=entries) + 0.02 * weights
        slope_b = error.sum()
        second_w += slope_w**2
        second_b += slope_b**2
        weights = weights - 0.5 * slope_w / np.sqrt(second_w)
        bias -= 0.5 * slope_b / np.sqrt(second_b)
    return weights, float(bias)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    most: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN),
    entries: int = ENTRIES,
) -> ToxicityModel:
    """Fits on at most ``most`` labelled documents, toxic and clean, with at most ``entries``
    entries."""
    spark = docs.sparkSession
    sample, sample_path = stored_at(_sample(docs, labels, most))
    total, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    counts, counts_path = stored_at(_counts(sample))
    names, kinds = _lexicon(counts, (toxic or 0) / max(total, 1), entries)
    discard(spark, counts_path)
    if not len(names):
        discard(spark, sample_path)
        return ToxicityModel(names, np.zeros(0), -50.0)
    n, at_doc, at_entry = _presence(sample, names)
    discard(spark, sample_path)
    votes = _votes(n, at_doc, at_entry, names, kinds)
    posterior = label_model(votes, majority(votes))
    weights, bias = _fit_linear(n, at_doc, at_entry, len(names), posterior)
    return ToxicityModel(names, weights, bias)


def _scored(docs: DataFrame, model: ToxicityModel, keep: list[Column], schema: str) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column("__text"))
            rest = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(scores, pa.float64())],
                [*rest, "score"],
            )

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(score, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit_toxicity(docs, labels)
    scored = _scored(docs, model, [F.col("doc_id")], "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, in the columns of ``docs``."""
    model = fit_toxicity(docs, labels)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.withColumn("text", F.col(text))
    scored = _scored(rows, model, [F.col(n) for n in names], f"{schema}, score double")
    return scored.where(F.col("score") < threshold).select(
        *(F.col(n).alias(c) for n, c in zip(names, docs.columns))
    )
