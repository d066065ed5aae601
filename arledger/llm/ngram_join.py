"""N-gram Jaccard join by rare-first prefix filtering.

1. Count: shingles of all texts are counted in a sketch of fixed size, which orders shingles
   rare first. Any order gives right results; this one keeps frequent shingles out of prefixes.
2. Prefixes: of a set of n shingles, only the first ``n - ceil(0.8 n) + 1`` in that order are
   joined; two sets that link share one of them. Equal sets are one class, joined once.
3. Candidates pass the length filter, the positional filter (what can still be shared behind
   the meeting place) and the suffix filter (shared counts per part of the hash range).
4. Each candidate pair is verified once, on the whole sets.

Pairs are needed for components only, so a group of near copies is not expanded: every class
is first compared with the smallest class of each of its prefix shingles. Then, shingles whose
classes are in different components yet give all pairs across components, with the classes
outside of the largest component on one side. A pair that is left out joins classes that are
connected already.

Defined cases: null, empty and blank texts have the empty set and link with nothing; a text of
fewer words than a shingle is one shingle of all its words; rows with a null doc_id link with
nothing; equal doc_ids are one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.llm.byte_text import BYTE_VALUE, IS_SPACE, LOWER, Chunk, Rolling, chunks, mix
from arledger.llm.common import narrowed, stored
from arledger.llm.components import connected_components

WORDS = 5
#: Similarity as a fraction: intersection / union of at least 4 / 5.
NUMERATOR, DENOMINATOR = 4, 5
#: The sketch has 2**SKETCH_BITS counters, whatever the size of the corpus.
SKETCH_BITS = 20
_BLOCK = 1 << 14
_PARTS = 128
#: The table that rules out documents before their sets are made has 2**_MARK_BITS bits.
_MARK_BITS = 24


def _shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) of a chunk, by row and hash."""
    data = LOWER[chunk.data]
    start, end = chunk.runs(~IS_SPACE[data])
    word, row = Rolling(data).of(start, end), chunk.rows_of(start)
    count = np.bincount(row, minlength=len(chunk))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    full = np.flatnonzero(row[: len(row) - WORDS + 1] == row[WORDS - 1 :])
    hashes = np.full(len(full), BYTE_VALUE[WORDS])
    for k in range(WORDS):
        hashes = mix(hashes * BYTE_VALUE[9] + word[full + k])
    rows = row[full]
    for size in range(1, WORDS):
        short = np.flatnonzero(count == size)
        whole = np.full(len(short), BYTE_VALUE[size])
        for k in range(size):
            whole = mix(whole * BYTE_VALUE[9] + word[first[short] + k])
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted shingle hashes) of each row."""
    for chunk in chunks(column, 1 << 19):
        rows, hashes = _shingles(chunk)
        ends = np.searchsorted(rows, np.arange(len(chunk) + 1))
        for i in range(len(chunk)):
            yield chunk.first + i, hashes[ends[i] : ends[i + 1]]


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """The sketch: documents per counter, over all texts. Tasks add up their part, blocks of
    counters are summed across tasks, and 2**SKETCH_BITS numbers come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                total += np.bincount(_counter(_shingles(chunk)[1]), minlength=len(total))
        if total.any():
            parts = [total[i : i + _BLOCK].astype(np.uint32).tobytes() for i in range(0, len(total), _BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                ["block", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(part.as_buffer(), np.uint32)
                sums[block] = sums.get(block, 0) + part.astype(np.int64)
        # Order needs no more precision than this, however large the corpus.
        kept = [np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int32()), pa.array(kept, pa.binary())], ["block", "counts"]
        )

    blocks = (1 << SKETCH_BITS) // _BLOCK
    rows = (
        docs.select("text")
        .mapInArrow(count, "block int, counts binary")
        .repartition(blocks, "block")
        .mapInArrow(add, "block int, counts binary")
        .collect()
    )
    total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for row in rows:
        at = row["block"] * _BLOCK
        total[at : at + _BLOCK] = np.frombuffer(row["counts"], np.uint32)
    return total


def _prefix_size(n: int) -> int:
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def document_sets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, two set hashes k1 and k2, prefix in order, parts."""
    rows = narrowed(docs, "doc_id", "text")
    sketch = docs.sparkSession.sparkContext.broadcast(shingle_counts(rows))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        # Some rows at a time: lists of arrays take more room than the columns they become.
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            size, k1, k2, prefixes, parts = [], [], [], [], []
            for _, hashes in _sets(batch.column(1)):
                n = len(hashes)
                size.append(n)
                k1.append(int(mix(hashes).sum().astype(np.int64)) if n else 0)
                k2.append(int(mix(hashes ^ BYTE_VALUE[17]).sum().astype(np.int64)) if n else 0)
                order = np.lexsort((hashes, counts[_counter(hashes)]))
                prefix = hashes[order[: _prefix_size(n)]] if n else hashes
                prefixes.append(prefix.astype(np.int64))
                parts.append(np.bincount((hashes & np.uint64(_PARTS - 1)).astype(np.int64), minlength=_PARTS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int32()),
                    pa.array(k1, pa.int64()),
                    pa.array(k2, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(parts, pa.list_(pa.int32())),
                ],
                ["doc_id", "n", "k1", "k2", "prefix", "parts"],
            )

    return stored(
        rows.mapInArrow(
            describe,
            "doc_id bigint, n int, k1 bigint, k2 bigint, prefix array<bigint>, parts array<int>",
        )
    )


def _least_shared(a: Column, b: Column) -> Column:
    """Shingles that sets of these sizes must share to link."""
    return F.ceil((a + b) * NUMERATOR / F.lit(NUMERATOR + DENOMINATOR)).cast("int")


def _can_link(a: str, b: str) -> Column:
    """Length and positional filter for entries that meet at one shingle."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    behind = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    long_enough = F.least(na, nb) * DENOMINATOR >= F.greatest(na, nb) * NUMERATOR
    return long_enough & (behind >= _least_shared(na, nb))


def _shared_entries(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Prefix entries (token, doc, n, pos) of shingles that two classes or more have."""
    entries = sets.where("n > 0 AND doc_id IS NOT NULL").select(
        F.posexplode("prefix").alias("pos", "token"), "doc_id", "n", "k1"
    )
    shared = (
        entries.groupBy("token")
        .agg(F.min("k1").alias("low"), F.max("k1").alias("high"))
        .where("low <> high")
        .select("token")
    )
    met = entries.select("token", "doc_id", "n", "pos").join(shared, "token", "left_semi")
    return stored(
        met.withColumnRenamed("doc_id", "doc").join(
            classes.select(F.col("rep").alias("doc")), "doc", "left_semi"
        )
    )


def _passes_suffix(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Suffix filter: bounds the shared shingles by what each part of the hash range holds."""
    side = sets.where("n > 0").select("doc_id", "n", "parts").dropDuplicates(["doc_id"])
    a = side.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa"))
    b = side.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))
    most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(most >= _least_shared(F.col("na"), F.col("nb")))
        .select("a", "b")
    )


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size with a bit set for each id: what it rules out is not there."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << _MARK_BITS)) + 1  # these functions count from 1
    rows = (
        ids.groupBy(F.bitmap_bucket_number(bit).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        .collect()
    )
    size = len(rows[0]["bits"]) if rows else 1
    table = np.zeros((1 << _MARK_BITS) // 8, dtype=np.uint8)
    for row in rows:
        at = (row["part"] - 1) * size
        table[at : at + size] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(table, bitorder="little").astype(bool)


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, hashes) of the wanted documents: packed shingle hashes in rising order.

    Texts are not shuffled: a task turns those that the bit table lets through into sets, and
    a join leaves out the few that were not asked for.
    """
    marked = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked.value[batch.column(2).to_numpy()]))
            packed = [hashes.tobytes() for _, hashes in _sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary())], ["doc", "hashes"]
            )

    rows = narrowed(docs, "doc_id", "text").select(
        F.col("doc_id").alias("doc"),
        "text",
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << _MARK_BITS)).alias("bit"),
    )
    sets = rows.mapInArrow(pack, "doc bigint, hashes binary")
    return stored(sets.join(wanted, "doc", "left_semi"))


def _documents_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Pairs whose whole sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good[i] = both * DENOMINATOR >= (len(x) + len(y) - both) * NUMERATOR
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["a", "b"]
            ).filter(pa.array(good))

    a = whole.select(F.col("doc").alias("a"), F.col("hashes").alias("x"))
    b = whole.select(F.col("doc").alias("b"), F.col("hashes").alias("y"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return stored(joined.mapInArrow(check, "a bigint, b bigint"))


def _hub_pairs(entries: DataFrame) -> DataFrame:
    """Each class with the smallest class of each of its prefix shingles."""
    hubs = entries.groupBy("token").agg(F.min(F.struct("doc", "n", "pos")).alias("h"))
    return (
        entries.select("token", F.struct("doc", "n", "pos").alias("e"))
        .join(hubs, "token")
        .where((F.col("e.doc") > F.col("h.doc")) & _can_link("e", "h"))
        .select(F.col("h.doc").alias("a"), F.col("e.doc").alias("b"))
        .distinct()
    )


def _crossing_pairs(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that meet at a shingle and lie in different components yet."""
    labelled = entries.join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc")
    )
    mixed = (
        labelled.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("token")
    )
    left = stored(labelled.join(mixed, "token", "left_semi"))
    largest = (
        left.groupBy("token", "component")
        .agg(F.count("*").alias("size"))
        .groupBy("token")
        .agg(F.max(F.struct("size", "component"))["component"].alias("largest"))
    )
    outside = left.join(largest, "token").where("component <> largest")
    entry = F.struct("doc", "n", "pos", "component")
    return (
        outside.select("token", entry.alias("o"))
        .join(left.select("token", entry.alias("e")), "token")
        .where((F.col("o.component") != F.col("e.component")) & _can_link("o", "e"))
        .select(
            F.least("o.doc", "e.doc").alias("a"), F.greatest("o.doc", "e.doc").alias("b")
        )
        .distinct()
    )


def ngram_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    sets = document_sets(docs)
    key = ["k1", "k2", "n"]
    classes = stored(
        sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    )
    entries = _shared_entries(sets, classes)
    tried = stored(_passes_suffix(_hub_pairs(entries), sets))
    links = _verified(tried, _whole_sets(docs, _documents_of(tried)))
    labels = connected_components(links)
    crossing = _passes_suffix(_crossing_pairs(entries, labels), sets)
    crossing = stored(crossing.join(tried, ["a", "b"], "left_anti"))
    more = _verified(crossing, _whole_sets(docs, _documents_of(crossing)))
    labels = connected_components(links.unionByName(more))
    found = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        *(F.col(k).alias(f"c_{k}") for k in key),
        F.coalesce("component", "rep").alias("component"),
    )
    met = (F.col("k1") == F.col("c_k1")) & (F.col("k2") == F.col("c_k2")) & (F.col("n") == F.col("c_n"))
    return sets.join(found, met, "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id, in the columns of ``docs``.
    Documents without a doc_id stay; repeated rows of one doc_id stay together."""
    gone = (
        ngram_components(docs)
        .where(F.col("component_id") < F.col("doc_id"))
        .select(F.col("doc_id").alias("__gone"))
        .distinct()
    )
    names = [f"__c{i}" for i in range(len(docs.columns))]
    doc_id = names[docs.columns.index("doc_id")]
    rows = docs.toDF(*names).join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
    return rows.toDF(*docs.columns)
