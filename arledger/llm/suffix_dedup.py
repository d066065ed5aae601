"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every string of ``LENGTH`` bytes holds one chosen anchor: the leftmost smallest hash among its
substrings of ``_GRAM`` bytes. Equal strings have equal anchors at equal places, so

1. anchors of all texts are counted, and only those that occur twice go on (equal texts count
   once here; all of a text that has a copy is repeated anyway). Each comes with hashes of its
   neighbourhood, all strings that belong to it. Equal neighbourhoods that follow each other
   closely, as in periodic text, are one row;
2. equal neighbourhoods become one class, whose strings are all repeated. Where an anchor has
   several classes, one neighbourhood of each is cut out of its text;
3. neighbourhoods are dealt out by anchor. A bucket's neighbourhoods form a few shards. Each
   shard has the transform of its own suffixes; the transforms are merged by refining their
   interleave symbol by symbol, without sorting all suffixes again. Intervals of the merged
   order that share ``LENGTH`` bytes are the repeats. A symbol is a run of ``_SYMBOL`` bytes, so
   a neighbourhood is a collection of short strings, one per offset, and ``LENGTH`` bytes are
   settled after ``LENGTH / _SYMBOL`` rounds;
4. an anchor with more than ``_MOST`` different neighbourhoods is not gathered in one task: there,
   strings are counted by hash over all tasks.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` lose nothing; texts have no
length limit; a string that overlaps its own copy counts; repeated rows are documents of their
own and thus copies; an empty table gives an empty result; other columns pass through
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arledger.llm.byte_text import Rolling, chunks
from arledger.llm.common import narrowed, stored

LENGTH = 400
_GRAM = 200
_SYMBOL = 100
_SHARDS = 4
#: Bytes of neighbourhoods in a bucket, and different neighbourhoods of one anchor.
_BUCKET_BYTES = 2_000_000
_MOST = 1000
#: Most tasks that buckets are dealt to, and bytes of neighbourhoods in one batch.
_MOST_TASKS = 20_000
_BATCH_BYTES = 8_000_000
_PLACE_BITS = np.uint64(20)
_SEGMENT = 1 << 19


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima from both block ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text from its gram hashes: place, first and last string start.

    Hash and place are packed in one number, so that the minimum is the leftmost one."""
    width = LENGTH - _GRAM + 1
    starts = len(grams) - width + 1
    place = np.empty(starts, dtype=np.int64)
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    for low in range(0, starts, _SEGMENT):
        part = grams[low : low + _SEGMENT + width - 1]
        packed = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        best = _smallest(packed, width)
        place[low : low + len(best)] = (best & mask).astype(np.int64) + low
    change = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [starts - 1]])
    return place[first], first, last


_ANCHORS = "g bigint, k1 bigint, k2 bigint, t bigint, pos bigint, last bigint, before bigint, size bigint"


def _neighbourhood_hashes(data: np.ndarray, low: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes per neighbourhood, of its bytes and of the anchor's place in it."""
    view = memoryview(data)
    places = zip(low.tolist(), size.tolist(), before.tolist())
    digests = b"".join([xxhash.xxh3_128_digest(view[a : a + n], seed) for a, n, seed in places])
    return np.frombuffer(digests, dtype=">i8").astype(np.int64).reshape(-1, 2)


def _chains(keys: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last members of chains: equal neighbourhoods of one text, each at most
    ``LENGTH`` after the one before, so that what they cover has no gap. Periodic text, where every
    place is an anchor, has as many chains as the period has places."""
    order = np.lexsort((pos, keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1) | (np.diff(pos[order]) > LENGTH)
    first = np.flatnonzero(new)
    return order[first], order[np.append(first[1:], len(order)) - 1]


def _anchors(texts: DataFrame) -> DataFrame:
    """Anchors of all texts of at least ``LENGTH`` bytes, with the hashes of their neighbourhoods.
    A row stands for a chain of equal ones, from ``pos`` to ``last``. Each task gives the
    anchors of equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                found: list[tuple] = []
                grams = Rolling(chunk.data).of_length(_GRAM) if len(chunk.data) >= _GRAM else None
                for i in range(len(chunk)):
                    low, high = int(chunk.offsets[i]), int(chunk.offsets[i + 1])
                    text = int(ids[chunk.first + i])
                    if high - low >= LENGTH and text not in seen:
                        seen.add(text)
                        own = grams[low : high - _GRAM + 1]
                        pos, first, last = anchors_of(own)
                        before, size = pos - first, last - first + LENGTH
                        keys = _neighbourhood_hashes(chunk.data, low + first, size, before)
                        head, tail = _chains(keys, pos)
                        t = np.full(len(head), text, dtype=np.int64)
                        g = own[pos[head]].astype(np.int64)
                        found.append((g, *keys[head].T, t, pos[head], pos[tail], before[head], size[head]))
                if found:
                    columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
                    names = [x.split()[0] for x in _ANCHORS.split(", ")]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("t", "text").mapInArrow(run, _ANCHORS)


def _neighbourhoods(anchors: DataFrame) -> DataFrame:
    """The rows of anchors that occur twice, once for each place."""
    occurrence = F.xxhash64("t", "pos")
    # In a table of its own, so that the join below can split a frequent anchor's rows.
    twice = stored(
        anchors.groupBy("g")
        .agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b"), F.max(F.col("last") > F.col("pos")).alias("chain"))
        .where("a <> b OR chain")
        .select("g")
    )
    # Tasks that hold copies of one text give its rows more than once.
    return stored(anchors.join(twice, "g", "left_semi").distinct())


def _cut(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of chosen neighbourhoods, (g, k1, k2, classes, bytes), from rows with t, low, size."""
    # At most what a text holds itself, as each neighbourhood is chosen once.
    per_text = wanted.groupBy(F.col("t").alias("w_t")).agg(
        F.collect_list(F.struct("g", "k1", "k2", "classes", "low", "size")).alias("found")
    )
    one_of_each = texts.groupBy("t").agg(F.min("doc_id").alias("rep"))
    chosen = per_text.join(one_of_each, F.col("w_t") == F.col("t")).select("w_t", "rep", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i in range(batch.num_rows):
                # Repeated rows share id and text.
                t = batch.column(0)[i].as_py()
                if t in seen:
                    continue
                seen.add(t)
                data = batch.column(1)[i].as_py().encode()
                rows = batch.column(2)[i].values
                low = rows.field("low").to_numpy(zero_copy_only=False)
                size = rows.field("size").to_numpy(zero_copy_only=False)
                # A bounded number of bytes at a time, however much a text's pieces overlap.
                run = np.cumsum(size) // _BATCH_BYTES
                for k in np.unique(run):
                    part = np.flatnonzero(run == k)
                    pieces = [data[a : a + n] for a, n in zip(low[part].tolist(), size[part].tolist())]
                    names = ["g", "k1", "k2", "classes"]
                    columns = [rows.field(n).slice(int(part[0]), len(part)) for n in names]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(pieces, pa.binary())], [*names, "bytes"]
                    )

    met = (F.col("t") == F.col("w_t")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    return texts.join(chosen, met).select("t", "text", "found").mapInArrow(
        cut, "g bigint, k1 bigint, k2 bigint, classes bigint, bytes binary"
    )


def _symbol_strings(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per place of the joined bytes: its symbol, the place that continues it (-1 at the end
    of a string), and the symbol before it. Places with too few bytes left have symbol 0."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
    begins = ends - np.repeat([len(p) for p in parts], [len(p) for p in parts])
    place = np.arange(len(data))
    whole = place + _SYMBOL <= ends
    symbol = np.zeros(len(data), dtype=np.uint64)
    symbol[whole] = Rolling(data).of(place[whole], place[whole] + _SYMBOL) | np.uint64(1)
    following = np.where(place + 2 * _SYMBOL <= ends, place + _SYMBOL, -1)
    before = np.zeros(len(data), dtype=np.uint64)
    inner = place - begins >= _SYMBOL
    before[inner] = symbol[place[inner] - _SYMBOL]
    return symbol, following, before


def _shard_order(symbol: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Order of a shard's suffixes by ``LENGTH`` bytes, by doubling ranks."""

    def ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((second, first))
        new = np.ones(len(order), dtype=np.int64)
        new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new)
        return rank, order

    rank, order = ranked(symbol, np.zeros(len(symbol), dtype=np.int64))
    ahead = following
    covered = 1
    while covered < LENGTH // _SYMBOL:
        there = np.where(ahead >= 0, rank[ahead], 0)
        rank, order = ranked(rank, there)
        ahead = np.where(ahead >= 0, ahead[ahead], -1)
        covered *= 2
    return order


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of sorted shards, and a mark where neighbours differ within ``rounds``
    symbols.

    Each transform holds, in the shard's suffix order, the symbol before each suffix; 0 is
    the end of a string. One round sorts the interleave stably by those symbols, which
    orders it by one symbol more; neighbours stay together while symbol and rest agree.
    """
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    total = len(shard)
    interleave, differs = shard, np.zeros(total, dtype=bool)
    ends = [int((t == 0).sum()) for t in transforms]
    if not total:
        return interleave, differs
    for _ in range(rounds):
        # Read each shard's transform in its own order, as the interleave calls for it.
        place = np.argsort(interleave, kind="stable")
        symbols = np.empty(total, dtype=np.uint64)
        symbols[place] = np.concatenate(transforms)
        group = np.cumsum(differs)
        real = symbols != 0
        moved = np.flatnonzero(real)[np.argsort(symbols[real], kind="stable")]
        # Suffixes that start with an end mark come first, shard by shard.
        interleave = np.concatenate([np.repeat(np.arange(len(ends)), ends), interleave[moved]])
        fresh = np.zeros(total, dtype=bool)
        first = sum(ends)
        fresh[:1] = True
        if len(moved):
            fresh[first] = True
            fresh[first + 1 :] = (symbols[moved][1:] != symbols[moved][:-1]) | (
                group[moved][1:] != group[moved][:-1]
            )
        differs = fresh
    return interleave, differs


def repeated_starts(parts: list[bytes]) -> list[np.ndarray]:
    """Per part: starts of the ``LENGTH``-byte strings that start elsewhere too."""
    shards = [list(range(i, len(parts), _SHARDS)) for i in range(min(_SHARDS, len(parts)))]
    transforms, orders, owners, places = [], [], [], []
    for members in shards:
        own = [parts[i] for i in members]
        symbol, following, before = _symbol_strings(own)
        size = np.array([len(p) for p in own])
        owner = np.repeat(members, size)
        place = np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size)
        kept = symbol != 0
        # Before the end mark of a string stands its last symbol. Equal suffixes stand by
        # place everywhere, which keeps the transform consistent.
        last = kept & (following < 0)
        order = _shard_order(symbol, following)
        order = order[kept[order]]
        transforms.append(np.concatenate([symbol[last], before[order]]))
        orders.append(order)
        owners.append(owner)
        places.append(place)
    interleave, differs = merge_transforms(transforms, LENGTH // _SYMBOL)
    owner, place = np.zeros(len(interleave), np.int64), np.full(len(interleave), -1, np.int64)
    for s, order in enumerate(orders):
        slots = np.flatnonzero(interleave == s)[len(transforms[s]) - len(order) :]
        owner[slots], place[slots] = owners[s][order], places[s][order]
    return _starts_in_shared_intervals(owner, place, differs, parts)


def _starts_in_shared_intervals(
    owner: np.ndarray, place: np.ndarray, differs: np.ndarray, parts: list[bytes]
) -> list[np.ndarray]:
    size = np.array([len(p) for p in parts], dtype=np.int64)
    whole = (place >= 0) & (place + LENGTH <= size[owner])
    group = np.cumsum(differs)
    members = np.bincount(group[whole], minlength=int(group[-1]) + 1 if len(group) else 1)
    shared = whole & (members[group] > 1)
    by_owner = np.lexsort((place[shared], owner[shared]))
    who, where = owner[shared][by_owner], place[shared][by_owner]
    cut = np.searchsorted(who, np.arange(len(parts) + 1))
    return [where[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive starts as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(starts) - 1]])
    return [(int(a), int(b)) for a, b in zip(starts[first], starts[last])]


_RUNS = "k1 bigint, k2 bigint, first bigint, last bigint"


def _repeats_by_merge(classes: DataFrame) -> DataFrame:
    """(k1, k2, first, last): runs of repeated starts within neighbourhoods, per bucket."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(list(rows["bytes"]))
        out = [
            (k1, k2, a, b)
            for k1, k2, starts in zip(rows["k1"], rows["k2"], found)
            for a, b in _runs(starts)
        ]
        return pd.DataFrame(out, columns=["k1", "k2", "first", "last"]).astype("int64")

    return classes.groupBy("bucket").applyInPandas(run, _RUNS)


def _repeats_by_hash(classes: DataFrame) -> DataFrame:
    """The same for anchors of very many neighbourhoods: strings counted over all tasks."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, part in zip(*(batch.column(i) for i in range(3))):
                data = np.frombuffer(part.as_buffer(), np.uint8)
                found = Rolling(data).of_length(LENGTH).astype(np.int64)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, k1.as_py())),
                        pa.array(np.full(n, k2.as_py())),
                        pa.array(found),
                        pa.array(np.arange(n)),
                    ],
                    ["k1", "k2", "string", "first"],
                )

    strings = classes.select("k1", "k2", "bytes").mapInArrow(
        hashes, "k1 bigint, k2 bigint, string bigint, first bigint"
    )
    one = F.xxhash64("k1", "k2", "first")
    twice = (
        strings.groupBy("string")
        .agg(F.min(one).alias("a"), F.max(one).alias("b"))
        .where("a <> b")
        .select("string")
    )
    return strings.join(twice, "string", "left_semi").select(
        "k1", "k2", "first", F.col("first").alias("last")
    )


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(t, ranges): byte ranges [start, end) that repeated strings cover, per text hash.

    ``texts`` has t, doc_id, text. Ranges may overlap. Copies of whole texts are not listed.
    """
    near = _neighbourhoods(stored(_anchors(texts)))
    occurrence = F.xxhash64("t", "pos")
    # Two hashes tell different neighbourhoods apart, so bytes are cut once for each.
    classes = stored(
        near.groupBy("g", "k1", "k2").agg(
            F.min("size").alias("size"),
            F.min(occurrence).alias("a"),
            F.max(occurrence).alias("b"),
            F.max(F.col("last") > F.col("pos")).alias("chain"),
            F.min(F.struct("t", "pos", "before")).alias("rep"),
        )
    )
    several = classes.groupBy("g").agg(F.count("*").alias("classes")).where("classes > 1")
    compared = stored(
        classes.join(several, "g").select(
            "g", "k1", "k2", "classes", "rep.t", (F.col("rep.pos") - F.col("rep.before")).alias("low"), "size"
        )
    )
    total = compared.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // _BUCKET_BYTES))
    chosen = stored(_cut(texts, compared))
    # A given number of partitions, as the work on a bucket is more than its bytes tell.
    few = (
        chosen.where(F.col("classes") <= _MOST)
        .select("k1", "k2", "bytes", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
        .repartition(min(buckets, _MOST_TASKS), "bucket")
    )
    many = chosen.where(F.col("classes") > _MOST)
    runs = _repeats_by_merge(few).unionByName(_repeats_by_hash(many))
    # All strings of a neighbourhood that occurs twice are repeated.
    copied = classes.where("a <> b OR chain").select(
        "k1", "k2", F.lit(0).cast("long").alias("first"), (F.col("size") - LENGTH).cast("long").alias("last")
    )
    found = stored(runs.unionByName(copied)).withColumnRenamed("last", "to")
    return (
        near.join(found, ["k1", "k2"])
        .groupBy("t")
        .agg(
            F.collect_set(
                F.struct(
                    (F.col("pos") - F.col("before") + F.col("first")).alias("start"),
                    (F.col("last") - F.col("before") + F.col("to") + LENGTH).alias("end"),
                )
            ).alias("ranges")
        )
    )


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _removed(data: bytes, copies: int, ranges: list | None) -> list[tuple[int, int]]:
    if copies > 1 and len(data) >= LENGTH:
        return [(0, len(data))]
    return _union([(r["start"], r["end"]) for r in (() if ranges is None else ranges)])


def _kept(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for r in removed for e in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_ranges(rows: DataFrame) -> DataFrame:
    """Adds copies and ranges to rows with t, doc_id, text."""
    copies = rows.groupBy("t").agg(F.count("*").alias("copies")).where("copies > 1")
    ranges = repeated_ranges(rows.select("t", "doc_id", "text"))
    known = ranges.join(copies, "t", "full_outer")
    return rows.join(known, "t", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return narrowed(docs, "doc_id", "text").select(
        "doc_id", text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("t")
    )


def repeats_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, ranges in zip(*(batch.column(i) for i in (1, 2, 3))):
                data = text.as_py().encode()
                gone = _removed(data, copies.as_py(), ranges.as_py())
                digest = hashlib.sha256(_kept(data, gone)).hexdigest()
                out.append((len(data), sum(b - a for a, b in gone), len(gone), digest))
            n, removed, spans, digests = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _with_ranges(_texts(docs)).select("doc_id", "text", "copies", "ranges").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, in the columns of ``docs``; characters that
    a cut leaves incomplete are dropped."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    rows = docs.toDF(*names).withColumns(
        {
            "doc_id": F.col(at["doc_id"]),
            "text": text,
            "t": F.xxhash64(text, F.octet_length(text)),
        }
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, copies: pd.Series, ranges: pd.Series) -> pd.Series:
        made = []
        for value, count, own in zip(texts, copies, ranges):
            data = value.encode()
            made.append(_kept(data, _removed(data, count, own)).decode(errors="ignore"))
        return pd.Series(made, dtype=object)

    changed = _with_ranges(rows).withColumn(
        "cut", F.when(F.col(at["text"]).isNotNull(), cut("text", "copies", "ranges"))
    )
    return changed.select(
        *(F.col("cut" if c == "text" else n).alias(c) for c, n in at.items())
    )
