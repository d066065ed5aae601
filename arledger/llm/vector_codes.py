"""Compression of vectors to short codes, with codebooks found by ball k-means.

Vectors are scaled to integers and cut into equal consecutive parts. Each part position has its
own codebook, which is refined in rounds: every part goes to its nearest entry, then every entry
becomes the floored mean of its parts.

An entry and the parts that went to it last time form a ball. Rounds compare as little as the
balls allow, without changing the result (all of it in integers, so no bound is rounded):

* only entries within twice the ball's radius of its centre are neighbours, which could take a
  part away from it;
* a part closer to its entry than half the way to the nearest neighbour lies in the ball's stable
  core and stays;
* the others lie in rings that end half way to each next neighbour, and are compared with the
  neighbours inside their ring only;
* a ball whose entry has not moved, and whose neighbours have not either, stays as it is.

Balls are taken per batch of rows, where their radii are smallest. A round is one pass over a table
of parts and their entries; a task adds up its parts per entry before anything is shuffled, and only
the sums, a row per task, entry and component at most, are grouped. The driver holds codebooks alone.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors
shorter than the longest, or than a multiple of the number of parts, count as filled up with zeros;
repeated rows and equal ids are vectors of their own, and first entries come in the order of id
(null last) and then components; with fewer vectors than entries, the codebooks are that much
smaller; equally near entries go to the lower index; entries without parts stay; null labels count
as one label; an empty table gives an empty result; other columns do not matter. Scaled components
beyond ``LIMIT`` are refused with an error, since distances would not fit in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.llm.common import discard, stored, stored_at

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Largest scaled component: squared distances of parts of up to 512 components stay below 2**63.
LIMIT = 1 << 26

_STATE = ["id", "label", "vector", "own"]
_SUMS = ["part", "entry", "place", "total", "parts"]


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """Floors of ``scale`` times the components; null for vectors that take no part."""
    bad = F.exists(
        embedding,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    message = F.lit(f"a component is beyond {LIMIT} after scaling")
    whole = F.transform(
        embedding,
        lambda x: F.when(
            F.abs(x.cast("double") * scale) <= LIMIT, F.floor(x.cast("double") * scale).cast("int")
        ).otherwise(F.raise_error(message).cast("int")),
    )
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long binaries as int32 vectors."""
    data = b"".join(column.to_pylist())
    width = len(data) // 4 // max(len(column), 1)
    return np.frombuffer(data, dtype="<i4").reshape(len(column), width)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    """Entry of each part, a row per vector."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data.reshape(len(column), parts).astype(np.int64)


def _packed(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors (or of each one to its own centre)."""
    gap = points - centre
    return np.einsum("ij,ij->i", gap, gap)


class Balls:
    """One part's codebook with what its balls need: squared distances between entries, each
    entry's other entries by rising distance, and which entries moved."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None):
        self.book = book
        self.between = np.stack([distances(book, entry) for entry in book]) if len(book) else book
        self.order = np.argsort(self.between, axis=1, kind="stable")
        self.moved = np.ones(len(book), bool) if before is None else (book != before).any(axis=1)

    def assign(self, points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each point, its squared distance, and the number of other distances
        worked out. ``own`` is the nearest entry under the codebook before."""
        best, nearest = distances(points, self.book[own]), own.copy()
        compared = 0
        for entry in np.unique(own):
            members = np.flatnonzero(own == entry)
            reach = 4 * best[members]
            others = self.order[entry][self.order[entry] != entry]
            others = others[self.between[entry][others] <= reach.max()]
            if not self.moved[entry] and not self.moved[others].any():
                continue
            # How many neighbours each member's ring holds: none in the stable core.
            ring = np.searchsorted(self.between[entry][others], reach, side="right")
            for k, other in enumerate(others):
                there = members[ring > k]
                compared += len(there)
                gap = distances(points[there], self.book[other])
                # Ties go to the lower index, whichever entry held the point.
                closer = (gap < best[there]) | ((gap == best[there]) & (other < nearest[there]))
                best[there[closer]], nearest[there[closer]] = gap[closer], other
        return nearest, best, compared


def _parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    return vectors.reshape(len(vectors), parts, vectors.shape[1] // parts).astype(np.int64)


def _balls(books: np.ndarray, before: np.ndarray | None) -> list[Balls]:
    return [Balls(book, None if before is None else before[p]) for p, book in enumerate(books)]


def _state_schema(label: str) -> str:
    return f"id bigint, label {label}, vector binary, own binary"


def _round(state: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """One pass: rows of the state with new entries, where ``part`` is null, and each task's sums
    per entry and component, where all columns of the state are null."""
    parts = len(books)
    label = state.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = _balls(books, before)
        total = np.zeros(books.shape, dtype=np.int64)
        members = np.zeros(books.shape[:2], dtype=np.int64)
        label_type = pa.null()
        for batch in batches:
            label_type = batch.schema.field("label").type
            points = _parts(_matrix(batch.column("vector")), parts)
            codes = _codes(batch.column("own"), parts)
            for p in range(parts):
                codes[:, p], _, _ = balls[p].assign(points[:, p], codes[:, p])
                for entry in np.unique(codes[:, p]):
                    there = codes[:, p] == entry
                    total[p, entry] += points[there, p].sum(axis=0)
                    members[p, entry] += int(there.sum())
            kept = [batch.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*kept, _packed(codes), *(pa.nulls(batch.num_rows, t) for t in _SUM_TYPES)],
                _STATE + _SUMS,
            )
        part, entry, place = (x.ravel() for x in np.indices(books.shape))
        used = members[part, entry] > 0
        if used.any():
            columns = [part, entry, place, total.ravel(), members[part, entry]]
            n = int(used.sum())
            empty = [pa.nulls(n, t) for t in (pa.int64(), label_type, pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*empty, *(pa.array(c[used], t) for c, t in zip(columns, _SUM_TYPES))], _STATE + _SUMS
            )

    sums = "part int, entry int, place int, total bigint, parts bigint"
    return state.mapInArrow(run, f"{_state_schema(label.simpleString())}, {sums}")


_SUM_TYPES = [pa.int32()] * 3 + [pa.int64()] * 2


def _refined(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Floored means; entries without parts stay. At most a row per component of the codebooks."""
    fresh = books.copy()
    grouped = sums.groupBy("part", "entry", "place").agg(
        F.sum("total").alias("total"), F.sum("parts").alias("parts")
    )
    for row in grouped.collect():
        fresh[row["part"], row["entry"], row["place"]] = row["total"] // row["parts"]
    return fresh


def _start(vectors: DataFrame, parts: int, entries: int) -> tuple[DataFrame, str, np.ndarray]:
    """The table of rounds, where all parts are in entry 0, its path, and the first codebooks."""
    kept = vectors.select(
        F.col("vec_id").cast("long").alias("id"), "label", scaled(F.col("embedding")).alias("v")
    ).where("v is not null")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            size = np.diff(column.offsets.to_numpy())
            matrix = np.zeros((batch.num_rows, width), dtype="<i4")
            matrix[np.repeat(np.arange(len(size)), size), _within(size)] = column.flatten().to_numpy()
            vector = pa.array([row.tobytes() for row in matrix], pa.binary())
            own = _packed(np.zeros((batch.num_rows, parts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), vector, own], _STATE
            )

    schema = _state_schema(kept.schema["label"].dataType.simpleString())
    state, path = stored_at(kept.mapInArrow(pack, schema))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    seeds = np.zeros((len(first), width), dtype=np.int64)
    for i, row in enumerate(first):
        seeds[i, : len(row["v"])] = row["v"]
    return state, path, _parts(seeds, parts).transpose(1, 0, 2)


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of several groups."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each vector, and the codebooks (part, entry, component).

    ``entries`` may be up to 256. ``code`` holds one byte per part, ``error`` the squared
    distances to the entries added up."""
    state, path, books = _start(vectors, parts, entries)
    before = None
    for _ in range(rounds):
        passed, fresh_path = stored_at(_round(state, books, before))
        discard(vectors.sparkSession, path)
        state, path = passed.where("part is null").select(_STATE), fresh_path
        books, before = _refined(books, passed.where("part is not null").select(_SUMS)), books

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = _balls(books, before)
        for batch in batches:
            points = _parts(_matrix(batch.column("vector")), parts)
            codes = _codes(batch.column("own"), parts)
            error = np.zeros(batch.num_rows, dtype=np.int64)
            for p in range(parts):
                codes[:, p], gap, _ = balls[p].assign(points[:, p], codes[:, p])
                error += gap
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), _packed(codes), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    label = state.schema["label"].dataType.simpleString()
    coded = state.mapInArrow(encode, f"vec_id bigint, label {label}, code binary, error bigint")
    return coded, books


def vector_code_digest(vectors: DataFrame) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = compress_vectors(vectors)
    coded = stored(coded)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # A row per label; a frequent label's rows can be split by the join.
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )
