"""Exact top-k inner products by dual cover-tree search.

Vectors are dealt to blocks by their nearest pivot; queries lie in the same blocks as the data.
Each block gets a cover tree of its vectors and one of its queries: every node has a centre
and a covering radius, and children cover a fraction of it. A pair of a query node and a data
node is left out when no product between them can reach the worst kth score of the node's
queries; the largest possible product follows from centres and radii.

First each block answers its own queries, which gives every query a kth score. Then query
groups meet the other blocks that the same bound does not rule out, and the best of all are
kept. Pivots and block size only steer the work; results are exact.

Defined cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros; equal scores go to the smaller id; every row is a
candidate and, if its id says so, a query of its own, also where rows share an id or are equal: such a
query meets all rows but itself, and rows that share an id give a result each; a query with fewer
candidates gets all of them; an empty table gives an empty result; other columns do not matter.
Scores are exact: vectors whose squared length reaches 2**53 after scaling, beyond which sums of
products in doubles may round, are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arledger.llm.common import stored

#: Pivots: one per block of rows, between these bounds.
PIVOTS = (16, 1024)
BLOCK_ROWS = 4096
#: Query groups that meet a block's tree in one row.
_GROUPS = 256
_LEAF = 128
_SHRINK = 1.3


def scaled(embedding: Column) -> Column:
    """Floors of 256 times the components; null for vectors that take no part."""
    values = F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    bad = F.exists(
        embedding,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return F.when(~F.coalesce(bad, F.lit(True)), values)


class CoverTree:
    """Nodes in arrays; a node's points are a range of ``order``."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.range: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            self._build(points, 0, len(points))
        self.norm = [float(np.sqrt(c @ c)) for c in self.centre]

    def _build(self, points: np.ndarray, low: int, high: int) -> int:
        own = points[self.order[low:high]]
        centre = own.mean(axis=0)
        gap = np.sqrt(((own - centre) ** 2).sum(axis=1))
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(gap.max()))
        self.range.append((low, high))
        self.children.append([])
        if high - low <= _LEAF or self.radius[node] == 0:
            return node
        # Cover the points with balls of a fraction of the radius, farthest point first.
        # Balls of few points are gathered, so a node without clusters has few children.
        near = self.radius[node] / _SHRINK
        left = np.arange(high - low)
        gathered: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        for _ in range(16):
            if not len(left):
                break
            first = own[left[gap[left].argmax()]]
            inside = ((own[left] - first) ** 2).sum(axis=1) <= near**2
            (parts if inside.sum() >= _LEAF // 4 else gathered).append(left[inside])
            left = left[~inside]
        rest = np.concatenate([*gathered, left]).astype(np.int64)
        parts += [rest[i : i + 4 * _LEAF] for i in range(0, len(rest), 4 * _LEAF)]
        if len(parts) == 1:
            half = np.argsort(own @ (own[gap.argmax()] - centre), kind="stable")
            parts = [half[: len(half) // 2], half[len(half) // 2 :]]
        members = self.order[low:high].copy()
        at = low
        for part in parts:
            self.order[at : at + len(part)] = members[part]
            at += len(part)
        at = low
        for part in parts:
            self.children[node].append(self._build(points, at, at + len(part)))
            at += len(part)
        return node


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        hit = scores >= self.score[rows, -1][:, None]
        hit &= scores > -np.inf
        for i in np.flatnonzero(hit.any(axis=1)):
            row, new = rows[i], hit[i]
            score = np.concatenate([self.score[row], scores[i, new]])
            id_ = np.concatenate([self.id[row], ids[new]])
            keep = np.lexsort((id_, -score))[:k]
            self.score[row], self.id[row] = score[keep], id_[keep]


def dual_search(
    queries: np.ndarray, query_keys: np.ndarray, data: np.ndarray, data_keys: np.ndarray,
    data_ids: np.ndarray, data_tree: CoverTree, best: Best,
) -> None:
    """Offers to ``best`` all products that can matter. A query never meets its own row, which
    keys tell apart."""
    if not len(queries) or not len(data):
        return
    q = CoverTree(queries)

    def bound(a: int, b: int) -> float:
        product = float(q.centre[a] @ data_tree.centre[b])
        ra, rb = q.radius[a], data_tree.radius[b]
        reach = ra * data_tree.norm[b] + rb * q.norm[a] + ra * rb
        return product + reach + 1e-6 * (1 + abs(product) + reach)

    stack = [(bound(0, 0), 0, 0)]
    while stack:
        most, a, b = stack.pop()
        rows = q.order[slice(*q.range[a])]
        if most < best.score[rows, -1].min():
            continue
        below_a, below_b = q.children[a], data_tree.children[b]
        if not below_a and not below_b:
            at = data_tree.order[slice(*data_tree.range[b])]
            scores = queries[rows] @ data[at].T
            scores[query_keys[rows][:, None] == data_keys[at][None, :]] = -np.inf
            best.offer(rows, scores, data_ids[at])
        elif below_a and (not below_b or q.radius[a] > data_tree.radius[b]):
            stack += sorted((bound(x, b), x, b) for x in below_a)
        else:
            stack += sorted((bound(a, x), a, x) for x in below_b)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, row in enumerate(column.to_pylist()):
        out[i, : len(row)] = row
    return out


def _found(best: Best, query_keys: np.ndarray, query_ids: np.ndarray) -> pd.DataFrame:
    real = best.score > -np.inf
    return pd.DataFrame(
        {
            "query_key": np.repeat(query_keys, real.sum(axis=1)),
            "query_id": np.repeat(query_ids, real.sum(axis=1)),
            "vec_id": best.id[real],
            "score": best.score[real].astype(np.int64),
        }
    )


def _dealt(vectors: DataFrame, width: int, rows: int) -> DataFrame:
    """(key, vec_id, v, block): nearest pivot, large cells salted into blocks of bounded size."""
    order = F.xxhash64("vec_id", "v")
    wanted = min(max(PIVOTS[0], -(-rows // BLOCK_ROWS)), PIVOTS[1])
    picked = vectors.orderBy(order, "vec_id").limit(wanted).toArrow()
    pivots = _matrix(picked.column("v"), width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            gap = (pivots**2).sum(axis=1)[None, :] - 2 * v @ pivots.T
            cell = pa.array(gap.argmin(axis=1).astype(np.int32))
            packed = pa.array([row.tobytes() for row in v], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("vec_id"), packed, cell],
                ["key", "vec_id", "v", "cell"],
            )

    cells = stored(vectors.mapInArrow(assign, "key bigint, vec_id bigint, v binary, cell int"))
    blocks = {
        r["cell"]: -(-r["count"] // BLOCK_ROWS) for r in cells.groupBy("cell").count().collect()
    }
    of_cell = F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair))
    salt = F.pmod(F.xxhash64(F.lit(3), "key"), F.element_at(of_cell, F.col("cell")))
    return cells.select(
        "key", "vec_id", "v", (F.col("cell").cast("long") * (1 << 40) + salt).alias("block")
    )


def top_products(
    embeddings: DataFrame, k: int = 5, query_every: int = 50, id_column: str = "vec_id"
) -> DataFrame:
    """For each row whose id is divisible by ``query_every``: query_id, rank, vec_id, score."""
    schema = "query_key bigint, query_id bigint, vec_id bigint, score bigint"
    spark = embeddings.sparkSession
    vectors = stored(
        embeddings.select(
            F.col(f"`{id_column}`").cast("bigint").alias("vec_id"),
            scaled(F.col("embedding")).alias("v"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .withColumn("key", F.monotonically_increasing_id())
    )
    # Keys are fixed from here on, because they are read from the stored table.
    width, rows, longest = vectors.agg(
        F.max(F.size("v")), F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    ).first()
    if longest is not None and not longest < 2.0**53:
        raise ValueError("vectors are too long after scaling for exact products in doubles")
    if not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dealt = _dealt(vectors, width, rows)

    def summarize(rows: pd.DataFrame) -> pd.DataFrame:
        """A block: its vectors, its queries with their kth scores, centres and radii."""
        rows = rows.sort_values(["vec_id", "key"])
        keys, ids = rows["key"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
        v = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(-1, width)
        asked = ids % query_every == 0
        best, tree = Best(int(asked.sum()), k), CoverTree(v)
        dual_search(v[asked], keys[asked], v, keys, ids, tree, best)
        q = v[asked]
        centre = q.mean(axis=0) if len(q) else np.zeros(width)
        far = float(np.sqrt(((q - centre) ** 2).sum(axis=1)).max()) if len(q) else 0.0
        return pd.DataFrame(
            {
                "block": [int(rows["block"].iloc[0])],
                "keys": [keys.tobytes()],
                "ids": [ids.tobytes()],
                "v": [v.astype(np.int32).tobytes()],  # the bound on lengths keeps them below 2**27
                "centre": [tree.centre[0]],
                "radius": [tree.radius[0]],
                "q_keys": [keys[asked].tobytes()],
                "q_ids": [ids[asked].tobytes()],
                "q_v": [q.tobytes()],
                "q_centre": [centre],
                "q_radius": [far],
                "q_score": [best.score.tobytes()],
                "q_best": [best.id.tobytes()],
                "q_worst": [float(best.score[:, -1].min()) if len(q) else np.inf],
            }
        )

    blocks = stored(
        dealt.groupBy("block").applyInPandas(
            summarize,
            "block bigint, keys binary, ids binary, v binary, centre array<double>, radius double, "
            "q_keys binary, q_ids binary, q_v binary, q_centre array<double>, q_radius double, "
            "q_score binary, q_best binary, q_worst double",
        )
    )

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.frombuffer(row.q_ids, np.int64)
                best = Best(len(ids), k)
                best.score = np.frombuffer(row.q_score, np.float64).reshape(-1, k)
                best.id = np.frombuffer(row.q_best, np.int64).reshape(-1, k)
                yield _found(best, np.frombuffer(row.q_keys, np.int64), ids)

    local = blocks.select("q_keys", "q_ids", "q_score", "q_best").mapInPandas(own, schema)
    pairs = _block_pairs(blocks)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                keys, ids = np.frombuffer(row.keys, np.int64), np.frombuffer(row.ids, np.int64)
                data = np.frombuffer(row.v, np.int32).reshape(-1, width).astype(np.float64)
                tree = CoverTree(data)
                for group in row.groups:
                    q_keys = np.frombuffer(group["q_keys"], np.int64)
                    q_ids = np.frombuffer(group["q_ids"], np.int64)
                    q = np.frombuffer(group["q_v"], np.float64).reshape(-1, width)
                    score = np.frombuffer(group["q_score"], np.float64).reshape(-1, k)
                    best = Best(len(q), k)
                    # Only the known kth score counts here; its own rows come from ``local``.
                    best.score[:] = score[:, -1:]
                    known = best.score.copy()
                    dual_search(q, q_keys, data, keys, ids, tree, best)
                    fresh = best.id != np.iinfo(np.int64).max
                    best.score = np.where(fresh, best.score, -np.inf)
                    if fresh.any() and known.size:
                        yield _found(best, q_keys, q_ids)

    asked = blocks.select(
        F.col("block").alias("q_block"), F.struct("q_keys", "q_ids", "q_v", "q_score").alias("group")
    )
    batched = (
        pairs.join(asked, "q_block")
        .groupBy("block", "chunk")
        .agg(F.collect_list("group").alias("groups"))
        .join(blocks.select("block", "keys", "ids", "v"), "block")
        .select("keys", "ids", "v", "groups")
    )
    others = batched.mapInPandas(meet, schema)
    ranked = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return (
        local.unionByName(others)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(q_block, block, chunk) that the bound on centres and radii does not rule out.

    The query set against all rows, in blocks: groups are sent to each shard of the block
    summaries, and pairs are made by an equi-join on the shard."""
    total = blocks.count()
    shards = max(1, -(-total // _GROUPS))
    data = blocks.select(
        "block", "centre", "radius", F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard")
    )
    groups = blocks.where(F.octet_length("q_ids") > 0).select(
        F.col("block").alias("q_block"),
        "q_centre",
        "q_radius",
        "q_worst",
        F.pmod(F.xxhash64(F.lit(1), "block"), F.lit(shards)).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)

    reach = (
        F.col("q_radius") * F.sqrt(dot("centre", "centre"))
        + F.col("radius") * F.sqrt(dot("q_centre", "q_centre"))
        + F.col("q_radius") * F.col("radius")
    )
    product = dot("q_centre", "centre")
    most = product + reach + 1e-6 * (1 + F.abs(product) + reach)
    return (
        groups.join(data.withColumn("shard", F.col("shard").cast("int")), "shard")
        .where((F.col("q_block") != F.col("block")) & (most >= F.col("q_worst")))
        .select("q_block", "block", "chunk")
    )
