"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt into shards of about ``SHARD`` by a hash of their id; each task builds a ball tree over one shard.
A node's inner product with a query is at most that of its centre plus its radius times the query's length. A query
takes nodes in order of this bound and stops at the first below its current k-th score.

The k-th score is shared between shards in two waves: each query first searches its home shard, and the k-th score it
finds there is where its search of every other shard starts. Only scores that reach it come back.

A query set is a given part of the rows. It meets the shards in blocks of about ``BLOCK`` queries, so a task holds one
shard and one block whatever the sizes; scores within a task are never all formed.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
vectors of different lengths don't meet; an empty vector scores 0 with others; equal rows count once; rows that share
an id are one candidate, which counts with its best score and is never a result of its own query; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.shared import cut

SHARD = 8192
BLOCK = 16384
LEAF = 64


def scaled(vectors: DataFrame, factor: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vec``: the vectors that take part, each component x as floor(factor * x)."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    held = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("raw"))
    return (
        held.where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull()).where(F.forall("raw", finite))
        .select("vec_id", F.transform("raw", lambda x: F.floor(F.lit(factor) * x)).alias("vec")).distinct()
    )


@dataclass
class BallTree:
    """Balls over ``points``: node i holds the rows ``start[i]`` to ``end[i]`` and the nodes ``below[i]``."""

    points: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: list[int]
    end: list[int]
    below: list[tuple[int, ...]]

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.lexsort((ids,))
        start, end, below, centre, radius = [], [], [], [], []
        work = [(0, len(order), None)]
        while work:
            a, b, parent = work.pop()
            number = len(start)
            if parent is not None:
                below[parent] += (number,)
            own = points[order[a:b]]
            middle = own.mean(axis=0)
            away = np.sqrt(((own - middle) ** 2).sum(axis=1))
            start.append(a)
            end.append(b)
            below.append(())
            centre.append(middle)
            radius.append(away.max())
            if b - a > leaf and away.max() > 0:
                one = own[away.argmax()]
                far = ((own - one) ** 2).sum(axis=1)
                along = own @ (own[far.argmax()] - one)
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(along, half)]
                work += [(a, a + half, number), (a + half, b, number)]
        return cls(points[order], ids[order], np.array(centre), np.array(radius), start, end, below)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node a number that no inner product with a point of the node exceeds."""
        length = np.sqrt((queries**2).sum(axis=1))[:, None]
        slack = 1e-9 * length * (np.sqrt((self.centre**2).sum(axis=1)) + self.radius) + 1e-6
        return queries @ self.centre.T + length * self.radius + slack

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, id)`` but for id ``own``, as far as scores reach ``floor``."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        kth, nodes = floor, [(-bounds[0], 0)]
        while nodes:
            negative, node = heapq.heappop(nodes)
            if -negative < kth:
                break
            if self.below[node]:
                for child in self.below[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(nodes, (-bounds[child], child))
                continue
            rows = slice(self.start[node], self.end[node])
            scores = self.points[rows] @ query
            for place in np.flatnonzero(scores >= kth):
                score, number = int(scores[place]), int(self.ids[rows][place])
                if number == own:
                    continue
                same = next((at for at, (_, held) in enumerate(best) if -held == number), None)
                if same is not None:  # another row of this id
                    best[same] = max(best[same], (score, -number))
                    heapq.heapify(best)
                else:
                    heapq.heappush(best, (score, -number))
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        return [(score, -negative) for score, negative in best]


def _matrices(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dimension, rows, matrix)`` of the vectors of each length."""
    column = table["vec"].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, flat[(ends[rows] - size)[:, None] + np.arange(size)].astype(np.int64)


_FOUND = "query_id long, vec_id long, score long"


def _searcher(k: int):
    def run(key: tuple, points: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if points.num_rows and queries.num_rows:
            ids, names = points["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            floors = queries["floor"].to_numpy(zero_copy_only=False)
            held = {size: (rows, matrix) for size, rows, matrix in _matrices(points)}
            for size, rows, asked in _matrices(queries):
                if size not in held:
                    continue
                of, matrix = held[size]
                largest = float(np.abs(matrix).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(size, 1)
                tree = BallTree.build(matrix.astype(float), ids[of])
                if largest >= 2.0**53:  # doubles would round the scores
                    tree.points = tree.points.astype(np.int64)
                for at in range(0, len(rows), 256):
                    some = asked[at:at + 256]
                    for query, row, bounds in zip(some, rows[at:at + 256], tree.bounds(some.astype(float))):
                        exact = query if largest >= 2.0**53 else query.astype(float)
                        best = tree.search(exact, int(names[row]), bounds, k, float(floors[row]))
                        found += [(int(names[row]), number, score) for score, number in best]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(points: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``points`` for every one of ``queries``, both
    ``vec_id, vec``."""
    points = cut(points)
    queries = cut(queries.select(F.col("vec_id").alias("vec_id"), F.col("vec").alias("vec")))  # columns of their own
    shards = max(1, -(-points.count() // shard))
    blocks = max(1, -(-queries.count() // block))

    def dealt(name, parts):
        return F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(parts)).cast("int")

    def search(asked):
        """One wave: the queries of ``asked`` in the shard they name."""
        held = points.withColumn("shard", dealt("shard", shards)).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_searcher(k), _FOUND)

    asked = queries.withColumn("block", dealt("block", blocks)).withColumn("home", dealt("shard", shards))
    first = cut(search(asked.select("vec_id", "vec", "block", F.col("home").alias("shard"), F.lit(float("-inf")).alias("floor"))))
    reached = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    floors = reached.select(F.col("query_id").alias("vec_id"), F.col("least").cast("double").alias("least"))
    others = (
        asked.join(floors, "vec_id", "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
        .select("vec_id", "vec", "block", "shard", F.coalesce("least", F.lit(float("-inf"))).alias("floor"))
    )
    found = first.union(search(others)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
