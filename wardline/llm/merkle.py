"""A Merkle manifest over grouped rows, with an inclusion proof for each, by time-forward processing.

Rows are leaves. In each group they ascend by their order column (null first, then by leaf); every ``ARITY`` consecutive
nodes of a level become the digest of their hex digests, the last run of a level may be shorter, until one node is left:
the group's subroot. The subroots, by group (null first, then UTF-8 bytes), make the root the same way.

A node's label is its place: tree, level, index. Digests go forward in time, as messages from a label to the one of the
parent. The priority queue that delivers them is external. Between blocks (the nodes under one that lies ``DEPTH`` levels
up) messages are written rows, which Spark's sort, spilling to disk, hands out in label order; inside a block they wait in a
heap. The reversed sweep starts at the root, takes labels in descending order, and delivers to each child its parent's
proof suffix with the child's siblings put in front. So a tree of any size, a hot group's too, is a few waves over
blocks of ``ARITY ** DEPTH`` rows that no two tasks share; a task holds one block and its batch.

A proof is text: level by level up to the root, separated by commas, the siblings' digests with ``*`` in place of the node.

Defined results: null, empty and very long fields are told apart by their lengths, and hashed whole; rows that repeat get
leaves of their own, side by side; a null group or order value comes first; an empty table gives an empty result; columns
other than those named are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.shared import broadcast_checked, cut

ARITY = 3
DEPTH = 7
NODE = "tree long, place long, n long, digest string"


def field(value: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself; null as a dash."""
    held = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(held).cast("string"), F.lit(":"), held), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, joined."""
    return F.sha2(F.concat(*[field(value) for value in values]), 256)


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n``."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their rank from 0 by ``order`` as ``name``: sorted by ranges, numbered inside each, and moved up
    by the rows of the ranges before, of which there are as many as tasks."""
    spread = cut(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = cut(spread.withColumn("_range", F.spark_partition_id()).withColumn("_inside", inside))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.groupBy("_range").agg(F.count("*").alias("rows"))
    ahead = ranges.select("_range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_ahead"))
    return held.join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_range", "_inside", "_ahead")


def _by_block(rows: DataFrame, depth: int) -> DataFrame:
    """The blocks dealt to tasks, each in label order."""
    block = F.floor(F.col("place") / ARITY**depth)
    block = F.when(F.col("path").isNotNull(), F.col("place")).otherwise(block) if "path" in rows.columns else block
    kind = [F.col("path").isNull()] if "path" in rows.columns else []
    return rows.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", *kind, "place")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block; a block may come in several batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        tree, block = held["tree"].to_numpy(), held["block"].to_numpy()
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], cuts):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1]) if len(cuts) else held
    if held is not None and held.num_rows:
        yield held


def _rise(first: int, n: int, digests: list[str], depth: int) -> tuple[str, dict[tuple[int, int], list[tuple[int, str]]]]:
    """The digest of the block's top, and the children (index, digest) of each node in it, by its label."""
    top = min(depth, height(n))
    if not top:
        return digests[0], {}
    queue = [(1, (first + i) // ARITY, first + i, held) for i, held in enumerate(digests)]  # in label order: a heap
    below = {}
    while True:
        label = queue[0][:2]
        children = []
        while queue and queue[0][:2] == label:
            children.append(heapq.heappop(queue)[2:])
        below[label] = children
        made = digest(*[held for _, held in children])
        level, index = label
        if level == top:
            return made, below
        heapq.heappush(queue, (level + 1, index // ARITY, index, made))


def _fall(path: str, below: dict[tuple[int, int], list[tuple[int, str]]]) -> dict[int, str]:
    """The path of each node at the block's base, from that of its top."""
    if not below:
        return {}
    level, index = max(below)
    queue, found = [(-level, -index, path)], {}
    while queue:
        level, index, path = heapq.heappop(queue)
        children = below[-level, -index]
        for child, _ in children:
            left = "".join(held for other, held in children if other < child)
            right = "".join(held for other, held in children if other > child)
            longer = f"{left}*{right},{path}" if path else f"{left}*{right}"
            if level == -1:
                found[child] = longer
            else:
                heapq.heappush(queue, (level + 1, -child, longer))
    return found


def _wave_up(nodes: DataFrame, depth: int) -> DataFrame:
    size = ARITY**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            n, first = rows["n"][0].as_py(), rows["place"][0].as_py()
            made, _ = _rise(first, n, rows["digest"].to_pylist(), depth)
            yield pa.RecordBatch.from_pylist([{"tree": rows["tree"][0].as_py(), "place": first // size, "n": -(-n // size), "digest": made}])

    return cut(_by_block(nodes.select("tree", "place", "n", "digest"), depth).mapInArrow(run, NODE))


def _rising(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The base nodes of every wave, and the last node of each tree (``tree, digest``)."""
    waves, done = [nodes], []
    while True:
        tops = _wave_up(waves[-1], depth)
        done.append(tops.where("n = 1").select("tree", "digest"))
        if tops.where("n > 1").isEmpty():
            return waves, reduce(DataFrame.union, done)
        waves.append(tops.where("n > 1"))


def _falling(waves: list[DataFrame], messages: DataFrame, keep: list[str], depth: int) -> DataFrame:
    """The first wave's nodes with their ``path``, and ``subroot`` as the messages to the trees' tops have it;
    ``messages`` is ``tree, path, subroot``."""
    def run_of(columns: list[str]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _runs(batches):
                told, nodes = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
                if not nodes.num_rows:
                    continue
                first = nodes["place"][0].as_py()
                _, below = _rise(first, nodes["n"][0].as_py(), nodes["digest"].to_pylist(), depth)
                found = _fall(told["path"], below) or {first: told["path"]}
                paths = pa.array([found[first + i] for i in range(nodes.num_rows)])
                nodes = nodes.set_column(nodes.schema.get_field_index("path"), "path", paths)
                same = pa.array([told["subroot"]] * nodes.num_rows, pa.string())
                nodes = nodes.set_column(nodes.schema.get_field_index("subroot"), "subroot", same)
                yield from nodes.select(columns).combine_chunks().to_batches()

        return run

    above = None
    for number, nodes in reversed(list(enumerate(waves))):
        # A tree is told at the wave that its top is made in; below, by the wave before.
        tops = nodes.where((F.col("place") == 0) & (F.col("n") <= ARITY**depth)).select("tree")
        told = messages.join(tops, "tree").withColumn("place", F.lit(0).cast("long"))
        told = told if above is None else told.unionByName(above.select("tree", "path", "subroot", "place"))
        extra = keep if number == 0 else []
        columns = ["tree", "place", "digest", "path", "subroot", *extra]
        rows = nodes.select("tree", "place", "n", "digest", *extra).unionByName(told, allowMissingColumns=True)
        schema = rows.select(*columns).schema
        above = _by_block(rows, depth).mapInArrow(run_of(columns), schema)
        above = above if number == 0 else cut(above)
    return above


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", leaf: str = "leaf", keep: tuple[str, ...] = (),
             depth: int = DEPTH) -> DataFrame:
    """Per row its ``order`` column, ``leaf``, ``subroot``, ``root`` and ``proof``, and the columns of ``keep``, which
    must not be named like one of these. ``leaf`` holds hex digests. ``depth`` sets the size of blocks, not the result."""
    held = rows.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.col(leaf).alias("digest"),
                       *[F.col(name).alias(f"_keep_{i}") for i, name in enumerate(keep)])
    extra = [f"_keep_{i}" for i in range(len(keep))]
    by = [F.col("_group").asc_nulls_first(), F.col("_order").asc_nulls_first(), F.col("digest")]
    placed = cut(numbered(held, by, "at"))
    groups = placed.groupBy("_group").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = cut(numbered(groups, [F.col("_group").asc_nulls_first()], "tree")).withColumnRenamed("_group", "_its_group")
    leaves = cut(
        placed.join(broadcast_checked(groups), F.col("_group").eqNullSafe(F.col("_its_group")))
        .select("tree", (F.col("at") - F.col("first")).alias("place"), "n", "digest", "_order", *extra)
    )
    waves, subroots = _rising(leaves, depth)
    subroots = cut(subroots)
    # Written, so that the one tree's number is a column to join by and not a constant.
    above = cut(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"),
                                F.lit(subroots.count()).cast("long").alias("n"), "digest"))
    upper, roots = _rising(above, depth)
    root = roots.first()
    told = roots.select("tree", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"))
    messages = cut(_falling(upper, told, [], depth).select(F.col("place").alias("tree"), "path", F.col("digest").alias("subroot")))
    found = _falling(waves, messages, ["_order", *extra], depth)
    return found.select(
        F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"), F.col("path").alias("proof"),
        *[F.col(f"_keep_{i}").alias(name) for i, name in enumerate(keep)],
    )


def siblings(proof: Column) -> Column:
    """The digests of a proof, level by level, left to right."""
    return F.translate(proof, "*,", "")


def fold(held: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for level in proof.split(",") if proof else []:
        left, right = level.split("*")
        held = digest(left, held, right)
    return held


def folded(rows: DataFrame, leaf: str, proof: str, name: str = "folded_root") -> DataFrame:
    """``rows`` without ``proof``, with the root that ``leaf`` leads to as ``name``; null where the leaf is."""
    left = [column for column in rows.columns if column != proof]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch[leaf].to_pylist(), batch[proof].to_pylist())
            found = pa.array([None if held is None else fold(held, path) for held, path in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch[column] for column in left], found], [*left, name])

    return rows.mapInArrow(run, rows.select(*left).withColumn(name, F.lit("")).schema)
