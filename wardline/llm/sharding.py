"""Sharding by a minimax contiguous partition.

Rows with equal texts form an atomic group. Groups stand in one fixed order, that of their text's hash, and a
shard is a run of neighbouring groups. The smallest capacity for which a greedy fill needs no more than the given
number of shards is found by binary search, and the groups are cut there, so the largest shard is as small as
a contiguous partition allows. Where one group is larger than an even share it sets that capacity, and a greedy fill by it would
leave the last shards with little or nothing. Such a group gets a shard of its own, and the groups before and after it are
partitioned again, over the shards left, if that needs no larger capacity.

At scale: groups are summed map-side, so a text that makes up a third of all rows is one row. Running sums are
taken inside 4096 hash blocks and shifted by the blocks' totals. The search never sees the groups: it gets, for at
most ``CELLS`` cells of the running sum, the first and last group end. A greedy fill over these is exact outside
the cells; two searches, one reading each cell as favourably and one as unfavourably as possible, bracket the
capacity, and only the cells that a cut can lie in are divided again, until both agree (each round narrows the
bracket by about CELLS / (8 * shards), so two or three rounds settle any size).

Defined results: a null text counts as empty, both being one group; repeated rows each get a slot; ids may be
null or tied (their order among equals is that of the hash, which is free); an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.shared import cut, text_key

CELLS = 1 << 16
BLOCK_BITS = 12
SALTS = 1024


def _ends(groups: DataFrame) -> DataFrame:
    """``k1, k2, size, end``: every group with the running sum of sizes up to and with it."""
    block = F.shiftright("k1", 64 - BLOCK_BITS)
    inside = Window.partitionBy("block").orderBy("k1", "k2")
    blocks = groups.withColumn("block", block)
    totals = blocks.groupBy("block").agg(F.sum("size").alias("total"))
    before = totals.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("before"))
    return (
        blocks.withColumn("inside", F.sum("size").over(inside))
        .join(F.broadcast(before), "block")  # 2 ** BLOCK_BITS rows at most
        .select("k1", "k2", "size", (F.col("before") + F.col("inside")).alias("end"))
    )


class _Known:
    """Group ends as far as they are known: intervals [first, last] that start and end with a group's end."""

    def __init__(self, intervals: list[tuple[int, int]]):
        self.intervals = sorted(intervals)
        self.first = [first for first, _ in self.intervals]

    def reach(self, limit: int, high: bool) -> int:
        """The largest group end up to ``limit``; inside an interval the ``high`` or the low guess at it."""
        at = bisect_right(self.first, limit) - 1
        if at < 0:
            return 0
        first, last = self.intervals[at]
        return last if last <= limit else limit if high else first

    def fill(self, capacity: int, shards: int, high: bool) -> list[int]:
        """Where a greedy fill by ``capacity`` cuts."""
        cuts, at = [], 0
        for _ in range(shards):
            at = self.reach(at + capacity, high)
            cuts.append(at)
        return cuts

    def smallest(self, total: int, low: int, shards: int, high: bool) -> int:
        """The smallest capacity from ``low`` whose greedy fill holds everything."""
        top = total
        while low < top:
            middle = (low + top) // 2
            if self.fill(middle, shards, high)[-1] >= total:
                top = middle
            else:
                low = middle + 1
        return low


def minimax_cuts(ends: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and ``shards`` running sums at which a fill by it cuts.

    ``cells`` should be well above the square of ``shards`` for few rounds; the result doesn't depend on it.
    """
    facts = ends.agg(F.max("end").alias("total"), F.max("size").alias("largest")).first()
    total, least = facts["total"] or 0, 0
    if not total:
        return 0, [0] * shards
    least = max(facts["largest"], -(-total // shards))
    spans, settled, width = [(0, total)], [], 2 * total
    while True:
        width = max(1, min(width // 2, -(-sum(b - a for a, b in spans) // cells)))
        intervals = settled + _outermost(ends, spans, width)
        known = _Known(intervals)
        low = known.smallest(total, least, shards, high=True)
        high = known.smallest(total, low, shards, high=False)
        if low == high:
            return low, known.fill(low, shards, high=False)
        # The limit that cut j + 1 is sought below, for every capacity in [low, high]:
        limits = [(a + low, b + high) for a, b in zip([0, *known.fill(low, shards, high=False)],
                                                      [0, *known.fill(high, shards, high=True)])]
        unsure = [(first - 1, last) for first, last in intervals
                  if first < last and any(first <= b and last > a for a, b in limits)]
        spans = _joined(unsure)
        settled = [(x, y) for x, y in intervals if not any(a < x and y <= b for a, b in spans)]


def even_cuts(ends: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and ``shards`` running sums to cut at, with groups above an even share set apart."""
    last = ends.agg(F.max("end").alias("end")).first()["end"] or 0

    def solve(low: int, high: int, count: int) -> tuple[int, list[int]]:
        part = ends.where((F.col("end") > low) & (F.col("end") <= high)).select("size", (F.col("end") - low).alias("end"))
        capacity, cuts = minimax_cuts(part, count, cells)
        plain = capacity, [low + at for at in cuts]
        big = part.orderBy(F.col("size").desc(), "end").first()
        if big is None or count == 1 or big["size"] * count <= high - low:
            return plain
        before, after = big["end"] - big["size"], high - low - big["end"]
        sides = (before > 0) + (after > 0)
        if not sides or count - 1 < sides:
            return plain
        left = round((count - 1) * before / (before + after)) if sides == 2 else (count - 1) * (before > 0)
        left = min(max(left, 1), count - 2) if sides == 2 else left
        most, found = big["size"], []
        for a, b, n in ((low, low + before, left), (low + big["end"], high, count - 1 - left)):
            if n:
                needed, inside = solve(a, b, n)
                most = max(most, needed)
                found += inside
            if a == low:
                found.append(low + big["end"])
        return (capacity, found) if most <= capacity else plain

    return solve(0, last, shards) if last else (0, [0] * shards)


def _outermost(ends: DataFrame, spans: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """First and last group end in each cell of ``width`` of the spans (a, b]."""
    cell, span = F.lit(None).cast("long"), F.lit(None).cast("int")
    for number, (a, b) in enumerate(spans):
        here = (F.col("end") > a) & (F.col("end") <= b)
        cell = F.when(here, F.floor((F.col("end") - F.lit(a + 1)) / F.lit(width))).otherwise(cell)
        span = F.when(here, F.lit(number)).otherwise(span)
    cells = (
        ends.select("end", span.alias("span"), cell.alias("cell")).where("span IS NOT NULL")
        .groupBy("span", "cell").agg(F.min("end").alias("first"), F.max("end").alias("last"))
    )
    return [(row["first"], row["last"]) for row in cells.collect()]


def _joined(spans: list[tuple[int, int]], most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` spans that cover ``spans``, the widest gaps between them left out."""
    spans = sorted(spans)
    gaps = sorted(range(1, len(spans)), key=lambda i: spans[i - 1][1] - spans[i][0])[: most - 1]
    bounds = [0, *sorted(gaps), len(spans)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in zip(bounds, bounds[1:])]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    k1, k2 = text_key(F.col(text))
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"), k1.alias("k1"), k2.alias("k2"),
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).alias("salt"),
    )


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, size, text_crc32, shard, slot``: sizes are UTF-8 bytes plus one, slots are gapless in
    each shard, and rows of one text share a shard.

    The slot is the number of rows before: groups are subdivided by a hash of the id (``SALTS`` parts), rows are
    numbered inside these parts, and the parts' starts come from running counts. Texts are read, never moved.
    """
    rows = _rows(docs, doc_id, text)
    parts = cut(rows.groupBy("k1", "k2", "salt").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    groups = parts.groupBy("k1", "k2").agg(F.sum("size").alias("size"))
    ends = cut(_ends(groups))
    _, cuts = even_cuts(ends, shards)
    # The last group of each shard: a handful of keys. A group's shard is the number of shards that end before it.
    marks = ends.where(F.col("end").isin([int(c) for c in cuts[:-1]])).select("k1", "k2", "end").collect()
    number = F.lit(0)
    for at in cuts[:-1]:
        mark = next((m for m in marks if m["end"] == at), None)
        if mark is not None:
            after = (F.col("k1") > mark["k1"]) | ((F.col("k1") == mark["k1"]) & (F.col("k2") > mark["k2"]))
            number = number + F.when(after, 1).otherwise(0)
    block = F.shiftright("k1", 64 - BLOCK_BITS)
    placed = parts.withColumn("shard", number.cast("int")).withColumn("block", block)
    inside = Window.partitionBy("shard", "block").orderBy("k1", "k2", "salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "block").agg(F.sum("rows").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead_of = counts.select("shard", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    starts = (
        placed.withColumn("within", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
        .join(F.broadcast(ahead_of), ["shard", "block"])  # 2 ** BLOCK_BITS + shards rows at most
        .select("k1", "k2", "salt", "shard", (F.col("ahead") + F.col("within")).alias("start"))
    )
    among = Window.partitionBy("k1", "k2", "salt").orderBy("doc_id", "size")
    numbered = rows.withColumn("nth", F.row_number().over(among) - 1)
    return numbered.join(starts, ["k1", "k2", "salt"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).alias("slot"))
