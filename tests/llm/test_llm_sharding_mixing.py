from zlib import crc32

import numpy as np
import pytest
from awkward import docs, empty, rows, words

from conftest import SMALL
from wardline.llm import mixing, queries, sharding


def greedy(sizes, capacity, shards):
    used, room = 0, 0
    for size in sizes:
        if size > capacity:
            return False
        if size > room:
            used, room = used + 1, capacity
        room -= size
    return used <= shards


def smallest(sizes, shards):
    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(sizes, middle, shards) else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards, cells", [(1, 8), (3, 4), (8, 16), (8, 100_000), (60, 32)])
def test_cuts_are_minimax(spark, shards, cells):
    draw = np.random.default_rng(shards)
    sizes = [int(x) for x in np.concatenate([draw.integers(1, 50, 200), draw.integers(1, 4000, 8)])]
    draw.shuffle(sizes)
    ends = np.cumsum(sizes)
    frame = spark.createDataFrame([(s, int(e)) for s, e in zip(sizes, ends)], "size long, end long")
    capacity, cuts = sharding.minimax_cuts(frame, shards, cells)
    assert capacity == smallest(sizes, shards)
    assert cuts[-1] == ends[-1] and max(np.diff([0, *cuts])) <= capacity and set(cuts) <= {0, *map(int, ends)}


@pytest.mark.parametrize("sizes, shards", [
    ([10] * 100 + [500] + [10] * 100, 8), ([500] + [10] * 100, 4), ([10] * 100 + [500], 4), ([7, 900, 5], 2), ([7, 900, 5], 3), ([900], 4),
    ([600, 340, 60], 3), ([10] * 30 + [400] + [10] * 30 + [300] + [10] * 40, 8), ([1, 1, 1], 8),
])
def test_a_large_group_leaves_no_shard_empty(spark, sizes, shards):
    ends = [int(x) for x in np.cumsum(sizes)]
    frame = spark.createDataFrame(list(zip(sizes, ends)), "size long, end long")
    capacity, cuts = sharding.even_cuts(frame, shards)
    loads = list(np.diff([0, *cuts]))
    assert capacity == smallest(sizes, shards) and max(loads) <= capacity and cuts[-1] == ends[-1] and set(cuts) <= set(ends)
    if max(sizes) * shards > sum(sizes) and len(sizes) >= shards and max(sizes) == capacity:
        assert min(loads) > 0
    others = sorted(loads)[:-1]
    if len(sizes) > 200:  # contiguous runs: the sides of a large group have whole numbers of shards
        assert max(others) <= 1.5 * min(others)


def check(found, pairs, shards=8):
    sizes = [len((text or "").encode()) + 1 for _, text in pairs]
    want = sorted(((n, size, crc32((text or "").encode())) for (n, text), size in zip(pairs, sizes)), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == want
    slots, of = {}, {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        of.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(held) == list(range(len(held))) for held in slots.values())
    assert all(len(held) == 1 for held in of.values()) and set(slots) <= set(range(shards))
    return [sum(r.size for r in found if r.shard == s) for s in range(shards)]


def test_shard_awkward_rows(spark):
    check(sharding.shard(docs(spark), 3).collect(), [row[:2] for row in rows()], 3)


def test_shard_slots_of_many_copies(spark):
    pairs = [(i, "copy") for i in range(3000)] + [(i, f"own {i}") for i in range(3000, 6000)]
    frame = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    check(sharding.shard(frame, 4).collect(), pairs, 4)


def test_a_text_of_a_third_of_all_bytes(spark):
    pairs = [(i, "hot" * 99) for i in range(100)] + [(i, f"own text number {i} " * 14) for i in range(100, 300)]
    frame = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    loads = sorted(check(sharding.shard(frame, 8).collect(), pairs))
    assert loads[0] > 0 and loads[6] <= 2 * loads[0] and loads[7] == 100 * 298


def test_empty_tables(spark):
    assert sharding.shard(empty(spark)).collect() == []
    assert mixing.copies(empty(spark)).collect() == [] == mixing.mix(empty(spark)).collect()


def test_shard_query(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    loads = check(queries.op2_minimax_shards(spark, SMALL).collect(), pairs)
    assert max(loads) <= sum(loads) / 8 + max(len((t or "").encode()) + 1 for _, t in pairs)


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The targets, by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / total for s in order}
        over = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not over or over | capped == set(order):
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    draw = np.random.default_rng(seed)
    sizes = {f"s{i}": int(draw.integers(0, 10 ** draw.integers(1, 6))) for i in range(23)} | {None: 500, "é": 3, "Z": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = shares(sizes)
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix_awkward_rows(spark):
    frame = docs(spark)
    found = mixing.copies(frame).collect()
    want = sorted((len(words(text)), number) for number, text, *_ in rows() if number is not None)
    assert sorted((r.size, r.doc_id) for r in found if r.doc_id is not None) == want
    sizes = {}
    for _, text, _, source, *_ in rows():
        sizes[source] = sizes.get(source, 0) + len(words(text))
    assert all(r.source_size in sizes.values() and r.copies <= 2 for r in found)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r.copies for r in found)


def test_reruns_agree_and_targets_are_met(spark):
    frame = spark.createDataFrame([(i, "w " * (i % 40), f"s{i % 5}") for i in range(20_000)], "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.copies(frame.repartition(n)).collect())) for n in (2, 9))
    assert first == again
    taken = {}
    for _, size, source_size, target, _, copies in first:
        taken.setdefault((target, source_size), []).append(size * copies)
    for (target, source_size), held in taken.items():
        assert abs(sum(held) - target) < 0.02 * target


def test_more_sources_than_may_be_broadcast(spark, monkeypatch):
    frame = docs(spark)
    few = sorted(map(repr, mixing.copies(frame).collect()))
    monkeypatch.setattr(mixing, "broadcast_checked", lambda rates: rates)
    assert sorted(map(repr, mixing.copies(frame).collect())) == few
