import numpy as np
import pytest
import xxhash
from awkward import docs, empty, rows, words

from conftest import SMALL
from wardline.llm import queries, simhash


def plain_fingerprint(text, shingle=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    held = words(lower)
    shingles = [" ".join(held[i:i + shingle]) for i in range(max(1, len(held) - shingle + 1))] if held else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, number in enumerate(ids):
        held = least.setdefault(find(i), [])
        held += [number] if number is not None else []
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def expected(pairs):
    prints = [plain_fingerprint(text) for _, text in pairs]
    return sorted(zip([n for n, _ in pairs], prints, plain_components([n for n, _ in pairs], prints)), key=repr)


def result(frame):
    found = simhash.components(frame).collect()
    return sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in found), key=repr)


def test_awkward_rows(spark):
    assert result(docs(spark)) == expected([row[:2] for row in rows()])


def test_empty_table(spark):
    assert result(empty(spark)) == []
    assert simhash.keep_one(empty(spark)).collect() == []


def links_connect(spark, prints, bits=4):
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint long")
    edges = simhash.links(frame, bits)
    assert edges.where(f"bit_count(a ^ b) > {bits}").count() == 0
    named = {r.node % 2**64: r.root for r in simhash.labels(edges).collect()}
    mine = [named.get(p, int(np.uint64(p).view(np.int64))) for p in prints]
    theirs = plain_components(prints, prints, bits)
    assert len({*zip(mine, theirs)}) == len(set(mine)) == len(set(theirs))


def test_links_of_random_clusters(spark):
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 2**64, 40, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for centre in centres:
        for _ in range(20):
            flips = draw.choice(64, draw.integers(1, 7), replace=False)
            prints.add(int(centre) ^ sum(1 << int(b) for b in flips))
    links_connect(spark, sorted(prints))


def test_long_postings_are_divided(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_POSTING", 8)
    draw = np.random.default_rng(5)
    prints = {sum(1 << int(b) for b in draw.choice(24, 3, replace=False)) for _ in range(300)}
    links_connect(spark, sorted(prints))


def test_chain_is_one_component(spark):
    prints = [(1 << 4 * i) - 1 for i in range(16)]
    links_connect(spark, prints)


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_labels(spark, shape):
    draw = np.random.default_rng(1)
    edges = {"chain": [(i + 1, i) for i in range(60)], "star": [(7, i) for i in range(40)],
             "random": [tuple(map(int, x)) for x in draw.integers(0, 120, (70, 2))]}[shape]
    found = {r.node: r.root for r in simhash.labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {n: {n} for e in edges for n in e}
    for _ in range(130):
        for a, b in edges:
            near[a] = near[b] = near[a] if near[a] is near[b] else near[a] | near[b]
    for node, root in found.items():
        assert root == min(near[node])
    assert set(found) >= {n for e in edges if e[0] != e[1] for n in e}


def test_keep_one_keeps_one_of_each_component(spark):
    frame = docs(spark)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    pairs = [row[:2] for row in rows()]
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0] is None, pairs[i][0] or 0))
    prints = [plain_fingerprint(pairs[i][1]) for i in order]
    firsts = [pairs[order[i]][0] for i in set(plain_components(list(range(len(order))), prints))]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(firsts, key=repr)


def test_query(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = queries.op10_simhash_components(spark, SMALL).collect()
    want = [(n, f"{p:016x}", c) for n, p, c in expected(pairs)]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted(want)
