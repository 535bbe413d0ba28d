from collections import Counter
from hashlib import sha256
from itertools import groupby
from zlib import crc32

import pytest
from awkward import docs, empty, rows
from pyspark.sql import functions as F

from wardline.llm import merkle, queries
from wardline.session import scratch_path


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    """Every level of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, at):
    """Siblings to the left and right of leaf ``at`` and the nodes above it."""
    steps = []
    for level in tree[:-1]:
        run = at // 3 * 3
        steps.append((level[run:at], level[at + 1:run + 3]))
        at //= 3
    return steps


def first(value):
    return (value is not None, value if value is not None else 0)


def model(table):
    """The contract's rows from (doc_id, source, lang, n_chars, text)."""
    leaves = []
    for number, source, lang, size, text in table:
        shown = text.replace("\n", "") if text is not None and number is not None and crc32(str(number).encode()) % 2 == 0 else text
        head = [part(number), part(source), part(lang), part(size)]
        leaves.append(((source is not None, (source or "").encode()), (first(number), h(*head, part(text))), number, h(*head, part(shown))))
    leaves.sort(key=lambda x: x[:2])
    trees = [list(some) for _, some in groupby(leaves, key=lambda x: x[0])]
    built = [levels([x[1][1] for x in tree]) for tree in trees]
    top = levels([tree[-1][0] for tree in built]) if built else []
    out = []
    for tree_number, (tree, held) in enumerate(zip(trees, built)):
        for at, (_, (_, leaf), number, seen) in enumerate(tree):
            steps = way(held, at) + way(top, tree_number)
            fold = seen
            for left, right in steps:
                fold = h(*left, fold, *right)
            proof = h(*[x for left, right in steps for x in left + right])
            out.append((number, leaf, held[-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return Counter(out)


def result(spark, frame):
    path = scratch_path(spark, "merkle-test")
    frame.write.parquet(f"{path}/documents.parquet")
    return Counter(tuple(r) for r in queries.op13_merkle_manifest(spark, path).collect())


def plain(table):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in table.collect()]


def test_awkward_rows(spark):
    frame = docs(spark)
    found = result(spark, frame)
    assert found == model(plain(frame)) and sum(found.values()) == len(rows())


def test_empty_table(spark):
    assert result(spark, empty(spark)) == Counter()


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_blocks_of_any_size(spark, depth):
    """A source with a third of all rows, many of one row, repeated rows; trees of 1 to 90 leaves in blocks of 3, 9, 2187."""
    table = [(i % 80, "hot", h(str(i % 80))) for i in range(90)] + [(None, None, h("none")), (1, None, h("one"))]
    table += [(i, f"s{i % 40}", h(str(i))) for i in range(100, 200)] + [(i, f"own{i}", h(str(i))) for i in range(30)]
    frame = spark.createDataFrame(table, "doc_id long, source string, leaf string").repartition(4)
    found = merkle.manifest(frame, keep=("source",), depth=depth)
    found = merkle.folded(found.withColumn("kept", F.col("proof")), "leaf", "proof").collect()
    assert Counter((r.doc_id, r.source, r.leaf) for r in found) == Counter(table)
    by = sorted(table, key=lambda r: ((r[1] is not None, (r[1] or "").encode()), first(r[0]), r[2]))
    trees = {source: levels([r[2] for r in some]) for source, some in groupby(by, key=lambda r: r[1])}
    root = levels([tree[-1][0] for tree in trees.values()])[-1][0]
    assert all(r.root == root == r.folded_root and r.subroot == trees[r.source][-1][0] for r in found)
    place = {source: i for i, source in enumerate(trees)}
    top = levels([tree[-1][0] for tree in trees.values()])
    want = Counter()
    for source, tree in trees.items():
        for at, leaf in enumerate(tree[0]):
            steps = way(tree, at) + way(top, place[source])
            want[leaf, ",".join("".join(left) + "*" + "".join(right) for left, right in steps)] += 1
    assert Counter((r.leaf, r.kept) for r in found) == want


def test_a_wrong_leaf_leads_elsewhere(spark):
    frame = spark.createDataFrame([(i, "a", h(str(i))) for i in range(10)], "doc_id long, source string, leaf string")
    found = merkle.manifest(frame).withColumn("wrong", F.sha2("leaf", 256))
    assert merkle.folded(found, "wrong", "proof").where("folded_root = root").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_height(n):
    assert merkle.height(n) == len(levels([str(i) for i in range(n)])) - 1
