import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from awkward import docs, empty, rows

from conftest import SMALL
from wardline.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return Counter(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))


def model(texts, items, k=20):
    """The contract's rows from (doc_id, text) and (item_id, text), every pair scored."""
    held = [(number, plain_terms(text)) for number, text in texts]
    held = [(number, terms, terms.total()) for number, terms in held if terms]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(term for _, terms, _ in held for term in terms)
    out = []
    for item, text in items:
        scored = []
        for number, terms, n in held:
            m = 100 - 25 + (25 * n * count) // total
            score = sum(times * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * terms[t] // (1000 * terms[t] + 12 * m))
                        for t, times in plain_terms(text).items() if t in terms)
            if score > 0:
                scored.append((-score, number is None, number or 0, number))
        out += [(item, rank, held[3], -held[0]) for rank, held in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def result(found):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect())


def asked(spark):
    items = [(1, rows()[0][1]), (2, "word two words SAME Same nbsp"), (2, "word two words SAME Same nbsp"), (None, "mail 中文 token"),
             (3, None), (4, ""), (5, " .,; "), (6, "absent-term only"), (7, rows()[10][1])]
    return items, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score", "3 AS rank")


@pytest.mark.parametrize("sizes", [{}, {"shard_postings": 300}, {"terms_at_once": 40, "shard_postings": 2000}])
def test_awkward_rows(spark, sizes):
    items, frame = asked(spark)
    found = lexical.search(docs(spark), frame, k=4, **sizes)
    assert result(found) == model([row[:2] for row in rows()], items, 4)


def test_empty_tables(spark):
    items, frame = asked(spark)
    assert lexical.search(empty(spark), frame).collect() == []
    assert lexical.search(docs(spark), frame.limit(0)).collect() == []


def test_query_over_the_small_table(spark):
    tables = [spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark")]
    texts, items = ([tuple(r) for r in table.select(key, "text").collect()] for table, key in zip(tables, ("doc_id", "item_id")))
    assert result(queries.op11_lexical_search(spark, SMALL)) == model(texts, items)


def test_terms_of_pieces(monkeypatch):
    texts = ["a bb ccc", "", " ", "x" * 50, "A b-C_d\x00e é 中文\x7fZ" * 9, "word " * 30 + "y" * 40]
    for size in (1, 2, 7, 16):
        monkeypatch.setattr(lexical, "PIECE_BYTES", size)
        for text in texts:
            assert lexical.counted(text.encode()) == {t.encode(): n for t, n in plain_terms(text).items()}
    assert lexical.counted(None) == {}


@pytest.mark.parametrize("seed", range(4))
def test_blocks_skip_only_what_cannot_rank(seed):
    """Groups of similar documents, copies and ties: the best k by blocks are those of all scores."""
    draw = np.random.default_rng(seed)
    terms, count = 300, 900
    vectors = []
    for d in range(count):
        topic = draw.integers(0, 12)
        held = np.unique(np.concatenate([draw.integers(0, 20, 6) + 280, draw.integers(0, 20, 6) + 20 * topic, draw.integers(0, terms, 2)]))
        vectors.append((held.astype(np.int32), draw.integers(1, 4, len(held))))
    vectors[500:700] = [vectors[3]] * 200
    df = np.bincount(np.concatenate([held for held, _ in vectors]), minlength=terms)
    order = np.argsort(df, kind="stable")
    rank = np.empty(terms, np.int32)
    rank[order] = np.arange(terms)
    weights = np.array([lexical.weight(count, int(x)) for x in df[order]])
    table = pa.table({"n": [int(tf.sum()) for _, tf in vectors], "ids": [rank[held].tobytes() for held, _ in vectors],
                      "tfs": [tf.astype(np.int64).tobytes() for _, tf in vectors]})
    shard = lexical.Shard(table, weights, count, sum(table["n"].to_pylist()))
    dense = np.zeros((count, terms), np.int64)
    dense[shard.rows, shard.terms] = shard.values
    asked = []
    for _ in range(25):
        mine = np.unique(draw.integers(0, terms, 3).tolist() + draw.integers(200, terms, 10).tolist())
        asked.append((mine, draw.integers(1, 3, len(mine))))
    for (found, scores), (mine, times) in zip(lexical.top(shard, asked, np.arange(count)[::-1], 10), asked):
        every = dense[:, mine] @ times
        want = sorted((d for d in range(count) if every[d] > 0), key=lambda d: (-every[d], -d))[:10]
        assert list(found) == want and list(scores) == list(every[want])


def test_blocks_cover_a_list_once():
    ids = [np.arange(1 + d % 7, dtype=np.int32).tobytes() for d in range(500)]
    table = pa.table({"n": [1 + d % 7 for d in range(500)], "ids": ids, "tfs": [np.ones(len(x) // 4, np.int64).tobytes() for x in ids]})
    shard = lexical.Shard(table, np.arange(1, 8)[::-1].copy(), 500, 2000)
    held, starts = shard.blocks(0)
    assert sorted(held) == list(range(500)) and max(np.diff(np.append(starts, 500))) <= lexical.BLOCK
    ends, terms, values = shard.vectors(held, np.ones(7, bool))
    tops = lexical._summaries(ends, terms, values, starts)
    for block, (a, b) in enumerate(zip(starts, np.append(starts[1:], 500))):
        want = {}
        for i in range(ends[a], ends[b]):
            want[terms[i]] = max(want.get(terms[i], 0), values[i])
        got = slice(tops[0][block], tops[0][block + 1])
        assert dict(zip(tops[1][got], tops[2][got])) == want
