from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import topk, urls


def plain(rows, k, every=1):
    """Best scores by trying all pairs; rows of (id, vector)."""
    held = {(n, tuple(int(np.floor(256.0 * float(np.float32(x)))) for x in v)) for n, v in rows
            if n is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for query in {n for n, _ in held if n % every == 0}:
        best = {}
        for n, v in held:
            for q, w in held:
                if q == query and n != query and len(v) == len(w):
                    score = sum(a * b for a, b in zip(v, w))
                    best[n] = max(best.get(n, score), score)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(query, rank, n, score) for rank, (n, score) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, k=5, every=1, **sizes):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long, block int, vec string")
    vectors = topk.scaled(frame)
    return sorted(map(tuple, topk.top_k(vectors, vectors.where(f"vec_id % {every} = 0"), k, **sizes).collect()))


def padded(pairs):
    return [(n, v, None, 1, "x") for n, v in pairs]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    pairs = [(0, [0.5, -0.5]), (1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [0.25, 1.0]), (3, None), (4, [0.1, None]), (5, [nan, 1.0]),
             (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (9, []), (10, [0.0, 0.0]), (11, [1e-9, -1e-9]),
             (12, [0.5, 0.5, 0.5]), (0, [0.75, 0.0]), (13, [-0.003, 0.999])]
    assert found(spark, padded(pairs)) == plain(pairs, 5)
    assert found(spark, []) == []


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "block": 7}])
def test_random_vectors_with_ties(spark, sizes):
    draw = np.random.default_rng(8)
    centres = draw.normal(0, 1, (6, 8))
    pairs = [(i, [float(np.float32(x)) for x in np.round(centres[i % 6] + draw.normal(0, 0.2, 8), 1)]) for i in range(300)]
    assert found(spark, padded(pairs), every=10, **sizes) == plain(pairs, 5, 10)


def test_fewer_than_k_and_large_components(spark):
    pairs = [(1, [3e5, 1.0]), (2, [3e5, -7.0]), (3, [-3e5, 2.0])]
    assert found(spark, padded(pairs), k=5) == plain(pairs, 5)


def test_search_prunes():
    draw = np.random.default_rng(1)
    points = np.round(np.repeat(draw.normal(0, 300, (20, 16)), 200, axis=0) + draw.normal(0, 3, (4000, 16)))
    tree = topk.BallTree.build(points, np.arange(4000))
    query = points[5]
    bounds = tree.bounds(query[None])[0]
    best = sorted(tree.search(query, 5, bounds, 5, float("-inf")), reverse=True)
    scores = points @ query
    scores[5] = -np.inf
    assert [s for s, _ in best] == sorted(scores.astype(float), reverse=True)[:5]
    leaves = [i for i, below in enumerate(tree.below) if not below]
    assert sum(bounds[i] >= best[-1][0] for i in leaves) < len(leaves) / 4


@pytest.mark.parametrize("url, host", [
    ("http://A.Example.COM/x?y#z", "a.example.com"), (" https://user:pw@h.org:8080/", "h.org"), ("https://h.org..", "h.org"),
    ("ftp://[::1]:21/x", "[::1]"), ("mailto:a@b.c", None), ("", None), (None, None), ("//h.org/", None), ("http:///x", None),
    ("http://" + "a." * 126 + "a/", "a." * 126 + "a"), ("http://" + "a." * 5000 + "a/", "a." * 5000 + "a")])
def test_host_of(spark, url, host):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(urls.host_of(F.col("u")).alias("h")).first().h == host


def d(n):
    return date.fromordinal(date(2024, 1, 1).toordinal() + n) if n is not None else None


ENTRIES = [("bad", "example.com", "block", 10), ("bad", "example.com", "remove", 20), ("bad", "example.com", "block", 90),
           ("good", "ok.example.com", "allow", 5), ("bad", "ok.example.com", "block", 15), ("bad", "ok.example.com", "remove", 15),
           ("good", "Example.ORG", "allow", 0), ("bad", "example.org", "block", 40), ("bad", "1.2.3.4", "block", 1),
           ("bad", "2.3.4", "block", 0), ("bad", None, "block", 0), (None, "example.com", "block", 0), ("bad", "com", "block", None),
           ("long", "old.net", "block", -4000)]


def plain_verdict(host, day):
    if host is None or day is None:
        return "none", None
    address = host.replace(".", "").isdigit()
    labels = host.split(".")
    for pattern in [host] if address else [".".join(labels[i:]) for i in range(len(labels))]:
        active = []
        for name in ("bad", "good", "long"):
            log = sorted((day_, {"remove": 0, "block": 1, "allow": 2}[action], action) for list_, p, action, day_ in ENTRIES
                         if list_ == name and p and p.lower() == pattern and day_ is not None and day_ <= day)
            if log:
                last = min(x for x in log if x[0] == log[-1][0])
                active += [(last[2], name)] if last[2] != "remove" else []
        if active:
            return min(active, key=lambda x: (x[0] != "block", x[1]))
    return "none", None


def test_verdicts(spark):
    hosts = ["a." * 200 + "example.com", "b" * 300 + ".org", "x." * 150 + "example.org", "a.example.com", "ok.example.com", "x.ok.example.com", "example.org", "1.2.3.4", "www.old.net", "com", None]
    captures = [(i, f"http://{h}/p{i}" if h else h, d(day), None, "x", 3) for i, (h, day) in enumerate(
        (h, day) for h in hosts for day in (0, 5, 10, 14, 15, 19, 20, 39, 40, 89, 90, 300, None) for _ in range(2))]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched date, host string, pattern string, bucket int")
    log = spark.createDataFrame([(a, b, c, d(n), 1) for a, b, c, n in ENTRIES], "list string, pattern string, action string, day date, depth int")
    found = {r.page_id: (r.verdict, r.list) for r in urls.evaluate(frame, log).collect()}
    want = {}
    for number, url, day, *_ in captures:
        host = url and url.split("/")[2]
        want[number] = plain_verdict(host, day and day.toordinal() - date(2024, 1, 1).toordinal())
    assert found == want
    assert urls.evaluate(frame.limit(0), log).collect() == []
    assert {r.verdict for r in urls.evaluate(frame, log.limit(0)).collect()} == {"none"}
    bare = spark.createDataFrame([(1, "a.example.com/x", d(10))], "page_id long, url string, fetched date")
    assert [(r.host, r.verdict) for r in urls.evaluate(bare, log).collect()] == [(None, "none")]
