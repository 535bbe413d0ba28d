"""Exact ranked lexical search over posting lists in geometric blocks.

Documents and queries are sparse vectors over terms, scored by inner product in whole numbers. Documents are dealt to shards
of some ``SHARD_POSTINGS`` postings. In a shard each posting list is clustered by document similarity (nearest of the
square root of its length of own documents, by inner product of hashed sketches) and cut into blocks of at most ``BLOCK``
documents; a block's summary holds the exact maximum of every coordinate. A query takes its terms from rare to common. A
block is skipped only if the product of its summary with the query, from that term on, is below the query's k-th score so
far; documents that hold an earlier term of the query were dealt with there. A whole list is skipped by the same test on the
shard's maxima, and only lists that some query still needs are clustered, one at a time. So results are exact, and memory is
that of a shard.

Only postings of terms that are asked for are kept. Queries come to the shards in blocks of some ``TERMS_AT_ONCE`` different terms
each, whose documents' postings are counted anew; the result doesn't depend on the blocks.

Defined results: a null text has no terms; a row without terms neither counts nor is found; rows that repeat an id, or a query,
are rows of their own; among equal scores the smaller id comes first, a null id last; very long texts are counted in
pieces; empty tables give an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.shared import broadcast_checked, cut

BLOCK = 32
SHARD_POSTINGS = 1 << 21
TERMS_AT_ONCE = 500_000
PIECE_BYTES = 1 << 22
SKETCH = 16

# A-Z lower-cased; every other ASCII character but 0-9 and a-z ends a term. Bytes from 128 on belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def counted(text: bytes | None) -> Counter:
    """How often each term occurs in a text."""
    found, at = Counter(), 0
    while text and at < len(text):
        piece = text[at:at + PIECE_BYTES].translate(_FOLD)
        last = piece.rfind(b" ") + 1
        if at + len(piece) < len(text) and not last:  # a term longer than a piece: take the text as one
            piece = text[at:].translate(_FOLD)
            last = len(piece)
        elif at + len(piece) >= len(text):
            last = len(piece)
        found.update(piece[:last].split())
        at += last
    return found


def _queries(queries: DataFrame, item_id: str, text: str) -> DataFrame:
    """``query, item_id, terms, times``: a row for each query that has terms."""
    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"))
    schema = rows.drop("text").withColumn("terms", F.array(F.lit(b""))).withColumn("times", F.array(F.lit(0).cast("long"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [counted(text) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["query"], batch["item_id"], pa.array([list(x) for x in held], pa.list_(pa.binary())),
                 pa.array([list(x.values()) for x in held], pa.list_(pa.int64()))], schema.names)

    return cut(rows.mapInArrow(run, schema).where("size(terms) > 0"))


def _postings(docs: DataFrame, number: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, ids, tfs``: every document that has terms, with its asked terms' numbers and counts."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for held in batch["text"]:
                terms = counted(held.as_py())
                asked = [(number[term], tf) for term, tf in terms.items() if term in number]
                sizes.append(terms.total())
                ids.append(np.array([i for i, _ in asked], np.int32).tobytes())
                tfs.append(np.array([tf for _, tf in asked], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())],
                ["doc_id", "n", "ids", "tfs"])

    return cut(rows.mapInArrow(run, "doc_id long, n long, ids binary, tfs binary").where("n > 0"))


def _document_counts(postings: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch["ids"].to_pylist()), np.int32)
            counts += np.bincount(ids, minlength=terms)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["id", "df"])

    found = postings.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df"))
    counts = np.zeros(terms, np.int64)
    for row in found.collect():  # one row per asked term of the block
        counts[row["id"]] = row["df"]
    return counts


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """A shard's documents as vectors over term ranks, 0 the rarest, and the posting list of each."""

    def __init__(self, table: pa.Table, weights: np.ndarray, documents: int, total: int):
        ids = table["ids"].to_pylist()
        self.ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
        self.terms = np.frombuffer(b"".join(ids), np.int32).astype(np.int64)
        tf = np.frombuffer(b"".join(table["tfs"].to_pylist()), np.int64)
        lengths = np.array([75 + 25 * n * documents // total for n in table["n"].to_pylist()], np.int64)
        self.rows = np.repeat(np.arange(len(ids)), np.diff(self.ends))
        self.values = weights[self.terms] * (1_000_000_000 * tf // (1000 * tf + 12 * lengths[self.rows]))
        order = np.argsort(self.terms, kind="stable")
        self.listed = self.rows[order]
        self.starts = np.searchsorted(self.terms[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.values[order], self.starts[held])
        cells = self.rows * SKETCH + (self.terms * 2654435761 >> 7) % SKETCH
        signs = np.where(self.terms * 40503 >> 4 & 1, -1.0, 1.0)
        sketch = np.bincount(cells, self.values * signs, len(ids) * SKETCH).reshape(-1, SKETCH)
        self.sketch = (sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a posting list, similar ones together, and where its blocks start."""
        held = self.listed[self.starts[term]:self.starts[term + 1]]
        if len(held) <= BLOCK:
            return held, np.zeros(1, np.int64)
        centres = self.sketch[held[np.linspace(0, len(held) - 1, math.isqrt(len(held))).astype(int)]]
        nearest = np.concatenate([(self.sketch[part] @ centres.T).argmax(axis=1) for part in np.array_split(held, -(-len(held) // 8192))])
        order = np.argsort(nearest, kind="stable")
        nearest, held = nearest[order], held[order]
        first = np.concatenate([[True], nearest[1:] != nearest[:-1]])
        inside = np.arange(len(held)) - np.maximum.accumulate(np.where(first, np.arange(len(held)), 0))
        return held, np.flatnonzero(inside % BLOCK == 0)

    def vectors(self, documents: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ends, terms, values`` of some documents, of the ``wanted`` terms alone."""
        sizes = self.ends[documents + 1] - self.ends[documents]
        ends = np.cumsum(sizes)
        at = np.repeat(self.ends[documents] - (ends - sizes), sizes) + np.arange(ends[-1])
        keep = wanted[self.terms[at]]
        at, rows = at[keep], np.repeat(np.arange(len(documents)), sizes)[keep]
        return np.searchsorted(rows, np.arange(len(documents) + 1)), self.terms[at], self.values[at]


def _summaries(ends: np.ndarray, terms: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ends, terms, values`` of each block: the maximum of every coordinate."""
    block = np.repeat(np.arange(len(starts)), np.diff(ends[np.append(starts, len(ends) - 1)]))
    order = np.lexsort((terms, block))
    block, terms, values = block[order], terms[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (terms[1:] != terms[:-1])]))
    return np.searchsorted(block[first], np.arange(len(starts) + 1)), terms[first], np.maximum.reduceat(values, first)


def top(shard: Shard, queries: list[tuple[np.ndarray, np.ndarray]], ties: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``documents, scores`` of the k best of each query (term ranks ascending, times); ``ties`` ranks equal scores."""
    rest, asked = [], {}
    for number, (terms, times) in enumerate(queries):
        rest.append(np.cumsum((times * shard.most[terms])[::-1])[::-1])
        for place, term in enumerate(terms):
            asked.setdefault(int(term), []).append((number, place))
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]
    floor = np.ones(len(queries), np.int64)  # only scores above 0 count
    times_of, earlier = np.zeros(len(shard.most), np.int64), np.zeros(len(shard.most), bool)
    for term in sorted(asked):
        asking = [(q, place) for q, place in asked[term] if rest[q][place] >= floor[q]]
        if not asking or not shard.most[term]:
            continue
        wanted = np.zeros(len(shard.most), bool)
        wanted[np.concatenate([queries[q][0] for q, _ in asking])] = True
        documents, starts = shard.blocks(term)
        ends, terms, values = shard.vectors(documents, wanted)
        bound_ends, bound_terms, bound_values = _summaries(ends, terms, values, starts)
        stops = np.append(starts[1:], len(documents))
        for q, place in asking:
            mine, times = queries[q]
            times_of[mine[place:]], earlier[mine[:place]] = times[place:], True
            bounds = np.add.reduceat(bound_values * times_of[bound_terms], bound_ends[:-1])
            order, at, many = np.argsort(-bounds, kind="stable"), 0, 1
            while at < len(order) and bounds[order[at]] >= floor[q]:
                some = order[at:at + many]
                some = some[bounds[some] >= floor[q]]
                at, many = at + many, many * 2
                rows = np.concatenate([np.arange(starts[b], stops[b]) for b in some])
                cells = np.concatenate([np.arange(ends[starts[b]], ends[stops[b]]) for b in some])
                heads = np.cumsum(np.concatenate([[0], (ends[rows + 1] - ends[rows])[:-1]]))
                scores = np.add.reduceat(values[cells] * times_of[terms[cells]], heads)
                new = ~np.logical_or.reduceat(earlier[terms[cells]], heads) & (scores >= floor[q])
                if new.any():
                    found = np.concatenate([best[q][0], documents[rows[new]]])
                    reached = np.concatenate([best[q][1], scores[new]])
                    first = np.lexsort((ties[found], -reached))[:k]
                    best[q] = found[first], reached[first]
                    floor[q] = max(1, reached[first[-1]]) if len(first) == k else 1
            times_of[mine], earlier[mine] = 0, False
    return best


def search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", terms_at_once: int = TERMS_AT_ONCE, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each query, all with scores above 0."""
    spark = docs.sparkSession
    asked = _queries(queries, item_id, item_text)
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms_at_once))
    found = None
    for block in range(blocks):
        here = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "terms", "times").collect()
        part = _search(docs, here, k, doc_id, text, shard_postings)
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "query long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(broadcast_checked(asked.select("query", "item_id")), "query").select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, asked: list, k: int, doc_id: str, text: str, shard_postings: int) -> DataFrame | None:
    """``query, doc_id, score``: each shard's best documents of each query of one block."""
    number: dict[bytes, int] = {}
    for row in asked:
        for term in row["terms"]:
            number.setdefault(bytes(term), len(number))
    postings = _postings(docs, number, doc_id, text)
    facts = postings.agg(F.count("*"), F.sum("n"), F.sum(F.octet_length("ids"))).first()
    documents, total, size = (int(x or 0) for x in facts)
    if not documents or not number:
        return None
    df = _document_counts(postings, len(number))
    weights = np.array([weight(documents, int(x)) for x in df], np.int64)
    order = np.argsort(df, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    weights = weights[order]
    names = np.array([row["query"] for row in asked], np.int64)
    queries = []
    for row in asked:
        terms = rank[[number[bytes(term)] for term in row["terms"]]].astype(np.int64)
        by = np.argsort(terms)
        queries.append((terms[by], np.array(row["times"], np.int64)[by]))
    shards = max(1, -(-(size // 4) // shard_postings))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = [rank[np.frombuffer(x, np.int32)].tobytes() for x in table["ids"].to_pylist()]
        table = table.set_column(table.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))
        numbers = table["doc_id"].to_pylist()
        ties = np.empty(len(numbers), np.int64)
        ties[sorted(range(len(numbers)), key=lambda i: (numbers[i] is None, numbers[i] or 0))] = np.arange(len(numbers))
        best = top(Shard(table, weights, documents, total), queries, ties, k)
        rows = np.concatenate([held for held, _ in best])
        return pa.table({
            "query": np.repeat(names, [len(held) for held, _ in best]), "doc_id": table["doc_id"].combine_chunks().take(pa.array(rows)),
            "score": np.concatenate([scores for _, scores in best])})

    holding = postings.where("octet_length(ids) > 0")
    dealt = holding.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return cut(dealt.groupBy("shard").applyInArrow(run, "query long, doc_id long, score long"))
