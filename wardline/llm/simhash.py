"""SimHash near-dedup through an inverted index on byte positions.

A document's 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most ``bits`` bits share
at least ``8 - bits`` of them, the guaranteed minimum. The index holds each fingerprint under every choice of that
many positions, that is at the intersections of its bytes' postings, so two fingerprints meet exactly when the tally
of positional bytes they share reaches the minimum; below that no pair is ever formed. Pairs that meet are verified
by their distance.

No tally is kept per pair: the choices of positions stand for it, and find the same pairs without forming any other.

Equal fingerprints are merged before the index, so copies cost nothing there. Inside a posting no list of pairs is
made: a search spreads from one fingerprint to all within reach and takes each away once reached, which yields one
link per fingerprint. A long posting is divided first by the parts of its remaining bytes, of which at least one must
agree. Buckets of the index hold some ``BUCKET_POSTINGS`` postings each, however many there are. Components come from alternating large-star and small-star rounds over these links, in the shared folder.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; fewer words than a shingle
make one shingle; rows that repeat an id are rows of their own; a null id can't be a component's id unless the
component has no other; an empty table gives an empty result; columns other than id and text are ignored by
:func:`components`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardline.llm.shared import cut, tasks
from wardline.llm.words import mixed

SEED = 42
LONG_POSTING = 4096
BUCKET_POSTINGS = 4_000_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text's lower-cased (A-Z) word shingles, repeats counted."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, width = b" ".join(parts), min(shingle, len(parts))
    ends = list(accumulate(len(part) + 1 for part in parts))
    starts = [0, *ends[:-1]]
    counts, total = np.zeros(64, np.int64), len(parts) - width + 1
    for at in range(0, total, 1 << 16):
        spans = zip(starts[at:min(total, at + (1 << 16))], ends[at + width - 1:])
        hashed = b"".join([xxhash.xxh64_digest(joined[a:b - 1], SEED) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprinted(docs: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (a signed long), in place of a column of that name."""
    return _printed(docs.drop("fingerprint"), shingle, lambda batch: batch[text])


def _printed(rows: DataFrame, shingle: int, texts: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts(batch)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, "fingerprint"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fingerprint", LongType())]))


def _positions(bits: int) -> list[tuple[int, ...]]:
    return list(combinations(range(8), 8 - bits))


def _keys(prints: np.ndarray, choice: np.ndarray, bits: int) -> np.ndarray:
    """The posting of each fingerprint under its choice of byte positions."""
    masks = np.array([sum(0xFF << 8 * i for i in some) for some in _positions(bits)], np.uint64)
    return mixed((prints & masks[choice]) ^ mixed(choice.astype(np.uint64) + np.uint64(1)))


def _reached(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``bits`` of each other that connect whatever such links connect: one per fingerprint at most."""
    left, a, b = prints, [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found = left[near]
                left = left[~near]
                frontier.extend(found)
                a.append(np.full(len(found), at, np.uint64))
                b.append(found)
    none = [np.empty(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _posting_links(prints: np.ndarray, shared: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside one posting, all of whose members agree in the bits of ``shared``."""
    if len(prints) <= LONG_POSTING:
        yield _reached(prints, bits)
        return
    rest = [i for i in range(64) if not shared >> i & 1]
    for part in np.array_split(np.array(rest), bits + 1):  # of bits + 1 parts one has no differing bit
        masked = prints & np.uint64(sum(1 << int(i) for i in part))
        order = np.argsort(masked, kind="stable")
        for same in np.split(prints[order], np.flatnonzero(np.diff(masked[order])) + 1):
            if len(same) > 1:
                yield _reached(same, bits)


def links(prints: DataFrame, bits: int = 4) -> DataFrame:
    """``a, b``: links between the different fingerprints of ``prints.fingerprint``, which connect all that are
    connected by distances of at most ``bits``."""
    distinct = cut(prints.select("fingerprint").distinct())
    postings = distinct.count() * len(_positions(bits))
    buckets = max(2 * tasks(prints.sparkSession), -(-postings // BUCKET_POSTINGS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices = np.arange(len(_positions(bits)), dtype=np.uint8)
        for batch in batches:
            held = batch["fingerprint"].to_numpy().view(np.uint64)
            held, choice = np.repeat(held, len(choices)), np.tile(choices, len(held))
            bucket = _keys(held, choice, bits) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(bounds))
            cells = [order[bounds[i]:bounds[i + 1]] for i in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([held[x].tobytes() for x in cells], pa.binary()),
                 pa.array([choice[x].tobytes() for x in cells], pa.binary())], ["bucket", "prints", "choices"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        held = np.frombuffer(b"".join(table["prints"].to_pylist()), np.uint64)
        choice = np.frombuffer(b"".join(table["choices"].to_pylist()), np.uint8)
        keys = _keys(held, choice, bits)
        order = np.argsort(keys, kind="stable")
        keys, held, choice = keys[order], held[order], choice[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(heads, append=len(keys))
        pairs = heads[sizes == 2]
        close = pairs[np.bitwise_count(held[pairs] ^ held[pairs + 1]) <= bits]
        a, b = [held[close]], [held[close + 1]]
        positions = _positions(bits)
        for head, size in zip(heads[sizes > 2], sizes[sizes > 2]):
            shared = sum(0xFF << 8 * i for i in positions[choice[head]])
            for some, others in _posting_links(held[head:head + size], shared, bits):
                a.append(some)
                b.append(others)
        pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.table({"a": pair[:, 0].view(np.int64), "b": pair[:, 1].view(np.int64)})

    indexed = distinct.mapInArrow(index, "bucket int, prints binary, choices binary")
    return indexed.groupBy("bucket").applyInArrow(meet, "a long, b long")


def labels(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected ``a, b`` edges; the root is its component's least node.

    Alternating large-star and small-star rounds; each writes its edges, which only get fewer, and the rounds end
    when a pair of them changes nothing.
    """
    def both(frame):
        return frame.select("a", "b").union(frame.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def signature(frame):
        found = frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(found)

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = signature(edges)
    while before[0]:
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(edges.join(least.withColumnRenamed("a", "x"), F.col("a") == F.col("x")).select("a", F.col("m").alias("b")))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        edges = cut(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(joined.select("a", F.col("m").alias("b"))).distinct()
        )
        now = signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _rooted(known: DataFrame, bits: int) -> DataFrame:
    """``known`` (``fingerprint`` and more, a row each) with the ``root`` of its component."""
    roots = cut(labels(links(known, bits)))
    return known.join(roots, F.col("fingerprint") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "fingerprint")).drop("node")


def components(docs: DataFrame, shingle: int = 4, bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, fingerprint, component_id``: the smallest id that links of at most ``bits`` differing bits
    reach, the row's own included."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = cut(fingerprinted(rows, shingle).drop("text"))
    rooted = cut(_rooted(cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))), bits))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(ids, "root").select("fingerprint", "component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that are the first of their component: the one of least id, or among
    rows of that id one, whichever hashes least. Texts are read twice and moved once, by fingerprint and id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    known = fingerprinted(rows, shingle).groupBy("fingerprint").agg(F.min(order).alias("least"))
    rooted = cut(_rooted(cut(known), bits))
    firsts = rooted.groupBy("root").agg(F.min(F.struct("least", "fingerprint")).alias("first"))
    firsts = firsts.select(F.col("first.fingerprint").alias("_fingerprint"), F.col("first.least.doc_id").alias("_id"))
    whole = _printed(docs.select(F.struct(*docs.columns).alias("row")), shingle, lambda batch: pc.struct_field(batch["row"], [text]))
    held = whole.withColumn("_own", F.col(f"row.{doc_id}"))
    kept = held.join(firsts, (F.col("fingerprint") == F.col("_fingerprint")) & F.col("_own").eqNullSafe(F.col("_id")))
    among = Window.partitionBy("fingerprint", "_own").orderBy(F.xxhash64("row"))
    return kept.withColumn("_nth", F.row_number().over(among)).where("_nth = 1").select("row.*")
