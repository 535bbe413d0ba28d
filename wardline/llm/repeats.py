"""Substring dedup: remove word windows that also occur in a document with a smaller id.

Fixed-block anchors. A window of ``window`` words always holds a whole aligned block of half its length, so the
index is made of each document's non-overlapping blocks and probed with every rolling window of a block's length.
Hits are extended to whole windows around them, and every window learns the smallest id among its occurrences.
Runs of removed windows are the maximal exact repeats.

How it stays linear and spread out:

* Documents are dealt into parts by a hash of id and text; one shuffle of the texts serves all steps.
* A part says each block hash once, however often it holds it, and decides repeats inside itself alone. So a block or
  window that fills a third of all rows costs one record per part, and no pairs are ever formed.
* A probe travels as four bytes of hash, beside the bits its bucket stands for, and about one byte of place. A false
  hit costs a candidate window and nothing else: candidates compare 80 bits plus their bucket's.
* Rolling windows that hit nothing, which are most, stop at the index. Only candidates go on, and only those of the
  smallest id their part has for them.

Defined results: a null or empty text has no words; documents shorter than a window keep all words; rows without an
id keep all words and remove none elsewhere; rows that repeat an id don't remove from each other; an empty table
gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import words
from wardline.llm.shared import tasks

_U16, _U32 = np.uint64(0xFFFF), np.uint64(0xFFFFFFFF)


def _packed(increasing: np.ndarray) -> bytes:
    """Increasing numbers as steps, byte plane by byte plane: the planes that are all zero compress to nothing."""
    steps = np.diff(increasing, prepend=0).astype("<i8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<i8").ravel())


class _Part:
    """The documents of a part in an order that doesn't depend on how they arrived, and their words' hashes."""

    def __init__(self, table: pa.Table, window: int):
        table = table.sort_by([("doc_id", "ascending"), ("k", "ascending")]).combine_chunks()
        self.window, self.block = window, (window + 1) // 2
        known = table["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        self.doc_id = table["doc_id"]
        self.ids = self.doc_id.fill_null(0).to_numpy()
        hashes, first, total = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0
        self.texts = pa.concat_arrays(table["text"].chunks or [pa.array([], pa.string())])
        for _, some in words.slices(self.texts):
            found = words.scan(some)
            hashes.append(words.word_hashes(found))
            first.append(found.first[1:] + total)
            total += len(found.starts)
        self.hashes, self.first = np.concatenate(hashes), np.concatenate(first)
        self.lengths = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.place = np.arange(total) - self.first[:-1][self.row]
        takes_part = known & (self.lengths >= window)
        self.left = np.where(takes_part, self.lengths, 0)[self.row] - self.place  # words from here to the end

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rolling block hashes, sorted, their places, and the bounds of equal ones."""
        places = np.flatnonzero(self.left >= self.block)
        hashes = words.window_hashes(self.hashes, self.block)[places]
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], places[order]
        return hashes, places, np.flatnonzero(_changes(hashes))

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """Starts of whole windows that hold a hit block or one that this part holds twice."""
        hashes, places, heads = self.blocks()
        many = np.repeat(np.diff(heads, append=len(hashes)) > 1, np.diff(heads, append=len(hashes)))
        hit = np.zeros(len(self.hashes) + self.window, np.int64)
        hit[places[many]] = 1
        hit[hits] = 1
        ahead = np.concatenate([np.zeros(1, np.int64), np.cumsum(hit)])
        starts = np.flatnonzero(self.left >= self.window)
        return starts[ahead[starts + self.window - self.block + 1] > ahead[starts]]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """True at the first of each run of equal rows."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return change


def _later(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with ``keys`` whether some row with equal keys has a smaller id, and the rows' order by keys."""
    if not len(ids):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort(keys)
    heads = np.flatnonzero(_changes(*(key[order] for key in keys)))
    least = np.minimum.reduceat(ids[order], heads)
    later = np.empty(len(ids), bool)
    later[order] = ids[order] > np.repeat(least, np.diff(heads, append=len(ids)))
    return later, order


def _by_bucket(buckets: np.ndarray, places: np.ndarray):
    """``(bucket, rows)`` with the rows of each bucket in order of place."""
    order = np.lexsort((places, buckets))
    heads = np.flatnonzero(_changes(buckets[order])) if len(order) else np.empty(0, int)
    for start, end in zip(heads, [*heads[1:], len(order)]):
        yield int(buckets[order[start]]), order[start:end]


_PROBES = "bucket int, part int, tags binary, places binary"


def _probes(buckets: int, window: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = _Part(table, window)
        hashes, places, heads = part.blocks()
        rows = {"bucket": [], "part": [], "tags": [], "places": []}
        if len(heads):
            aligned = np.logical_or.reduceat(part.place[places] % part.block == 0, heads)
            hashes, places = hashes[heads], places[heads]
            tags = ((hashes >> np.uint64(33)) << np.uint64(1) | aligned.astype(np.uint64)).astype("<u4")
            for bucket, own in _by_bucket((hashes & _U32) % np.uint64(buckets), places):
                rows["bucket"].append(bucket)
                rows["part"].append(key[0].as_py())
                rows["tags"].append(tags[own].tobytes())
                rows["places"].append(_packed(places[own]))
        return _table(rows, _PROBES)

    return run


_FOUND = "part int, places binary"


def _index(key: tuple, table: pa.Table) -> pa.Table:
    """Places whose block hash is that of an aligned block and occurs in another part."""
    rows = {"part": [], "places": []}
    tags = [np.frombuffer(x, "<u4") for x in table["tags"].to_pylist()]
    joined = np.concatenate(tags)
    order = np.argsort(joined >> 1, kind="stable")
    heads = np.flatnonzero(_changes(joined[order] >> 1))
    sizes = np.diff(heads, append=len(joined))
    hit = np.empty(len(joined), bool)
    hit[order] = np.repeat((sizes > 1) & np.logical_or.reduceat((joined[order] & 1) > 0, heads), sizes)
    at = 0
    for part, count, places in zip(table["part"].to_pylist(), map(len, tags), table["places"].to_pylist()):
        own = hit[at:at + count]
        at += count
        if own.any():
            rows["part"].append(part)
            rows["places"].append(_packed(_unpacked(places)[own]))
    return _table(rows, _FOUND)


_OPEN = "bucket int, part int, done boolean, a binary, b binary, ids binary, places binary"


def _extended(buckets: int, window: int):
    def run(key: tuple, docs: pa.Table, hits: pa.Table) -> pa.Table:
        rows = {name: [] for name in ("bucket", "part", "done", "a", "b", "ids", "places")}
        if docs.num_rows:
            part = _Part(docs, window)
            starts = part.candidates(_all_places(hits))
            ids = part.ids[part.row[starts]]
            a = words.window_hashes(part.hashes, window)[starts]
            b = words.window_hashes(part.hashes, window, words.AGAIN)[starts]
            later, _ = _later(ids, a, b)
            number = key[0].as_py()
            if later.any():
                done = starts[later]
                _add(rows, number % buckets, number, True, b"", b"", b"", _packed(done))
            starts, ids, a, b = (x[~later] for x in (starts, ids, a, b))
            for bucket, own in _by_bucket((b >> np.uint64(16)) % np.uint64(buckets), starts):
                _add(rows, bucket, number, False, a[own].astype("<u8").tobytes(),
                     (b[own] & _U16).astype("<u2").tobytes(), _packed(ids[own]), _packed(starts[own]))
        return _table(rows, _OPEN)

    return run


def _judged(key: tuple, table: pa.Table) -> pa.Table:
    """Window starts that a smaller id has too."""
    rows = {"part": [], "places": []}
    done = table["done"].to_numpy()
    for part, places in zip(*(table.filter(pa.array(done))[name].to_pylist() for name in ("part", "places"))):
        rows["part"].append(part)
        rows["places"].append(places)
    table = table.filter(pa.array(~done))
    if table.num_rows:
        ids = [_unpacked(x) for x in table["ids"].to_pylist()]
        a = np.frombuffer(b"".join(table["a"].to_pylist()), "<u8")
        b = np.frombuffer(b"".join(table["b"].to_pylist()), "<u2")
        later, _ = _later(np.concatenate(ids), a, b)
        at = 0
        for part, count, places in zip(table["part"].to_pylist(), map(len, ids), table["places"].to_pylist()):
            own = later[at:at + count]
            at += count
            if own.any():
                rows["part"].append(part)
                rows["places"].append(_packed(_unpacked(places)[own]))
    return _table(rows, _FOUND)


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _cleaned(window: int):
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table({"doc_id": [], "n_words": [], "n_removed": [], "kept": []}, _KEPT)
        part = _Part(docs, window)
        removed = words.covered(_all_places(found), window, len(part.hashes))
        counts = words.by_row(removed, part.first)
        kept = []
        for row, text in enumerate(part.texts):
            own = (text.as_py() or "").encode().split()
            if counts[row]:
                stays = ~removed[part.first[row]:part.first[row + 1]]
                own = [own[i] for i in np.flatnonzero(stays)]
            kept.append(b" ".join(own).decode())
        return _table({"doc_id": part.doc_id, "n_words": part.lengths, "n_removed": counts, "kept": kept}, _KEPT)

    return run


def _all_places(found: pa.Table) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(_unpacked(x) for x in found["places"].to_pylist())])


def _add(rows: dict[str, list], *values) -> None:
    for column, value in zip(rows.values(), values):
        column.append(value)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _table(columns: dict, ddl: str) -> pa.Table:
    kinds = dict(x.split() for x in ddl.split(", "))
    schema = pa.schema([(name, _ARROW[kinds[name]]) for name in columns])
    return pa.table({name: pa.array(values, schema.field(name).type) if not isinstance(values, pa.ChunkedArray)
                     else values.cast(schema.field(name).type) for name, values in columns.items()}, schema=schema)


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept``; ``kept`` holds the words that stay, joined by one space.

    A word goes if it lies in a window of ``window`` words whose word sequence also starts in a document with a
    smaller id. Windows are judged on the input.
    """
    many = 2 * tasks(docs.sparkSession)
    key = F.xxhash64(F.col(doc_id).cast("long"), F.col(text))
    dealt = docs.select(
        F.pmod(key, F.lit(many)).cast("int").alias("part"), F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("k"), F.col(text).alias("text"),
    )
    parts = dealt.groupBy("part")
    probes = parts.applyInArrow(_probes(many, window), _PROBES)
    hits = probes.groupBy("bucket").applyInArrow(_index, _FOUND)
    extended = parts.cogroup(hits.groupBy("part")).applyInArrow(_extended(many, window), _OPEN)
    judged = extended.groupBy("bucket").applyInArrow(_judged, _FOUND)
    return parts.cogroup(judged.groupBy("part")).applyInArrow(_cleaned(window), _KEPT)
