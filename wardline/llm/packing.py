"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Pieces are dealt into partitions
of about ``PIECES`` and packed best-fit decreasing in each. A partition whose number of sequences equals a
dual-feasible-function lower bound is certified: no packing of its pieces has fewer. A certified partition gives up its
emptiest sequences only, so that no more room is kept than the fewest sequences would have. A partition with a gap keeps
its full sequences, which no packing can better, and gives up the pieces of the others. The pieces given up are dealt
anew, mixed with those of other partitions, and packed again. Rounds end when the whole reaches the bound of the whole,
when one partition holds all that is left, or when a round saves nothing, whose packing is then dropped for the one
before.

Only lengths and ids are exchanged, never texts. The number of partitions follows the number of pieces, so no task
holds more than about ``PIECES`` of them, whatever share one source or group of copies has.

Defined results: a null or empty text is a document of the end id alone; rows that repeat an id are documents of their
own (``row`` tells them apart); a null id is carried through; a very long text gives as many pieces as it needs;
an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import re
import struct
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from wardline.llm.shared import cut
from wardline.llm.words import SLICE_BYTES, slices

CAPACITY = 4096
PIECES = 50_000
CACHED_PIECES = 250_000

# Words that can be cut into pieces (letters, single digits, runs of signs) without the tokenizer: no apostrophes, which
# may start a suffix, no signs of special tokens, no letters that change their number in lower case: of those beyond ASCII
# only À to ÿ, which are the byte C3 and another.
_OTHER, _LETTER, _DIGIT, _SIGN, _SPACE = 0, 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[ord(x) for x in "'<|"]] = _OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_WHOLE = re.compile(rb"[\x00-\x08\x0E-\x1F\x7F'<|\xC2\xC4-\xFF]|\xC3[\x97\xB7]")  # in the words with some _OTHER
_BLOCK = re.compile(rb"(?s).{1,%d}[^\x20\x09-\x0D]*" % SLICE_BYTES)  # whole words of a long text
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

# What a tokenizer must do before its model for those pieces to be its own.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def _cut_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``begins, whole, lowered``: where in ``data`` pieces begin, which bytes are of words that must be left to the
    tokenizer, which are not cut, and the bytes with all other words in lower case."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    lead, second = lead[letter], second[letter]
    kind[lead] = kind[lead + 1] = _LETTER
    lowered = _LOWER[data]
    lowered[lead + 1] += (second < 0x9F).view(np.uint8) * np.uint8(0x20)
    whole = kind == _OTHER
    if whole.any():
        inside = kind != _SPACE
        first = inside.copy()
        first[1:] &= kind[:-1] == _SPACE
        odd = np.add.reduceat(whole, np.flatnonzero(first), dtype=np.int64) > 0
        whole = inside & odd[np.cumsum(first, dtype=np.int32) - 1]
        kind[whole] = _OTHER
        lowered[whole] = data[whole]
    begins = kind == _DIGIT
    begins[1:] |= kind[1:] != kind[:-1]
    begins[:1] = True
    begins &= kind != _SPACE
    return begins, whole, lowered


def _pieces(words: list[bytes]) -> np.ndarray:
    """How many pieces each of ``words`` has, none of which is empty; 0 if that must be left to the tokenizer."""
    begins, whole, _ = _cut_words(np.frombuffer(b" ".join(words), np.uint8))
    starts = np.cumsum([0, *[len(word) + 1 for word in words[:-1]]])
    return np.where(whole[starts], 0, np.add.reduceat(begins, starts, dtype=np.int64))


class _Recent(dict):
    """``find`` of each key asked for, found once."""

    def __init__(self, find: Callable[[bytes], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, key: bytes) -> bytes:
        value = self[key] = self.find(key)
        return value


class _Encoder:
    """Little-endian ids of texts, for a tokenizer that never joins or looks across ASCII white space.

    Its ids of a text are then those of its words one after the other, and those of a word, if the tokenizer cuts by
    ``_RULES``, those that its model gives for each piece. Pieces repeat, more than words do: the ids of recent ones are
    kept, in two generations of some ``kept``. Other words, and all words of other tokenizers, are kept whole.
    """

    def __init__(self, path: str, kept: int = CACHED_PIECES):
        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        made = json.loads(self.tokenizer.to_str())
        special = [token["content"].encode() for token in made["added_tokens"]]
        self.cuts = all(made[k] == rule for k, rule in _RULES.items()) and not any(_pieces([x])[0] for x in special)
        self.model, self.bytes = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.recent, self.older = _Recent(self._find), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if max(map(len, texts), default=0) <= SLICE_BYTES:
            return self._encode([text.encode() for text in texts])
        return [b"".join(ids for block in _BLOCK.findall(text.encode()) for ids in self._encode([block])) for text in texts]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        parts, ends = self._split(texts)
        found = list(map(self.recent.__getitem__, parts))
        if len(self.recent) > self.kept:
            self.recent, self.older = _Recent(self._find), self.recent
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends)]

    def _split(self, texts: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The pieces and uncut words of all texts, and how many there are up to the end of each text."""
        if not self.cuts:
            split = [text.split() for text in texts]
            return [*chain.from_iterable(split)], np.cumsum([len(x) for x in split]).tolist()
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        begins, _, lowered = _cut_words(data)
        inner = np.flatnonzero(begins)
        ends = np.searchsorted(inner, np.cumsum([len(text) + 1 for text in texts]))
        joined = inner[(inner > 0) & (_KIND[data[inner - 1]] != _SPACE)]
        return np.insert(lowered, joined, 0x20).tobytes().split(), ends.tolist()

    def _find(self, part: bytes) -> bytes:
        known = self.older.get(part)
        if known is not None:
            return known
        text = part.decode()
        if not self.cuts or _WHOLE.search(part):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            shown = text if part.isascii() else self.bytes.pre_tokenize_str(text)[0][0]
            ids = [token.id for token in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces; ids end with ``end_id``."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            for at, part in slices(batch["text"]):
                texts = [x or "" for x in part.to_pylist()]
                rows: list[list[int]] = [[], [], [], [], []]
                for number, ids in zip(batch["doc_id"].slice(at, len(part)).to_pylist(), encode(texts)):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start:start + 4 * capacity]
                        for column, value in zip(rows, (number, piece, start // 4, len(own) // 4, crc32(own))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of sequences that no packing of ``lengths`` undercuts."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """:func:`lower_bound` for ``counts[n]`` pieces of each length n up to ``capacity``.

    Sums of dual feasible functions: the identity; for each threshold t up to half, 1 above capacity - t, the length
    itself from t, 0 below; and for small k the function that rounds (k + 1) * length / capacity down to k-ths.
    """
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle = volume[capacity - t] - volume[t - 1]
    best = max(-(-int(volume[-1]) // capacity), int((large - (-middle // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0  # multiples keep their value: length / capacity, here in k * (k + 1)-ths
        value = np.where(whole, k * (k + 1) * sizes // capacity, (k + 1) * (scaled // capacity))
        best = max(best, -(-int((counts * value).sum()) // (k * (k + 1))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the sequence and the offset of each length, and the room left in each sequence."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the different rooms that some sequence has, increasing
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        at = bisect_left(rooms, length)
        if at == len(rooms):
            bin_number, left = len(room), capacity
            room.append(capacity)
        else:
            left = rooms[at]
            same = open_by_room[left]
            bin_number = same.pop()
            if not same:
                del open_by_room[left]
                rooms.pop(at)
        place[item], offset[item] = bin_number, capacity - left
        left -= length
        room[bin_number] = left
        if left:
            if left not in open_by_room:
                open_by_room[left] = []
                insort(rooms, left)
            open_by_room[left].append(bin_number)
    return place, offset, np.array(room, np.int64)


_PACKED = "row long, length long, sequence_id long, offset long, certified boolean, given_up boolean"


def _packer(number: int, partitions: int, capacity: int, spare: int):
    """Pack one of ``partitions`` in round ``number``. Without a certificate it gives up all sequences with room, with
    one only as many of the emptiest that all such partitions together keep at most ``spare`` room."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        lengths = table["length"].to_numpy()
        place, offset, room = best_fit(lengths, capacity)
        certified = len(room) == lower_bound(lengths, capacity)
        fullest = np.argsort(room, kind="stable")
        kept = fullest[np.cumsum(room[fullest]) * partitions <= (spare if certified else 0)]
        given_up = ~np.isin(place, kept)
        sequence = ((number << 26 | key[0].as_py()) << 24) + place
        return pa.table({"row": table["row"], "length": table["length"], "sequence_id": sequence, "offset": offset,
                         "certified": np.full(len(lengths), certified), "given_up": given_up})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, size: int = PIECES) -> DataFrame:
    """``row, sequence_id, offset, certified, fewest`` for ``items`` of ``row, length``; rows are distinct, lengths at
    least 1. ``certified`` says that the partition needed no more sequences for what it was dealt, ``fewest`` is a
    number of sequences that no packing of all items undercuts."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("length").count().collect():  # at most one row per token of the capacity
        counts[row["length"]] = row["count"]
    fewest = bound_of_counts(counts, capacity)
    spare = fewest * capacity - int(counts @ np.arange(capacity + 1))  # the room that even the fewest sequences have
    left, count, settled, pending = items.select("row", "length"), int(counts.sum()), [], None
    done, best, number = 0, None, 0
    while True:
        partitions = max(1, -(-count // size))
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(number), "row"), F.lit(partitions)).cast("int"))
        packed = cut(dealt.groupBy("part").applyInArrow(_packer(number, partitions, capacity, spare >> (number + 1)), _PACKED))
        groups = {r["given_up"]: r for r in packed.groupBy("given_up").agg(
            F.count_if(F.col("offset") == 0).alias("sequences"), F.count("*").alias("pieces")).collect()}
        total = done + sum(r["sequences"] for r in groups.values())
        if best is not None and total >= best:  # nothing saved: what was given up stays where it was
            settled.append(pending)
            break
        best = total
        if total == fewest or partitions == 1 or True not in groups:
            settled.append(packed)
            break
        settled.append(packed.where("NOT given_up"))
        done += groups[False]["sequences"] if False in groups else 0
        pending = packed.where("given_up")
        left, count, number = pending.select("row", "length"), groups[True]["pieces"], number + 1
    return reduce(DataFrame.union, settled).select("row", "sequence_id", "offset", "certified", F.lit(fewest).alias("fewest"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Per piece ``row, doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified, fewest``."""
    found = cut(pieces(docs, tokenizer, capacity, end_id, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    return found.join(pack(found, capacity), "row")
