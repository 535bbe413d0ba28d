"""Words of many texts at once, as numpy arrays over an Arrow string column's bytes.

Word boundaries are ASCII characters, which never occur inside a longer UTF-8 sequence, so bytes suffice.
Hashes are polynomials modulo 2**64, taken from running sums and mixed; equal words or windows have equal hashes
wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Scan:
    """Word i is ``data[starts[i]:ends[i]]``; row r has the words ``first[r]`` to ``first[r + 1]`` and the bytes
    ``offsets[r]`` to ``offsets[r + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, part)``: whole texts of up to ``most`` bytes together, or one text that is longer."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        limit = (ends[at - 1] if at else 0) + most
        to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def scan(texts: pa.Array) -> Scan:
    """The words of ``texts``; a null text has none."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, content = texts.buffers()
    places = np.frombuffer(places, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8)[places[0]:places[-1]] if content else np.empty(0, np.uint8)
    offsets = places - places[0]
    word = ~_SPACE[data]
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = False
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return Scan(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads differences over all bits."""
    values = values ^ (values >> np.uint64(32))
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            size = max(count, 2 * len(self.up))
            self.up, self.down = (_geometric(base, size) for base in (self.base, self.inverse))
        return self.up[:count], self.down[:count]


def _geometric(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


BYTES = Powers(0x9E3779B97F4A7C15)
WORDS = Powers(0xC2B2AE3D27D4EB4F)
AGAIN = Powers(0xA0761D6478BD642F)


def word_hashes(found: Scan) -> np.ndarray:
    """A uint64 for each word that depends on its bytes alone."""
    up, down = BYTES.upto(len(found.data) + 1)
    sums = np.zeros(len(found.data) + 1, np.uint64)
    np.cumsum((found.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[found.ends] - sums[found.starts]) * down[found.starts])


def window_hashes(hashes: np.ndarray, width: int, powers: Powers = WORDS) -> np.ndarray:
    """For each i a hash of ``hashes[i:i + width]``, as far as there are that many."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, down = powers.upto(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mixed((sums[width:] - sums[:count]) * down[:count])


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``width`` words that begins at one of ``starts``, all different."""
    steps = np.zeros(total + width + 1, np.int32)
    steps[starts] += 1
    steps[starts + width] -= 1
    return np.cumsum(steps[:total]) > 0


def by_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set between each two of ``bounds``."""
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])[bounds])
