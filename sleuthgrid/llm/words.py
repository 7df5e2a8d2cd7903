"""Words and word-window fingerprints of whole texts, vectorised over UTF-8 buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. A word's hash takes eight bytes at a
time, windows combine word hashes pairwise, each with a mixing step in between, and whole sequences sum
mixed pairs of word and place: none is linear modulo a power of two. All come in two independent
lanes of 64 bits, and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed each for itself.
LONG = 128
#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """The words of some texts: hash, start and end byte in `data`, and offsets by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        self.data = data = _LOWER[data] if lower else data
        solid = ~_SPACE[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self._doubled: dict[tuple[int, int], np.ndarray] = {}

    @property
    def hash(self) -> np.ndarray:
        return self._power(0, 0)

    def _hashes(self, lane: int) -> np.ndarray:
        """Of each word a hash of its bytes, eight at a time with a mixing step after each."""
        length = self.ends - self.starts
        out = mix(length.astype(np.uint64) + np.uint64(lane) * _STEP)
        eights = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        own, done = np.flatnonzero(length <= LONG), 0
        while len(own):
            part = eights[self.starts[own] + done]
            part &= _MASKS[np.minimum(length[own] - done, 8)]
            out[own] = mix(out[own] * _ODD + part)
            done += 8
            own = own[length[own] > done]
        for i in np.flatnonzero(length > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), seed=lane)
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def _power(self, height: int, lane: int) -> np.ndarray:
        """Fingerprints of 2**height words from each word that has as many after it."""
        if (height, lane) not in self._doubled:
            if height:
                half = self._power(height - 1, lane)
                m = max(0, len(half) - (1 << height - 1))
                found = mix(half[:m] * _ODD + half[len(half) - m :])
            else:
                found = self._hashes(lane)
            self._doubled[height, lane] = found
        return self._doubled[height, lane]

    def prefix(self, k: int, at: np.ndarray, lane: int = 0) -> np.ndarray:
        """Fingerprints of the k words from each word index in `at`."""
        out, done = np.full(len(at), k, np.uint64), 0
        for height in range(k.bit_length() - 1, -1, -1):
            if k >> height & 1:
                out = mix(out * _ODD + self._power(height, lane)[at + done])
                done += 1 << height
        return out

    def whole(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """Fingerprints of the words starts[i]..ends[i]-1, for ascending stretches that don't overlap; 0 for empty ones."""
        n = ends - starts
        out = np.zeros(len(starts), np.uint64)
        full = np.flatnonzero(n > 0)
        if len(full):
            place = ranges(n[full])
            at = np.repeat(starts[full], n[full]) + place
            terms = mix(self._power(0, lane)[at] + _STEP * (place + 1).astype(np.uint64))
            first = np.cumsum(n[full]) - n[full]
            out[full] = mix(np.add.reduceat(terms, first) + n[full].astype(np.uint64))
        return out

    def windows(self, k: int) -> np.ndarray:
        """Word indexes at which k words of one text begin."""
        starts, n = self.offsets[:-1], np.maximum(self.counts() - k + 1, 0)
        return np.repeat(starts, n) + ranges(n)

    def sets(self, k: int) -> Iterator[np.ndarray]:
        """Of each text the sorted distinct k-word shingles; a shorter text is one shingle, one without words has none."""
        at = self.windows(k)
        all_, ends = self.prefix(k, at), np.cumsum(np.maximum(self.counts() - k + 1, 0))
        short = self.whole(self.offsets[:-1], np.where(self.counts() < k, self.offsets[1:], self.offsets[:-1]))
        lo = 0
        for i, hi in enumerate(ends.tolist()):
            n = int(self.offsets[i + 1] - self.offsets[i])
            yield np.unique(all_[lo:hi]) if n >= k else short[i : i + 1] if n else all_[:0]
            lo = hi


def ranges(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... in one array."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's offset in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs (first, past the last) of texts that hold at most `size` bytes, or one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first, past the last, their words) for runs of texts of a column."""
    data, offsets = buffers(column)
    for lo, hi in chunks(offsets):
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower)
