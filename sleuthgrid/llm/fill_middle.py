"""Fill-in-middle rearrangement of texts, cut by rank and select on packed bit vectors.

A unit is a maximal run of A-Z and a-z, or any other single character. A bit vector over the bytes of
some texts marks where units begin, another one where characters begin. Each is packed and has a directory of
the ones before each block. A text's units are the difference of two ranks, the bytes at which it is cut are found
by select, and the characters of its parts are differences of ranks again. No list of units is ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import texts
from .words import buffers, chunks

#: Markers before the prefix, suffix and middle of a rearranged text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes of a bit vector to an entry of its directory.
BLOCK = 64


class BitVector:
    """Packed bits with the number of ones before each block of 8 * BLOCK bits."""

    def __init__(self, bits: np.ndarray):
        self.length = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.bytes = np.zeros((len(packed) // BLOCK + 1) * BLOCK, np.uint8)
        self.bytes[: len(packed)] = packed
        ones = np.bitwise_count(self.bytes.view("<u8")).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones among the first at[i] bits."""
        block, rest = at // (8 * BLOCK), at % (8 * BLOCK)
        out = self.before[block]
        for lo, hi in _parts(len(at)):
            counts = np.bitwise_count(self._block(block[lo:hi])).astype(np.int64)
            whole = rest[lo:hi, None] // 8 > np.arange(BLOCK)
            last = np.minimum(at[lo:hi] // 8, len(self.bytes) - 1)
            part = np.bitwise_count(self.bytes[last] & ((1 << (rest[lo:hi] % 8)) - 1).astype(np.uint8))
            out[lo:hi] += (counts * whole).sum(axis=1) + part
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k[i] ones before it; the length where there are no more than k[i]."""
        out = np.full(len(k), self.length, np.int64)
        own = np.flatnonzero(k < self.ones)
        block = np.searchsorted(self.before, k[own], "right") - 1
        rest = k[own] - self.before[block]
        for lo, hi in _parts(len(own)):
            data = self._block(block[lo:hi])
            upto = np.cumsum(np.bitwise_count(data), axis=1, dtype=np.int64)
            byte = (upto <= rest[lo:hi, None]).sum(axis=1)
            row = np.arange(hi - lo)
            left = rest[lo:hi] - np.where(byte > 0, upto[row, byte - 1], 0)
            bits = np.unpackbits(data[row, byte][:, None], axis=1, bitorder="little")
            bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
            out[own[lo:hi]] = (block[lo:hi] * BLOCK + byte) * 8 + bit
        return out

    def _block(self, block: np.ndarray) -> np.ndarray:
        rows = self.bytes.reshape(-1, BLOCK)
        return rows[np.minimum(block, len(rows) - 1)]


def _parts(n: int, rows: int = 4096) -> Iterator[tuple[int, int]]:
    for lo in range(0, n, rows):
        yield lo, min(lo + rows, n)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> BitVector:
    """Where the units of some texts begin; data: their bytes, offsets: each text's first byte and the end."""
    letter = _LETTER[data]
    bits = ~letter & ((data & 0xC0) != 0x80)
    bits |= letter & ~np.concatenate([[False], letter[:-1]])[: len(data)]
    bits[offsets[offsets < len(data)]] = True  # no unit goes over the end of a text
    return BitVector(bits)


def _draws(doc_id: int | None, salt: str) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def _rearrange(ids: pa.Array, column: pa.Array, salt: str, plain_from: int, spm_below: int) -> Iterator[pa.RecordBatch]:
    data, offsets = buffers(column)
    own_ids = ids.to_pylist()
    for lo, hi in chunks(offsets):
        d, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        units = unit_starts(d, off)
        chars = BitVector((d & 0xC0) != 0x80)
        base = units.rank(off)
        n = np.diff(base)
        draws = np.array([_draws(i, salt) for i in own_ids[lo:hi]], np.int64).reshape(-1, 4)
        cuts = np.sort(draws[:, :2] % (n[:, None] + 1), axis=1)
        first, second = (np.where(cuts[:, c] < n, units.select(base[:-1] + cuts[:, c]), off[1:]) for c in (0, 1))
        places = chars.rank(np.concatenate([off[:-1], first, second])).reshape(3, -1)
        raw, form, out = d.tobytes(), [], []
        for i, (s, a, b, e) in enumerate(zip(off[:-1].tolist(), first.tolist(), second.tolist(), off[1:].tolist(), strict=True)):
            text = raw[s:e]
            if not text or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)) or draws[i, 2] % 100 >= plain_from:
                form.append("plain")
                out.append(text)
                continue
            p, m, q = (mark.encode() + part for mark, part in ((PREFIX, raw[s:a]), (MIDDLE, raw[a:b]), (SUFFIX, raw[b:e])))
            form.append("spm" if draws[i, 3] % 100 < spm_below else "psm")
            out.append(q + p + m if form[-1] == "spm" else p + q + m)
        none = np.array([f == "plain" for f in form], bool)
        counts = [pa.array(x, pa.int64(), mask=none) for x in (places[1] - places[0], places[2] - places[1])]
        yield pa.RecordBatch.from_arrays([pa.array(own_ids[lo:hi], pa.int64()), pa.array(n), pa.array(form, pa.string()), *counts, pa.array(out, pa.binary()).cast(pa.string())], _NAMES)


_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(docs: DataFrame, *, salt: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Of each row doc_id, n (its units), form, prefix_chars, middle_chars and output.

    The first four groups of eight hexadecimal digits of sha256("salt:doc_id") are the draws h1 to h4. The
    prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger; the rest is
    the suffix. form is plain if h3 % 100 >= plain_from, else spm if h4 % 100 < spm_below, else psm. A text that is
    empty or holds a marker is plain too, so that the markers of an output are never ambiguous. prefix_chars and
    middle_chars are in code points, null for plain rows.

    A null text is the empty one; a null doc_id draws from "salt:". Rows that repeat a doc_id draw alike and are
    cut each by its own n. Further columns are ignored, whatever their names; an empty table gives no rows. A text is
    worked on whole, in one task, with a quarter of its size in bits beside it.
    """

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rearrange(b.column("doc_id"), b.column("text"), salt, plain_from, spm_below)

    return texts(docs).mapInArrow(rearrange, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle rearranged. No marker's end is another's begin, so splitting finds the three that were put in."""
    parts = F.split(output, "<[PSM]>")
    psm, spm = (F.concat(*(F.get(parts, F.lit(i)) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
