"""Benchmark decontamination by greedy string tiling.

Windows of `min_match` words that a document shares with a benchmark item are seeds, found by
fingerprints. Where the seeds of an item could reach the coverage, item and document are tiled by running
Karp-Rabin matching: the greatest length at which unmarked words of both still have a common
fingerprint is sought, matches of that length are marked as tiles, and so on with smaller lengths down to
min_match. A document leaks an item when its tiles cover `coverage` of the item's words, in whatever order
the passages stand. Tiling holds a few numbers for each word, never the pairs of seeds, which a
repetitive text has as many of as the square of its length.

The benchmark is the query set and is compared with all documents in blocks of a fixed size, one after
the other, so what is sent to tasks is bounded, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, texts
from .words import Words, buffers, chunks, mix, ranges

#: Benchmark words in a block.
BLOCK_WORDS = 1_000_000
_BITS = 1 << 22


class Items:
    """A block of benchmark items: their words and the seeds in them; of items too short to hold a seed, the whole."""

    def __init__(self, rows: list[tuple[int | None, Words]], min_match: int):
        self.min_match = min_match
        short = [(i, int(w.whole(w.offsets[:-1], w.offsets[1:])[0]), len(w.starts)) for i, w in rows if len(w.starts) < min_match]
        self.short = sorted(short, key=lambda x: x[1])
        self.short_hash = np.array([x[1] for x in self.short], np.uint64)
        long = [(i, w) for i, w in rows if len(w.starts) >= min_match]
        self.ids, self.words = [i for i, _ in long], [w.hash for _, w in long]
        seeds = [w.prefix(min_match, w.windows(min_match)) for _, w in long]
        hashes = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(long)), [len(s) for s in seeds])
        at = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.seeds, self.item, self.at = hashes[order], item[order], at[order]
        self.filter = np.zeros(_BITS, bool)
        self.filter[(hashes & np.uint64(_BITS - 1)).astype(np.int64)] = True

    def leaks(self, column: pa.Array, coverage: float) -> Iterator[list[dict]]:
        """Of each text the items that it leaks."""
        data, offsets = buffers(column)
        for lo, hi in chunks(offsets):
            d, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            w = Words(d, off, lower=True)
            at = w.windows(self.min_match)
            prints = w.prefix(self.min_match, at)
            hit = self.filter[(prints & np.uint64(_BITS - 1)).astype(np.int64)]
            hit[hit] = np.isin(prints[hit], self.seeds)
            at, prints = at[hit], prints[hit]
            bounds = np.searchsorted(at, w.offsets)
            whole = self._short_leaks(d, off) if self.short else [[] for _ in range(lo, hi)]
            for t in range(hi - lo):
                own = slice(bounds[t], bounds[t + 1])
                yield whole[t] + (self._of_text(prints[own], at[own], w.hash, coverage) if bounds[t] < bounds[t + 1] else [])

    def _short_leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """Items shorter than a seed leak where they are a whole line of the text."""
        w = Words(data, np.unique(np.concatenate([offsets, np.flatnonzero(data == 10)])), lower=True)
        lines = w.whole(w.offsets[:-1], w.offsets[1:])
        found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        at = np.flatnonzero(np.isin(lines, self.short_hash) & (w.counts() > 0))
        text = np.searchsorted(offsets, w.starts[w.offsets[at]], "right") - 1
        for t, h in sorted(set(zip(text.tolist(), lines[at].tolist(), strict=True))):
            lo, hi = np.searchsorted(self.short_hash, np.uint64(h), "left"), np.searchsorted(self.short_hash, np.uint64(h), "right")
            found[t] += [{"item_id": i, "matched_words": n, "item_words": n, "n_tiles": 1} for i, _, n in self.short[lo:hi]]
        return found

    def _of_text(self, prints: np.ndarray, at: np.ndarray, words: np.ndarray, coverage: float) -> list[dict]:
        distinct = np.unique(prints)
        lo, hi = (np.searchsorted(self.seeds, distinct, side) for side in ("left", "right"))
        seed = np.repeat(lo, hi - lo) + ranges(hi - lo)  # at most the seeds of the block
        out, items = [], self.item[seed]
        order = np.argsort(items, kind="stable")
        cuts = np.flatnonzero(np.diff(items[order], prepend=-1))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            own = seed[order[s:e]]
            k = int(self.item[own[0]])
            n = len(self.words[k])
            if _covered(self.at[own], self.min_match, n) < coverage * n:
                continue
            tiles = tile(self.words[k], stretches(words, at[np.isin(prints, self.seeds[own])], self.min_match), self.min_match)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * n:
                out.append({"item_id": self.ids[k], "matched_words": covered, "item_words": n, "n_tiles": len(tiles)})
        return out


def _covered(at: np.ndarray, width: int, n: int) -> int:
    edge = np.zeros(n + 1, np.int64)
    starts = np.unique(at)
    edge[starts] += 1
    np.subtract.at(edge, starts + width, 1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def stretches(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that the windows at `at` cover, with one word that doesn't count between stretches: words, whether they count, places."""
    new = np.flatnonzero(np.diff(at, prepend=-width - 1) > width)
    first, last = at[new], at[np.append(new[1:], len(at)) - 1] + width
    place = np.repeat(first, last - first + 1) + ranges(last - first + 1)
    counts = np.ones(len(place), bool)
    counts[np.cumsum(last - first + 1) - 1] = False
    return words[np.minimum(place, len(words) - 1)], counts, place


class _Side:
    """Words of one side, which of them are still unmarked, and fingerprints of any length."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.free, self.powers = free.copy(), [words]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and fingerprints of the windows of unmarked words."""
        marked = np.cumsum(np.append(0, ~self.free))
        at = np.flatnonzero(marked[length:] == marked[:-length])
        out, done = np.full(len(at), length, np.uint64), 0
        for height in range(length.bit_length() - 1, -1, -1):
            while len(self.powers) <= height:
                half = self.powers[-1]
                m = max(0, len(half) - (1 << len(self.powers) - 1))
                self.powers.append(mix(half[:m] * np.uint64(0x9E3779B97F4A7C15) + half[len(half) - m :]))
            if length >> height & 1:
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.powers[height][at + done])
                done += 1 << height
        return at, out

    def is_free(self, at: int, length: int) -> bool:
        return bool(self.free[at : at + length].all())


def tile(item: np.ndarray, text: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in the item, start in the text, length) of `width` words or more.

    Longest first; equal lengths by the place in the item, then in the text. text: as stretches() gives it.
    """
    words, counts, places = text
    a, b, tiles = _Side(item, np.ones(len(item), bool)), _Side(words, counts), []
    most = min(len(item), len(words))
    while most >= width:
        low, high = width - 1, most  # the greatest length that both sides share
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(a.windows(middle)[1], b.windows(middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        if low < width:
            break
        at, own = a.windows(low)
        where, other = b.windows(low)
        order = np.argsort(other, kind="stable")
        where, other = where[order], other[order]
        first, last = (np.searchsorted(other, own, side) for side in ("left", "right"))
        next_: dict[int, int] = {}
        for i, f, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            if f == e or not a.is_free(i, low):
                continue
            j = next_.get(f, f)
            while j < e and not b.is_free(int(where[j]), low):
                j += 1
            next_[f] = j
            if j < e:
                at_text = int(where[j])
                a.free[i : i + low] = b.free[at_text : at_text + low] = False
                tiles.append((i, int(places[at_text]), low))
        most = low - 1
    return tiles


def _blocks(benchmark: DataFrame, min_match: int) -> Iterator[Items]:
    """The items in blocks of BLOCK_WORDS words; the driver holds one at a time."""
    held: list[tuple[int | None, Words]] = []
    size = 0
    for r in texts(benchmark, "item_id").toLocalIterator():
        text = (r["text"] or "").encode()
        w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=True)
        if not len(w.starts):
            continue
        held.append((r["doc_id"], w))
        size += len(w.starts)
        if size >= BLOCK_WORDS:
            yield Items(held, min_match)
            held, size = [], 0
    if held:
        yield Items(held, min_match)


LEAK = "array<struct<item_id:long,matched_words:int,item_words:int,n_tiles:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("matched_words", pa.int32()), ("item_words", pa.int32()), ("n_tiles", pa.int32())]))


def _leaks(items: Items, coverage: float, text: Column) -> Column:
    @F.arrow_udf(LEAK)
    def find(column: pa.Array) -> pa.Array:
        return pa.array(list(items.leaks(column, coverage)), _ARROW)

    return find(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, matched_words, item_words, n_tiles, coverage.

    Words are compared with A-Z lower-cased. An item of fewer than min_match words leaks where its words are a
    whole line of the text. Null, empty and blank texts on either side leak nothing. Rows that repeat a
    document or an item are each judged; a null doc_id or item_id is returned as null. Empty tables give no
    rows; further columns are ignored. A text is worked on whole, in one task; time for a very
    long or repetitive one grows with its words times the number of different tile lengths.
    """
    docs = texts(docs)
    found = None
    for items in _blocks(benchmark, min_match):
        # what one block found is written before the next is made, so no more than one is held
        found = materialize(found, "leaks") if found is not None else None
        own = docs.select("doc_id", F.explode(_leaks(items, coverage, F.col("text"))).alias("leak")).select("doc_id", "leak.*")
        own = own.withColumn("coverage", F.col("matched_words") / F.col("item_words"))
        found = own if found is None else found.unionByName(own)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched_words int, item_words int, n_tiles int, coverage double") if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text leaks no item; as find_leaks."""
    first = True
    for items in _blocks(benchmark, min_match):
        docs = docs if first else materialize(docs, "decontaminated")
        docs, first = docs.where(F.size(_leaks(items, coverage, F.col("text").cast("string"))) == 0), False
    return docs
