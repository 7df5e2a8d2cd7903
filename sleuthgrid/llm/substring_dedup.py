"""Substring dedup by prefix-partitioned suffix trees.

The suffixes (word positions) of all texts are split by their prefixes into groups that fit in
memory. A suffix that begins at each word would send every word `window` times, so each window is represented by
one suffix in it: the one whose first GRAM words have the least fingerprint. Equal windows
choose the same one, so they meet in one group; neighbouring windows mostly choose the same one as
well and are sent together, as a stretch of words with that suffix in it. A suffix whose first GRAM words no
other one begins with is a leaf at the root: it repeats nothing, and its stretch isn't sent. Prefixes are
of variable length: one that begins too many suffixes is lengthened by a word, and at last to the whole window.

A group builds its subtree from real words: the suffixes of its distinct stretches, sorted, and the
length of the prefix that each shares with the one before. A deep internal node, of `window` words or more, is a
run of suffixes that share as many; all its leaves but those of the least doc_id are repeats. Adjacent
ones join into the maximal repeats, a document's spans. Words are compared as words throughout;
fingerprints only deal out work.

Texts are dealt into blocks by a hash and shuffled once. What a block holds of a group is one row: its
distinct stretches, words as numbers of a dictionary, and the rows that have them; so a passage that a
third of the rows share is sent once a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import merged_counts, partitions, texts
from .words import Words, buffers, chunks, ranges

#: Words by which a window chooses its suffix, and the lengths of prefixes, before the whole window.
GRAM, DEPTHS = 4, (2, 3, 4)
_BASE, _NULL = 30, np.iinfo(np.int64).max


def _depths(window: int) -> list[int]:
    return [d for d in DEPTHS if d <= window] or [window]


def anchors(w: Words, at: np.ndarray, window: int) -> np.ndarray:
    """Of each window the place of the suffix that stands for it: the first least fingerprint of GRAM words in it."""
    gram = min(GRAM, window)
    places = np.arange(max(0, len(w.starts) - gram + 1), dtype=np.uint64)
    best = w.prefix(gram, places.astype(np.int64)) >> np.uint64(_BASE) << np.uint64(_BASE) | places
    width, span = 1, window - gram + 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - span + width], best[span - width :])
    return (best[at] & np.uint64((1 << _BASE) - 1)).astype(np.int64)


class Stretches:
    """The stretches of some texts: first word, number of windows and the suffix that stands for these."""

    def __init__(self, w: Words, window: int):
        at = w.windows(window)
        anchor = anchors(w, at, window)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        self.first, self.anchor = at[new], anchor[new]
        self.windows = np.diff(np.append(np.flatnonzero(new), len(at)))

    def keep(self, which: np.ndarray) -> None:
        self.first, self.anchor, self.windows = self.first[which], self.anchor[which], self.windows[which]

    def grouped(self, w: Words, window: int, heavy: list[np.ndarray], slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, windows, prefix fingerprint) of the stretches; those whose prefixes are all heavy go window by window."""
        prefix, todo = np.zeros(len(self.first), np.uint64), np.arange(len(self.first))
        for d, over in zip(_depths(window), heavy, strict=True):
            own = w.prefix(d, self.anchor[todo])
            light = ~over[_slot(own, slots)]
            prefix[todo[light]] = own[light]
            todo = todo[~light]
        n = self.windows[todo]
        single = np.repeat(self.first[todo], n) + ranges(n)
        keep = np.ones(len(self.first), bool)
        keep[todo] = False
        join = lambda a, b: np.concatenate([a[keep], b])
        return join(self.first, single), join(self.windows, np.ones(len(single), np.int64)), join(prefix, w.prefix(window, single))


def _slot(prefix: np.ndarray, slots: int) -> np.ndarray:
    return (prefix & np.uint64(slots - 1)).astype(np.int64)


def prefix_counts(docs: DataFrame, window: int, slots: int) -> tuple[list[np.ndarray], int, int]:
    """Counts of the prefixes of each length by hash slot, over all texts; words; bytes."""
    depths = _depths(window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size = np.zeros((len(depths), slots), np.int64), np.zeros(2, np.int64)
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for lo, hi in chunks(offsets):
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size += (len(w.starts), len(w.data))
                anchor = Stretches(w, window).anchor
                for d, own in zip(depths, sums, strict=True):
                    own += np.bincount(_slot(w.prefix(d, anchor), slots), minlength=slots)
        parts = [size, *sums]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], ["part", "counts"])

    size, *sums = merged_counts(docs.select("text").mapInArrow(count, "part int, counts binary"), [2, *[slots] * len(depths)])
    return sums, int(size[0]), int(size[1])


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, of as few bytes as the largest needs, compressed; the first byte is the width."""
    kind = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or int(x.max()) < 1 << 8 * k and int(x.min()) >= 0)
    raw = x.astype(f"<{'i' if kind == 8 else 'u'}{kind}").tobytes()
    return bytes([kind]) + len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    raw = pa.decompress(packed[5:], int.from_bytes(packed[1:5], "little"), codec="zstd", asbytes=True) if len(packed) > 5 else b""
    return np.frombuffer(raw, f"<{'i' if packed[0] == 8 else 'u'}{packed[0]}").astype(np.int64)


def _steps(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=x.dtype.type(0)))


def _unsteps(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed))


def _binary(letters: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of letters that end at `ends`."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


def _gather(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return ids[np.repeat(first, n) + ranges(n)]


class _Block:
    """The texts of a block in a fixed order, so that a row is known by its number; rows that repeat as a whole may change places."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.number = self.table.column("block")[0].as_py()
        self.doc = self.table.column("doc_id").combine_chunks().fill_null(_NULL).to_numpy(zero_copy_only=False)
        self.data, self.offsets = buffers(self.table.column("text"))
        self.words, self.window = Words(self.data, self.offsets), window
        self.stretches = Stretches(self.words, window)

    def grams(self) -> np.ndarray:
        """Of each stretch the fingerprint of the first GRAM words of its suffix."""
        return self.words.prefix(min(GRAM, self.window), self.stretches.anchor)


_ASKED, _TOLD = "block int, part int, grams binary, again binary", "block int, part int, again binary"


def _parts(grams: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of sorted fingerprints, dealt by their first bits."""
    part = ((grams >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    yield from zip(part[cuts].astype(int).tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(grams)], strict=False)


def _ask(table: pa.Table, window: int, n_parts: int) -> pa.Table:
    """Of a block the fingerprints of its suffixes' first words, and whether it has them twice; a row for each part of these."""
    b = _Block(table, window)
    grams, n = np.unique(b.grams(), return_counts=True)
    rows = [(b.number, part, _steps(grams[s:e]), np.packbits(n[s:e] > 1).tobytes()) for part, s, e in _parts(grams, n_parts)]
    return _table(rows, _ASKED)


def _tell(table: pa.Table) -> pa.Table:
    """For each block of a part which of its fingerprints are found twice or more in all blocks."""
    lists = [_unsteps(x).view(np.uint64) for x in table.column("grams").to_pylist()]
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    again = np.zeros(len(every) + 1, bool)
    again[1:-1] = every[order[1:]] == every[order[:-1]]
    twice = np.empty(len(every), bool)
    twice[order] = again[1:] | again[:-1]
    ends = np.cumsum([len(x) for x in lists])
    rows = []
    for block, part, own, n, e in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), table.column("again").to_pylist(), map(len, lists), ends.tolist(), strict=True):
        rows.append((block, part, np.packbits(twice[e - n : e] | np.unpackbits(np.frombuffer(own, np.uint8), count=n).astype(bool)).tobytes()))
    return _table(rows, _TOLD)


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [(f.split()[0].strip("`"), kinds[f.split()[1]]) for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


_SENT = "block int, `group` int, words binary, ids binary, lengths binary, holders binary, holder binary, start binary, row binary, doc binary"


def _send(table: pa.Table, told: pa.Table, window: int, n_parts: int, heavy: list[np.ndarray], slots: int, n_groups: int) -> pa.Table:
    """Of a block's stretches that may repeat something a row for each group."""
    if not len(table):
        return _table([], _SENT)
    b = _Block(table, window)
    grams = b.grams()
    distinct, which = np.unique(grams, return_inverse=True)
    bits = {r["part"]: r["again"] for r in told.select(["part", "again"]).to_pylist()}
    again = np.zeros(len(distinct), bool)
    for part, s, e in _parts(distinct, n_parts):
        again[s:e] = np.unpackbits(np.frombuffer(bits[part], np.uint8), count=e - s)
    b.stretches.keep(again[which])
    w = b.words
    first, windows, prefix = b.stretches.grouped(w, window, heavy, slots)
    return _table(list(_rows_of_groups(b, first, windows, prefix, n_groups)) if len(first) else [], _SENT)


def _rows_of_groups(b: _Block, first: np.ndarray, windows: np.ndarray, prefix: np.ndarray, n_groups: int) -> Iterator[tuple]:
    w = b.words
    length = windows + b.window - 1
    needed = np.zeros(len(w.starts) + 1, np.int32)  # words in some stretch that is sent
    np.add.at(needed, first, 1)
    np.subtract.at(needed, first + length, 1)
    used = np.flatnonzero(np.cumsum(needed)[:-1] > 0)
    size = w.ends[used] - w.starts[used]
    encoded = _binary(w.data[np.repeat(w.starts[used], size) + ranges(size)], np.cumsum(size)).dictionary_encode()
    ids, distinct = np.zeros(len(w.starts), np.int32), encoded.dictionary
    ids[used] = encoded.indices.to_numpy()
    same = _binary(_gather(ids, first, length).astype("<i4").view(np.uint8), 4 * np.cumsum(length)).dictionary_encode().indices.to_numpy()
    n = int(same.max()) + 1
    a = np.zeros(n, np.int64)  # of each distinct stretch one that has its words
    a[same[::-1]] = np.arange(len(same))[::-1]
    group = ((prefix[a] >> np.uint64(20)) % np.uint64(n_groups)).astype(np.int64)
    text = np.searchsorted(w.offsets, first, "right") - 1
    by_group = np.argsort(group, kind="stable")
    place = np.empty(n, np.int64)
    place[by_group] = np.arange(n)
    by_stretch = np.argsort(place[same], kind="stable")
    ends = np.cumsum(np.bincount(place[same], minlength=n))
    cuts = np.flatnonzero(np.diff(group[by_group], prepend=-1))
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True):
        own = a[by_group[s:e]]
        numbers, local = np.unique(_gather(ids, first[own], length[own]), return_inverse=True)
        held = by_stretch[ends[s - 1] if s else 0 : ends[e - 1]]
        rows, holder = np.unique(text[held], return_inverse=True)
        words = b" ".join(distinct.take(pa.array(numbers)).to_pylist())
        yield (
            b.number, int(group[by_group[s]]), len(words).to_bytes(4, "little") + pa.compress(words, codec="zstd", asbytes=True), _pack(local), _pack(length[own]), _pack(np.diff(ends[s:e], prepend=ends[s - 1] if s else 0)),
            _pack(holder), _pack(first[held] - w.offsets[text[held]]), _steps(rows), _steps(b.doc[rows]),
        )


class Subtree:
    """The suffixes, of `window` words or more, of a group's stretches: sorted, each with the prefix that it shares with the one before."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, window: int):
        pairs = [ids[at + d].astype(np.int64) << 32 | (ids[at + d + 1] if d + 1 < window else 0) for d in range(0, window, 2)]
        self.order = np.lexsort(pairs[::-1]) if len(at) else np.zeros(0, np.int64)
        self.shared = np.zeros(len(at), np.int32)
        place = at[self.order]
        live = np.arange(1, len(at))
        for d in range(window):
            live = live[ids[place[live] + d] == ids[place[live - 1] + d]]
            self.shared[live] += 1

    def least_below(self, value: np.ndarray, depth: int) -> np.ndarray:
        """Of each suffix the least value among the leaves of its node at `depth` words."""
        if not len(self.order):
            return value
        starts = np.flatnonzero(self.shared < depth)
        least = np.minimum.reduceat(value[self.order], starts)
        out = np.empty_like(value)
        out[self.order] = np.repeat(least, np.diff(np.append(starts, len(value))))
        return out


_FOUND = "block int, row binary, holder binary, start binary, n binary"


def _repeats(table: pa.Table, window: int) -> pa.Table:
    """Of a group the windows that start in a smaller doc_id too: rows and, of each run of such windows, first word and number; a row for each block."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    words = [pa.decompress(x[4:], int.from_bytes(x[:4], "little"), codec="zstd", asbytes=True).split(b" ") for x in columns["words"]]
    numbers = pa.array([x for own in words for x in own], pa.large_binary()).dictionary_encode().indices.to_numpy()
    base = np.cumsum([0, *map(len, words)])
    ids = np.concatenate([numbers[_unpack(x) + b] for x, b in zip(columns["ids"], base, strict=False)])
    length, holders, start = (np.concatenate([_unpack(x) for x in columns[c]]) for c in ("lengths", "holders", "start"))
    rows = [_unsteps(x) for x in columns["row"]]
    block = np.repeat(np.array(columns["block"], np.int64), [len(x) for x in rows])
    base = np.cumsum([0, *map(len, rows)])
    row = np.concatenate([_unpack(x) + b for x, b in zip(columns["holder"], base, strict=False)])
    number, doc = np.concatenate(rows), np.concatenate([_unsteps(x) for x in columns["doc"]])
    # equal stretches of several blocks are one
    same = _binary(ids.astype("<i4").view(np.uint8), 4 * np.cumsum(length)).dictionary_encode().indices.to_numpy()
    n = int(same.max()) + 1
    stretch = np.repeat(same, holders)
    least = np.full(n, _NULL, np.int64)
    np.minimum.at(least, stretch, doc[row])
    one = np.zeros(n, np.int64)
    one[same[::-1]] = np.arange(len(same))[::-1]
    first, windows = (np.cumsum(length) - length)[one], length[one] - window + 1
    at = np.repeat(first, windows) + ranges(windows)
    below = Subtree(ids, at, window).least_below(np.repeat(least, windows), window)
    # each holder of a stretch against its windows
    n_windows, upto = windows[stretch], (np.cumsum(windows) - windows)[stretch]
    holder = np.repeat(np.arange(len(stretch)), n_windows)
    place = ranges(n_windows)
    again = np.flatnonzero(below[np.repeat(upto, n_windows) + place] < doc[row[holder]])
    holder, place = holder[again], place[again]
    new = np.ones(len(again), bool)
    new[1:] = (holder[1:] != holder[:-1]) | (place[1:] != place[:-1] + 1)
    run = np.flatnonzero(new)
    run_row, run_start, run_n = row[holder[run]], start[holder[run]] + place[run], np.diff(np.append(run, len(again)))
    order = np.lexsort((run_start, number[run_row], block[run_row]))
    cuts = np.flatnonzero(np.diff(block[run_row][order], prepend=-1))
    out = []
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False):  # none, where nothing repeats
        own = order[s:e]
        which, index = np.unique(number[run_row[own]], return_inverse=True)
        out.append((int(block[run_row[own[0]]]), _steps(which), _pack(index), _pack(run_start[own]), _pack(run_n[own])))
    return _table(out, _FOUND)


RESULT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<start:int,length:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _cut(table: pa.Table, found: pa.Table, window: int, keep_text: bool) -> pa.Table:
    """The result's rows of a block of texts."""
    if not len(table):
        return pa.schema(_ARROW).empty_table()
    b = _Block(table, window)
    n_words = b.words.counts()
    base = np.cumsum(n_words + 1) - n_words - 1
    edge = np.zeros(int((n_words + 1).sum()) + 1, np.int32)
    for packed in found.select(["row", "holder", "start", "n"]).to_pylist():
        start = base[_unsteps(packed["row"])[_unpack(packed["holder"])]] + _unpack(packed["start"])
        np.add.at(edge, start, 1)
        np.subtract.at(edge, start + _unpack(packed["n"]) + window - 1, 1)
    gone = np.cumsum(edge) > 0
    n_removed, kept, sha, spans = [], [], [], []
    for i in range(len(b.doc)):
        words, own = b.data[b.offsets[i] : b.offsets[i + 1]].tobytes().split(), []
        mine = gone[base[i] : base[i] + n_words[i]]
        if mine.any():
            edges = np.flatnonzero(np.diff(mine, prepend=False, append=False)).tolist()
            own = [{"start": s, "length": e - s} for s, e in zip(edges[::2], edges[1::2], strict=True)]
            for x in reversed(own):
                del words[x["start"] : x["start"] + x["length"]]
        left = b" ".join(words)
        n_removed.append(sum(x["length"] for x in own))
        kept.append(left.decode() if keep_text else None)
        sha.append(hashlib.sha256(left).hexdigest())
        spans.append(own)
    columns = [b.table.column("doc_id").combine_chunks(), pa.array(n_words), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string()), pa.array(spans, _SPANS)]
    return pa.table(dict(zip(_NAMES, columns, strict=True)))


_NAMES = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "spans"]
_ARROW = list(zip(_NAMES, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _SPANS], strict=True))


def dedup_substrings(docs: DataFrame, *, window: int = 13, block_bytes: int = 6 << 20, group_words: int = 8_000_000, slots: int = 1 << 16, keep_text: bool = True) -> DataFrame:
    """Remove the words covered by a `window`-word passage which also starts in a document of smaller doc_id.

    Windows are judged on the input, not on what is left. Returns doc_id, n_words, n_removed, kept
    (the words left, joined by a space; null unless keep_text), kept_sha256 of it, and spans (start
    and length in words) of the maximal repeats removed; one row for each input row.

    Null or empty text: no words. Null doc_id: counts as greater than every id, and such rows
    remove nothing from each other; so do rows that repeat one doc_id. Further columns are ignored.
    An empty table gives an empty result. A text is worked on whole, in one task; rows that repeat as
    a whole are in one block.

    Memory: `block_bytes` of texts, or about `group_words` words of a group. A prefix is heavy, and
    lengthened, if its slot counts more suffixes than an eighth of a group holds, or four times the mean of
    all slots; `slots` counters for each length of prefix pass through the driver, so raise them with corpora of many TB.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    counts, n_words, size = prefix_counts(docs, window, slots)
    n_blocks = max(1, math.ceil(size / block_bytes))
    n_groups = max(2 * partitions(spark), math.ceil(4 * n_words / group_words))
    heavy = [own > max(group_words // (2 * (window + GRAM)) // 8, 4 * int(own.sum()) // slots) for own in counts]
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")).repartition(max(partitions(spark), n_blocks), "block")

    asked = blocks.groupBy("block").applyInArrow(lambda table: _ask(table, window, n_groups), _ASKED)
    told = asked.groupBy("part").applyInArrow(_tell, _TOLD)
    send = lambda table, own: _send(table, own, window, n_groups, heavy, slots, n_groups)
    sent = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, _SENT)
    found = sent.groupBy("group").applyInArrow(lambda table: _repeats(table, window), _FOUND)
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda table, own: _cut(table, own, window, keep_text), RESULT)
