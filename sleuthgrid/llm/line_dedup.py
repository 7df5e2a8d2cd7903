"""Line dedup by pairwise alignment.

A run is some consecutive lines, blank ones between them, that together reach `min_words` words and
would not without the last, or without the first; a line of `min_words` words is a run. A run's first
holder is the least doc_id that has it. Every later document which has the run is paired with that
holder, so a run that r documents share makes r - 1 pairs, however frequent it is. Paired documents
are aligned by patience diff on line hashes: lines unique in both, in their longest common order,
are anchors, and equal lines around them join the anchors' blocks. Blocks of at least `min_words`
words are deleted from the later document, and nothing else. An alignment keeps order, so blocks that the pair
has in another order are aligned for themselves after it. Every line with words of a block which an alignment may delete is in
a run of that block, so no other earlier holder could delete words that a document keeps. Only line
hashes are shuffled to be aligned, no text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, partitions
from .words import Words, buffers, chunks

#: Documents paired with one holder that go to a task.
HOLDER = 2048
_LINE, _WORDS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _hash_lines(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text two hashes of each of its lines and their numbers of words; a line's words decide, not its white space."""
    data, offsets = buffers(column)
    for lo, hi in chunks(offsets):
        d, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        breaks = np.flatnonzero(d == 10)
        bounds = np.unique(np.concatenate([off, breaks]))
        w = Words(d, bounds)
        counts = w.counts()
        one, two = (w.whole(w.offsets[:-1], w.offsets[1:], lane).view(np.int64) for lane in (0, 1))
        of = np.searchsorted(bounds, off)
        empty = np.zeros(1, np.int64)
        for i, (s, e) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
            # an empty text has no segment; one that starts with a break has its first line empty
            if off[i] == off[i + 1]:
                s = e
            parts = one[s:e], two[s:e], counts[s:e]
            yield tuple(np.concatenate([empty, p]) for p in parts) if s < e and d[off[i]] == 10 else parts


def lines(text: Column, min_words: int) -> Column:
    """struct(hashes, words, runs) of the \\n-split lines of a text; null and empty texts have none.

    hashes tell the lines of two documents apart, runs are the distinct runs by the other, independent hash:
    what is deleted has both in common.
    """

    def run(column: pa.Array) -> pa.Array:
        found = [(one, words, _seeds(two.tolist(), words.tolist(), min_words)) for one, two, words in _hash_lines(column)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], _LINE), pa.array([f[1] for f in found], _WORDS), pa.array([f[2] for f in found], _LINE)], ["hashes", "words", "runs"])

    return F.arrow_udf(run, "struct<hashes:array<long>,words:array<int>,runs:array<long>>")(text)


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Lines unique in both, in their longest common order."""
    once = {x for x, n in Counter(a).items() if n == 1} & {x for x, n in Counter(b).items() if n == 1}
    place = {x: i for i, x in enumerate(a) if x in once}
    tops: list[int] = []
    piles: list[int] = []
    back: dict[int, int | None] = {}
    for j, x in enumerate(b):
        if x in once:
            k = bisect_left(tops, place[x])
            tops[k : k + 1], piles[k : k + 1] = [place[x]], [j]
            back[j] = piles[k - 1] if k else None
    found, j = [], piles[-1] if piles else None
    while j is not None:
        found.append((place[b[j]], j))
        j = back[j]
    return found[::-1]


def _wide_anchors(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Anchors (start in a, start in b, length): lines that both have once; else windows of 2, 4, ... lines that both have once."""
    width = 1
    while width <= min(len(a), len(b)):
        found = _anchors(a, b)
        if found:
            out: list[tuple[int, int, int]] = []
            for i, j in found:  # windows that overlap count from the end of the one before
                over = max(0, out[-1][0] + out[-1][2] - i, out[-1][1] + out[-1][2] - j) if out else 0
                if over < width:
                    out.append((i + over, j + over, width - over))
            return out
        names: dict[tuple[int, int], int] = {}
        a, b = ([names.setdefault(x, len(names)) for x in zip(s, s[width:], strict=False)] for s in (a, b))
        width *= 2
    return []


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of two line sequences, in order.

    Patience diff; in a stretch without a line that is unique in both, windows of lines that are unique in
    both are the anchors, and a stretch without these stays unaligned.
    """
    blocks, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            blocks.append((a0, b0, 1))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            blocks.append((a1, b1, 1))
        if a0 == a1 or b0 == b1:
            continue
        own = _wide_anchors(a[a0:a1], b[b0:b1])
        at_a, at_b = a0, b0
        for i, j, n in own:
            blocks.append((a0 + i, b0 + j, n))
            todo.append((at_a, a0 + i, at_b, b0 + j))
            at_a, at_b = a0 + i + n, b0 + j + n
        if own:
            todo.append((at_a, a1, at_b, b1))
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(blocks):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def runs(words: list[int], min_words: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the shortest runs of min_words words or more from each line with words on, and up to each."""
    upto = [0, *accumulate(words)]
    start = end = 0
    for i, n in enumerate(words):
        if n < min(min_words, 1):
            continue
        end = max(end, i + 1)
        while end < len(words) and upto[end] - upto[i] < min_words:
            end += 1
        if upto[end] - upto[i] >= min_words:
            yield i, end
        while start < i and upto[i + 1] - upto[start + 1] >= min_words:
            start += 1
        if start < i and upto[i + 1] - upto[start] >= min_words:
            yield start, i + 1


def _seeds(hashes: list[int], words: list[int], min_words: int) -> list[int]:
    """One hash for each distinct run."""
    found = set()
    for s, e in runs(words, min_words):
        x = hashes[s]
        for y in hashes[s + 1 : e]:
            x = ((x ^ (x >> 29 & 0x7FFFFFFFF)) * 0x9E3779B97F4A7C15 + y + 1) & 0xFFFFFFFFFFFFFFFF
        found.add(x - (1 << 64) if x >> 63 == 1 else x)
    return list(found)


def _gone(before: list[int], known: dict[tuple[int, ...], int], own: list[int], words: list[int], min_words: int) -> list[int]:
    """The lines of a document that it loses to an earlier one, all in aligned blocks. known: where the earlier one's runs begin.

    An alignment keeps order, so blocks that the pair has in another order are aligned after it, each for itself from a
    run that both have on.
    """
    at: set[int] = set()
    for _, j, n in align(before, own):
        if sum(words[j : j + n]) >= min_words:
            at.update(range(j, j + n))
    for s, e in runs(words, min_words):
        if at.issuperset(range(s, e)) or (place := known.get(tuple(own[s:e]))) is None:
            continue
        end = e
        while end < len(own) and end not in at and place + end - s < len(before) and own[end] == before[place + end - s]:
            end += 1
        at.update(s + j + k for _, j, n in align(before[place : place + end - s], own[s:end]) for k in range(n))
    return sorted(at)


def line_deletions(docs: DataFrame, *, min_words: int = 5, rare: int | None = None) -> DataFrame:
    """(doc_id, print, gone): of each document that loses lines their places, print telling apart rows of one doc_id.

    rare: leave out runs that more documents have as seeds; lines that no alignment by other seeds reaches then stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("print"), lines(F.col("text"), min_words).alias("l")).select("doc_id", "print", "l.*").where(F.size("runs") > 0)
    rows = materialize(rows, "line-hashes")
    spark = docs.sparkSession

    seeds = rows.select("doc_id", F.explode("runs").alias("run"))
    first = seeds.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    if rare is not None:
        first = first.where(F.col("n") <= rare)
    first = materialize(first.select("run", "first"), "line-first")  # written, so that a run which many documents have is split by adaptive execution in the join
    pairs = materialize(seeds.join(first, "run").where("doc_id > first").select("doc_id", "first").distinct(), "line-pairs")

    # a holder's lines are sent once to each of its tasks, not once for each pair
    tasks = pairs.groupBy("first").agg(F.expr(f"cast(ceil(count(*) / {HOLDER}) as int)").alias("tasks"))
    holders = rows.join(tasks, rows["doc_id"] == tasks["first"]).select("first", F.explode(F.expr("sequence(0, tasks - 1)")).alias("task"), F.lit(True).alias("holds"), "doc_id", "print", "hashes", "words")
    many = tasks.where("tasks > 1")
    dealt = pairs.join(many, "first", "left").select("first", F.coalesce(F.pmod(F.xxhash64("doc_id"), "tasks"), F.lit(0)).cast("int").alias("task"), "doc_id")
    later = dealt.join(rows, "doc_id").select("first", "task", F.lit(False).alias("holds"), "doc_id", "print", "hashes", "words")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before = None, []
        for b in batches:
            out: list[tuple[int, int, list[int]]] = []
            columns = (b.column(c).to_pylist() for c in ("first", "task", "holds", "doc_id", "print", "hashes", "words"))
            for first, task, holds, doc_id, print_, own, words in zip(*columns, strict=True):
                if (first, task) != key:
                    key, before = (first, task), []
                if holds:
                    before.append((own, {tuple(own[s:e]): s for s, e in reversed(list(runs(words, min_words)))}))
                    continue
                gone: set[int] = set()
                for theirs, known in before:  # rows that repeat the holder's doc_id, mostly one
                    gone.update(_gone(theirs, known, own, words, min_words))
                if gone:
                    out.append((doc_id, print_, sorted(gone)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), _WORDS))], ["doc_id", "print", "gone"])

    both = holders.unionByName(later).repartition(partitions(spark), "first", "task").sortWithinPartitions("first", "task", F.desc("holds"))
    found = both.mapInArrow(delete, "doc_id long, print long, gone array<int>")
    return found.select("doc_id", "print", F.explode("gone").alias("at")).groupBy("doc_id", "print").agg(F.collect_set("at").alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    @F.arrow_udf("string")
    def cut(column: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, at in zip(column.to_pylist(), places.to_pylist(), strict=True):
            if t is None or not at:
                out.append(t)
                continue
            lost = set(at)
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost))
        return pa.array(out, pa.string())

    return cut(text, gone)


def dedup_lines(docs: DataFrame, *, min_words: int = 5) -> DataFrame:
    """docs with the deleted lines gone from text, n_chars (if there) set to its length, and n_removed lines (long).

    Each block is kept in the least doc_id that has it. Lines are compared by their words, so white
    space at their ends doesn't matter. A block counts from min_words words; shorter ones and blank
    lines outside blocks stay. Null doc_id or text: the row stays as it is. Rows that repeat a doc_id
    lose nothing to each other. Empty table: no rows. Further columns stay, but for n_removed. A text's
    lines are worked on whole, in one task, in time that grows with their number, however they repeat.
    """
    gone = line_deletions(docs, min_words=min_words)
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct("*").alias("row")).withColumns({"doc_id": F.col("row.doc_id").cast("long"), "print": F.xxhash64(text)})
    joined = rows.join(gone, ["doc_id", "print"], "left")
    joined = joined.withColumn("left", _without(text, F.col("gone")))
    new = {"text": F.col("left")}
    columns = [new["text"].alias(c) if c == "text" else F.length(new["text"]).cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns if c != "n_removed"]
    return joined.select(*columns, F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, *, min_words: int = 5) -> DataFrame:
    """As dedup_lines, with the columns of docs alone, and without the documents of which no word is left by it."""
    out = dedup_lines(docs, min_words=min_words)
    return out.where((F.col("n_removed") == 0) | F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")).select(*(f"`{c}`" for c in docs.columns))
