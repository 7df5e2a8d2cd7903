"""N-gram Jaccard join by an R-tree over count vectors.

A document's set is its distinct word shingles. The shingles are hashed into GROUPS groups, and the
numbers in each group make the document a point. The coordinate minima of two points sum up to at
least the overlap of their sets, and those of a point and the upper corner of a tree node bound its
overlap with all points in the node. Pairs that the bound lets pass are verified on their whole sets.

One tree over all documents can't be dealt to tasks, so trees are built in two steps:

1. Tiles. Each document is in the tile of each of its first (1 - threshold) * size + 1 shingles in a
   fixed order, rare ones first; two sets that reach the threshold share such a shingle. Order is
   by a count sketch of fixed size over all shingles; any order gives the same links.
2. Blocks. A document that shares a quarter of these shingles with the least document of their tiles goes,
   once and with its text, to the block of that document with which it shares most. A block has a tree of its own; links are verified there as they
   are found, and documents that links already join are compared no more, so a group of near copies
   costs about as many comparisons as it has documents. Large blocks are dealt to many tasks by a
   hash; some documents of the block, its centre among them, go to all of these.

Trees over the tiles then find what blocks can't see. They search tiles that still hold several components,
skip nodes within the document's own component, and the pairs they leave are verified on the texts.
Tiles of more than TILE rows are dealt as pairs of cells, so that none has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import materialize, merged_counts, partitions, texts
from .words import mix, words_of

GROUPS = 256
#: A point's bytes: a count for each group, at most 255, and what is over these in all groups.
WIDTH = GROUPS + 4
_SLOTS, _PART = 1 << 20, 1 << 15
#: The most bits of a filter of ids: 4 MB.
FILTER_BITS = 1 << 25
#: Points in a leaf and children of a node.
FANOUT = 16
#: Tiles up to this size are one leaf: their pairs are bounded directly.
LEAF_TILE = 32
#: Pairs whose bound is worked out at once, documents to a block's task, bytes of sets in a tree of it, rows of a tile to a task.
PAIRS, BLOCK, TREE_BYTES, TILE = 1 << 15, 2048, 24 << 20, 8192
#: Documents of a large block that go to all of its tasks.
ANCHORS = 32
#: A set's size and two fingerprints stand for it.
SET = ["n", "one", "two"]


def point_of(shingles: np.ndarray) -> bytes:
    """The counts of a set's shingles by group."""
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + int(np.maximum(counts - 255, 0).sum()).to_bytes(4, "little")


class Points:
    """Count vectors as an array of bytes, and their counts over 255."""

    def __init__(self, counts: np.ndarray, over: np.ndarray):
        self.counts, self.over = counts, over

    @classmethod
    def of(cls, packed: list[bytes]) -> Points:
        rows = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, WIDTH)
        return cls(np.ascontiguousarray(rows[:, :GROUPS]), np.ascontiguousarray(rows[:, GROUPS:]).view("<u4").ravel().astype(np.int64))

    def __len__(self) -> int:
        return len(self.over)

    def take(self, at: np.ndarray | slice) -> Points:
        return Points(self.counts[at], self.over[at])


def overlap_bound(p: Points, i: np.ndarray, q: Points, j: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of the points p[i] and q[j]; minima of counts over 255 are bounded by those of their sums."""
    eight = np.minimum(p.counts[i], q.counts[j]).view("<u8")
    low = np.uint64(0x00FF00FF00FF00FF)
    lanes = ((eight & low) + ((eight >> np.uint64(8)) & low)).sum(axis=1)  # four sums of 16 bits: 64 bytes of 255 at most
    total = sum((lanes >> np.uint64(s)) & np.uint64(0xFFFF) for s in (0, 16, 32, 48)).astype(np.int64)
    return total + np.minimum(p.over[i], q.over[j])


class CountRTree:
    """R-tree over points in the order of their size; packed bottom-up, FANOUT to a node.

    `component` may change while pairs are sought; nodes keep the components from when the tree was built.
    """

    def __init__(self, points: Points, size: np.ndarray, component: np.ndarray):
        self.points, self.size, self.component = points, size, component
        self.levels: list[tuple[Points, np.ndarray, np.ndarray]] = []
        top, least, comp = points, size, component
        while len(top) > FANOUT or not self.levels:
            starts = np.arange(0, len(top), FANOUT)
            one = np.minimum.reduceat(comp, starts)
            one = np.where(one == np.maximum.reduceat(comp, starts), one, -1)  # -1: several components
            top = Points(np.maximum.reduceat(top.counts, starts), np.maximum.reduceat(top.over, starts))
            least, comp = np.minimum.reduceat(least, starts), one
            self.levels.append((top, least, comp))

    def pairs(self, per_cent: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, bound), i < j, of different components that may reach the threshold, at most PAIRS at a time."""
        top = len(self.levels[-1][0])
        for lo in range(0, len(self.points), rows):
            own = np.arange(lo, min(lo + rows, len(self.points)))
            yield from self._below(np.repeat(own, top), np.tile(np.arange(top), len(own)), len(self.levels), per_cent)

    def _below(self, i: np.ndarray, node: np.ndarray, height: int, per_cent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        corner, least, comp = self.levels[height - 1] if height else (self.points, self.size, self.component)
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS], node[s : s + PAIRS]
            after = (b + 1) * FANOUT**height > a + 1 if height else b > a
            ok = after & (comp[b] != self.component[a]) & (100 * self.size[a] >= per_cent * least[b])
            a, b = a[ok], b[ok]
            bound = overlap_bound(self.points, a, corner, b)
            # a larger partner raises the overlap that is needed, so the node's least size bounds it
            ok = may_link(bound, self.size[a], np.maximum(least[b], self.size[a]), per_cent)
            a, b, bound = a[ok], b[ok], bound[ok]
            if not height:
                if len(a):
                    yield a, b, bound
                continue
            below = len(self.levels[height - 2][0]) if height > 1 else len(self.points)
            children = (b[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            a = np.repeat(a, FANOUT)[children < below]
            yield from self._below(a, children[children < below], height - 1, per_cent)


def may_link(overlap: np.ndarray, p_size: np.ndarray, q_size: np.ndarray, per_cent: int) -> np.ndarray:
    """Whether an overlap reaches the threshold: 100 * overlap >= per_cent * union."""
    return (100 + per_cent) * overlap >= per_cent * (p_size + q_size)


def _all_pairs(points: Points, size: np.ndarray, comp: np.ndarray, per_cent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As CountRTree.pairs, for a few points."""
    i, j = np.triu_indices(len(size), 1)
    ok = (comp[i] != comp[j]) & (100 * size[i] >= per_cent * size[j])
    i, j = i[ok], j[ok]
    bound = overlap_bound(points, i, points, j)
    ok = may_link(bound, size[i], size[j], per_cent)
    if ok.any():
        yield i[ok], j[ok], bound[ok]


def _small_tiles(starts: np.ndarray, lengths: np.ndarray, points: Points, size: np.ndarray, comp: np.ndarray, per_cent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of tiles of up to LEAF_TILE rows; those of one length together."""
    for m in range(2, LEAF_TILE + 1):
        first = starts[lengths == m]
        a, b = np.triu_indices(m, 1)
        step = max(1, PAIRS // len(a))
        for s in range(0, len(first), step):
            i = (first[s : s + step, None] + a).ravel()
            j = (first[s : s + step, None] + b).ravel()
            ok = (comp[i] != comp[j]) & (100 * size[i] >= per_cent * size[j])
            i, j = i[ok], j[ok]
            ok = may_link(overlap_bound(points, i, points, j), size[i], size[j], per_cent)
            yield i[ok], j[ok]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers that two sorted arrays of distinct ones share."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def link(sets: list[np.ndarray], points: Points, comp: np.ndarray, per_cent: int) -> np.ndarray:
    """The component of each document of a block, in the order of their sizes; comp: those already known."""
    size = np.array([len(s) for s in sets])
    if len(sets) <= LEAF_TILE:
        found = _all_pairs(points, size, comp, per_cent)
    else:
        found = CountRTree(points, size, comp).pairs(per_cent)
    return link_found(found, sets, comp, per_cent)


def link_found(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], sets: list[np.ndarray], comp: np.ndarray, per_cent: int) -> np.ndarray:
    """comp after verifying the pairs (i, j, how likely) that are found, those of one component left out. comp changes while they are sought."""
    size = np.array([len(s) for s in sets])
    for i, j, bound in found:
        first = True
        while True:
            live = comp[i] != comp[j]
            i, j, bound = i[live], j[live], bound[live]
            if not len(i):
                break
            # the likeliest partner of each document first, after that the likeliest pair of each two components
            key = i if first else np.minimum(comp[i], comp[j]) * len(comp) + np.maximum(comp[i], comp[j])
            order = np.lexsort((-bound, key))
            tried = order[np.flatnonzero(np.diff(key[order], prepend=-1))]
            for x in tried.tolist():
                a, b = int(i[x]), int(j[x])
                if comp[a] != comp[b] and may_link(_common(sets[a], sets[b]), size[a], size[b], per_cent):
                    low, high = sorted((comp[a], comp[b]))
                    comp[comp == high] = low
            i, j, bound = np.delete(i, tried), np.delete(j, tried), np.delete(bound, tried)
            first = False
    return comp


def _summaries(docs: DataFrame, k: int, lower: bool) -> DataFrame:
    """Of each row doc_id, n and two fingerprints of its set; and, with slot, counts of shingles by hash slot."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SLOTS, np.int64)
        for b in batches:
            n, one, two = [], [], []
            for _, _, w in words_of(b.column("text"), lower):
                for s in w.sets(k):
                    n.append(len(s))
                    one.append(int(mix(s).sum()))
                    two.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(1)))) if len(s) else 0)
                    counts[(s & np.uint64(_SLOTS - 1)).astype(np.int64)] += 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.uint64()).view(pa.int64()), pa.array(two, pa.uint64()).view(pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        parts = counts.reshape(-1, _PART)
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names)

    names = ["doc_id", "n", "one", "two", "slot", "counts"]
    return docs.mapInArrow(summarize, "doc_id long, n long, one long, two long, slot int, counts binary")


def _classes(summaries: DataFrame) -> np.ndarray:
    """The binary logarithm of each slot's count: of fixed size, whatever the corpus."""
    parts = merged_counts(summaries.where("slot is not null").select(F.col("slot").alias("part"), "counts"), [_PART] * (_SLOTS // _PART))
    return np.ceil(np.log2(np.maximum(np.concatenate(parts), 1))).astype(np.uint8)


def _signatures(docs: DataFrame, classes: np.ndarray, k: int, lower: bool, per_cent: int) -> DataFrame:
    """Of each document its point and the shingles whose tiles it is in."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, tokens, points = [], [], []
            for _, _, w in words_of(b.column("text"), lower):
                for s in w.sets(k):
                    n.append(len(s))
                    points.append(point_of(s))
                    count = len(s) - (per_cent * len(s) + 99) // 100 + 1 if len(s) else 0
                    order = np.argsort(classes[(s & np.uint64(_SLOTS - 1)).astype(np.int64)], kind="stable")  # s is sorted: ties by hash
                    tokens.append(s[order[:count]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(points, pa.binary())], ["doc_id", "n", "tokens", "point"])

    return docs.mapInArrow(sign, "doc_id long, n long, tokens array<long>, point binary").where("doc_id is not null and n > 0")


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id may be among ids (written, column id), by a Bloom filter: so that a join with ids sends few other texts.

    The filter has some eight bits for an id, up to FILTER_BITS; beyond that more and more texts go to the join, each once. Its
    pieces are joined to the rows, so no task needs a Python worker for it, and plans, of which the driver keeps many, don't hold it.
    """
    bits = min(FILTER_BITS, 1 << max(15, (8 * ids.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    parts = ids.select((slot("id") + 1).alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("_bits"))
    rows = docs.where("doc_id is not null").withColumn("_slot", slot("doc_id") + 1).withColumn("_bucket", F.expr("bitmap_bucket_number(_slot)"))
    at = F.expr("bitmap_bit_position(_slot)")
    byte = F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
    taken = F.bit_get(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1
    return rows.join(F.broadcast(parts), "_bucket").where(taken).select(*docs.columns)  # as large as the filter, at most 4 MB


def _centres(members: DataFrame, per_cent: int) -> DataFrame:
    """(doc_id, centre): the least document of the tiles with which each shares most. members: (token, doc_id, n, first)."""
    near = members.where("doc_id != first").groupBy("doc_id", "first").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
    best = near.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("first")).alias("first"), "n")).alias("x")).select("doc_id", "x.shared", "x.n", (-F.col("x.first")).alias("centre"))
    # texts of documents that share little more than chance words needn't be sent; tiles find what links these have
    return best.where(f"4 * shared >= n - ({per_cent} * n + 99) div 100 + 1").select("doc_id", "centre")


def block_links(best: DataFrame, docs: DataFrame, k: int, lower: bool, linked: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> DataFrame:
    """Links (a, b) found in blocks: each document with one of its block's component. best: (doc_id, centre).

    linked: the components of sets in the order of their sizes, given those already known.
    """
    spark = docs.sparkSession
    best = materialize(best, "block-best")
    sizes = best.groupBy("centre").agg(F.count("*").alias("n"))
    tasks = F.expr(f"cast(ceil(n / {BLOCK}) as int)")
    every = F.expr("sequence(0, tasks - 1)")
    h = F.xxhash64("doc_id")
    own = best.join(sizes.where(f"n > {BLOCK}").select("centre", "n", tasks.alias("tasks")), "centre", "left")
    some = F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), "n") < ANCHORS, every).otherwise(F.array(F.pmod(h, "tasks").cast("int")))
    dealt = own.select("centre", "doc_id", F.explode(F.when(F.col("tasks").isNull(), F.array(F.lit(0))).otherwise(some)).alias("task"))
    centres = sizes.select("centre", F.col("centre").alias("doc_id"), F.explode(F.expr(f"sequence(0, cast(ceil(n / {BLOCK}) as int) - 1)")).alias("task"))
    rows = dealt.unionByName(centres).join(_wanted(docs, best.select(F.explode(F.array("doc_id", "centre")).alias("id"))), "doc_id").select("centre", "task", "doc_id", "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        key, size = None, 0

        def settle() -> tuple[list[int], list[int]]:
            held.sort(key=lambda x: len(x[1]))
            ids = np.array([d for d, _ in held])
            comp = np.unique(ids, return_inverse=True)[1]  # rows of one doc_id are one document
            comp = linked([s for _, s in held], comp)
            order = np.lexsort((ids, comp))
            new = np.diff(comp[order], prepend=-1) != 0
            least = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
            return ids[order][~new].tolist(), least[~new].tolist()

        def out(pairs: tuple[list[int], list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])

        for b in batches:
            keys = list(zip(b.column("centre").to_pylist(), b.column("task").to_pylist(), strict=True))
            ids = b.column("doc_id").to_pylist()
            for lo, hi, w in words_of(b.column("text"), lower):
                for i, s in zip(range(lo, hi), w.sets(k), strict=True):
                    if held and (keys[i] != key or size > TREE_BYTES):
                        if len(held) > 1:
                            yield out(settle())
                        held[:] = held[:: max(1, len(held) // ANCHORS)] if keys[i] == key else []
                        size = sum(x.nbytes for _, x in held)
                    key = keys[i]
                    if len(s):
                        held.append((ids[i], s))
                        size += s.nbytes + WIDTH
        if len(held) > 1:
            yield out(settle())

    return rows.repartition(partitions(spark), "centre", "task").sortWithinPartitions("centre", "task").mapInArrow(search, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, lower: bool, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, from their whole texts."""
    need = _wanted(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
    both = pairs.join(need.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    both = both.repartition(partitions(docs.sparkSession), "b")  # a number that adaptive execution keeps: few tasks would hold many texts each
    both = both.join(need.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b").select("a", "b", "a_text", "b_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                column = part.column("b_text").dictionary_encode()  # one document comes again and again
                known = [s for _, _, w in words_of(column.dictionary, lower) for s in w.sets(k)]
                own = (s for _, _, w in words_of(part.column("a_text"), lower) for s in w.sets(k))
                ok = []
                for s, c in zip(own, column.indices.to_pylist(), strict=True):
                    other = known[c] if c is not None else s[:0]
                    ok.append(len(s) > 0 and len(other) > 0 and bool(may_link(_common(s, other), len(s), len(other), per_cent)))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long")


def cells(tiled: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of tiles with the columns u and v: tasks that together see each two rows of a tile of different components.

    A tile of up to TILE rows is one task. The rows of a larger one are dealt to cells: those of a
    component with many rows to cells of its own, by a hash of the document, the others by a hash of the
    component. Each two cells but those of one component are a task.
    """
    small = tiled.join(sizes.where(f"n <= {TILE}").select("token"), "token", "left_semi").select("*", F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"))
    large = sizes.where(f"n > {TILE}").select("token")
    rows = tiled.join(large, "token", "left_semi")
    counts = rows.groupBy("token", "comp").agg(F.count("*").alias("own"))
    whole = counts.where(f"own >= {TILE} div 4").select("token", F.col("comp").alias("whole"), "own")
    rest = counts.where(f"own < {TILE} div 4").groupBy("token").agg(F.sum("own").alias("rest"))
    marked = rows.join(whole.withColumnRenamed("whole", "comp"), ["token", "comp"], "left").join(rest, "token", "left")
    place = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.expr(f"own div {TILE} + 1"))).otherwise(F.pmod(F.xxhash64("comp"), F.expr(f"rest div {TILE} + 1")))
    marked = marked.withColumn("kind", F.when(F.col("own").isNotNull(), F.col("comp"))).withColumn("cell", F.xxhash64("kind", place))
    each = marked.select("token", "kind", "cell").distinct()
    left, right = (each.select("token", F.col("kind").alias(f"{s}_kind"), F.col("cell").alias(s)) for s in "uv")
    tasks = left.join(right, "token").where("u <= v and (u_kind is null or v_kind is null or u_kind <> v_kind)").select("token", "u", "v")
    sides = tasks.select("token", "u", "v", F.explode(F.array_distinct(F.array("u", "v"))).alias("cell"))
    return small.unionByName(marked.join(sides, ["token", "cell"]).select(*tiled.columns, "u", "v"))


def _tile_pairs(labelled: DataFrame, points: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b), a > b, of different components that tiles find and the bound lets pass. labelled: (token, doc_id, comp, n).

    A row whose neighbours by size in the tile are too small and too large for the threshold has no partner there, so its point isn't sent.
    """
    spark = labelled.sparkSession
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("token", "n")
    mixed = materialize(mixed, "ngram-mixed")
    rows = labelled.join(mixed.select("token", F.col("n").alias("rows")), "token")
    by = Window.partitionBy("token").orderBy("n", "doc_id")
    few = rows.where(f"rows <= {TILE}").select("*", F.lag("n").over(by).alias("below"), F.lead("n").over(by).alias("above"))
    few = few.where(f"100 * below >= {per_cent} * n or 100 * n >= {per_cent} * above").select("token", "doc_id", "comp")
    kept = few.unionByName(rows.where(f"rows > {TILE}").select("token", "doc_id", "comp"))
    tiled = kept.join(points, "doc_id").select("token", "doc_id", "comp", "n", "point")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, doc, comp, size, points in _whole_tiles(batches):
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            lengths = np.diff(np.append(starts, len(key)))
            for i, j in _small_tiles(starts, lengths, points, size, comp, per_cent):
                yield out(doc[i], doc[j])
            large = lengths > LEAF_TILE
            for s, n in zip(starts[large].tolist(), lengths[large].tolist(), strict=True):
                own = slice(s, s + n)
                if not (comp[own] == comp[s]).all():
                    for i, j, _ in CountRTree(points.take(own), size[own], comp[own]).pairs(per_cent):
                        yield out(doc[own][i], doc[own][j])

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    dealt = cells(tiled, mixed).repartition(partitions(spark), "token", "u", "v").sortWithinPartitions("token", "u", "v", "n", "doc_id")
    return dealt.mapInArrow(search, "a long, b long").where("a <> b").distinct()


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Points]]:
    """(number of the tile, doc_id, comp, n, points) of runs of rows sorted by token, u and v that end where a tile ends."""
    held: list[tuple] = []
    number, last, rows = 0, None, 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Points]:
        key, doc, comp, n = (np.concatenate([h[c] for h in held]) for c in range(4))
        return key, doc, comp, n, Points(np.concatenate([h[4].counts for h in held]), np.concatenate([h[4].over for h in held]))

    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            b = whole.slice(lo, 4096)
            at = np.stack([b.column(c).to_numpy() for c in ("token", "u", "v")])
            new = np.ones(b.num_rows, bool)
            new[1:] = (at[:, 1:] != at[:, :-1]).any(axis=0)
            new[0] = last is None or bool((at[:, 0] != last).any())
            last = at[:, -1]
            key = number + np.cumsum(new)
            number = int(key[-1])
            part = (key, *(b.column(c).to_numpy() for c in ("doc_id", "comp", "n")), Points.of(b.column("point").to_pylist()))
            cut = int(np.flatnonzero(new)[-1]) if new.any() else -1
            if rows >= 16_384 and cut >= 0:
                if cut:
                    held.append(tuple(x[:cut] for x in part[:4]) + (part[4].take(slice(0, cut)),))
                yield joined()
                held, rows = [tuple(x[cut:] for x in part[:4]) + (part[4].take(slice(cut, None)),)], b.num_rows - cut
            else:
                held.append(part)
                rows += b.num_rows
    if held:
        yield joined()


def jaccard_components(docs: DataFrame, *, k: int = 5, per_cent: int = 80, lower: bool = True) -> DataFrame:
    """Of each row doc_id, n_shingles (size of its set of k-word shingles) and component_id.

    Documents link when 100 * intersection >= per_cent * union of their sets; component_id is the
    least doc_id that links reach, itself included. A text of fewer than k words is one shingle; a
    null, empty or blank one has none and links with nothing. lower: A-Z are lower-cased.

    Rows that repeat a doc_id are one document, linked by any of its texts. A null doc_id links with
    nothing and its component_id is null. Further columns are ignored; an empty table gives no rows.
    A text is worked on whole, in one task. Fixed sizes on the driver: 8 MB of shingle counts, 4 MB of Bloom filter at most.
    """
    docs = texts(docs)
    spark = docs.sparkSession
    summaries = materialize(_summaries(docs, k, lower), "ngram-summaries")
    classes = _classes(summaries)
    rows = summaries.where("slot is null").select("doc_id", "n", "one", "two")
    full = rows.where("n > 0 and doc_id is not null")
    least = materialize(full.groupBy(*SET).agg(F.min("doc_id").alias("rep")), "ngram-least")

    signed = materialize(_signatures(docs, classes, k, lower, per_cent).join(least.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "ngram-signatures")
    points = signed.select("doc_id", "n", "point")
    dealt = signed.select(F.explode("tokens").alias("token"), "doc_id", F.col("n").cast("int").alias("n")).repartition(partitions(spark), "token")
    tiles = dealt.groupBy("token").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    members = materialize(dealt.join(tiles, "token"), "ngram-tiles")

    stars = components(block_links(_centres(members, per_cent), docs, k, lower, lambda sets, comp: link(sets, Points.of([point_of(s) for s in sets]), comp, per_cent)).unionByName(one_id(full, least)))
    labelled = materialize(label(members.select("token", "doc_id", "n"), stars), "ngram-labelled")
    pairs = materialize(_tile_pairs(labelled, points, per_cent), "ngram-pairs")
    return by_sets(rows, least, stars, verified(pairs, docs, k, lower, per_cent))


def one_id(full: DataFrame, least: DataFrame) -> DataFrame:
    """Links (a, b): the sets of one repeated doc_id belong together, so their least documents are linked by it."""
    several = full.groupBy("doc_id").agg(F.min("one").alias("lo"), F.max("one").alias("hi")).where("lo < hi").select("doc_id")
    reps = full.join(several, "doc_id", "left_semi").join(least, SET).select("doc_id", "rep").distinct()
    return reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")


def label(members: DataFrame, stars: DataFrame) -> DataFrame:
    """members with the component comp of their doc_id."""
    return members.join(stars.select(F.col("a").alias("doc_id"), F.col("b").alias("comp")), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def by_sets(rows: DataFrame, least: DataFrame, stars: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the rows (doc_id, n, one, two), by the least document of each set, components so far and further links."""
    of = lambda side: stars.select(F.col("a").alias(side), F.col("b").alias(f"{side}_comp"))
    joined = linked.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    merged = components(joined)
    final = least.join(stars.withColumnsRenamed({"a": "rep", "b": "star"}), "rep", "left").withColumn("star", F.coalesce("star", "rep"))
    final = final.join(merged.withColumnsRenamed({"a": "star", "b": "merged"}), "star", "left").select(*SET, F.coalesce("merged", "star").alias("component_id"))
    full = rows.where("n > 0 and doc_id is not null")
    found = full.join(final, SET, "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")  # a set that many rows share is split by adaptive execution
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def one_of_each(docs: DataFrame, *, k: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, whose document is the least of its component; as jaccard_components.

    A null doc_id links with nothing, so its rows stay; rows that repeat a doc_id stay or go together.
    """
    found = jaccard_components(docs, k=k, per_cent=per_cent)
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, docs["doc_id"].cast("long") == copies["doc_id"], "left_anti")
