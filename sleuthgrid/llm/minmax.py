"""Near duplicates by min-max hashing.

A permutation of the hashes gives two values of a signature, the least and the greatest of a set's shingles
under it, so half as many permutations are worked out. Each of the two agrees for two sets with the probability of
their similarity, and that both disagree is rarer than for separate permutations, so the estimate is unbiased and of lower variance.

Bands of ROWS values each are hashed, and sets that share a band are candidates. The number of bands is such that a
pair at the threshold shares none with a probability below MISS. Candidates are linked in two steps:

1. Blocks. Each document goes, once and with its text, to the document with which it shares most bands. There, links are
   verified on the whole sets from one centre of a band after the other; documents that links already join are compared no more.
2. Bands that still hold several components. Their documents are compared in cells of a bounded number of rows, each
   pair in the first band that it shares. A bitmap of each set, of BITS bits, bounds the overlap: a bit that one of two
   documents has alone is a shingle that the other lacks. Pairs that the bound lets pass are verified on their texts.

A band holds a document once, so a group of copies makes up at most one row in as many as there are bands in any task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngram_join import PAIRS, SET, block_links, by_sets, cells, label, link_found, may_link, one_id, verified
from .shared import materialize, partitions, texts
from .words import mix, ranges, words_of

#: Values in a band, the probability that a pair at the threshold shares no band, and bits of a set's bitmap.
ROWS, MISS, BITS = 4, 1e-9, 2048
#: Documents of a band with which a block compares the others; what these don't link is left to the second step.
CENTRES = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


class MinMax:
    """Signatures of at least enough values for the bands of a threshold."""

    def __init__(self, per_cent: int, seed: int = 1):
        t = max(per_cent, 1) / 100
        self.bands = 2 * math.ceil(math.log(MISS) / math.log(max(1 - t**ROWS, 1e-12)) / 2)
        self.values = self.bands * ROWS
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 63, self.values // 2, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, self.values // 2, np.uint64) * np.uint64(2)
        # a pair at the threshold agrees in fewer values with a probability of at most exp(-values * divergence); blocks don't try such pairs
        self.agree = max((c for c in range(math.ceil(t * self.values)) if self.values * _divergence(c / self.values, t) >= -math.log(MISS)), default=0)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The minima under all permutations, then the maxima; leading 32 bits of each."""
        low, high = np.full(len(self.factor), np.iinfo(np.uint64).max), np.zeros(len(self.factor), np.uint64)
        for lo in range(0, len(shingles), 1024):
            moved = shingles[lo : lo + 1024, None] * self.factor + self.shift
            np.minimum(low, moved.min(axis=0), out=low)
            np.maximum(high, moved.max(axis=0), out=high)
        return (np.concatenate([low, high]) >> np.uint64(32)).astype(np.uint32)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Of each row of signatures a hash of each band."""
        own = signatures.reshape(len(signatures), self.bands, ROWS).astype(np.uint64)
        out = np.tile(mix(np.arange(self.bands, dtype=np.uint64) + np.uint64(1)), (len(own), 1))
        for r in range(ROWS):
            out = mix(out * _STEP + own[:, :, r])
        return out

    def found(self, sets: list[np.ndarray], comp: np.ndarray, per_cent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, values that agree): of each band one document of each component with the others of the band."""
        size = np.array([len(s) for s in sets])
        signatures = np.stack([self.signature(s) for s in sets])
        keys = self.keys(signatures)
        for band in range(self.bands):
            key = np.unique(keys[:, band], return_inverse=True)[1]
            tried = np.zeros(len(sets), bool)
            for _ in range(CENTRES):
                # of each group with several components the first document whose component was no centre yet
                order = np.flatnonzero(~tried)
                order = order[np.argsort(key[order], kind="stable")]
                first = order[np.flatnonzero(np.diff(key[order], prepend=-1))]
                centre = np.full(int(key.max()) + 1, -1)
                centre[key[first]] = first
                i = np.flatnonzero(centre[key] >= 0)
                j = centre[key[i]]
                own = comp[i] == comp[j]
                tried[i[own]] = True
                i, j = i[~own], j[~own]
                if not len(i):
                    break
                ok = 100 * np.minimum(size[i], size[j]) >= per_cent * np.maximum(size[i], size[j])
                agree = (signatures[i] == signatures[j]).sum(axis=1)
                ok &= agree >= self.agree
                yield i[ok], j[ok], agree[ok]
                tried[i[comp[i] == comp[j]]] = True


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(shingles >> np.uint64(20)).astype(np.int64) % BITS] = True
    return np.packbits(bits).tobytes()


def most_overlap(p_bits: np.ndarray, p_size: np.ndarray, q_bits: np.ndarray, q_size: np.ndarray) -> np.ndarray:
    """Bounds of the overlap of sets, by bitmaps in 64-bit words: what one has alone isn't shared."""
    alone = lambda a, b: np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
    return np.minimum(p_size - alone(p_bits, q_bits), q_size - alone(q_bits, p_bits))


def _divergence(x: float, t: float) -> float:
    term = lambda p, q: p * math.log(p / q) if p else 0.0
    return term(x, t) + (term(1 - x, 1 - t) if t < 1 else math.inf if x < 1 else 0.0)


def _signed(docs: DataFrame, k: int, lower: bool, hashing: MinMax) -> DataFrame:
    """Of each row doc_id, n and two fingerprints of its set, its signature and bitmap; null without a set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in words_of(b.column("text"), lower):
                sets = list(w.sets(k))
                one = pa.array([int(mix(s).sum()) for s in sets], pa.uint64()).view(pa.int64())
                two = pa.array([int(np.bitwise_xor.reduce(mix(s + np.uint64(1)))) if len(s) else 0 for s in sets], pa.uint64()).view(pa.int64())
                signatures = pa.array([hashing.signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
                bits = pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), one, two, signatures, bits], ["doc_id", *SET, "signature", "bits"])

    return docs.mapInArrow(sign, "doc_id long, n long, one long, two long, signature binary, bits binary")


def _matrix(column: pa.Array, values: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, values)


def _banded(signed: DataFrame, hashing: MinMax) -> DataFrame:
    """(doc_id, n, keys): a hash of each band."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                keys = hashing.keys(_matrix(b.column("signature"), hashing.values)).view(np.int64)
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * hashing.bands)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["doc_id", "n", "keys"])

    return signed.select("doc_id", "n", "signature").mapInArrow(band, "doc_id long, n long, keys array<long>")


def _band_pairs(labelled: DataFrame, signed: DataFrame, hashing: MinMax, per_cent: int) -> DataFrame:
    """The pairs (a, b), a > b, of different components that share a band and may link. labelled: (token, doc_id, comp)."""
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("token", "n")
    mixed = materialize(mixed, "minmax-mixed")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = hashing.keys(_matrix(b.column("signature"), hashing.values)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), b.column("bits"), pa.array([k.tobytes() for k in keys], pa.binary())], ["doc_id", "size", "bits", "keys"])

    short = signed.select("doc_id", "n", "bits", "signature").mapInArrow(shorten, "doc_id long, size long, bits binary, keys binary")
    rows = labelled.join(mixed.select("token"), "token", "left_semi").join(short, "doc_id").select("token", "doc_id", "comp", "size", "bits", "keys")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, doc, comp, size, token, bits, keys in _whole_cells(batches):
            after = np.searchsorted(cell, cell, "right") - np.arange(len(cell)) - 1
            done = np.cumsum(after)
            lo = 0
            while lo < len(cell):
                hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
                i = np.repeat(np.arange(lo, hi), after[lo:hi])
                j = i + 1 + ranges(after[lo:hi])
                lo = hi
                ok = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= per_cent * np.maximum(size[i], size[j]))
                i, j = i[ok], j[ok]
                for s in range(0, len(i), PAIRS):
                    p, q = i[s : s + PAIRS], j[s : s + PAIRS]
                    ok = may_link(most_overlap(bits[p], size[p], bits[q], size[q]), size[p], size[q], per_cent)
                    p, q = p[ok], q[ok]
                    ok = keys[p, (keys[p] == keys[q]).argmax(axis=1)] == token[p]  # this is the first band that they share
                    a, b = doc[p[ok]], doc[q[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    dealt = cells(rows, mixed).repartition(partitions(labelled.sparkSession), "token", "u", "v").sortWithinPartitions("token", "u", "v")
    return dealt.mapInArrow(search, "a long, b long").where("a <> b").distinct()


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the cell, doc_id, comp, size, token, bits, keys) of runs of sorted rows that end where a cell ends; of tokens and keys 32 bits."""
    held: list[tuple[np.ndarray, ...]] = []
    number, rows, last = 0, 0, None
    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            b = whole.slice(lo, 4096)
            at = np.stack([b.column(c).to_numpy() for c in ("token", "u", "v")], axis=1)
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]).any(axis=1)
            new[0] = last is None or bool((at[0] != last).any())
            last = at[-1]
            cell = number + np.cumsum(new)
            number = int(cell[-1])
            bits, keys = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(len(at), -1) for c, kind in (("bits", "<u8"), ("keys", "<u4")))
            held.append((cell, *(b.column(c).to_numpy() for c in ("doc_id", "comp", "size")), at[:, 0].astype(np.uint32), bits, keys))
            rows += len(at)
            if rows >= 8192 and new.any():
                joined = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(joined[0], number))
                if cut:
                    yield tuple(x[:cut] for x in joined)
                    held, rows = [tuple(x[cut:] for x in joined)], len(joined[0]) - cut
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def near_duplicates(docs: DataFrame, *, k: int = 5, per_cent: int = 80, lower: bool = True, seed: int = 1) -> DataFrame:
    """Of each row doc_id, n_shingles (size of its set of k-word shingles), component_id and kept.

    Documents link when 100 * intersection >= per_cent * union of their sets, confirmed on the full sets;
    component_id is the least doc_id that links reach, itself included, and kept says whether that is the row's own. A
    text of fewer than k words is one shingle; a null, empty or blank one has none and links with nothing. lower:
    A-Z are lower-cased. Equal sets are always linked; two that differ and reach the threshold are missed with a
    probability of some 1e-8 (no shared band, or an equal 32-bit key in an earlier one) unless others link them.

    Rows that repeat a doc_id are one document, linked by any of its texts. A null doc_id links with nothing, its
    component_id is null and the row is kept. Further columns are ignored; an empty table gives no rows. A text is worked on whole, in
    one task. Nothing of the corpus but 4 MB of Bloom filter at most and sums of components reaches the driver.
    """
    docs = texts(docs)
    spark = docs.sparkSession
    hashing = MinMax(per_cent, seed)
    signed = materialize(_signed(docs, k, lower, hashing), "minmax-signed")
    rows = signed.select("doc_id", *SET)
    full = rows.where("n > 0 and doc_id is not null")
    least = materialize(full.groupBy(*SET).agg(F.min("doc_id").alias("rep")), "minmax-least")
    own = signed.where("n > 0").join(least.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    dealt = _banded(own, hashing).select(F.explode("keys").alias("token"), "doc_id").repartition(partitions(spark), "token")
    bands = dealt.groupBy("token").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    members = materialize(dealt.join(bands, "token"), "minmax-bands")
    near = members.where("doc_id != first").groupBy("doc_id", "first").agg(F.count("*").alias("shared"))
    best = near.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("first")).alias("first"))).alias("x")).where(F.col("x.shared") * 10 >= hashing.bands)
    best = best.select("doc_id", (-F.col("x.first")).alias("centre"))
    linked = block_links(best, docs, k, lower, lambda sets, comp: link_found(hashing.found(sets, comp, per_cent), sets, comp, per_cent))
    stars = components(linked.unionByName(one_id(full, least)))

    labelled = materialize(label(members.select("token", "doc_id"), stars), "minmax-labelled")
    pairs = materialize(_band_pairs(labelled, own, hashing, per_cent), "minmax-pairs")
    out = by_sets(rows, least, stars, verified(pairs, docs, k, lower, per_cent))
    return out.withColumn("kept", F.expr("coalesce(doc_id = component_id, true)"))


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, that near_duplicates keeps; rows that repeat a doc_id stay or go together."""
    copies = near_duplicates(docs, k=k, per_cent=per_cent).where("not kept").select("doc_id").distinct()
    return docs.join(copies, docs["doc_id"].cast("long") == copies["doc_id"], "left_anti")
