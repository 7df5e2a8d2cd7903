"""Compression of vectors to codes of codebook entries, the nearest entries found by annular norm pruning.

A codebook keeps its entries in the order of their norms. By the triangle inequality an entry at a distance of
at most r has a norm within r of the vector's own. Entries are compared from the nearest in norm outwards, exactly and in
integers. Binary search gives the interval of norms that the best distance so far allows, ends included; what lies
outside of this annulus is never compared.

Codebooks are of fixed size. They are trained on all vectors: each task sums up its vectors by entry, and
the driver gets the sums of these, as large as the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, merged_counts
from .words import ranges

#: Components are limited to this size, so that squared distances are exact in 64 bits.
LIMIT = 1 << 24
#: Components of pairs worked on at once.
_WORK = 1 << 20


class Annuli:
    """One codebook, its entries in the order of their norms."""

    def __init__(self, entries: np.ndarray):
        norms = _norms(entries)
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the index of its nearest entry, the lower one of a tie, and its squared distance."""
        index, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        step = max(1, _WORK // max(1, self.entries.size))
        for lo in range(0, len(x), step):
            index[lo : lo + step], least[lo : lo + step] = self._nearest(x[lo : lo + step])
        return index, least

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _norms(x)
        near = np.searchsorted(self.norms, own)
        index, best = np.full(len(x), len(self.order)), np.full(len(x), np.iinfo(np.int64).max)
        low, high, live, step = near.copy(), near.copy(), np.arange(len(x)), 4
        while len(live):  # compared so far: low to high; the annulus narrows as the best distance falls
            reach = np.sqrt(best[live].astype(float))
            slack = (own[live] + reach) * 2.0**-48  # more than norms and roots can be off by rounding
            first = np.searchsorted(self.norms, own[live] - reach - slack, "left")
            end = np.searchsorted(self.norms, own[live] + reach + slack, "right")
            down, up = np.maximum(np.maximum(low[live] - step, first), 0), np.minimum(high[live] + step, end)
            count = np.stack([np.maximum(low[live] - down, 0), np.maximum(up - high[live], 0)], axis=1)
            some = count.sum(axis=1) > 0
            live, down, count = live[some], down[some], count[some]
            if len(live):
                begin = np.stack([np.minimum(down, low[live]), high[live]], axis=1)
                self._compare(x, live, begin, count, index, best)
                low[live] -= count[:, 0]
                high[live] += count[:, 1]
            step *= 2
        return index, best

    def _compare(self, x: np.ndarray, live: np.ndarray, begin: np.ndarray, count: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        """Rows `live` against two runs of entries each; what is nearer, or as near and of a lower index, is noted."""
        each = count.sum(axis=1)
        row, at = np.repeat(live, each), np.repeat(begin.ravel(), count.ravel()) + ranges(count.ravel())
        distance, starts = self._distance(x[row], at), np.cumsum(each) - each
        least = np.minimum.reduceat(distance, starts)
        lowest = np.minimum.reduceat(np.where(distance == np.repeat(least, each), self.order[at], len(self.order)), starts)
        index[live] = np.where(least < best[live], lowest, np.where(least == best[live], np.minimum(lowest, index[live]), index[live]))
        best[live] = np.minimum(best[live], least)
        self.compared += len(row)

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((x - self.entries[at]) ** 2).sum(axis=1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1).astype(float))


class Codebooks:
    """Entries of each part, as an array of parts, entries and components."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part: its slice of the rows, their nearest entries and squared distances."""
        width = self.entries.shape[2]
        for p, entries in enumerate(self.entries):
            own = x[:, p * width : (p + 1) * width]
            yield own, *Annuli(entries).nearest(own)


def _rows(column: pa.Array, width: int, step: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of vectors (their first row, integers), the shorter ones with zeros at their end."""
    for lo in range(0, len(column), step):
        part = column.slice(lo, step)
        size = np.diff(part.offsets.to_numpy())
        out = np.zeros((len(part), width), np.int64)
        out[np.repeat(np.arange(len(part)), size), ranges(size)] = part.flatten().to_numpy()
        yield lo, out


def _integers(vector: Column) -> Column:
    most = F.lit(float(LIMIT))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * 256.0, most), -most)).cast("int"))


def _round(kept: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the mean, rounded down, of the parts next to it."""
    parts, k, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, width + 1), np.int64)
        for b in batches:
            for _, x in _rows(b.column("vector"), parts * width):
                for p, (own, index, _) in enumerate(books.assign(x)):
                    np.add.at(sums[p], index, np.concatenate([own, np.ones((len(own), 1), np.int64)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums], pa.binary())], ["part", "counts"])

    sums = np.stack(merged_counts(kept.select("vector").mapInArrow(add, "part int, counts binary"), [k * (width + 1)] * parts)).reshape(parts, k, width + 1)
    count = sums[:, :, width:]
    return Codebooks(np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books.entries))


def train(kept: DataFrame, *, parts: int, entries: int, rounds: int) -> Codebooks | None:
    """Codebooks of the table (vec_id, vector of integers); None without rows."""
    first = [r["vector"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    if not first:
        return None
    width = -(-kept.agg(F.max(F.size("vector"))).first()[0] // parts)
    start = np.zeros((len(first), parts * width), np.int64)
    for i, v in enumerate(first):
        start[i, : len(v)] = v
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _round(kept, books)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """Of each row of (vec_id, vector, label): vec_id, code, error and label."""
    parts, _, width = books.entries.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, x in _rows(b.column("vector"), parts * width):
                found = list(books.assign(x))
                codes = np.stack([i for _, i, _ in found], axis=1).astype(np.uint8)
                error = np.sum([d for _, _, d in found], axis=0)
                ids, labels = (b.column(c).slice(lo, len(x)) for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64()), labels], ["vec_id", "code", "error", "label"])

    out = T.StructType([kept.schema["vec_id"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), kept.schema["label"]])
    return kept.select("vec_id", "vector", "label").mapInArrow(code, out)


def vector_codes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Of each kept row vec_id, code, error, label_error and codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component go. A component x becomes floor(256 * x),
    limited to 2**24 either way. A vector is cut into equal parts; one that is shorter than the longest, or whose
    length is no multiple of parts, counts as if zeros followed. A part's codebook begins as that part of the rows with
    the least vec_id (of rows that repeat one, the lesser vector; null ids last) and is replaced in each round by
    the means, rounded down, of the parts next to each entry. Then every part is coded as its nearest entry, two
    hexadecimal digits each; error is the sum of their squared distances, label_error the sum of that over all
    rows of an equal label, null labels being equal.

    Fewer rows than entries make smaller codebooks; no kept rows give none. Further columns are ignored. The
    driver gets the first rows and, in each round, sums as large as the codebooks.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits: at most 256 entries")
    of = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = materialize(of.where(F.col("vector").isNotNull() & finite).withColumn("vector", _integers(F.col("vector"))), "vector-integers")
    books = train(kept, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialize(encode(kept, books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long")
    by_label = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of_label")
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["of_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
