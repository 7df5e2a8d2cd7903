"""Sharding by extendible hashing.

A document's 128 hash bits place it: 64 of its doc_id and, where these can't part a bucket, 64 of its
text. The directory is indexed by a prefix of the bits. Buckets over the byte limit, and only these,
split on further bits until every one fits. Each round counts bytes under STEP more bits of
the buckets that are still too large, as tables: the directory is never on the driver, which holds a
count for each of 4,096 ranges of it to number the shards.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Bits by which buckets are counted in a round, and of a hash.
STEP, BITS = 8, 64
#: Bits of the ranges in which shards are numbered, and rows that repeat as a whole to a task.
RANGE, COPIES = 12, 1 << 16


def place(doc_id: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), F.lit("shard"))


def _prefix(hash_: str, depth: int) -> Column:
    return F.shiftrightunsigned(hash_, BITS - depth) if depth else F.lit(0).cast("long")


def _buckets(children: list[tuple[int, int, int, int]], depth: int, limit: int) -> list[tuple[int, int, int, int, str]]:
    """Of the children of a bucket the buckets that they are in: (child, prefix, depth, bytes, kind).

    children: (prefix at depth + STEP bits, bytes, least hash, greatest hash). kind: `fits`, `one` (a single hash, so that no
    further bit parts it) or `split` (on more than STEP bits).
    """
    out = []
    todo = [(depth, children)]
    while todo:
        d, own = todo.pop()
        if not own:
            continue
        total = sum(c[1] for c in own)
        kind = "fits" if total <= limit else "one" if min(c[2] for c in own) == max(c[3] for c in own) else "split" if d == depth + STEP else None
        if kind:
            shift = depth + STEP - d
            out += [(c[0], c[0] >> shift, d, total, kind) for c in own]
            continue
        bit = depth + STEP - d - 1
        todo += [(d + 1, [c for c in own if c[0] >> bit & 1 == b]) for b in (0, 1)]
    return out


def _directory(rows: DataFrame, within: list[str], hash_: str, limit: int) -> list[tuple[int, DataFrame]]:
    """For each round the depth of its children, and of each child its bucket: within, child, prefix, depth, total, kind.

    rows: within, the hash and bytes. The buckets of one `within` are split apart from those of another.
    """
    out: list[tuple[int, DataFrame]] = []
    depth, wanted = 0, None
    kinds = [f"{c} long" for c in within]

    def split(table: pa.Table) -> pa.Table:
        unsigned = lambda x: x & (1 << BITS) - 1
        signed = lambda x: x - (1 << BITS) if x >> BITS - 1 else x
        own = table.to_pylist()
        found = _buckets([(unsigned(r["child"]), r["bytes"], r["lo"], r["hi"]) for r in own], depth, limit)
        columns = [[own[0][c]] * len(found) for c in within] + [[signed(f[0]) for f in found], [signed(f[1]) for f in found], *([f[k] for f in found] for k in (2, 3, 4))]
        types = [pa.int64()] * len(within) + [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*within, "child", "prefix", "depth", "total", "kind"])

    while depth < BITS:
        counts = rows.select(*within, _prefix(hash_, depth).alias("parent"), _prefix(hash_, depth + STEP).alias("child"), F.col(hash_).alias("h"), "bytes")
        if wanted is not None:
            counts = counts.join(wanted, [*within, "parent"], "left_semi")
        counts = counts.groupBy(*within, "parent", "child").agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        found = counts.groupBy(*within, "parent").applyInArrow(split, ", ".join([*kinds, "child long, prefix long, depth int, total long, kind string"]))
        found = materialize(found, "shard-directory")
        depth += STEP
        out.append((depth, found))
        wanted = found.where("kind = 'split'").select(*within, F.col("child").alias("parent"))
        if wanted.isEmpty():
            break
    return out


def _dealt(rows: DataFrame, directory: list[tuple[int, DataFrame]], within: list[str], hash_: str) -> DataFrame:
    """rows with prefix, depth, total and kind of their bucket."""
    out = None
    for depth, found in directory:
        own = found.where("kind <> 'split'") if depth < BITS else found
        part = rows.withColumn("child", _prefix(hash_, depth)).join(own, [*within, "child"]).drop("child")
        out = part if out is None else out.unionByName(part)
    return out


def _bits(prefix: str, depth: str) -> Column:
    return F.expr(f"lpad(bin({prefix}), {depth}, '0')")


def _assigned(rows: DataFrame, limit: int) -> DataFrame:
    """rows (place, second, bytes and further columns, of a written table) with shard_id, shard_bits, shard_bytes and page."""
    first = _directory(rows.select("place", "bytes"), [], "place", limit)
    dealt = _dealt(rows, first, [], "place")
    whole = materialize(dealt.where("kind = 'one'").drop("prefix", "depth", "total", "kind"), "shard-rows")  # one doc_id, over the limit
    fits = dealt.where("kind = 'fits'").select(*rows.columns, F.col("prefix").alias("p"), F.col("depth").alias("d"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("e"), F.col("total").alias("shard_bytes"), F.lit(False).alias("copies"))
    if not whole.isEmpty():
        second = _directory(whole.select("place", "second", "bytes"), ["place"], "second", limit)
        parted = _dealt(whole, second, ["place"], "second")
        fits = fits.unionByName(parted.select(*rows.columns, F.col("place").alias("p"), F.lit(BITS).alias("d"), F.col("prefix").alias("q"), F.col("depth").alias("e"), F.col("total").alias("shard_bytes"), (F.col("kind") != "fits").alias("copies")))
    key = ["p", "d", "q", "e"]
    start = lambda prefix, depth: F.expr(f"case when {depth} = 0 then 0 else shiftleft({prefix}, {BITS} - {depth}) end")
    leaves = fits.select(*key).distinct().select(*key, start("p", "d").alias("s"), start("q", "e").alias("t")).withColumn("range", F.shiftrightunsigned("s", BITS - RANGE))
    leaves = materialize(leaves, "shard-leaves")
    counts = {r["range"]: r["n"] for r in leaves.groupBy("range").agg(F.count("*").alias("n")).collect()}  # 4,096 at most
    before, offsets = 0, {}
    for r in sorted(counts):
        offsets[r], before = before, before + counts[r]
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << BITS - 1)))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(unsigned("s"), "d", unsigned("t"), "e")) - 1
    base = F.element_at(F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair)), F.col("range")) if offsets else F.lit(0)
    numbered = leaves.select(*key, (rank + base).cast("int").alias("shard_id"))
    out = fits.join(numbered, key).withColumn("shard_bits", F.concat(_bits("p", "d"), _bits("q", "e")))
    # rows that repeat are numbered in a written table: a task that runs again deals them to the same pages
    copies = materialize(out.where("copies").withColumn("number", F.monotonically_increasing_id()), "shard-copies")
    one_size = copies.groupBy("shard_id").agg(F.max("bytes").alias("most"), F.count("*").alias("n"))
    tasks = F.expr(f"n div {COPIES} + 1")
    paged = copies.join(one_size, "shard_id").withColumn("task", F.pmod(F.xxhash64("number"), tasks))
    number = F.row_number().over(Window.partitionBy("shard_id", "task").orderBy("bytes", "number")) - 1
    paged = paged.withColumn("page", F.floor(number / F.greatest(F.lit(1), F.expr(f"{limit} div greatest(most, 1)"))) * tasks + F.col("task"))
    result = [*rows.columns, "shard_id", "shard_bits", "shard_bytes"]
    return out.where("not copies").select(*result, F.lit(0).cast("long").alias("page")).unionByName(paged.select(*result, F.col("page").cast("long")))


def _placed(docs: DataFrame, *carry: Column) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return materialize(docs.select(*carry, size.alias("bytes"), place(F.col("doc_id")).alias("place"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit("text")).alias("second")), "shard-places")


def assign_shards(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, shard_id, shard_bits (the directory's prefix), bytes (of text), shard_bytes and page; a row for each of docs.

    shard_id numbers the buckets that have rows in the order of their prefixes. Rows that repeat a doc_id have one
    hash of it; if they are over the limit together, bits of their texts' hashes split them. Rows that repeat
    doc_id and text can't be split: if they are over the limit together, they are dealt to pages of their shard,
    each within the limit, numbered with gaps; `page` is 0 for all others. A text over the limit is a page of
    its own. So every shard is within the limit, or each of its pages is, but for single texts over it. Null doc_id: as a
    repeated id. Null or empty text: 0 bytes. An empty table gives no rows; further columns are ignored.
    """
    rows = _placed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return _assigned(rows, limit).select("doc_id", "shard_id", "shard_bits", "bytes", "shard_bytes", "page")


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """Write docs as Parquet, a folder shard_id=N/page=M for each shard and page; as assign_shards. Each row is written once, whatever repeats."""
    rows = _assigned(_placed(docs, F.struct("*").alias("row")), limit)
    names = [c for c in docs.columns if c not in ("shard_id", "page")]
    rows.select(*(F.col(f"row.`{c}`") for c in names), "shard_id", "page").repartition("shard_id", "page").write.partitionBy("shard_id", "page").parquet(path)
