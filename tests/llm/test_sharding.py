from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sleuthgrid.llm import sharding
from sleuthgrid.llm.sharding import assign_shards, place, write_shards

from .brute import DOCS, corpus


@pytest.mark.parametrize("limit", [1 << 20, 3000, 700])
def test_every_shard_fits_and_only_large_buckets_split(spark, limit):
    rows = corpus(n=120)
    out = assign_shards(spark.createDataFrame(rows, DOCS), limit).collect()
    assert sorted(r["doc_id"] for r in out) == [r[0] for r in rows]
    size, bits = defaultdict(int), {}
    for r in out:
        assert r["bytes"] == len((rows[r["doc_id"]][1] or "").encode()) and r["page"] == 0
        size[r["shard_id"]] += r["bytes"]
        bits[r["shard_bits"]] = r["shard_bytes"]
    assert all(n <= limit for n in size.values()) and sum(size.values()) == sum(r["bytes"] for r in out)
    assert all({r["shard_bytes"] for r in out if r["shard_id"] == k} == {n} for k, n in size.items())
    for b in bits:  # prefix-free, and what a bucket was split from was over the limit
        assert not any(o != b and o.startswith(b) for o in bits)
        assert not b or sum(n for o, n in bits.items() if o.startswith(b[:-1])) > limit


def brute(rows, limit):
    """Extendible hashing bit by bit: a bucket over the limit splits on its next bit, unless it holds one hash alone."""
    out, todo = {}, [("", [(format(h & (1 << 64) - 1, "064b") + format(g & (1 << 64) - 1, "064b"), n) for h, g, n in rows])]
    while todo:
        prefix, own = todo.pop()
        depth = len(prefix)
        if sum(n for _, n in own) <= limit or len({h for h, _ in own}) == 1:
            if own:
                out[prefix] = sum(n for _, n in own)
            continue
        if depth < 64 and len({h[:64] for h, _ in own}) == 1:  # one doc_id: on with the bits of the texts
            todo += [(own[0][0][:64] + b, [x for x in own if x[0][64] == b]) for b in "01"]
            continue
        todo += [(prefix + b, [x for x in own if x[0][depth] == b]) for b in "01"]
    return out


@pytest.mark.parametrize("limit", [2000, 300, 60])
def test_directory_as_brute_force(spark, limit):
    rows = [(i % 23 if i % 3 else 5, f"text {i} " + "x" * (i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = df.select(place(df["doc_id"]).alias("h"), F.xxhash64("text", F.lit("text")).alias("g"), F.octet_length("text").alias("n")).collect()
    out = assign_shards(df, limit).collect()
    want = brute([tuple(r) for r in hashes], limit)
    assert {r["shard_bits"]: r["shard_bytes"] for r in out} == want
    numbers = {r["shard_bits"]: r["shard_id"] for r in out}
    assert [numbers[b] for b in sorted(numbers)] == list(range(len(want))) and len(out) == 200


def test_repeated_rows_are_dealt_to_pages(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x" * 40)] * 10 + [(None, "y")] * 3 + [(2, None), (3, "z" * 500)], "doc_id long, text string").selectExpr("*", "1 as place", "2 as second", "3 as shard_id", "4 as p")
    for copies in (sharding.COPIES, 3):
        monkeypatch.setattr(sharding, "COPIES", copies)
        out = assign_shards(df, 100).collect()
        pages = defaultdict(int)
        for r in out:
            pages[r["shard_id"], r["page"]] += r["bytes"]
        assert len(out) == 15 and sorted(pages.values())[-2] <= 100 and max(pages.values()) == 500 and len(pages) > 5
    assert assign_shards(df.limit(0), 100).collect() == []


def test_written_shards(spark, tmp_path):
    rows = corpus()
    write_shards(spark.createDataFrame(rows, DOCS), 2000, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == len(rows) and {"shard_id", "page", *(c.split()[0] for c in DOCS.split(", "))} == set(back.columns)


def test_written_shards_keep_repeated_rows(spark, tmp_path):
    rows = [(1, "a b c", "p")] * 3 + [(1, "other", "q"), (2, None, None)]
    write_shards(spark.createDataFrame(rows, "doc_id long, text string, row string"), 4, f"file://{tmp_path}/out")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").select("doc_id", "text", "row").collect()), key=str) == sorted(rows, key=str)
