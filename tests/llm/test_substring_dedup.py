import hashlib

import numpy as np
import pytest

from sleuthgrid.llm.substring_dedup import Subtree, dedup_substrings

from .brute import DOCS, corpus, words


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {b for a in range(len(w) - window + 1) if first[tuple(w[a : a + window])] < i for b in range(a, a + window)}
        kept = " ".join(x for b, x in enumerate(w) if b not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("window", "block_bytes", "group", "slots"), [(13, 6 << 20, 8_000_000, 1 << 16), (13, 2000, 600, 256), (4, 3000, 100, 64), (2, 800, 20, 16), (1, 900, 90, 16)])
def test_as_brute_force(spark, window, block_bytes, group, slots):
    rows = corpus()
    out = dedup_substrings(spark.createDataFrame(rows, DOCS), window=window, block_bytes=block_bytes, group_words=group, slots=slots)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    assert got == brute([(r[0], r[1]) for r in rows], window)


def test_different_words_of_a_series_that_defeats_polynomial_hashes(spark):
    """The Thue-Morse word and its complement collide for every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    common = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {common}"), (2, f"{two} {common}"), (3, f"{one} {common}")]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: 0, 3: 13}


def test_subtree_as_sorted_suffixes():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 3, 500).astype(np.int32)
    at, value = np.arange(494), rng.integers(0, 99, 494)
    tree = Subtree(ids, at, 7)
    sorted_ = sorted(range(494), key=lambda i: ids[i : i + 7].tolist())
    assert [ids[i : i + 7].tolist() for i in tree.order] == [ids[i : i + 7].tolist() for i in sorted_]
    for depth in (3, 7):
        least = {}
        for i in at.tolist():
            least[tuple(ids[i : i + depth])] = min(value[i], least.get(tuple(ids[i : i + depth]), 99))
        assert tree.least_below(value, depth).tolist() == [least[tuple(ids[i : i + depth])] for i in at.tolist()]


def test_null_ids_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (4, None)], "doc_id long, text string").selectExpr("*", "1 as block", "2 as `group`")
    out = sorted(((r["doc_id"], r["n_removed"]) for r in dedup_substrings(df).collect()), key=str)
    assert out == sorted([(None, 20), (None, 20), (3, 0), (3, 0), (4, 0)], key=str)
    assert dedup_substrings(df.limit(0)).collect() == []


def test_rows_of_one_id_and_null_ids_lose_each_their_own_words(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(15)) for x in "ab")
    rows = [(1, a), (7, f"{a} own words of one"), (7, f"other {b}"), (None, f"{a} z"), (None, f"y {b}"), (None, f"y {b}"), (5, b)]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=60)
    got = sorted(((r["doc_id"], r["kept"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (7, "own words of one"), (7, "other"), (None, "z"), (None, "y"), (None, "y"), (5, b)], key=str)
