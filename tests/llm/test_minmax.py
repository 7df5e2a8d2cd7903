import numpy as np
import pytest

from sleuthgrid.llm import minmax, ngram_join
from sleuthgrid.llm.minmax import MinMax, drop_near_duplicates, near_duplicates

from .brute import DOCS, components, corpus


@pytest.mark.parametrize(("k", "per_cent"), [(4, 80), (5, 80), (2, 50)])
def test_components_as_brute_force(spark, k, per_cent):
    rows = corpus()
    want = components([(r[0], r[1]) for r in rows], k, per_cent)
    out = near_duplicates(spark.createDataFrame(rows, DOCS), k=k, per_cent=per_cent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want
    assert all(r["kept"] == (want[r["doc_id"]][1] == r["doc_id"]) for r in out.collect())


def pair(rng, n, share):
    """Two sets of n hashes with this similarity, as near as whole numbers come."""
    common = round(2 * n * share / (1 + share))
    all_ = rng.integers(0, 1 << 63, 2 * n - common, np.uint64) * np.uint64(2)
    return np.sort(all_[:n]), np.sort(all_[n - common :])


@pytest.mark.parametrize("n", [9, 45, 900])
def test_pairs_at_the_threshold_share_bands_and_estimates_are_unbiased(n):
    rng, hashing = np.random.default_rng(n), MinMax(80)
    assert hashing.bands * minmax.ROWS == hashing.values and (1 - 0.8**minmax.ROWS) ** hashing.bands < minmax.MISS
    agree, shared = [], []
    for _ in range(400):
        a, b = pair(rng, n, 0.8)
        both = np.stack([hashing.signature(a), hashing.signature(b)])
        keys = hashing.keys(both)
        agree.append(int((both[0] == both[1]).sum()))
        shared.append(int((keys[0] == keys[1]).sum()))
        assert (both[0][: hashing.values // 2] <= both[0][hashing.values // 2 :]).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert min(shared) > 0 and min(agree) >= hashing.agree
    spread = (true * (1 - true) / hashing.values) ** 0.5
    assert abs(np.mean(agree) / hashing.values - true) < 5 * spread / 20
    assert np.std(agree) / hashing.values < 1.1 * spread  # no more than as many separate permutations would have
    assert abs(np.mean(shared) / hashing.bands - true**minmax.ROWS) < 0.03


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(5)
    for n in (5, 100, 700, 5000):
        for share in (0.3, 0.7, 0.8, 0.95):
            a, b = pair(rng, n, share)
            words = [np.frombuffer(minmax.bitmap(x), "<u8")[None] for x in (a, b)]
            bound = int(minmax.most_overlap(words[0], np.array([n]), words[1], np.array([n]))[0])
            true = len(np.intersect1d(a, b))
            assert true <= bound <= n and (n > 700 or bound - true <= 0.5 * (n - true) + 3)


def test_unlike_sets_share_few_bands():
    rng, hashing = np.random.default_rng(1), MinMax(80)
    shared = [int((np.diff(hashing.keys(np.stack([hashing.signature(x) for x in pair(rng, 200, 0.2)])).astype(np.int64), axis=0) == 0).sum()) for _ in range(200)]
    assert sum(s > 0 for s in shared) < 40


def test_large_group_that_misses_its_centre(spark, monkeypatch):
    """Near copies of which many miss the least one; blocks and cells are made small, so that all ways are gone."""
    for name, value in {"BLOCK": 40, "ANCHORS": 3, "TILE": 50, "TREE_BYTES": 30_000}.items():
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(minmax, "PAIRS", 300)
    monkeypatch.setattr(minmax, "CENTRES", 1)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own), None, None, 0))
    want = components([(r[0], r[1]) for r in rows], 4, 80)
    out = near_duplicates(spark.createDataFrame(rows, DOCS), k=4, per_cent=80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want
    assert 1 < len({c for _, c in want.values()}) < 400


def test_null_and_repeated_ids_long_text_empty_table_clashing_columns(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**9, 400_000))
    one, two = "a b c d e f g", "q r s t u v w"
    rows = [(None, one), (1, one), (1, one), (2, two), (3, one), (5, one), (5, two), (7, None), (8, long), (9, long + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as token", "1 as n", "2 as kept", "3 as component_id", "4 as signature")
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert out == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (5, 1, False), (7, 7, True), (8, 8, True), (9, 8, False)], key=str)
    left = drop_near_duplicates(df)
    assert left.columns == df.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 1, 7, 8, None]
    assert near_duplicates(df.limit(0)).collect() == []
