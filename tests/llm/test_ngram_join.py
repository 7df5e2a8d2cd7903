import numpy as np
import pytest

from sleuthgrid.llm import ngram_join
from sleuthgrid.llm.ngram_join import WIDTH, CountRTree, Points, jaccard_components, may_link, one_of_each, overlap_bound, point_of

from .brute import DOCS, components, corpus


@pytest.mark.parametrize(("k", "per_cent"), [(4, 85), (5, 80), (2, 30)])
def test_components_as_brute_force(spark, k, per_cent):
    rows = corpus()
    want = components([(r[0], r[1]) for r in rows], k, per_cent)
    out = jaccard_components(spark.createDataFrame(rows, DOCS), k=k, per_cent=per_cent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want


def test_large_tile_is_searched_by_the_tree(spark):
    head = "common words that all of these texts begin with "
    rows = [(i, head + " ".join(f"w{i % 9}x{j}" for j in range(20)) + f" tail{i}", None, None, 0) for i in range(90)]
    want = components([(r[0], r[1]) for r in rows], 3, 60)
    out = jaccard_components(spark.createDataFrame(rows, DOCS), k=3, per_cent=60)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want


def test_tree_pairs_as_all_pairs():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (200, ngram_join.GROUPS)).astype(np.uint8)
    counts = counts[np.argsort(counts.sum(axis=1, dtype=int))]
    points = Points(counts, rng.integers(0, 3, 200))
    size, comp = counts.sum(axis=1, dtype=np.int64), np.arange(200) // 4
    got = {(a, b) for i, j, _ in CountRTree(points, size, comp).pairs(43) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    least = lambda a, b: np.array([int(np.minimum(counts[a], counts[b]).sum(dtype=int) + min(points.over[a], points.over[b]))])
    assert all(overlap_bound(points, np.array([a]), points, np.array([b])) == least(a, b) for a in range(9) for b in range(200))
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if comp[a] != comp[b] and 100 * size[a] >= 43 * size[b] and may_link(least(a, b), size[[a]], size[[b]], 43)[0]}
    assert want and got == want


def test_point_keeps_counts_over_a_byte():
    shingles = np.unique(np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    point = point_of(shingles)
    assert len(point) == WIDTH
    points = Points.of([point])
    assert points.counts.sum(dtype=int) + points.over[0] == len(shingles)


def test_large_group_that_misses_its_centre(spark, monkeypatch):
    """Near copies of which many miss the least one; blocks, trees and tiles are made small, so that all ways are gone."""
    for name, value in {"BLOCK": 40, "ANCHORS": 3, "TILE": 50, "TREE_BYTES": 30_000, "PAIRS": 500}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.choice(120, rng.integers(1, 5), replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own), None, None, 0))
    want = components([(r[0], r[1]) for r in rows], 4, 85)
    out = jaccard_components(spark.createDataFrame(rows, DOCS), k=4, per_cent=85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want
    assert 1 < len({c for _, c in want.values()}) < 400


def test_null_and_repeated_ids_empty_table_clashing_columns(spark):
    rows = [(None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "q r s t u v", "y"), (5, "q r s t u v", "y"), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string").selectExpr("*", "token as n", "token as component_id", "token as comp")
    out = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(df).collect()), key=str)
    assert out == sorted([(None, None), (1, 1), (1, 1), (5, 1), (7, 7)], key=str)
    assert sorted((r["doc_id"] for r in one_of_each(df).collect()), key=str) == [1, 1, 7, None]
    assert one_of_each(df).columns == df.columns
    assert jaccard_components(df.limit(0)).collect() == []


def test_a_repeated_id_joins_the_copies_of_all_its_texts(spark):
    one, two = "a b c d e f g", "q r s t u v w"
    rows = [(2, two), (3, one), (5, one), (5, two), (9, "n o n e o f t h e s e")]
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in out.collect()) == [(2, 2), (3, 2), (5, 2), (5, 2), (9, 9)]
