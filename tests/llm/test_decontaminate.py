import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from sleuthgrid.llm import decontaminate as decontaminate_module
from sleuthgrid.llm.decontaminate import Items, decontaminate, find_leaks, stretches, tile
from sleuthgrid.llm.words import Words

from .brute import DOCS, corpus, sentence, words


def brute_tiles(a, b, width):
    """Greedy string tiling by trying every pair of places, longest first, then first in a, then in b."""
    in_a, in_b, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in in_a and j + n not in in_b:
                    n += 1
                if n >= width and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        tiles.append(best)
        in_a.update(range(best[0], best[0] + best[2]))
        in_b.update(range(best[1], best[1] + best[2]))


def test_tiles_as_brute_force():
    rng = random.Random(2)
    for _ in range(80):
        a, b = (np.array([rng.randint(0, 2) for _ in range(rng.randint(3, 25))], np.uint64) for _ in range(2))
        seeds = {tuple(a[i : i + 3].tolist()) for i in range(len(a) - 2)}
        at = np.array([j for j in range(len(b) - 2) if tuple(b[j : j + 3].tolist()) in seeds], np.int64)
        got = tile(a, stretches(b, at, 3), 3) if len(at) else []
        assert got == brute_tiles(a.tolist(), b.tolist(), 3)


def test_repetitive_texts_take_little():
    """Texts of one word, or two, have as many pairs of seeds as the square of their length."""
    items = Items([(1, Words(x := np.frombuffer(t.encode(), np.uint8), np.array([0, len(x)]), True)) for t in ["a " * 2000]] + [(2, Words(y := np.frombuffer(b"a b " * 900, np.uint8), np.array([0, len(y)]), True))], 5)
    began = time.process_time()
    tracemalloc.start()
    found = list(items.leaks(pa.array(["a " * 500_000, "a b " * 200_000, ". " * 500_000, "b a"]), 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[x["item_id"] for x in own] for own in found] == [[1], [2], [], []]
    assert time.process_time() - began < 20 and peak < 500 << 20


def test_short_items_leak_as_whole_lines(spark):
    docs = spark.createDataFrame([(1, "before\nTwo  words \nafter"), (2, "two words more"), (3, "two words"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(8, "two words"), (9, None)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["matched_words"]) for r in find_leaks(docs, bench).collect()) == [(1, 8, 2), (3, 8, 2)]
    assert sorted(r["doc_id"] for r in decontaminate(docs, bench).collect()) == [2, 4]


def test_blocks_of_the_benchmark_find_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [sentence(rng, 12) for _ in range(5)]
    docs = spark.createDataFrame([(i, f"own {t} words") for i, t in enumerate(items[:3])] + [(9, "nothing of these")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate_module, "BLOCK_WORDS", 20)
    assert sorted((r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert [r["doc_id"] for r in decontaminate(docs, bench).collect()] == [9]


def test_leaks_as_brute_force(spark):
    rng = random.Random(4)
    items = [sentence(rng, 24) for _ in range(6)]
    rows = corpus()
    w = items[0].split()
    planted = {900: items[0].upper(), 901: "x " + " ".join(w[12:]) + " y z " + " ".join(w[:12]), 902: " ".join(w[:11]) + " q", 903: "a b " + items[1] + " and " + items[2], 904: " ".join(w[:13])}
    rows += [(i, t, None, None, 0) for i, t in planted.items()]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "too short")], "item_id long, text string").selectExpr("*", "7 as doc_id")
    want = {}
    for i, t, *_ in rows:
        for k, item in enumerate(items):
            n = sum(x[2] for x in brute_tiles(words(item, True), words(t, True), 5))
            if 2 * n >= 24:
                want[i, k] = n
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in find_leaks(docs, bench).collect()}
    assert got == want and {(900, 0), (901, 0), (903, 1), (903, 2), (904, 0)} <= set(got) and (902, 0) not in got
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in want}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_leaks(docs.limit(0), bench).collect() == [] and find_leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate(docs, bench.limit(0)).count() == 1 and decontaminate(docs, bench).count() == 0
