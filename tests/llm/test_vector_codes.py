import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from sleuthgrid.llm import vector_codes as vc
from sleuthgrid.llm.vector_codes import Annuli, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) in plain loops; rows of one length."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), c) for c, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(book, cut(v)[p])[1]].append(cut(v)[p])
            new.append([[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if own[e] else entry for e, entry in enumerate(book)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, v, label in kept:
        found = [near(b, x) for b, x in zip(books, cut(v), strict=True)]
        out.append((i, "".join(f"{c:02x}" for _, c in found), sum(d for d, _ in found), label))
        total[label] += out[-1][2]
    return [(i, c, e, total[label], digest) for i, c, e, label in out]


def vectors(n, width, seed=2):
    rng = np.random.default_rng(seed)
    return [(i * 3, [float(x) for x in np.float32(rng.normal(size=width) / 8)], None if i % 5 == 0 else i % 3) for i in range(n)]


@pytest.mark.parametrize("n", [5, 64, 200])
def test_codes_as_brute_force(spark, n):
    rows = vectors(n, 32)
    rows += [(1, [0.5] * 32, 1), (4, rows[2][1], 1), (4, rows[3][1], 9), (None, rows[1][1], 2), (9, rows[3][1], None)]  # ties, repeated and null ids
    bad = [(0, None, 1), (-1, [None] + [0.0] * 31, 1), (-2, [math.nan] + [0.0] * 31, 1), (2, [math.inf] * 32, 1), (5, [0.0] * 31 + [-math.inf], None)]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 as code", "2 as error", "3 as vector", "4 as of_label").repartition(3)
    assert sorted(map(tuple, vector_codes(df).collect()), key=str) == sorted(brute(rows), key=str)


def test_few_values_give_ties(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(32)], 0) for i in range(90)]
    assert sorted(map(tuple, vector_codes(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(brute(rows))


@pytest.mark.parametrize("scale", [1, 300, vc.LIMIT])
def test_annulus_holds_the_nearest_entry(scale):
    rng = np.random.default_rng(7)
    entries, x = (np.clip(np.rint(rng.normal(size=(n, 4)) * scale / 2), -vc.LIMIT, vc.LIMIT).astype(np.int64) for n in (64, 3000))
    entries[10] = entries[3]
    x[:64] = entries
    book = Annuli(entries)
    index, least = book.nearest(x)
    all_ = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (index == all_.argmin(axis=1)).all() and (least == all_.min(axis=1)).all()
    assert book.compared < 0.8 * all_.size  # the others are never compared


def test_uneven_lengths_large_components_and_empty(spark):
    rows = vectors(30, 20)
    padded = [(i, v + [0.0] * 12, c) for i, v, c in rows]
    mixed = [(i, v if i % 2 else v[:20], c) for i, v, c in padded]
    got = sorted(map(tuple, vector_codes(spark.createDataFrame(mixed, SCHEMA)).collect()))
    assert got == sorted(brute(padded))
    huge = spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [1.0] * 16, 1)], SCHEMA)
    assert {r["error"] for r in vector_codes(huge, entries=2).collect()} != {0}
    assert vector_codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    assert [r["code"] for r in vector_codes(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)).collect()] == ["00" * 16] * 2
    with pytest.raises(ValueError, match="two hexadecimal"):
        vector_codes(huge, entries=257)
