import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sleuthgrid.llm.fill_middle import BitVector, fill_in_middle, restored, unit_starts

from .brute import DOCS, ODD, corpus


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    hex_ = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hex_[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(deadline=None, max_examples=60)
@given(st.lists(st.booleans(), max_size=3000), st.lists(st.integers(0, 3000), max_size=20))
def test_rank_and_select_as_counting(bits, at):
    v = BitVector(np.array(bits, bool))
    places = [i for i, b in enumerate(bits) if b]
    assert v.ones == len(places)
    at = np.array([x % (len(bits) + 1) for x in at], np.int64)
    assert v.rank(at).tolist() == [sum(bits[:x]) for x in at.tolist()]
    assert v.select(at).tolist() == [places[x] if x < len(places) else len(bits) for x in at.tolist()]


def test_units_end_with_their_text():
    texts = ["ab", "cd1", "", "é", "e漢a b"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    v = unit_starts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert np.diff(v.rank(offsets)).tolist() == [1, 2, 0, 1, 5]


def test_rows_as_brute_force_and_back(spark):
    rng = random.Random(5)
    odd = ["<", "<P", "a<S> b", "x<M", "<<<P<S<M", "P>S>M>", "<P" * 9, "S>" + "<" * 7, "\r\n\t\x00é", "á", "Z" * 5000, "漢" * 700, "😀 a😀b"]
    noise = ["".join(rng.choice("<PSM>ab é\n1") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = corpus() + [(1000 + i, t, None, None, 0) for i, t in enumerate(odd * 12 + noise)] + [(None, "no id here", None, None, 0), (3, "again 3", None, None, 0), (-7, "below zero", None, None, 0)]
    out = fill_in_middle(spark.createDataFrame(rows, DOCS)).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted((brute(r[0], r[1]) for r in rows), key=str)
    assert sorted((str(r["doc_id"]), r["back"]) for r in out) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_long_text_empty_table_clashing_columns(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("ab cd1é漢") for _ in range(2_000_000))
    ids = [i for i in range(40) if brute(i, "a")[2] != "plain"][:2]
    df = spark.createDataFrame([(ids[0], long), (ids[1], long), (None, None)], "doc_id long, text string").selectExpr("*", "1 as n", "text as output", "2 as form")
    got = {r["doc_id"]: tuple(r) for r in fill_in_middle(df).collect()}
    assert got == {i: brute(i, t) for i, t in [(ids[0], long), (ids[1], long), (None, None)]}
    assert fill_in_middle(df.limit(0)).collect() == []
    assert fill_in_middle(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id int, text string")).count() == len(ODD)
