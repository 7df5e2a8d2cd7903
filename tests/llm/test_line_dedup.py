import random
import time

from sleuthgrid.llm import line_dedup
from sleuthgrid.llm.line_dedup import align, dedup_lines, drop_repeated_lines

from .brute import DOCS, corpus, words


def test_alignments_are_common_ordered_blocks():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(2))
        at_a = at_b = 0
        for i, j, n in align(a, b):
            assert i >= at_a and j >= at_b and n > 0 and a[i : i + n] == b[j : j + n]
            at_a, at_b = i + n, j + n
    assert align([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)] and align([1, 2, 9, 3], [7, 1, 2, 3]) == [(0, 1, 2), (3, 3, 1)]


def test_lines_stay_in_the_first_document_alone(spark):
    rows = corpus()
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    seen = {}
    for i, t, *_ in rows:
        kept, own = out[i]["text"], (t or "").split("\n")
        for line in own:
            key = tuple(words(line))
            if len(key) >= 5:
                if seen.setdefault(key, i) == i:
                    assert line in kept.split("\n"), "a line's first document keeps it"
    again = [tuple(words(x)) for r in out.values() for x in (r["text"] or "").split("\n")]
    long = [x for x in again if len(x) >= 5]
    assert len(long) - len(set(long)) <= 0.02 * len(long)  # an alignment leaves lines that stand in another order


def test_odd_rows(spark):
    block = "a line of five words\nanother line of six words"
    df = spark.createDataFrame([(1, block, 4), (2, "own one two three four\n" + block, 4), (2, block, 4), (None, block, 4), (4, None, 4), (5, "", 4), (6, "\n" + block + "\n", 4)], "doc_id long, text string, n_chars int").selectExpr("*", "1 as gone", "2 as print", "3 as row", "4 as n_removed")
    out = dedup_lines(df)
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()), key=str)
    assert got == sorted([(1, block, 0), (2, "own one two three four", 2), (2, "", 2), (None, block, 0), (4, None, 0), (5, "", 0), (6, "\n", 2)], key=str)
    kept = drop_repeated_lines(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 4, 5, None]
    assert dedup_lines(df.limit(0)).collect() == []


def test_lines_in_another_order_than_their_first_holder_has(spark):
    one, two, three = ("line number one has six words", "line number two has six words", "line number three has six words")
    rows = [(1, [one, two, three]), (2, [two, one]), (3, [two, one]), (4, [three, "own four words here now", two, one])]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()} == {1: "\n".join(rows[0][1]), 2: "", 3: "", 4: "own four words here now"}


def brute(docs):
    """The lines with words that each document keeps: all but those in a run of 5 words or more that stands in an earlier one, too."""
    want = {}
    for d, own in enumerate(docs):
        gone = set()
        for before in docs[:d]:
            for i in range(len(before)):
                for j in range(len(own)):
                    n = 0
                    while i + n < len(before) and j + n < len(own) and words(before[i + n]) == words(own[j + n]):
                        n += 1
                    if sum(len(words(x)) for x in own[j : j + n]) >= 5:
                        gone.update(range(j, j + n))
        want[d] = [x for j, x in enumerate(own) if words(x) and j not in gone]
    return want


def test_corpus_as_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute([(t or "").split("\n") for _, t, *_ in rows])
    for holder in (line_dedup.HOLDER, 2):
        monkeypatch.setattr(line_dedup, "HOLDER", holder)
        out = dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
        assert {r["doc_id"]: [x for x in (r["text"] or "").split("\n") if words(x)] for r in out} == want


def test_alignments_alone_delete(spark, monkeypatch):
    rng = random.Random(2)
    for _ in range(300):  # the first alignment takes the longest ordered part, what is left comes from blocks in another order
        a = [rng.randint(0, 30) for _ in range(20)]
        cut = rng.randint(1, 19)
        own, width = a[cut:] + a[:cut], [1] * 20
        known = {tuple(a[s:e]): s for s, e in line_dedup.runs(width, 5)}
        first = {j + k for _, j, n in align(a, own) if n >= 5 for k in range(n)}
        both = line_dedup._gone(a, known, own, width, 5)
        assert first <= set(both) and set(both) >= {x for s, e in line_dedup.runs(width, 5) if tuple(own[s:e]) in known for x in range(s, e)}
    monkeypatch.setattr(line_dedup, "align", lambda a, b: [])
    assert line_dedup._gone([1, 2, 3], {(1, 2): 0}, [1, 2, 3], [3, 3, 3], 5) == []


def test_long_repetitive_texts_take_little():
    rng = random.Random(6)
    sequences = [([1, 2, 3] * 5000, [2, 1, 3, 3] * 5000), ([1] * 20_000, [1] * 15_000 + [2]), ([rng.randint(0, 3) for _ in range(10_000)], [rng.randint(0, 3) for _ in range(10_000)]), (list(range(10_000)), list(range(10_000))[::-1])]
    began = time.process_time()
    for a, b in sequences:
        at_a = at_b = 0
        for i, j, n in align(a, b):
            assert i >= at_a and j >= at_b and a[i : i + n] == b[j : j + n]
            at_a, at_b = i + n, j + n
    assert time.process_time() - began < 20


def test_many_deleted_lines(spark):
    lines = [f"line number {i} of this text" for i in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*lines[::-1], "own words of the second text"]))], "doc_id long, text string")
    began = time.time()
    assert {r["doc_id"]: r["n_removed"] for r in dedup_lines(df).collect()} == {1: 0, 2: 20_000}
    assert time.time() - began < 60


def test_blocks_of_short_lines_as_brute_force(spark):
    rng = random.Random(11)
    alphabet = ["", "", *(" ".join(f"w{i}" for _ in range(n)) for i, n in enumerate([1, 1, 2, 2, 3, 3, 4, 4, 5, 7]))]
    verse = [f"verse {i} of four" for i in range(30)]
    docs = [[rng.choice(alphabet) for _ in range(rng.randint(1, 9))] for _ in range(80)] + [["one", *verse], ["other", *verse, "end"]]
    want = brute(docs)
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")
    assert want[81] == ["other", "end"] and {r["doc_id"]: [x for x in r["text"].split("\n") if x] for r in dedup_lines(df).collect()} == want
