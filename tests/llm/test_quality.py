import random

from sleuthgrid.llm.quality import judge_quality, keep_quality

from .brute import DOCS, corpus, sentence, words


def brute(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    repeated = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    own = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(repeated)


def test_counts_as_brute_force(spark):
    rows = [*corpus(n=30), (500, "a b c d e " * 9, "en", "s", 1), (501, "same line here\n" * 4 + "x # <y>", "en", "s", 1), (502, "a b c d e a b c d e f", None, None, 1)]
    for r in judge_quality(spark.createDataFrame(rows, DOCS)).collect():
        q, want = r["quality"], brute(r["text"])
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        assert q["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (q["kept"] and q["base_failed"])


def test_outliers_of_a_group_go_and_its_own_habits_stay(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 40), "en", "prose", 1) for i in range(150)] + [(1000 + i, " ".join(w + "#" for w in sentence(rng, 40).split()), "en", "code", 1) for i in range(150)]
    rows += [(5000, " ".join(w + "###" for w in sentence(rng, 40).split()), "en", "prose", 1)]
    kept = {r["doc_id"] for r in keep_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {r[0] for r in rows} - {5000}


def test_missing_columns_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(None, None), (1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l")], "doc_id long, text string").selectExpr("*", "1 as quality", "2 as limits", "3 as `row`")
    out = keep_quality(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [1, 1]
    assert keep_quality(df.limit(0)).collect() == []
