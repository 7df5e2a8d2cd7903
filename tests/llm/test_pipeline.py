import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sleuthgrid.llm.shared import tokenizer_path

from .brute import DOCS, components, corpus, sentence, words
from .test_decontaminate import brute_tiles
from .test_quality import brute as counts


def test_stages_as_brute_force(spark, tmp_path):
    import random

    rng = random.Random(8)
    items = [sentence(rng, 20) for _ in range(3)]
    rows = [*corpus(n=40), (700, "before it " + items[0] + " after it", "en", "s0", 1), (701, sentence(rng, 40), "en", "s0", 1)]
    near = [sentence(rng, 8) for _ in range(12)]
    rows += [(800, " ".join(near), "en", "s0", 1), (801, " ".join(near) + " end", "en", "s0", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, tokenizer = spark.read.parquet(f"{tmp_path}/documents.parquet"), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            ok = {i for i, t in before if (c := counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
            assert set(after) <= ok and {701, 800, 801} <= set(after)
        elif name == "line_dedup":
            assert all(after[i] == t or len(words(after[i])) < len(words(t)) for i, t in before if i in after)
            lines = [tuple(words(x)) for t in after.values() for x in t.split("\n") if len(words(x)) >= 5]
            assert len(lines) == len(set(lines)) and {tuple(words(x)) for _, t in before for x in t.split("\n") if len(words(x)) >= 5} == set(lines)
        elif name == "ngram_jaccard_join":
            assert set(after) == {c for _, c in components(before, 5, 80).values()} and 800 in after and 801 not in after
        elif name == "benchmark_decontamination":
            leaks = {i for i, t in before if any(2 * sum(x[2] for x in brute_tiles(words(k, True), words(t, True), 5)) >= 20 for k in items)}
            assert 700 in leaks and set(after) == {i for i, _ in before} - leaks
        else:
            pieces = [(r["doc_id"], r["length"]) for r in out.collect()]
            assert sum(n for _, n in pieces) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in before)
            assert {i for i, _ in pieces} == {i for i, _ in before}
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert np.sum([r["length"] for r in whole]) == sum(n for _, n in pieces)
