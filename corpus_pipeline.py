"""A training corpus from documents: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), with docs read again from its predecessor's Parquet output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sleuthgrid.llm.decontaminate import decontaminate
from sleuthgrid.llm.line_dedup import drop_repeated_lines
from sleuthgrid.llm.ngram_join import one_of_each
from sleuthgrid.llm.packing import pack
from sleuthgrid.llm.quality import keep_quality
from sleuthgrid.llm.shared import materialize, table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs, min_words=5)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, k=5, per_cent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), size=1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; sequence ids and the packing order depend on how the input is split into tasks."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
    return docs


#: SQL can't express the tiling, the R-tree join and the packing; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None
