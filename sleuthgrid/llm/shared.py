"""Tables in the shared folder of the cluster, and input columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one. A cluster has to name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="sleuthgrid-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later reads need no executor that computed it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id as long and text as string, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(key: Column, n: int) -> Column:
    """0..n-1, even over the values of key."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer, at the same place on the driver and all executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def merged_counts(rows: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """Sums of counts that tasks made: rows of `part` int and `counts` binary (64-bit), part k of sizes[k] numbers.

    A part's rows are added up one at a time, so memory and what reaches the driver are of fixed size.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for b in batches:
            for own, counts in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                counts = np.frombuffer(counts.as_py(), "<i8")
                if own == part:
                    total += counts
                    continue
                if part is not None:
                    yield one(part, total)
                part, total = own, counts.copy()
        if part is not None:
            yield one(part, total)

    def one(part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    out = [np.zeros(n, np.int64) for n in sizes]
    dealt = rows.repartition(min(len(sizes), 2 * partitions(rows.sparkSession)), "part").sortWithinPartitions("part")
    for r in dealt.mapInArrow(add, "part int, counts binary").collect():
        out[r["part"]] += np.frombuffer(r["counts"], "<i8")
    return out
