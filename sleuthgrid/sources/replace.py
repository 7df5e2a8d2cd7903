"""Tables that an import replaces as a whole, and imports that count once.

A table is a folder of editions beside a pointer, a small table of one row that names the edition in force. An
import writes a new edition and then the pointer, so readers see the old or the new rows, never a mixture, and a
failed import changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows in force, or None before the first import."""
    try:
        rows = spark.read.parquet(f"{path}/pointer").orderBy(F.desc("at")).limit(1).collect()
    except AnalysisException:
        return None
    return spark.read.parquet(f"{path}/{rows[0]['edition']}") if rows else None


def replace_all(rows: DataFrame, path: str) -> int:
    """Replace the table by rows and return how many there are; no rows leave it as it is, as an empty feed is a failed fetch."""
    edition = f"edition-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{edition}")
    spark = rows.sparkSession
    n = spark.read.schema(rows.schema).parquet(f"{path}/{edition}").count()
    if n:
        spark.range(1).select(F.lit(edition).alias("edition"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return n


def import_once(files: DataFrame, ledger: str) -> DataFrame:
    """The files (path, content) whose content no earlier import had, one of each content; note them with `imported` once they are in. A file's key is the CRC-32 and length of its content."""
    keyed = files.select("path", "content", F.concat_ws("-", F.hex(F.crc32("content")), F.octet_length("content")).alias("crc"))
    one = keyed.groupBy("crc").agg(F.min_by(F.struct("path", "content"), "path").alias("f")).select("crc", "f.*")
    try:
        known = files.sparkSession.read.parquet(ledger).select("crc").distinct()
    except AnalysisException:
        return one
    return one.join(known, "crc", "left_anti")


def imported(files: DataFrame, ledger: str) -> None:
    """Note files (crc, path) in the ledger."""
    files.select("crc", "path", F.current_timestamp().alias("at")).write.mode("append").parquet(ledger)
