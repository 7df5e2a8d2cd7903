"""Layers fetched page by page: the pages as they were saved, each a JSON text with features or an error, as rows and as an account of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nested import as_object, parsed


def pages_of_folder(spark: SparkSession, path: str) -> DataFrame:
    """(offset, body) of saved pages named by the offset of their first row, such as page-2000.json."""
    files = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))
    return files.select(F.regexp_extract("file", r"(\d+)\D*$", 1).try_cast("long").alias("offset"), "body").where("offset is not null")


def paged_rows(pages: DataFrame, key: list[str], attributes: str, max_rows: int | None = None) -> DataFrame:
    """key, row (its number in the layer) and attributes of each feature, up to the number max_rows; pages that can't be read have none."""
    body = pages.select(*key, "offset", parsed(F.col("body")).alias("_v")).select(*key, "offset", F.posexplode(F.try_variant_get("_v", "$.features", "array<variant>")).alias("_n", "_f"))
    rows = body.select(*key, (F.col("offset") + F.col("_n")).alias("row"), F.from_json(F.to_json(F.try_variant_get("_f", "$.attributes", "variant")), attributes).alias("a")).where("a is not null")
    return (rows if max_rows is None else rows.where(F.col("row") < max_rows)).select(*key, "row", "a.*")


def paged_account(pages: DataFrame, totals: DataFrame, key: list[str], page: int, max_rows: int | None = None) -> DataFrame:
    """key, rows, reported_total, capped and errors of each layer. totals: key and reported_total, null where the layer doesn't say.

    capped: there is a row beyond max_rows, by what is reported or by what came. errors: pages that answer with an error
    or can't be read, and the pages that are due, by the reported total or up to the last one, and aren't there.
    """
    read = pages.select(*key, "offset", parsed(F.col("body")).alias("_v"))
    size = F.size(F.try_variant_get("_v", "$.features", "array<variant>"))
    failed = F.when(as_object(F.col("_v")).isNull(), "no JSON object").when(F.try_variant_get("_v", "$.error", "variant").isNotNull(), F.concat(F.lit("error "), F.coalesce(F.try_variant_get("_v", "$.error.code", "string"), F.lit("")))).when(F.coalesce(size, F.lit(-1)) < 0, "no features")
    read = read.select(*key, "offset", F.when(failed.isNull(), size).otherwise(0).alias("_n"), failed.alias("_failed"))
    most = F.lit(max_rows if max_rows is not None else (1 << 62)).cast("long")
    sums = read.groupBy(*key).agg(
        F.sum(F.greatest(F.lit(0), F.least(F.col("_n").cast("long"), most - F.col("offset")))).alias("rows"), F.max(F.col("offset") + F.col("_n")).alias("_end"), F.collect_set("offset").alias("_there"),
        F.collect_list(F.when(F.col("_failed").isNotNull(), F.struct("offset", F.col("_failed").alias("what")))).alias("_errors"),
    )
    both = totals.join(sums, key, "left")
    due = F.least(F.coalesce("reported_total", "_end", F.lit(0)), most)
    offsets = F.when(due > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.floor((due - 1) / page)), lambda i: i * page)).otherwise(F.array().cast("array<long>"))
    missing = F.transform(F.array_except(offsets, F.coalesce("_there", F.array().cast("array<long>"))), lambda o: F.struct(o.alias("offset"), F.lit("missing").alias("what")))
    errors = F.array_sort(F.concat(F.coalesce("_errors", F.array().cast("array<struct<offset:bigint,what:string>>")), missing))
    return both.select(*key, F.coalesce("rows", F.lit(0)).alias("rows"), "reported_total", (F.greatest(F.coalesce("reported_total", F.lit(0)), F.coalesce("_end", F.lit(0))) > most).alias("capped"), errors.alias("errors"))
