"""What is shown of what is held: joined and newest first, by membership, by print, without what may not be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_joined(rows: DataFrame, held: DataFrame, key: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows in order that are held, with what is held of them. Rows are limited after the join, so that each shown one has its partner."""
    return rows.join(held, key).orderBy(*order).limit(limit)


def membership(asked: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """asked with whether its key is held."""
    return asked.join(held.select(*key).distinct().withColumn("held", F.lit(True)), key, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def by_print(asked: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """asked with what is held under its SHA-1, whatever its letter case and colons; nulls where nothing is. held: sha1 in lower case, without colons."""
    key = F.lower(F.replace(F.trim(F.col(column)), F.lit(":"), F.lit("")))
    return asked.withColumn("sha1", key).join(held, "sha1", "left")


def dispatched(entities: DataFrame, inputs: dict[str, list[str]]) -> DataFrame:
    """A row for each entity and collector that takes entities of its type; inputs: the types that each collector takes."""
    pairs = [(c, t) for c, types in inputs.items() for t in types]
    taken = entities.sparkSession.createDataFrame(pairs, "collector string, type string")
    return entities.join(F.broadcast(taken), "type")  # as many rows as collectors take types


def public_view(numbers: DataFrame, reports: DataFrame, key: str, stale_before: Column) -> DataFrame:
    """Of each number how many shown reports it has of each category (a sorted map), operator_only, and whether the last one is stale. reports: category, made, hidden."""
    shown = reports.where("not hidden")
    counts = shown.groupBy(key, "category").agg(F.count("*").alias("_n"), F.max("made").alias("_made"))
    sums = counts.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "_n")))).alias("categories"), F.max("_made").alias("_last"))  # as many entries as categories
    out = numbers.join(sums, key, "left")
    return out.select(*numbers.columns, F.coalesce("categories", F.create_map().cast("map<string,bigint>")).alias("categories"), F.coalesce(F.col("_last") < stale_before, F.lit(False)).alias("stale"))


def active_listings(listings: DataFrame, key: str, limit: int) -> DataFrame:
    """The newest `limit` listings that are active, shown and reported, with their place."""
    kept = listings.where("active and not hidden and report_count > 0").orderBy(F.desc("last_report_at"), key).limit(limit)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_report_at"), key)).cast("long"))  # at most `limit` rows


def merged_flags(flags: DataFrame, key: list[str]) -> DataFrame:
    """Each flag of a key is set if any of its rows sets it."""
    return flags.groupBy(*key).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags.columns if c not in key))


def without_prose(rows: DataFrame, columns: list[str], words: int = 8) -> DataFrame:
    """rows with null for those fields that read as prose: `words` words or more, or a sentence that ends within."""
    prose = lambda c: (F.size(F.split(F.trim(c), r"\s+")) >= words) | F.trim(c).rlike(r"[a-z]\. +[A-Z]")
    return rows.withColumns({c: F.when(~prose(F.col(c)), F.col(c)) for c in columns})


def advanced(cursors: DataFrame, sizes: DataFrame, key: str, step: int) -> DataFrame:
    """Cursors moved on by `step` rows, not past the end of their window, and whether they have reached it; windows without a cursor begin at 0. cursors: cursor, exhausted; sizes: n."""
    both = sizes.join(cursors, key, "left")
    end = F.when(F.coalesce("exhausted", F.lit(False)), F.col("cursor")).otherwise(F.least("n", F.coalesce("cursor", F.lit(0)) + step))
    return both.select(key, end.alias("cursor"), (end >= F.col("n")).alias("exhausted"))
