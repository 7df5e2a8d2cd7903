"""Summaries of traffic, runs and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def traffic(views: DataFrame, visitor: str, counted: Column) -> DataFrame:
    """One row: total of the counted rows, all rows, distinct visitors among the counted, and the share that isn't counted."""
    out = views.agg(F.count_if(counted).alias("total"), F.count("*").alias("all_rows"), F.count_distinct(F.when(counted, F.col(visitor))).alias("visitors"))
    return out.withColumn("bot_share", F.when(F.col("all_rows") > 0, F.bround((F.col("all_rows") - F.col("total")) / F.col("all_rows"), 4)).otherwise(F.lit(0.0)))


def top(df: DataFrame, column: str, k: int, missing: str) -> DataFrame:
    """The k commonest values of a column, null as `missing`; ties by value."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def scorecard(timings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per collector runs, seconds, evidence and mean confidence, from either side; share of all seconds.

    timings: collector, seconds. evidence: collector, confidence. A side that has no row stays null, which is not 0.
    """
    a = timings.groupBy("collector").agg(F.count("*").alias("runs"), F.sum("seconds").alias("seconds"))
    b = evidence.groupBy("collector").agg(F.count("*").alias("evidence"), F.bround(F.avg("confidence"), 3).alias("confidence"))
    total = timings.agg(F.sum("seconds").alias("_total"))
    return a.join(b, "collector", "full_outer").join(F.broadcast(total)).withColumn("share", F.bround(F.col("seconds") / F.col("_total"), 4)).drop("_total")  # one row


def zero_filled(dimension: DataFrame, facts: DataFrame, key: str, fact_key: str) -> DataFrame:
    """The number of facts of each row of a dimension, 0 where there are none."""
    counts = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias("_n"))
    return dimension.join(counts, key, "left").withColumn("n", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def coverage(all_keys: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """One row: keys, covered ones and their percentage to two places."""
    marked = all_keys.select(key).distinct().join(covered.select(key).distinct().withColumn("_c", F.lit(True)), key, "left")
    out = marked.agg(F.count("*").alias("total"), F.count("_c").alias("covered"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.bround(100.0 * F.col("covered") / F.col("total"), 2)).otherwise(F.lit(0.0)))


def bursts(events: DataFrame, key: str, at: str, hours: int, least: int) -> DataFrame:
    """(key, window_start, n): tumbling windows in which a key has `least` rows or more."""
    return events.groupBy(F.window(at, f"{hours} hours").alias("w"), key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key, F.col("w.start").alias("window_start"), "n")
