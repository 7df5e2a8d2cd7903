"""Merging of observations, snapshots and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_known(value: Column, order: Column) -> Column:
    """Aggregate: the first value in order that isn't null."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def last_known(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def upsert(observations: DataFrame, key: list[str], order: Column, *, most: list[str] = (), least: list[str] = (), first: list[str] = (), last: list[str] = (), any_: list[str] = ()) -> DataFrame:
    """One row for each key, merged over its observations by the rule of each column. The order is explicit, so arrival doesn't matter."""
    rules = [F.max(c).alias(c) for c in most] + [F.min(c).alias(c) for c in least] + [F.bool_or(c).alias(c) for c in any_]
    rules += [first_known(F.col(c), order).alias(c) for c in first] + [last_known(F.col(c), order).alias(c) for c in last]
    return observations.groupBy(*key).agg(F.count("*").alias("n_observations"), *rules)


def reconcile(held: DataFrame, incoming: DataFrame, key: str, active: str = "active") -> DataFrame:
    """What a source's new snapshot does to the rows held: key and status added, refreshed, relisted, delisted or gone (inactive before and absent still)."""
    old = held.groupBy(F.col(key)).agg(F.bool_or(active).alias("_active"))
    new = incoming.select(key).distinct().withColumn("_new", F.lit(True))
    both = old.join(new, key, "full_outer")
    status = F.when(F.col("_active").isNull(), "added").when(F.col("_new") & F.col("_active"), "refreshed").when(F.col("_new"), "relisted").when(F.col("_active"), "delisted").otherwise("gone")
    return both.select(key, status.alias("status"))


def collapse_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges (source, target, rel) with dropped nodes replaced by those kept, without loops and repeats. aliases: drop, keep."""
    out = edges
    for end in ("source", "target"):
        out = out.join(aliases.select(F.col("drop").alias(end), F.col("keep").alias("_keep")), end, "left").withColumn(end, F.coalesce("_keep", end)).drop("_keep")
    return out.where("source <> target").select("source", "target", "rel").distinct()


def latest(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The n first rows of each key in order, numbered `nth`. Spark limits each key before the shuffle, so hot keys stay small."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("nth") <= n)


def latest_and_previous(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """Of each key the latest value, the one before it and their difference (null without one before)."""
    two = latest(df, key, order, 2).groupBy(*key).agg(F.max(F.when(F.col("nth") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("nth") == 2, F.col(value))).alias("previous"))
    return two.withColumn("delta", F.col("latest") - F.col("previous"))


def set_changes(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, change) with change added or removed, for values that only one of two snapshots has."""
    columns = [*key, value]
    a = old.select(*columns).distinct().withColumn("_old", F.lit(True))
    b = new.select(*columns).distinct().withColumn("_new", F.lit(True))
    both = a.join(b, columns, "full_outer").where("_old is null or _new is null")
    return both.select(*columns, F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"))
