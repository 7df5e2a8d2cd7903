"""Counts and orders that describe what is held: conditional counts, histograms, recounts, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stage


def status_counts(held: DataFrame, **conditions: Column) -> DataFrame:
    """One row: for each name how many rows fulfil its condition."""
    return held.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def histogram(held: DataFrame, value: Column, name: str, empty: str = "other") -> DataFrame:
    """(name, n) of each value; null and empty ones are `empty`."""
    return held.groupBy(F.coalesce(F.nullif(value, F.lit("")), F.lit(empty)).alias(name)).agg(F.count("*").alias("n"))


def recount(numbers: DataFrame, reports: DataFrame, votes: DataFrame, key: str) -> DataFrame:
    """Of each number report_count, first and last report (of reports that are neither retracted nor hidden), agree_count and disagree_count (votes of 1 and -1)."""
    live = reports.where("not retracted and not hidden").groupBy(key).agg(F.count("*").alias("report_count"), F.min("created_at").alias("first_report_at"), F.max("created_at").alias("last_report_at"))
    said = votes.groupBy(key).agg(F.count_if(F.col("value") == 1).alias("agree_count"), F.count_if(F.col("value") == -1).alias("disagree_count"))
    return numbers.select(key).join(live, key, "left").join(said, key, "left").fillna(0, ["report_count", "agree_count", "disagree_count"])


def top_values(rows: DataFrame, key: list[str], value: str, n: int) -> DataFrame:
    """Of each key its n most frequent values, most frequent first, then in the alphabet, as a list; null and empty values don't count."""
    counts = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*key, value).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_n"), value))
    return counts.withColumn("_place", place).where(F.col("_place") <= n).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", value))), lambda x: x[value]).alias("top"))


def complaint_summary(asked: DataFrame, complaints: DataFrame, key: str, subjects: int = 5) -> DataFrame:
    """Of each asked number complaints, robocalls, first and last date and its top subjects; 0 complaints means looked up and none held."""
    own = complaints.join(asked.select(key).distinct(), key, "left_semi")
    sums = own.groupBy(key).agg(F.count("*").alias("complaints"), F.count_if("robocall").alias("robocalls"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return asked.select(key).distinct().join(sums, key, "left").join(top_values(own, [key], "subject", subjects), key, "left").fillna(0, ["complaints", "robocalls"])


def newest_distinct(rows: DataFrame, value: Column, seen: str, name: str = "value") -> DataFrame:
    """The newest row of each value, letters in lower case; ties by the other columns."""
    keyed = rows.withColumn(name, F.lower(F.trim(value))).where(F.col(name) != "")
    rest = [c for c in keyed.columns if c not in (name, seen)]
    return keyed.groupBy(name).agg(F.max(F.struct(seen, *rest)).alias("_r")).select(name, "_r.*")


def sweep_order(sources: DataFrame, ingested: DataFrame, key: str, place: str) -> DataFrame:
    """sources with `turn`, 1 first: never ingested, then the longest ago, then those that were cut short, then in the registry's order. ingested: key, at, capped."""
    joined = sources.join(ingested.select(key, "at", "capped"), key, "left")
    order = [F.col("at").isNotNull(), F.col("at"), F.desc(F.coalesce("capped", F.lit(False))), F.col(place)]
    return joined.withColumn("turn", F.row_number().over(Window.orderBy(*order)))  # a registry of sources: some thousand rows


def charge_notes(notes: DataFrame, collectors: DataFrame, timeout: str, error: str) -> DataFrame:
    """Of each known collector how many notes tell of its timeouts and its errors. A note is tried as a timeout first; one that names none that is known is charged to nobody.

    timeout, error: patterns, fitting from the note's begin, whose first group is the collector. notes: note; collectors: collector.
    """
    late, wrong = F.regexp_extract("note", f"^(?:{timeout})", 1), F.regexp_extract("note", f"^(?:{error})", 1)
    named = notes.select(F.when(F.col("note").rlike(f"^(?:{timeout})"), late).otherwise(wrong).alias("collector"), F.col("note").rlike(f"^(?:{timeout})").alias("late")).where("collector <> ''")
    sums = named.groupBy("collector").agg(F.count_if("late").alias("timeouts"), F.count_if(~F.col("late")).alias("errors"))
    return collectors.select("collector").distinct().join(sums, "collector", "left").fillna(0, ["timeouts", "errors"])


def empty_runs(runs: DataFrame) -> DataFrame:
    """A signal for each run in which collectors ran and no entity was added: case_id, severity, kind, fingerprint (of the set of collectors). runs: case_id, collectors, collector_runs, entities_added."""
    names = F.array_join(F.array_sort(F.coalesce("collectors", F.array())), ",")
    names = F.when(names == "", "all").otherwise(names)
    quiet = runs.where("coalesce(collector_runs, 0) > 0 and coalesce(entities_added, 0) <= 0")
    return quiet.select("case_id", F.lit("S3").alias("severity"), F.lit("run_empty").alias("kind"), F.concat(F.lit("run_empty|"), names).alias("fingerprint"))


def requeued(jobs: DataFrame, seconds: int, now: Column) -> DataFrame:
    """jobs with those queued again that run since `seconds` or longer. Columns: status, started_at."""
    stale = (F.col("status") == "running") & (F.col("started_at") <= now - F.make_dt_interval(secs=F.lit(seconds)))
    return jobs.withColumn("status", F.when(stale, "queued").otherwise(F.col("status")))


def due(last: Column, seconds: int, now: Column) -> Column:
    """Whether a feed may be fetched again; one never fetched may."""
    return last.isNull() | (last <= now - F.make_dt_interval(secs=F.lit(seconds)))


def watch_changes(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Of each watched key with an earlier snapshot what came and what went, as sorted lists; keys without changes aren't named, first snapshots set the base alone."""
    old = before.groupBy(key).agg(F.collect_set(value).alias("_old"))
    new = now.groupBy(key).agg(F.collect_set(value).alias("_new"))
    both = old.join(new, key, "left").withColumn("_new", F.coalesce("_new", F.array().cast("array<string>")))
    changed = both.select(key, F.array_sort(F.array_except("_new", "_old")).alias("came"), F.array_sort(F.array_except("_old", "_new")).alias("went"))
    return changed.where((F.size("came") > 0) | (F.size("went") > 0))


def recency_of_hosts(rows: DataFrame, host: Column, rank: str, at: str) -> DataFrame:
    """host, rank and at: each host once, with its lowest rank and the newest time that it has under that."""
    each = rows.groupBy(host.alias("host"), rank).agg(F.max(at).alias(at))
    return each.groupBy("host").agg(F.min_by(F.struct(rank, at), rank).alias("_x")).select("host", f"_x.{rank}", f"_x.{at}")


def placed(rows: DataFrame, by: list[Column], name: str) -> DataFrame:
    """rows with their place, from 1, in the order of `by`, which has to tell all rows apart. Ranges of the order are numbered each for itself, after the sizes of those before."""
    parts = stage(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "placed")  # written, as ranges are drawn anew each time
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before")
