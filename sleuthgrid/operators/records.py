"""Lookups into record tables, and the rules by which records are kept, merged, shown and alerted on.

A lookup keeps rows that find nothing, with nulls: not found differs from zero or clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import parents
from .merge import latest


def suffixes(hosts: DataFrame, rules: DataFrame, host: str) -> DataFrame:
    """(host, public_suffix, registrable) of each distinct host of two labels or more.

    rules: rule, kind (rule, wildcard or exception, without their marks). An exception's parent wins;
    else the longest fit, where a wildcard takes one more label. registrable is null where the host is
    itself a suffix, and both are null where no rule fits.
    """
    names = hosts.select(F.rtrim(F.lower(F.trim(F.col(host))), F.lit(".")).alias("host")).where("instr(host, '.') > 0").distinct()
    each = names.select("host", F.posexplode(parents(F.col("host"))).alias("_at", "rule"))
    hits = each.join(rules.select("rule", "kind"), "rule")
    labels = F.size(F.split("rule", r"\."))
    size = F.when(F.col("kind") == "exception", labels - 1).when(F.col("kind") == "wildcard", labels + 1).otherwise(labels)
    fits = hits.withColumn("_n", size).where("kind <> 'wildcard' or _at > 0")
    best = fits.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("kind") == "exception", F.col("_n"))), F.max("_n")).alias("_n"))
    parts = F.split("host", r"\.")
    tail = lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    named = F.when(F.col("_n") > 0, F.col("_n"))
    return names.join(best, "host", "left").select("host", F.when(named.isNotNull(), tail(F.col("_n"))).alias("public_suffix"), F.when(named < F.size(parts), tail(F.col("_n") + 1)).alias("registrable"))


def labels_of(addresses: DataFrame, labels: DataFrame, *, delisted: bool = False) -> DataFrame:
    """addresses (chain, address) with n_labels, top_tag and confidence of the labels in force; also those delisted if asked for.

    A label fits by chain and by the address as written or in lower case; addresses without one have nulls.
    """
    held = labels if delisted else labels.where("active")
    asked = addresses.select("chain", "address").distinct()
    forms = asked.select("chain", "address", F.explode(F.array_distinct(F.array(F.trim("address"), F.lower(F.trim("address"))))).alias("_form"))
    hits = forms.withColumn("_chain", F.lower(F.trim("chain"))).join(held.select(F.col("chain").alias("_chain"), F.col("address").alias("_form"), "tag", F.col("confidence").alias("_c")), ["_chain", "_form"])
    found = hits.groupBy("chain", "address").agg(F.count("*").alias("n_labels"), F.max_by("tag", F.struct("_c", "tag")).alias("top_tag"), F.max("_c").alias("confidence"))
    return asked.join(found, ["chain", "address"], "left")


def scores_of(wanted: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """wanted with score and percentile of a vulnerability, null where none is held."""
    key = F.upper(F.trim(F.col(column)))
    return wanted.withColumn("_cve", key).join(scores.select(F.col("cve").alias("_cve"), "score", "percentile"), "_cve", "left").drop("_cve")


def known_urls(urls: DataFrame, held: DataFrame, column: str, held_column: str = "url") -> DataFrame:
    """Rows whose url is held, slashes at the end aside."""
    bare = lambda c: F.rtrim(F.col(c), F.lit("/"))
    return urls.withColumn("_u", bare(column)).join(held.select(bare(held_column).alias("_u")), "_u", "left_semi").drop("_u")


def absent(held: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The rows of incoming whose key isn't held, one for each key."""
    return incoming.join(held.select(*key), key, "left_anti").dropDuplicates(key)


def publishable(entries: DataFrame, disputes: DataFrame, today: Column) -> DataFrame:
    """Entries neither removed, suppressed nor expired, and without an open dispute. disputes: entry_id, status."""
    shown = entries.where(F.col("removed_at").isNull() & F.col("suppressed_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > today)))
    return shown.join(disputes.where("status = 'open'").select("entry_id"), "entry_id", "left_anti")


def orphaned(runs: DataFrame, jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Runs that began by the cutoff and still run, though their case has no active job."""
    return runs.where((F.col("status") == "running") & (F.col("started_at") <= cutoff)).join(jobs.where("status in ('queued', 'running')").select("case_id"), "case_id", "left_anti")


def merge_seeds(seeds: DataFrame) -> DataFrame:
    """(type, value, confidence, include, sources) of seeds with type, value, confidence, include, source.

    Confidence is the greatest. A seed repeated is included from .55 if one says so or it reaches .7;
    weak people (.75), handles of unknown platforms (.7) and seeds under .55 are left out.
    """
    merged = seeds.groupBy("type", "value").agg(F.max("confidence").alias("_c"), F.bool_or("include").alias("_i"), F.count("*").alias("_n"), F.array_sort(F.collect_set("source")).alias("sources"))
    include = F.when((F.col("_n") > 1) & (F.col("_c") >= 0.55), F.col("_i") | (F.col("_c") >= 0.7)).otherwise(F.col("_i"))
    weak = (F.col("_c") < 0.55) | ((F.col("type") == "person") & (F.col("_c") < 0.75)) | ((F.col("type") == "username") & F.col("value").startswith("unknown:") & (F.col("_c") < 0.7))
    return merged.select("type", "value", F.bround("_c", 2).alias("confidence"), (include & ~weak).alias("include"), "sources")


def incident_ledger(events: DataFrame, key: list[str], at: str, detail: str) -> DataFrame:
    """One row for each fingerprint: its count, first and last time, and the last detail that isn't empty."""
    given = F.when(F.coalesce(F.col(detail), F.lit("")) != "", F.struct(at, detail))
    return events.groupBy(*key).agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max(given)[detail].alias("detail"))


def incident_alerts(events: DataFrame, key: list[str], order: list[Column], escalate_at: int = 10) -> DataFrame:
    """The events that speak: the first of each fingerprint and the one that reaches escalate_at, numbered `nth`.

    Only the first escalate_at of a key leave a task, so a hot fingerprint stays small.
    """
    return latest(events, key, order, escalate_at).where(F.col("nth").isin(1, escalate_at))


def transfer_alerts(transfers: DataFrame, labels: DataFrame, services: DataFrame) -> DataFrame:
    """Transfers (chain, sender, receiver and others) with a label on an end, with severity, direction and whether a mixer is met.

    A label triggers, a service alone doesn't; S2 where an end is a mixer, else S3. Works on streams,
    as labels and services are static. Both are grouped first, so no transfer is repeated.
    """
    tags = labels.where("active").groupBy("chain", F.lower("address").alias("_a")).agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    mixers = services.where("kind = 'mixer'").select("chain", F.lower("address").alias("_a"), F.lit(True).alias("_mixer")).distinct()
    out = transfers
    for end in ("sender", "receiver"):
        renamed = lambda d, c: d.select("chain", F.col("_a").alias(f"_{end}"), F.col(c).alias(f"{c}_{end}"))  # noqa: B023, E731
        out = out.withColumn(f"_{end}", F.lower(F.trim(end))).join(renamed(tags, "_tags"), ["chain", f"_{end}"], "left").join(renamed(mixers, "_mixer"), ["chain", f"_{end}"], "left").drop(f"_{end}")
    hit = out.where("_tags_sender is not null or _tags_receiver is not null")
    mixed = F.coalesce("_mixer_sender", F.lit(False)) | F.coalesce("_mixer_receiver", F.lit(False))
    sent = F.col("_tags_sender").isNotNull()
    return hit.select(*transfers.columns, F.when(mixed, "S2").otherwise("S3").alias("severity"), F.when(sent, "sent").otherwise("received").alias("direction"), mixed.alias("mixer_involved"), F.array_join(F.coalesce("_tags_sender", "_tags_receiver"), ", ").alias("tags"))


def touched_services(pairs: DataFrame, services: DataFrame, address: str) -> DataFrame:
    """pairs with the names of the services at an address, null where there is none."""
    held = services.groupBy("chain", F.lower("address").alias("_a")).agg(F.array_sort(F.collect_set("name")).alias("services"))
    return pairs.withColumn("_a", F.lower(F.trim(address))).join(held, ["chain", "_a"], "left").drop("_a")


def transfers_of(transfers: DataFrame, address: str) -> DataFrame:
    """Transfers from or to an address."""
    return transfers.where((F.col("sender") == address) | (F.col("receiver") == address))
