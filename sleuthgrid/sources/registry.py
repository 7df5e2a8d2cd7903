"""Registries imported as editions: entries, their name keys and the account of the import, replaced together or not at all."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import canonical, name_keys

# Dispositions that are findings; all others, and words that nobody knows, are none.
FINDINGS = ["convicted", "pleaded_guilty", "pleaded_no_contest", "registry_listed", "civil_order"]
GIVEN = {"record_id": 120, "city": 80, "county": 80, "state": 2, "statute": 120, "citation": 400}
ENTRY = "entry_id string, source_id string, record_id string, name_raw string, name_canonical string, city string, county string, state string, offense string, statute string, disposition string, finding_date date, expires_at date, source_url string, citation string, first_seen_at timestamp, last_seen_at timestamp, removed_at timestamp, suppressed_at timestamp"
COUNTS = ["total", "stored", "not_finding", "invalid", "delisted", "relisted"]


class NothingValid(ValueError):
    """No row of a snapshot was a finding: it is a failed export, not a list that became empty."""


def _clean(c: Column | str, most: int) -> Column:
    return F.nullif(F.substring(F.btrim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " ")), 1, most), F.lit(""))


def checked_rows(rows: DataFrame, default_url: str, source_id: str, years: int | None = None) -> DataFrame:
    """rows (name, disposition, offense, finding_date, source_url and GIVEN; all text) cleaned, with entry_id and `verdict`: finding, not_a_finding or invalid.

    An entry's id is the source's record id, else a hash of what it says. A finding needs a name of two words, a
    disposition of FINDINGS, an offense and an http url.
    """
    clean = rows.select(
        *(_clean(c, n).alias(c) for c, n in GIVEN.items()), _clean("name", 160).alias("name_raw"), _clean("offense", 240).alias("offense"), F.coalesce(_clean("source_url", 1000), F.lit(default_url)).alias("source_url"),
        F.lower(F.regexp_replace(_clean("disposition", 40), "[ -]", "_")).alias("disposition"), F.to_date(F.try_to_timestamp(F.substring(_clean("finding_date", 40), 1, 10), F.lit("yyyy-MM-dd"))).alias("finding_date"),
    ).withColumns({"source_id": F.lit(source_id), "name_canonical": canonical(F.col("name_raw")), "state": F.upper("state"), "expires_at": F.add_months("finding_date", 12 * years) if years else F.lit(None).cast("date")})
    named = F.col("name_raw").isNotNull() & F.col("name_canonical").contains(" ") & F.col("disposition").isNotNull()
    whole = F.col("offense").isNotNull() & F.col("source_url").rlike("^https?://")
    verdict = F.when(~named, "invalid").when(~F.col("disposition").isin(FINDINGS), "not_a_finding").when(~whole, "invalid").otherwise("finding")
    said = F.concat_ws("|", "source_id", "name_canonical", F.lower("offense"), F.coalesce(F.col("finding_date").cast("string"), F.lit("")))
    return clean.withColumn("verdict", verdict).withColumn("entry_id", F.concat(F.lit(source_id + ":"), F.coalesce("record_id", F.concat(F.lit("h"), F.substring(F.sha1(said), 1, 16)))))


def fold(held: DataFrame, checked: DataFrame, source_id: str, at: Column, snapshot: bool = True) -> DataFrame:
    """The entries after an import of checked rows, with `_was`, whether each was removed before, and `_new`, whether the import has it.

    What the import has is listed, again if it was removed, with its latest fields; its first_seen_at and suppressed_at stay as they were.
    In a snapshot, what the source had and the import lacks is removed now. Entries of other sources stay. Of rows that
    repeat an entry the one with the least fields in order counts.
    """
    fields = [c for c in held.columns if c not in ("entry_id", "source_id", "first_seen_at", "last_seen_at", "removed_at", "suppressed_at")]
    fresh = checked.where("verdict = 'finding'").groupBy("entry_id").agg(F.min(F.struct(*fields)).alias("_f"))
    both = held.join(fresh, "entry_id", "full_outer")
    new = F.col("_f").isNotNull()
    gone = F.lit(snapshot) & (F.col("source_id") == source_id) & F.col("removed_at").isNull()
    out = {c: F.when(new, F.col(f"_f.{c}")).otherwise(F.col(c)) for c in fields} | {
        "source_id": F.coalesce("source_id", F.lit(source_id)), "first_seen_at": F.coalesce("first_seen_at", at), "last_seen_at": F.when(new, at).otherwise(F.col("last_seen_at")),
        "removed_at": F.when(~new, F.when(gone, at).otherwise(F.col("removed_at"))), "_was": F.col("removed_at").isNotNull(), "_new": new, "_gone": ~new & gone,
    }
    return both.select("entry_id", *(out.get(c, F.col(c)).alias(c) for c in held.columns if c != "entry_id"), *(out[c].alias(c) for c in ("_was", "_new", "_gone")))


def entries(spark: SparkSession, path: str, table: str = "entries") -> DataFrame:
    """A table of the edition in force; no rows before the first import."""
    try:
        pointer = spark.read.parquet(f"{path}/pointer").orderBy(F.desc("number")).limit(1).collect()
    except AnalysisException:
        return spark.createDataFrame([], ENTRY if table == "entries" else "key string, entry_id string")
    return spark.read.parquet(f"{path}/{pointer[0]['edition']}/{table}")


def import_registry(rows: DataFrame, path: str, source_id: str, default_url: str, *, snapshot: bool = True, years: int | None = None) -> dict[str, int]:
    """Fold rows into the registry at path and return COUNTS. The new edition's tables are written first, the pointer to it last, so a failed import changes none of them.

    Editions are numbered; two imports at once may both number theirs alike, and then one of them is in force: run one at a time.
    """
    spark = rows.sparkSession
    edition = f"edition-{uuid.uuid4().hex}"
    checked_rows(rows, default_url, source_id, years).write.parquet(f"{path}/{edition}/checked")
    checked = spark.read.parquet(f"{path}/{edition}/checked")
    told = {r["verdict"]: r["n"] for r in checked.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    total, stored = sum(told.values()), told.get("finding", 0)
    if snapshot and total and not stored:
        raise NothingValid(f"none of {total} rows of {source_id} is a finding: not taken as a list that became empty")
    now = F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
    fold(entries(spark, path), checked, source_id, now, snapshot).write.parquet(f"{path}/{edition}/folded")
    folded = spark.read.parquet(f"{path}/{edition}/folded")
    counts = folded.agg(F.count_if("_gone").alias("delisted"), F.count_if(F.col("_was") & F.col("_new")).alias("relisted")).first()
    folded.drop("_was", "_new", "_gone").write.parquet(f"{path}/{edition}/entries")
    folded.select(F.explode(name_keys(F.col("name_canonical"))).alias("key"), "entry_id").distinct().write.parquet(f"{path}/{edition}/keys")
    out = {"total": total, "stored": stored, "not_finding": told.get("not_a_finding", 0), "invalid": told.get("invalid", 0), "delisted": counts["delisted"], "relisted": counts["relisted"]}
    number = (spark.read.parquet(f"{path}/pointer").agg(F.max("number")).first()[0] if _any(spark, path) else 0) + 1
    spark.range(1).select(F.lit(edition).alias("edition"), F.lit(number).cast("long").alias("number"), now.alias("at"), F.lit(source_id).alias("source_id"), *(F.lit(v).cast("long").alias(k) for k, v in out.items())).coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return out


def _any(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(f"{path}/pointer").isEmpty()
    except AnalysisException:
        return False
