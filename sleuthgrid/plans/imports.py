"""Queries of imports: a registry's edition after an import, and layers that were saved page by page, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import paged, registry
from ..tables import read
from .catalog import Catalog

catalog = Catalog()


@catalog.query("""
WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer), held AS (SELECT k, k % 6 = 0 AS removed, k % 10 = 0 AS suppressed FROM c WHERE k % 2 = 0),
rows_ AS (SELECT k, 'Cruelty in ' || seg AS offense, CASE WHEN k % 5 = 0 THEN 'not_a_finding' WHEN k % 7 = 0 THEN 'invalid' ELSE 'finding' END AS verdict FROM c WHERE k % 3 <> 0), new AS (SELECT * FROM rows_ WHERE verdict = 'finding')
SELECT 's:' || coalesce(held.k, new.k) AS entry_id, new.k IS NOT NULL AS listed, coalesce(suppressed, false) AS suppressed, new.k IS NOT NULL AND coalesce(removed, false) AS relisted, new.k IS NULL AND NOT removed AS delisted, coalesce(new.offense, 'Old') AS offense
FROM held FULL JOIN new USING (k)
""")
def registry_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("c_custkey"), F.lit("2024-01-01").cast("timestamp")
    customers = read(spark, sf_dir, "customer")
    id_ = F.concat(F.lit("s:"), k)
    given = {"entry_id": id_, "source_id": F.lit("s"), "offense": F.lit("Old"), "first_seen_at": at, "last_seen_at": at, "removed_at": F.when(k % 6 == 0, at), "suppressed_at": F.when(k % 10 == 0, at)}
    kinds = [f.split() for f in registry.ENTRY.split(", ")]
    held = customers.where("c_custkey % 2 = 0").select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds))
    none = F.lit(None).cast("string")
    rows = customers.where("c_custkey % 3 <> 0").select(
        F.when(k % 7 == 0, "Single").otherwise("Ann  Bee").alias("name"), F.when(k % 5 == 0, "Charged").otherwise("Pleaded-Guilty").alias("disposition"), F.concat(F.lit(" Cruelty  in "), "c_mktsegment").alias("offense"),
        none.alias("finding_date"), none.alias("source_url"), k.cast("string").alias("record_id"), *(none.alias(c) for c in ("city", "county", "state", "statute", "citation")),
    )
    folded = registry.fold(held, registry.checked_rows(rows, "https://r.example.org/", "s"), "s", F.lit("2024-02-01").cast("timestamp"))
    return folded.select("entry_id", F.col("removed_at").isNull().alias("listed"), F.col("suppressed_at").isNotNull().alias("suppressed"), (F.col("_was") & F.col("_new")).alias("relisted"), F.col("_gone").alias("delisted"), "offense")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("owner"))
    feature = F.struct(F.struct(F.col("n").alias("id"), "owner").alias("attributes"))
    pages = orders.groupBy(F.floor(F.col("n") / 500).alias("p")).agg(F.array_sort(F.collect_list(feature)).alias("features"))
    body = F.when(F.col("p") % 7 == 5, '{"error": {"code": 500}}').otherwise(F.to_json(F.struct("features")))
    return pages.where("p % 7 <> 3").select(F.lit("orders").alias("layer"), (F.col("p") * 500).alias("offset"), body.alias("body"))


_PAGED = "WITH o AS (SELECT o_orderkey AS n, o_orderkey // 500 AS p, o_orderstatus AS owner FROM orders)"


@catalog.query(_PAGED + """
, e AS (SELECT DISTINCT p * 500 AS first, CASE WHEN p % 7 = 3 THEN 'missing' ELSE 'error 500' END AS what FROM o WHERE p % 7 IN (3, 5))
SELECT 'orders' AS layer, (SELECT count(*) FROM o WHERE p % 7 NOT IN (3, 5)) AS rows, (SELECT count(*) FROM o) AS reported_total, false AS capped, coalesce((SELECT list(first || ' ' || what ORDER BY first) FROM e), []) AS errors
""")
def paged_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = read(spark, sf_dir, "orders").agg(F.count("*").alias("reported_total")).select(F.lit("orders").alias("layer"), "reported_total")
    account = paged.paged_account(_pages(spark, sf_dir), totals, ["layer"], 500)
    return account.withColumn("errors", F.transform("errors", lambda e: F.concat(e["offset"].cast("string"), F.lit(" "), e["what"])))


@catalog.query("SELECT o_orderkey AS row, o_orderkey AS id, o_orderstatus AS owner FROM orders WHERE o_orderkey // 500 % 7 NOT IN (3, 5)")
def paged_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged.paged_rows(_pages(spark, sf_dir), ["layer"], "id long, owner string").drop("layer")
