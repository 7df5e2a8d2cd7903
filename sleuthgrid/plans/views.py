"""Queries that join, page and show what is held, on analogues in the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import bare_host
from ..functions.network import address_key, is_eligible
from ..functions.rules import blockable
from ..operators import search, views
from ..tables import dealt, read, stage
from .catalog import Catalog

catalog = Catalog()


@catalog.query("""
SELECT o_orderkey AS report_id, c_name AS number, o_orderpriority AS category FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100
""")
def recent_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").alias("made"))
    numbers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("number"))
    return views.newest_joined(reports, numbers, ["k"], [F.desc("made"), F.col("report_id")], 100).select("report_id", "number", "category")


@catalog.query("""
SELECT l_orderkey, l_linenumber, s_name AS source FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 200
""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '1998-01-01'").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"), "l_shipdate")
    sources = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("source"))
    return views.newest_joined(items, sources, ["k"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 200).select("l_orderkey", "l_linenumber", "source")


@catalog.query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS held FROM customer")
def graph_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return views.membership(read(spark, sf_dir, "customer").select("c_custkey"), held, ["c_custkey"])


@catalog.query("""
SELECT c_custkey, s_suppkey AS cert FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND c_custkey % 3 > 0
""")
def certificate_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN 'zz' ELSE upper(regexp_replace(sha1(CAST(c_custkey AS string)), '(..)(?!$)', '$1:')) END").alias("print"))
    held = read(spark, sf_dir, "supplier").select(F.sha1(F.col("s_suppkey").cast("string")).alias("sha1"), F.col("s_suppkey").alias("cert"))
    return views.by_print(asked, held, "print").select("c_custkey", "cert")


@catalog.query("""
WITH h AS (SELECT DISTINCT CASE l_suppkey % 4 WHEN 0 THEN 'h' || l_suppkey || '.org' WHEN 1 THEN '11.0.' || (l_suppkey // 250) || '.' || (l_suppkey % 250) END AS host FROM lineitem)
SELECT host, host LIKE 'h%' AS is_domain FROM h WHERE host IS NOT NULL
""")
def blocklist_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'HTTP://H' || l_suppkey || '.org/x' WHEN 1 THEN '11.0.' || (l_suppkey div 250) || '.' || (l_suppkey % 250) || ':80' WHEN 2 THEN '10.0.0.1' ELSE 'localhost' END")
    listed = dealt(read(spark, sf_dir, "lineitem").select(raw.alias("raw")).distinct())  # each writing of a host is read once, however often it is listed
    hosts = stage(listed.select(bare_host(F.col("raw")).alias("host")).distinct(), "listed-hosts")  # written, else the tests below are worked out on what makes a host, over and over
    address = address_key(F.col("host")).isNotNull()
    kept = hosts.where(F.when(address, F.coalesce(is_eligible(F.col("host")), F.lit(False))).otherwise(blockable(F.col("host"), [], [".local"])))
    return kept.select("host", (~address).alias("is_domain"))


@catalog.query("""
WITH m(collector, type) AS (VALUES ('click', 'A'), ('click', 'N'), ('view', 'R'), ('search', 'Z'))
SELECT collector, count(*) AS n FROM lineitem JOIN m ON type = l_returnflag GROUP BY 1
""")
def supported_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"))
    return views.dispatched(entities, {"click": ["A", "N"], "view": ["R"], "search": ["Z"]}).groupBy("collector").agg(F.count("*").alias("n"))


@catalog.query("""
WITH r AS (SELECT o_custkey AS k, o_orderpriority AS category, o_orderdate AS made, o_orderstatus = 'P' AS hidden FROM orders), c AS (SELECT k, category, count(*) AS n FROM r WHERE NOT hidden GROUP BY ALL)
SELECT c_custkey AS k, coalesce((SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM c WHERE c.k = c_custkey), '') AS categories, c_custkey % 5 = 0 AS operator_only,
  coalesce((SELECT max(made) FROM r WHERE r.k = c_custkey AND NOT hidden) < TIMESTAMP '1998-01-01', false) AS stale FROM customer
""")
def public_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 5 == 0).alias("operator_only"))
    reports = read(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_orderpriority AS category", "o_orderdate AS made", "o_orderstatus = 'P' AS hidden")
    out = views.public_view(numbers, reports, "k", F.expr("timestamp_ntz '1998-01-01 00:00:00'"))
    return out.withColumn("categories", F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@catalog.query("""
SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 > 0 AND o_totalprice > 100000 ORDER BY place LIMIT 1000
""")
def active_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "O").alias("active"), (F.col("o_orderkey") % 3 == 0).alias("hidden"), (F.col("o_totalprice") > 100000).cast("int").alias("report_count"), F.col("o_orderdate").alias("last_report_at"))
    return views.active_listings(listings, "o_orderkey", 1000).select("o_orderkey", "o_custkey", "place")


@catalog.query("SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY source, doc_id LIMIT 20 OFFSET 40")
def paged_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source").orderBy("source", "doc_id").offset(40).limit(20)


@catalog.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def oldest_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@catalog.query("""
WITH m AS (SELECT l_suppkey AS query_id, l_partkey AS id, min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 4 END) AS s FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS place FROM m)
SELECT query_id, id, place FROM r WHERE place <= 5
""")
def ranked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.expr("CASE min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 4 END) WHEN 1 THEN 'exact' WHEN 3 THEN 'weak' ELSE 'surname' END")
    matches = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(strength.alias("strength"))
    return search.ranked(matches, "id", 5).select("query_id", "id", F.col("place").cast("long").alias("place"))


@catalog.query("SELECT user_id, bool_or(event_type = 'click') AS lookalikes, bool_or(event_type = 'purchase') AS breaches, bool_or(event_type = 'error' AND value > 100) AS probes FROM events GROUP BY 1")
def merged_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = read(spark, sf_dir, "events").selectExpr("user_id", "event_type = 'click' AS lookalikes", "event_type = 'purchase' AS breaches", "event_type = 'error' AND value > 100 AS probes")
    return views.merged_flags(flags, ["user_id"])


@catalog.query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS place, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name FROM customer
""")
def repaired_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'He was born in the town and lived there. Later he moved.' ELSE c_mktsegment END").alias("place"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'she is survived by two sons and a daughter who live nearby' ELSE c_name END").alias("name"))
    return views.without_prose(held, ["place", "name"])


@catalog.query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")
def observation_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.casebook import older_than

    return read(spark, sf_dir, "events").where(~older_than(F.col("ts"), 10, F.expr("timestamp_ntz '2024-01-20 00:00:00'"))).select("event_id")


@catalog.query("""
WITH w AS (SELECT o_custkey % 10 AS w, count(*) AS n FROM orders GROUP BY 1) SELECT w AS window, least(n, 50 + 100) AS cursor, n <= 50 + 100 AS exhausted FROM w
""")
def growth_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("window")).agg(F.count("*").alias("n"))
    cursors = sizes.select("window", F.lit(50).cast("long").alias("cursor"), F.lit(False).alias("exhausted"))
    return views.advanced(cursors, sizes, "window", 100)


@catalog.query("SELECT l_returnflag AS county, count(*) AS entries, count(DISTINCT l_partkey) AS names, max(l_orderkey) AS checkpoint FROM lineitem GROUP BY 1")
def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("county")).agg(F.count("*").alias("entries"), F.count_distinct("l_partkey").alias("names"), F.max("l_orderkey").alias("checkpoint"))
