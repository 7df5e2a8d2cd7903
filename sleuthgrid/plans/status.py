"""Queries of counts, recency and signals, on analogues in the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import status
from ..tables import read
from .catalog import Catalog

catalog = Catalog()
NOW = "timestamp_ntz '1998-06-01 00:00:00'"


@catalog.query("""
WITH r AS (SELECT l_suppkey AS k, l_shipdate AS made, l_returnflag = 'R' AS retracted, l_quantity > 45 AS hidden FROM lineitem), v AS (SELECT l_suppkey AS k, CASE WHEN l_discount > 0.06 THEN 1 WHEN l_discount < 0.03 THEN -1 ELSE 0 END AS v FROM lineitem),
a AS (SELECT k, count(*) AS n, min(made) AS f, max(made) AS l FROM r WHERE NOT retracted AND NOT hidden GROUP BY 1), b AS (SELECT k, count(*) FILTER (v = 1) AS yes, count(*) FILTER (v = -1) AS no FROM v GROUP BY 1)
SELECT s_suppkey AS phone_id, coalesce(n, 0) AS report_count, f AS first_report_at, l AS last_report_at, coalesce(yes, 0) AS agree_count, coalesce(no, 0) AS disagree_count FROM supplier LEFT JOIN a ON a.k = s_suppkey LEFT JOIN b ON b.k = s_suppkey
""")
def phone_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    reports = lines.selectExpr("l_suppkey AS phone_id", "l_shipdate AS created_at", "l_returnflag = 'R' AS retracted", "l_quantity > 45 AS hidden")
    votes = lines.selectExpr("l_suppkey AS phone_id", "CASE WHEN l_discount > 0.06 THEN 1 WHEN l_discount < 0.03 THEN -1 ELSE 0 END AS value")
    return status.recount(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("phone_id")), reports, votes, "phone_id")


@catalog.query("""
WITH asked AS (SELECT c_custkey AS number FROM customer WHERE c_custkey % 2 = 0), c AS (SELECT o_custkey AS number, o_orderdate AS made, o_orderstatus = 'F' AS robocall, o_orderpriority AS subject FROM orders),
t AS (SELECT number, subject, row_number() OVER (PARTITION BY number ORDER BY count(*) DESC, subject) AS p FROM c GROUP BY number, subject), l AS (SELECT number, string_agg(subject, '|' ORDER BY p) AS top FROM t WHERE p <= 3 GROUP BY 1)
SELECT asked.number, count(made) AS complaints, count(*) FILTER (robocall) AS robocalls, min(made) AS first_at, max(made) AS last_at, any_value(top) AS top FROM asked LEFT JOIN c ON c.number = asked.number LEFT JOIN l ON l.number = asked.number GROUP BY 1
""")
def complaint_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("number"))
    complaints = read(spark, sf_dir, "orders").selectExpr("o_custkey AS number", "o_orderdate AS at", "o_orderstatus = 'F' AS robocall", "o_orderpriority AS subject")
    return status.complaint_summary(asked, complaints, "number", 3).withColumn("top", F.array_join("top", "|"))


@catalog.query("""
SELECT count(*) FILTER (l_returnflag = 'A') AS active, count(*) FILTER (l_returnflag = 'R') AS delisted, count(*) FILTER (l_linestatus = 'O' AND l_tax > 0.02) AS disputed, count(DISTINCT l_partkey) AS names FROM lineitem
""")
def registry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    counts = status.status_counts(lines, active=F.col("l_returnflag") == "A", delisted=F.col("l_returnflag") == "R", disputed=(F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.02))
    return counts.crossJoin(lines.agg(F.count_distinct("l_partkey").alias("names")))  # two single rows


@catalog.query("SELECT l_returnflag AS chain, count(*) FILTER (l_linestatus = 'O') AS active, count(*) FILTER (l_linestatus <> 'O') AS delisted FROM lineitem GROUP BY 1")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.col("l_linestatus") == "O"
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chain")).agg(F.count_if(active).alias("active"), F.count_if(~active).alias("delisted"))


@catalog.query("SELECT coalesce(nullif(CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '' ELSE source END, ''), 'other') AS type, count(*) AS n FROM documents GROUP BY 1")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.histogram(read(spark, sf_dir, "documents"), F.expr("CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '' ELSE source END"), "type")


@catalog.query("""
SELECT c_mktsegment AS layer, count(*) AS n FROM customer WHERE CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END IS NULL GROUP BY 1
""")
def unresolved_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.expr("CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END")
    return read(spark, sf_dir, "customer").where(region.isNull()).groupBy(F.col("c_mktsegment").alias("layer")).agg(F.count("*").alias("n"))


@catalog.query("SELECT n_regionkey AS region, round_even(avg(n_nationkey), 6) AS lat, round_even(avg(n_nationkey * 2 - 10), 6) AS lon FROM nation GROUP BY 1")
def region_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.bround(F.avg("n_nationkey"), 6).alias("lat"), F.bround(F.avg(F.col("n_nationkey") * 2 - 10), 6).alias("lon"))


@catalog.query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS counties, max(o_orderdate) AS last_at FROM orders GROUP BY 1")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("counties"), F.max("o_orderdate").alias("last_at"))


@catalog.query("""
WITH s AS (SELECT c_nationkey, count(*) AS counties, count(*) FILTER (c_acctbal > 5000) AS deep, count(*) FILTER (c_acctbal > 9000) > 0 AS pack FROM customer GROUP BY 1)
SELECT CAST(sum(counties) AS BIGINT) AS counties, count(*) FILTER (pack) AS packs, CAST(sum(deep) AS BIGINT) AS deep, CAST(greatest(0, sum(counties) - sum(deep)) AS BIGINT) AS open FROM s
""")
def county_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("counties"), F.count_if(F.col("c_acctbal") > 5000).alias("deep"), (F.count_if(F.col("c_acctbal") > 9000) > 0).alias("pack"))
    return states.agg(F.sum("counties").alias("counties"), F.count_if("pack").alias("packs"), F.sum("deep").alias("deep"), F.greatest(F.lit(0), F.sum("counties") - F.sum("deep")).alias("open"))


@catalog.query("SELECT 'x' AS platform, coalesce(sum(value) FILTER (event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-03'), 0) AS spend, coalesce(sum(value) FILTER (event_type = 'unheard'), 0) AS none FROM events")
def spend_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0))
    out = read(spark, sf_dir, "events").agg(of((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz"))).alias("spend"), of(F.col("event_type") == "unheard").alias("none"))
    return out.select(F.lit("x").alias("platform"), "*")


@catalog.query("SELECT DISTINCT CAST(ts AS DATE) AS day FROM events")
def ingested_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()


@catalog.query("""
SELECT value, ts, event_id FROM (SELECT 'h' || user_id || '.org' AS value, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'view') WHERE n = 1
""")
def newest_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("event_type <> 'view'").select(F.expr("CASE WHEN event_id % 2 = 0 THEN ' H' ELSE 'h' END || user_id || '.Org'").alias("host"), "ts", "event_id")
    return status.newest_distinct(rows, F.col("host"), "ts").select("value", "ts", "event_id")


@catalog.query("""
WITH h AS (SELECT 'h' || l_suppkey AS host, 0 AS r, l_shipdate AS made FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'h' || l_suppkey, 1, l_shipdate FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT host, min(r) AS r, max(made) FILTER (r = 0) AS a, max(made) FILTER (r = 1) AS b FROM h GROUP BY 1)
SELECT host, r, CASE WHEN r = 0 THEN a ELSE b END AS seen_at, row_number() OVER (ORDER BY r, CASE WHEN r = 0 THEN a ELSE b END DESC, host) AS place FROM b
""")
def recent_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')").select(F.expr("'h' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN ':80' ELSE '' END").alias("host"), F.expr("CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END").alias("r"), F.col("l_shipdate").alias("at"))
    recent = status.recency_of_hosts(lines, F.regexp_replace("host", r":\d+$", ""), "r", "at").withColumnRenamed("at", "seen_at")
    return status.placed(recent, [F.col("r"), F.desc("seen_at"), F.col("host")], "place")


@catalog.query("""
WITH i AS (SELECT o_custkey % 40 AS k, max(o_orderdate) AS made, bool_or(o_orderstatus = 'P') AS capped FROM orders WHERE o_custkey % 3 > 0 AND o_custkey % 40 < 30 GROUP BY 1)
SELECT n_nationkey AS source, row_number() OVER (ORDER BY made IS NOT NULL, CAST(made AS DATE), capped DESC NULLS LAST, n_nationkey) AS turn FROM nation LEFT JOIN i ON k = n_nationkey * 2
""")
def sweep_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ingested = read(spark, sf_dir, "orders").where("o_custkey % 3 > 0 and o_custkey % 40 < 30").groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.max("o_orderdate").cast("date").alias("at"), F.bool_or(F.col("o_orderstatus") == "P").alias("capped"))
    sources = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") * 2).cast("long").alias("k"))
    return status.sweep_order(sources, ingested, "k", "source").select("source", F.col("turn").cast("long").alias("turn"))


@catalog.query("""
WITH p AS (SELECT p_partkey, p_retailprice FROM part WHERE p_size > 10) SELECT o_orderkey % 500 AS cve, max(p_retailprice) AS score FROM orders JOIN p ON p_partkey = o_orderkey % 500 GROUP BY 1 ORDER BY score DESC, cve LIMIT 10
""")
def top_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 500).alias("cve")).distinct()
    held = read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("cve"), F.col("p_retailprice").alias("score"))
    return asked.join(held, "cve").orderBy(F.desc("score"), "cve").limit(10)


@catalog.query("""
WITH n AS (SELECT CASE event_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'stranger' END AS c, event_id % 3 = 0 AS late FROM events WHERE event_id % 4 < 3)
SELECT k.c AS collector, count(*) FILTER (late) AS timeouts, count(*) FILTER (NOT late) AS errors FROM (SELECT DISTINCT event_type AS c FROM events) k LEFT JOIN n ON n.c = k.c GROUP BY 1
""")
def charged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    name = "CASE event_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'stranger' END"
    notes = events.selectExpr(f"coalesce({name} || CASE WHEN event_id % 3 = 0 THEN ': timed out after 45s' ELSE ': error: no answer' END, 'a note of another kind') AS note")
    return status.charge_notes(notes, events.select(F.col("event_type").alias("collector")), r"([a-z_]+): timed out", r"([a-z_]+): error")


@catalog.query("""
SELECT o_custkey AS case_id, 'S3' AS severity, 'run_empty' AS kind, 'run_empty|' || coalesce(string_agg(DISTINCT CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END, ',' ORDER BY CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END), 'all') AS fingerprint
FROM orders GROUP BY 1 HAVING count(*) % 4 > 0 AND count(*) FILTER (o_orderstatus = 'P') = 0
""")
def empty_run_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.collect_set(F.expr("CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END")).alias("collectors"), (F.count("*") % 4).alias("collector_runs"), F.count_if(F.col("o_orderstatus") == "P").alias("entities_added"))
    return status.empty_runs(runs)


@catalog.query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderdate <= TIMESTAMP '1998-06-01' - INTERVAL 86400 SECOND THEN 'queued' ELSE 'running' END ELSE 'done' END AS status,
  NULLIF(o_orderstatus, 'P') IS NULL OR o_orderdate <= TIMESTAMP '1998-06-01' - INTERVAL 2592000 SECOND AS due FROM orders
""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'done' END AS status", "o_orderdate AS started_at", "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS fetched_at")
    return status.requeued(jobs, 86400, F.expr(NOW)).select("o_orderkey", "status", status.due(F.col("fetched_at"), 2592000, F.expr(NOW)).alias("due"))


@catalog.query("""
WITH o AS (SELECT DISTINCT l_suppkey AS k, 'v' || l_partkey % 9 AS v FROM lineitem WHERE l_linenumber < 4 AND l_suppkey % 5 > 0), n AS (SELECT DISTINCT l_suppkey AS k, 'v' || l_partkey % 9 AS v FROM lineitem WHERE l_linenumber > 5 AND l_suppkey % 7 > 0),
w AS (SELECT DISTINCT k FROM o), c AS (SELECT k, string_agg(v, ',' ORDER BY v) AS s FROM (SELECT * FROM n EXCEPT SELECT * FROM o) GROUP BY 1), g AS (SELECT k, string_agg(v, ',' ORDER BY v) AS s FROM (SELECT * FROM o EXCEPT SELECT * FROM n) GROUP BY 1)
SELECT w.k AS watched, coalesce(c.s, '') AS came, coalesce(g.s, '') AS went FROM w LEFT JOIN c ON c.k = w.k LEFT JOIN g ON g.k = w.k WHERE c.s IS NOT NULL OR g.s IS NOT NULL
""")
def watch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("watched"), F.concat(F.lit("v"), F.col("l_partkey") % 9).alias("v"), "l_linenumber")
    found = status.watch_changes(lines.where("l_linenumber < 4 and watched % 5 > 0"), lines.where("l_linenumber > 5 and watched % 7 > 0"), "watched", "v")
    return found.select("watched", F.array_join("came", ",").alias("came"), F.array_join("went", ",").alias("went"))


@catalog.query("SELECT ps.l_suppkey AS port, n_name AS service FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) ps LEFT JOIN nation ON n_nationkey = ps.l_suppkey AND ps.l_returnflag = 'R' WHERE ps.l_returnflag <> 'N'")
def port_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_suppkey").alias("port"), F.col("l_returnflag").alias("proto")).distinct()
    held = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("port"), F.lit("R").alias("proto"), F.col("n_name").alias("service"))
    return asked.join(held, ["port", "proto"], "left").select("port", "service")


@catalog.query("""
WITH g AS (SELECT DISTINCT 'h' || o_custkey AS ip FROM orders WHERE o_orderstatus = 'P'), f AS (SELECT DISTINCT 'h' || c_custkey AS ip, c_acctbal AS made FROM customer)
SELECT ip FROM f WHERE ip NOT IN (SELECT ip FROM g) ORDER BY made DESC, ip LIMIT 40
""")
def corpus_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("h"), "o_custkey").alias("ip")).distinct()
    feed = read(spark, sf_dir, "customer").select(F.concat(F.lit("h"), "c_custkey").alias("ip"), F.col("c_acctbal").alias("at"))
    return feed.join(held, "ip", "left_anti").orderBy(F.desc("at"), "ip").limit(40).select("ip")
