"""Entity, merge, score and verdict queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, names, scores
from ..operators import merge, search
from ..operators.summaries import coverage as covered_share
from ..tables import dealt, read
from .catalog import Catalog

catalog = Catalog()


def _since_cut() -> Column:
    return F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")


@catalog.query("""
WITH o AS (SELECT o_custkey AS k, max(o_orderdate < TIMESTAMP '1997-01-01') AS held FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
n AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT coalesce(o.k, n.k) AS o_custkey, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN CASE WHEN o.k % 5 = 0 THEN 'gone' ELSE 'delisted' END WHEN o.k % 5 = 0 THEN 'relisted' ELSE 'refreshed' END AS status FROM o FULL JOIN n ON o.k = n.k
""")
def snapshot_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    held = orders.where(~_since_cut()).select("o_custkey", (F.col("o_custkey") % 5 != 0).alias("active"))
    return merge.reconcile(held, orders.where(_since_cut()), "o_custkey")


@catalog.query("""
SELECT user_id, count(*) AS n_observations, max(value) AS value, min(ts) AS first_seen, max(ts) AS last_seen, bool_or(event_type = 'purchase') AS is_seed, arg_max(event_type, event_id) AS last_type, arg_min(props, event_id) AS first_props FROM events GROUP BY 1
""")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "events").select("user_id", "event_id", "value", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), (F.col("event_type") == "purchase").alias("is_seed"), F.col("event_type").alias("last_type"), F.col("props").alias("first_props"))
    return merge.upsert(seen, ["user_id"], F.col("event_id"), most=["value", "last_seen"], least=["first_seen"], any_=["is_seed"], last=["last_type"], first=["first_props"])


@catalog.query("""
SELECT c_custkey, c_name, count(*) AS contributions, round_even(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
""")
def contributor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("contributions"), F.bround(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))
    return sums.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")


@catalog.query("""
WITH o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, count(*) FILTER (o_orderstatus = 'F') AS strong FROM orders GROUP BY 1),
f AS (SELECT c_custkey, (c_custkey % 10)::DOUBLE / 10 AS base0, coalesce(kinds, 0) AS collectors, coalesce(n, 0) AS evidence, coalesce(strong, 0) AS strong, coalesce(n, 0) AS degree, c_custkey % 7 = 0 AS seed, CASE WHEN c_custkey % 101 = 0 THEN true WHEN c_custkey % 103 = 0 THEN false END AS verified FROM customer LEFT JOIN o ON o_custkey = c_custkey),
s AS (SELECT *, CASE WHEN base0 = 0 THEN 0.35 ELSE base0 END AS base FROM f),
x AS (SELECT c_custkey, CASE WHEN verified THEN 0.97 WHEN NOT verified THEN 0.05 ELSE greatest(0.01, least(0.99, 0.35::DOUBLE * base + 0.15::DOUBLE * 0.35 + 0.20::DOUBLE * CASE WHEN collectors > 0 THEN 0.85 ELSE 0.4 END + 0.10::DOUBLE * CASE WHEN collectors > 0 THEN 0.55 ELSE 0.4 END
  + least(0.15::DOUBLE, 0.04::DOUBLE * greatest(0, collectors - 1)) + least(0.10::DOUBLE, 0.02::DOUBLE * evidence) + least(0.12::DOUBLE, 0.025::DOUBLE * strong) + least(0.06::DOUBLE, 0.008::DOUBLE * degree) + CASE WHEN seed THEN 0.12 ELSE 0 END
  - CASE WHEN collectors = 0 AND NOT seed AND degree <= 1 THEN 0.12 ELSE 0 END - CASE WHEN collectors <= 1 AND NOT seed THEN 0.08 ELSE 0 END)) END AS score FROM s)
SELECT c_custkey, round_even(score, 6) AS score, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.35 THEN 'low' ELSE 'speculative' END AS band FROM x
""")
def score_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"), F.count_if(F.col("o_orderstatus") == "F").alias("strong"))
    c = read(spark, sf_dir, "customer").select("c_custkey").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n", "kinds", "strong"])
    no, key = F.lit(False), F.col("c_custkey")
    verified = F.when(key % 101 == 0, True).when(key % 103 == 0, False)
    factors = {
        "base": (key % 10).cast("double") / 10, "type": F.lit("person"), "max_trust": F.when(F.col("kinds") > 0, F.lit(0.85)), "mean_trust": F.when(F.col("kinds") > 0, F.lit(0.55)), "n_collectors": F.col("kinds"), "n_evidence": F.col("n"),
        "strong": F.col("strong"), "degree": F.col("n"), "same_as": F.lit(0), "is_seed": key % 7 == 0, "lookalike": no, "breached": no, "avatar": no, "only_presence": no, "disputed": no, "verified": verified,
    }
    scored = c.select("c_custkey", scores.entity_score(factors).alias("raw"))
    return scored.select("c_custkey", F.bround("raw", 6).alias("score"), scores.confidence_band(F.col("raw")).alias("band"))


@catalog.query("""
WITH p AS (SELECT l_partkey, l_suppkey, max(l_discount) AS w FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, count(*) AS providers, round_even(least(0.99, 1 - product(1 - w)), 6) AS combined FROM p GROUP BY 1
""")
def noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_provider = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("w"))
    return by_provider.groupBy("l_partkey").agg(F.count("*").alias("providers"), F.bround(scores.noisy_or(F.col("w")), 6).alias("combined"))


@catalog.query("""
WITH p AS (SELECT l_partkey, l_suppkey, max(CASE WHEN l_returnflag = 'R' THEN l_discount * 5 END) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_partkey, count(*) AS checked, count(w) AS listed, least(0.99, 1 - coalesce(product(1 - w), 1)) AS combined FROM p GROUP BY 1)
SELECT l_partkey, CASE WHEN listed > 0 THEN CASE WHEN combined >= 0.75 THEN 'malicious' ELSE 'suspicious' END WHEN checked > 0 THEN 'clean' ELSE 'unknown' END AS verdict, listed FROM c
""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_discount") * 5)).alias("w"))
    found = hits.groupBy("l_partkey").agg(F.count("*").alias("checked"), F.count("w").alias("listed"), scores.noisy_or(F.col("w")).alias("combined"))
    return found.select("l_partkey", scores.listing_verdict(F.col("combined"), F.col("listed"), F.col("checked")).alias("verdict"), "listed")


@catalog.query("""
WITH r AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') * 2.0::DOUBLE + count(*) FILTER (l_returnflag = 'A') * 0.5::DOUBLE AS spam, count(*) FILTER (l_returnflag = 'N')::DOUBLE AS legit, count(DISTINCT l_orderkey) AS reporters FROM lineitem GROUP BY 1),
s AS (SELECT *, CASE WHEN spam + legit > 0 THEN spam / (spam + legit) ELSE 0 END AS share, spam - legit AS score FROM r)
SELECT l_suppkey, CASE WHEN reporters = 0 THEN 'unknown' WHEN reporters = 1 THEN 'unconfirmed' WHEN spam > 0 AND legit > 0 AND share BETWEEN 0.3 AND 0.7 THEN 'disputed' WHEN score >= 5 AND share > 0.7 THEN 'likely_spam' WHEN score <= -3 AND share < 0.3 THEN 'likely_legit' ELSE 'mixed' END AS verdict FROM s
""")
def phone_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", 2.0).when(F.col("l_returnflag") == "A", 0.5).otherwise(0.0)).alias("spam"), F.count_if(F.col("l_returnflag") == "N").cast("double").alias("legit"), F.count_distinct("l_orderkey").alias("reporters"))
    return votes.select("l_suppkey", scores.phone_verdict(F.col("reporters"), F.col("spam"), F.col("legit")).alias("verdict"))


@catalog.query("SELECT o_orderkey, CASE WHEN o_totalprice / 500000 >= 0.85 THEN 'high' WHEN o_totalprice / 500000 >= 0.6 THEN 'medium' WHEN o_totalprice / 500000 >= 0.35 THEN 'low' ELSE 'speculative' END AS band FROM orders")
def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", scores.confidence_band(F.col("o_totalprice") / 500000).alias("band"))


@catalog.query("SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'AUTO%' THEN 'sentinel' WHEN c_mktsegment LIKE 'BUILD%' THEN 'reputation' WHEN c_mktsegment LIKE 'MACH%' THEN 'intent' ELSE 'other' END AS kind FROM customer")
def case_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_mktsegment")
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(s.startswith("AUTO"), "sentinel").when(s.startswith("BUILD"), "reputation").when(s.startswith("MACH"), "intent").otherwise("other").alias("kind"))


@catalog.query("""
SELECT conv_id, CASE max(CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 END) WHEN 1 THEN 'suggest_close' WHEN 2 THEN 'needs_analyst' ELSE 'escalate' END AS disposition FROM conversations GROUP BY 1
""")
def worst_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("role") == "system", "suggest_close").when(F.col("role") == "user", "needs_analyst").otherwise("escalate")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(scores.worst_disposition(d).alias("disposition"))


@catalog.query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'escalate' WHEN o_orderkey % 11 = 0 THEN 'needs_analyst' WHEN o_totalprice / 1000000 >= 0.465 THEN 'escalate' WHEN o_orderpriority LIKE '1%' OR o_totalprice / 1000000 > 0.115 THEN 'needs_analyst' ELSE 'suggest_close' END AS disposition FROM orders
""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    decided = scores.triage(F.col("o_orderstatus") == "P", no, F.col("o_orderkey") % 11 != 0, no, F.col("o_totalprice") / 1000000, F.col("o_orderpriority").startswith("1"))
    return read(spark, sf_dir, "orders").select("o_orderkey", decided.alias("disposition"))


@catalog.query("""
SELECT DISTINCT CASE WHEN l_suppkey % 4 = 3 THEN l_suppkey - 1 ELSE l_suppkey END AS source, l_partkey + 1000000000 AS target, l_returnflag AS rel FROM lineitem
""")
def alias_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1_000_000_000).alias("target"), F.col("l_returnflag").alias("rel"))
    aliases = read(spark, sf_dir, "supplier").where("s_suppkey % 4 = 3").select(F.col("s_suppkey").alias("drop"), (F.col("s_suppkey") - 1).alias("keep"))
    return merge.collapse_aliases(edges, aliases)


@catalog.query("SELECT sha256(coalesce(text, '')) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@catalog.query("""
WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1)
SELECT user_id, event_type, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, event_type, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def diff_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return merge.set_changes(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id"], "event_type")


@catalog.query("SELECT o_orderkey, o_orderdate::DATE AS day, o_orderdate::DATE < DATE '1997-01-01' AS expired, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') AS age_days FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = dates.any_date(text)
    return read(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), dates.expired(day, F.lit("1997-01-01").cast("date")).alias("expired"), dates.age_days(day, F.lit("1998-12-31").cast("date")).cast("long").alias("age_days"))


@catalog.query("SELECT count(DISTINCT n_nationkey) AS total, count(DISTINCT s_nationkey) AS covered, round_even(100.0::DOUBLE * count(DISTINCT s_nationkey) / count(DISTINCT n_nationkey), 2) AS percent FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered_share(read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


@catalog.query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@catalog.query("""
WITH n AS (SELECT c_custkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(p_name, '[^A-Za-z, ]+', ' ', 'g')), '[ ,]+'), lambda x: x <> '' AND x NOT IN ('jr','sr','ii','iii','iv','v','md','phd','dds','esq','jd','rn','dvm','do','cpa','mba')), ' ') AS norm FROM (SELECT p_partkey AS c_custkey, p_name FROM part)),
t AS (SELECT *, string_split(norm, ' ') AS ts FROM n WHERE norm <> '')
SELECT c_custkey AS p_partkey, norm, '~sn:' || ts[-1] AS surname_key, CASE WHEN len(ts) > 1 THEN ts[1][1] || ' ' || ts[-1] END AS initial_key FROM t
""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read(spark, sf_dir, "part").select("p_partkey", names.canonical(F.col("p_name")).alias("norm")).where("norm <> ''")
    tokens = F.split("norm", " ")
    keys = named.select("p_partkey", "norm", F.explode(names.name_keys(F.col("norm"))).alias("key"))
    wanted_last, wanted_first = F.concat(F.lit("~sn:"), F.element_at(tokens, -1)), F.concat_ws(" ", F.substring(F.element_at(tokens, 1), 1, 1), F.element_at(tokens, -1))
    return keys.groupBy("p_partkey", "norm").agg(F.max(F.when(F.col("key") == wanted_last, F.col("key"))).alias("surname_key"), F.max(F.when(F.col("key") == wanted_first, F.col("key"))).alias("initial_key"))


@catalog.query("""
WITH w AS (SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z]+', ' ', 'g')) AS n FROM supplier WHERE s_suppkey % 100 = 0), c AS (SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z]+', ' ', 'g')) AS n FROM customer)
SELECT 'q' || s.s_suppkey AS query_id, c.c_custkey AS id, 'exact' AS strength FROM w s JOIN c ON trim(s.n) = trim(c.n)
UNION ALL SELECT 'q' || a.s_suppkey, b.s_suppkey + 1000000000, 'exact' FROM w a JOIN (SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z]+', ' ', 'g')) AS n FROM supplier) b ON trim(a.n) = trim(b.n)
""")
def multi_key_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    suppliers = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.col("s_name").alias("name"))
    queries = read(spark, sf_dir, "supplier").where("s_suppkey % 100 = 0").select(F.concat(F.lit("q"), F.col("s_suppkey")).alias("query_id"), F.col("s_name").alias("query"))
    return search.search_names(search.name_index(dealt(customers.union(suppliers)), "id", "name"), queries, "id")
