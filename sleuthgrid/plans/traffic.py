"""Traffic, health and detection queries over events, orders and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, web
from ..operators import summaries
from ..operators.merge import latest, latest_and_previous
from ..streaming.detector import window_counts
from ..tables import read
from .catalog import Catalog

catalog = Catalog()


@catalog.query("""
SELECT count(*) FILTER (event_type <> 'error') AS total, count(*) AS all_rows, count(DISTINCT user_id) FILTER (event_type <> 'error') AS visitors,
  round_even((count(*) - count(*) FILTER (event_type <> 'error'))::DOUBLE / count(*), 4) AS bot_share FROM events
""")
def traffic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.traffic(read(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error")


@catalog.query("SELECT coalesce(event_type, '(none)') AS event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.top(read(spark, sf_dir, "events"), "event_type", 3, "(none)")


@catalog.query("""
WITH t AS (SELECT event_type AS collector, count(*) AS runs, sum((props->>'$.k')::BIGINT)::BIGINT AS seconds FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
e AS (SELECT event_type AS collector, count(*) AS evidence, round_even(avg(event_id % 2), 3) AS confidence FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT coalesce(t.collector, e.collector) AS collector, runs, seconds, evidence, confidence, round_even(seconds::DOUBLE / (SELECT sum(seconds) FROM t), 4) AS share FROM t FULL JOIN e ON t.collector = e.collector
""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    timings = events.where("event_id % 3 <> 0").select(F.col("event_type").alias("collector"), F.get_json_object("props", "$.k").cast("long").alias("seconds"))
    evidence = events.where("user_id % 2 = 0").select(F.col("event_type").alias("collector"), (F.col("event_id") % 2).alias("confidence"))
    return summaries.scorecard(timings, evidence)


@catalog.query("SELECT key AS key, count(*) AS n, sum((props->>('$.' || key))::BIGINT)::BIGINT AS total FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def json_map_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")))
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@catalog.query("""
SELECT user_id, time_bucket(INTERVAL 24 hours, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3
""")
def sentinel_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.bursts(read(spark, sf_dir, "events"), "user_id", "ts", 24, 3)


@catalog.query("""
WITH b AS (SELECT user_id, time_bucket(INTERVAL 24 hours, ts, TIMESTAMP '1970-01-01') AS w, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT user_id, w AS window_start, n FROM b WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'purchase' AND e.ts < b.w AND e.ts >= b.w - INTERVAL 7 days)
""")
def cooldown_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("ts").alias("bought"))
    near = (F.col("user_id") == F.col("buyer")) & (F.col("bought") < F.col("window_start")) & (F.col("bought") >= F.col("window_start") - F.expr("interval 7 days"))
    return summaries.bursts(events, "user_id", "ts", 24, 3).join(bought, near, "left_anti")


@catalog.query("""
WITH t AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders)
SELECT o_custkey, max(o_totalprice) FILTER (i = 1) AS latest, max(o_totalprice) FILTER (i = 2) AS previous, max(o_totalprice) FILTER (i = 1) - max(o_totalprice) FILTER (i = 2) AS delta FROM t WHERE i <= 2 GROUP BY 1
""")
def latest_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_and_previous(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice")


@catalog.query("""
WITH last AS (SELECT event_type AS lake, max(ts) AS newest FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
SELECT lake, newest, date_diff('day', newest::DATE, now::DATE) AS age_days, newest::DATE < (now::DATE - INTERVAL 1 day)::DATE AS stale FROM last, m
""")
def lake_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    newest = events.groupBy(F.col("event_type").alias("lake")).agg(F.max("ts").alias("newest"))
    now = newest.agg(F.max("newest").alias("now"))
    age = dates.age_days(F.col("newest").cast("date"), F.col("now").cast("date")).cast("long")
    return newest.join(F.broadcast(now)).select("lake", "newest", age.alias("age_days"), (age > 1).alias("stale"))  # one row


@catalog.query("""
SELECT * EXCLUDE i FROM (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS i FROM events) WHERE i <= 20
""")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.col("event_id")], 20).drop("nth")


@catalog.query("SELECT n_nationkey, n_name, count(o_orderkey) AS n FROM nation LEFT JOIN (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey) ON c_nationkey = n_nationkey GROUP BY 1, 2")
def group_counts_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = read(spark, sf_dir, "orders").select("o_custkey").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return summaries.zero_filled(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), placed, "n_nationkey", "c_nationkey")


@catalog.query("SELECT count(*) AS total, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 7 days) AS recent FROM events")
def count_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("ts")
    now = events.agg(F.max("ts").alias("now"))
    return events.join(F.broadcast(now)).agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.col("now") - F.expr("interval 7 days")).alias("recent"))  # one row


@catalog.query("SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@catalog.query("SELECT time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2")
def stream_window_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_counts(spark, sf_dir)


@catalog.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@catalog.query("""
SELECT page_id, lower(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
  array_to_string(list_reverse(string_split(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)', 1), '.')), '.') AS reversed FROM pages
""")
def host_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = web.host_of(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), web.reverse_labels(host).alias("reversed"))


@catalog.query(r"""
WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS b FROM pages),
p AS (SELECT page_id, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS origin, regexp_replace(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref|source|at_medium|at_campaign|_hsenc|_hsmi)(=|$)')) AS q FROM u)
SELECT page_id, origin || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url, sha256(origin || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) AS content_id FROM p
""")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = web.canonical_url(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.sha2(url, 256).alias("content_id"))


@catalog.query(r"SELECT page_id, regexp_matches(lower(url), '^[^?#]*\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|map|webp)([?#]|$)') AS static, regexp_matches(lower(url), '/wp-includes/|/wp-admin|/wp-content/|/wordpress|/xmlrpc\.php|/\.env|/\.git/|/phpmyadmin|/vendor/phpunit|/administrator/|/cgi-bin/|/shell|/config\.json|/\.aws/') AS probe FROM pages")
def static_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", web.is_static(F.col("url")).alias("static"), web.is_probe(F.col("url")).alias("probe"))


@catalog.query("SELECT event_id, left(sha256('salt:' || strftime(ts, '%Y-%m-%d') || '|' || user_id || '|' || event_type), 16) AS visitor FROM events")
def visitor_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    salt = F.concat(F.lit("salt:"), F.date_format("ts", "yyyy-MM-dd"))
    return read(spark, sf_dir, "events").select("event_id", web.visitor_key(salt, F.col("user_id").cast("string"), F.col("event_type")).alias("visitor"))


@catalog.query("""
SELECT user_id, event_id, gap_s, sum(CASE WHEN gap_s IS NULL OR gap_s > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session
FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000000 AS gap_s FROM events)
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = read(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("gap_s", F.floor((micros - F.lag(micros).over(by)) / 1_000_000))
    return gap.select("user_id", "event_id", "gap_s", F.sum(F.when(F.col("gap_s").isNull() | (F.col("gap_s") > 86400), 1).otherwise(0)).over(by).alias("session"))
