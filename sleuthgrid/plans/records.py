"""Queries over records: canonical values, lookups, ledgers and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, mail, network
from ..functions import text as tx
from ..functions import web
from ..operators import alerts, records
from ..tables import dealt, read
from .catalog import Catalog

catalog = Catalog()

_RULES = [("com", "rule"), ("net", "rule"), ("org", "rule"), ("example.com", "rule"), ("net", "wildcard"), ("www.example.net", "exception")]


@catalog.query("""
WITH r(rule, kind) AS (VALUES ('com', 'rule'), ('net', 'rule'), ('org', 'rule'), ('example.com', 'rule'), ('net', 'wildcard'), ('www.example.net', 'exception')),
h AS (SELECT DISTINCT rtrim(regexp_extract(lower(url), '://([^/?#:]+)', 1), '.') AS host FROM pages WHERE contains(regexp_extract(lower(url), '://([^/?#:]+)', 1), '.')),
x AS (SELECT host, kind, CASE kind WHEN 'rule' THEN rule WHEN 'exception' THEN substr(rule, instr(rule, '.') + 1) ELSE string_split(left(host, length(host) - length(rule) - 1), '.')[-1] || '.' || rule END AS s
  FROM h JOIN r ON host = rule AND kind <> 'wildcard' OR ends_with(host, '.' || rule)),
b AS (SELECT host, coalesce(max_by(s, length(s)) FILTER (kind = 'exception'), max_by(s, length(s))) AS s FROM x GROUP BY 1)
SELECT host, s AS public_suffix, CASE WHEN host <> s THEN string_split(left(host, length(host) - length(s) - 1), '.')[-1] || '.' || s END AS registrable FROM h LEFT JOIN b USING (host)
""")
def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = read(spark, sf_dir, "pages").select(web.host_of(F.col("url")).alias("h"))
    return records.suffixes(hosts, spark.createDataFrame(_RULES, "rule string, kind string"), "h")


@catalog.query(r"""
SELECT page_id, regexp_replace(regexp_extract(lower(url), '://([^/?#:]+)', 1), '^www\.', '') AS domain, lower(regexp_extract(url, '^[^:]*://[^/?#]*')) || rtrim(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/') AS url_key FROM pages
""")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", identity.canonical_value(F.lit("domain"), F.col("url")).alias("domain"), identity.canonical_value(F.lit("url"), F.col("url")).alias("url_key"))


@catalog.query(rf"""
WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}')) AS address FROM documents),
p AS (SELECT address, lower(split_part(address, '@', 1)) AS l, replace(lower(split_part(address, '@', 2)), 'googlemail.com', 'gmail.com') AS d FROM m)
SELECT address, CASE WHEN d = 'gmail.com' THEN replace(split_part(l, '+', 1), '.', '') ELSE split_part(l, '+', 1) END || '@' || d AS mailbox, split_part(l, '+', 1) IN ({', '.join(repr(r) for r in sorted(identity.ROLES))}) AS is_role FROM p WHERE split_part(l, '+', 1) <> ''
""")
def mailbox_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select(F.explode(tx.found(F.col("text"), tx.EMAIL)).alias("address")).distinct()
    local = F.substring_index(F.lower(F.substring_index("address", "@", 1)), "+", 1)
    return found.where(local != "").select("address", identity.mailbox(F.col("address")).alias("mailbox"), identity.is_role(F.col("address")).alias("is_role"))


@catalog.query("""
WITH a AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders),
net(s, b) AS (VALUES (0, 8), (10 * 16777216::BIGINT, 8), (100 * 16777216::BIGINT + 64 * 65536, 10), (127 * 16777216::BIGINT, 8), (169 * 16777216::BIGINT + 254 * 65536, 16), (172 * 16777216::BIGINT + 16 * 65536, 12), (192 * 16777216::BIGINT, 24), (192 * 16777216::BIGINT + 512, 24), (192 * 16777216::BIGINT + 168 * 65536, 16), (198 * 16777216::BIGINT + 18 * 65536, 15),
  (198 * 16777216::BIGINT + 51 * 65536 + 25600, 24), (203 * 16777216::BIGINT + 113 * 256, 24), (224 * 16777216::BIGINT, 4), (240 * 16777216::BIGINT, 4))
SELECT o_orderkey, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS address, NOT EXISTS (SELECT 1 FROM net WHERE n BETWEEN s AND s + (1::BIGINT << (32 - b)) - 1) AS is_public FROM a
""")
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * 2654435761) % 4294967296
    part = lambda by: F.floor(n / by) % 256
    made = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(".", part(16777216), part(65536), part(256), part(1)).alias("address"))
    return made.withColumn("is_public", network.is_public(F.col("address")))


@catalog.query("""
WITH l AS (SELECT p_partkey AS a, 'tag' || p_size % 3 AS tag, (p_retailprice % 100) / 100 AS c FROM part WHERE p_size % 4 <> 0 AND p_partkey % 3 = 0)
SELECT 'eth' AS chain, '0xAb' || p_partkey AS address, CASE WHEN a IS NOT NULL THEN 1 END::BIGINT AS n_labels, tag AS top_tag, c AS confidence FROM part LEFT JOIN l ON a = p_partkey
""")
def address_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    held = part.where("p_partkey % 3 = 0").select(F.lit("eth").alias("chain"), F.concat(F.lit("0xab"), "p_partkey").alias("address"), F.concat(F.lit("tag"), F.col("p_size") % 3).alias("tag"), (F.col("p_retailprice") % 100 / 100).alias("confidence"), (F.col("p_size") % 4 != 0).alias("active"))
    return records.labels_of(part.select(F.lit("eth").alias("chain"), F.concat(F.lit("0xAb"), "p_partkey").alias("address")), held)


@catalog.query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.absent(held, read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@catalog.query("""
SELECT o_orderkey AS entry_id FROM orders WHERE o_orderstatus <> 'P' AND (o_orderpriority IS NULL OR o_orderdate > TIMESTAMP '1995-06-01') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_returnflag = 'A')
""")
def publishable_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.expr("if(o_orderstatus = 'P', o_orderdate, null)").alias("removed_at"), F.lit(None).cast("timestamp").alias("suppressed_at"), F.expr("if(o_orderpriority is null, null, o_orderdate)").alias("expires_at"))
    disputes = read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("entry_id"), F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("status"))
    return records.publishable(entries, disputes, F.lit("1995-06-01").cast("timestamp_ntz")).select("entry_id")


@catalog.query("""
SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01')
""")
def orphaned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("ok").alias("status"), F.col("o_orderdate").alias("started_at"))
    jobs = orders.select(F.col("o_custkey").alias("case_id"), F.expr("if(o_orderdate > timestamp_ntz'1998-01-01', 'queued', 'ok')").alias("status"))
    return records.orphaned(runs, jobs, F.lit("1996-01-01").cast("timestamp_ntz")).select("run_id")


@catalog.query("""
WITH s AS (SELECT CASE user_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'username' ELSE 'domain' END AS type, CASE WHEN user_id % 2 = 0 THEN 'unknown:' ELSE 'v' END || user_id AS value, (event_id * 37 % 100) / 100 AS c, event_id % 7 = 0 AS i, event_type AS source FROM events),
g AS (SELECT type, value, max(c) AS c, bool_or(i) AS i, count(*) AS n, list_sort(list(DISTINCT source)) AS sources FROM s GROUP BY 1, 2)
SELECT type, value, c AS confidence, CASE WHEN n > 1 AND c >= 0.55 THEN i OR c >= 0.7 ELSE i END AND NOT (c < 0.55 OR type = 'person' AND c < 0.75 OR type = 'username' AND starts_with(value, 'unknown:') AND c < 0.7) AS include, sources FROM g
""")
def seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 3 == 0, "person").when(F.col("user_id") % 3 == 1, "username").otherwise("domain")
    value = F.concat(F.when(F.col("user_id") % 2 == 0, "unknown:").otherwise("v"), "user_id")
    seeds = read(spark, sf_dir, "events").select(kind.alias("type"), value.alias("value"), (F.col("event_id") * 37 % 100 / 100).alias("confidence"), (F.col("event_id") % 7 == 0).alias("include"), F.col("event_type").alias("source"))
    return records.merge_seeds(seeds)


@catalog.query("""
SELECT user_id, event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, max_by(props, (ts, props)) FILTER (event_id % 3 = 0 AND props <> '') AS detail FROM events GROUP BY 1, 2
""")
def incident_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("detail", F.expr("if(event_id % 3 = 0, props, '')"))
    return records.incident_ledger(events, ["user_id", "event_type"], "ts", "detail")


@catalog.query("""
SELECT user_id, event_id, ts, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS nth FROM events) WHERE nth IN (1, 10)
""")
def incident_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.incident_alerts(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])


@catalog.query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_suppkey % 11 = 0 AS ls, l_partkey % 13 = 0 AS lr, l_suppkey % 5 = 0 OR l_partkey % 5 = 0 AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN m THEN 'S2' ELSE 'S3' END AS severity, CASE WHEN ls THEN 'sent' ELSE 'received' END AS direction, m AS mixer_involved, CASE WHEN ls THEN 'supplier tag' ELSE 'part tag' END AS tags FROM t WHERE ls OR lr
""")
def transfer_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda table, key, mark: read(spark, sf_dir, table).select(F.lit("eth").alias("chain"), F.concat(F.lit(mark), key).alias("address"), F.col(key).alias("k"))
    both = [("supplier", "s_suppkey", "0xS", 11), ("part", "p_partkey", "0xP", 13)]
    labels = [named(t, k, m).where(F.col("k") % by == 0).select("chain", "address", F.lit(f"{t} tag").alias("tag"), F.lit(True).alias("active")) for t, k, m, by in both]
    services = [named(t, k, m).where("k % 5 = 0").select("chain", "address", F.lit("mixer").alias("kind")) for t, k, m, _ in both]
    transfers = read(spark, sf_dir, "lineitem").select(F.lit("eth").alias("chain"), F.concat(F.lit("0xs"), "l_suppkey").alias("sender"), F.concat(F.lit("0xp"), "l_partkey").alias("receiver"), "l_orderkey", "l_linenumber")
    return records.transfer_alerts(transfers, labels[0].union(labels[1]), services[0].union(services[1])).drop("chain", "sender", "receiver")


@catalog.query("""
WITH e AS (SELECT event_id, user_id, event_type, '8.8.' || user_id % 200 || '.' || event_id % 200 AS ip, event_id % 4 AS form FROM events)
SELECT event_id, CASE form WHEN 0 THEN 'outbound_conn' WHEN 1 THEN 'inbound_conn' WHEN 2 THEN 'dns_query' ELSE 'web_request' END AS kind, CASE form WHEN 2 THEN 'h' || user_id || '.example.com' WHEN 3 THEN 'http://' || ip || '/' || event_type ELSE ip END AS first_indicator, CASE WHEN form = 1 THEN 1 ELSE 0 END AS n_local FROM e
""")
def alert_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat(F.lit("8.8."), F.col("user_id") % 200, F.lit("."), F.col("event_id") % 200)
    forms = [
        F.to_json(F.struct(F.struct(ip.alias("ip")).alias("destination"))), F.to_json(F.struct(ip.alias("src_ip"), F.lit("10.0.0.1").alias("dest_ip"))),
        F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("H"), "user_id", F.lit(".Example.com.")).alias("name")).alias("question")).alias("dns"))), F.to_json(F.struct(F.concat(F.lit("http://"), ip, F.lit("/"), "event_type").alias("url"))),
    ]
    form = F.col("event_id") % 4
    raw = read(spark, sf_dir, "events").select("event_id", F.when(form == 0, forms[0]).when(form == 1, forms[1]).when(form == 2, forms[2]).otherwise(forms[3]).alias("text"))
    found = alerts.normalise(raw, ["event_id"], "text")
    return found.select("event_id", "kind", F.element_at("indicators", 1)["value"].alias("first_indicator"), F.size("kept_local").alias("n_local"))


@catalog.query("""
SELECT o_orderkey, 3 AS n_hops, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS trusted, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN NULL ELSE '8.8.' || o_custkey % 200 || '.1' END AS origin FROM orders
""")
def mail_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("o_orderkey") % 3 == 0, "mx.other.org").otherwise("b.mx.example.com")
    handed = F.when(F.col("o_orderkey") % 5 == 0, "10.1.1.1").otherwise(F.concat(F.lit("8.8."), F.col("o_custkey") % 200, F.lit(".1")))
    blob = F.concat(F.lit("Received: from x ([10.0.0.9])\n by a.mx.example.com with ESMTP; d\nReceived: from y.net (y.net by z ["), handed, F.lit("])\n by "), second, F.lit(" with SMTP; d\nReceived: from z.net ([7.7.7.7]) by y.net; d\nFrom: a@z.net\n\nbody"))
    chain = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", mail.hops(mail.headers(blob)).alias("c"))
    counted = chain.select("o_orderkey", "c", F.size("c").alias("n_hops"), mail.trusted_hops(F.col("c")).alias("trusted"))
    return counted.select("o_orderkey", "n_hops", "trusted", mail.origin(F.col("c"), F.col("trusted")).alias("origin"))
