"""Queries of the case book: resolving, merging, scoring's inputs, filters, lookups, retention, on analogues in the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import casebook
from ..tables import read
from .catalog import Catalog

catalog = Catalog()
NOW = "timestamp_ntz '1998-06-01 00:00:00'"

# Inputs, the same expressions in both dialects.
_CASES = {
    "case_id": "o_orderkey",
    "name": "CASE o_orderkey % 5 WHEN 0 THEN 'Scanned us: ' WHEN 1 THEN 'Reputation: ' WHEN 2 THEN 'Phone: ' WHEN 3 THEN '100%_' ELSE 'Work ' END || o_orderpriority",
    "note": "CASE o_custkey % 4 WHEN 0 THEN 'ui-intent: a' WHEN 1 THEN 'intent: b' WHEN 2 THEN 'own words' END",
    "basis": "CASE o_custkey % 3 WHEN 0 THEN 'own_asset' WHEN 1 THEN 'public_cti' ELSE 'other' END",
    "closed": "o_orderstatus = 'F'",
    "owner_id": "NULLIF(o_custkey % 7, 0)",
    "made": "o_orderdate",
}
_EDGES = {
    "source_key": "'k' || CAST(o_custkey AS VARCHAR(20))",
    "target_key": "'k' || CAST(1 + (o_custkey * 7 + o_orderkey % 3) % 40 AS VARCHAR(20))",
    "rel": "CASE o_orderstatus WHEN 'O' THEN 'lookalike_of' WHEN 'F' THEN 'has_mx' ELSE 'same_as' END",
    "confidence": "CAST(o_orderkey % 100 AS DOUBLE) / 100",
    "seen": "o_orderkey",
    "pri": "o_orderpriority",
    "early": "o_orderkey % 2 = 0",
}
_ENTITIES = {"id": "c_custkey", "norm_key": "'k' || CAST(c_custkey AS VARCHAR(20))", "merged_into_id": "CASE c_custkey % 11 WHEN 0 THEN 'e1' WHEN 5 THEN '' END", "confidence": "CAST(c_custkey % 100 AS DOUBLE) / 100"}


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {c}" for c, e in _CASES.items()))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {c}" for c, e in _EDGES.items()))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {c}" for c, e in _ENTITIES.items()))


_WITH = f"WITH cases AS (SELECT {_sql(_CASES)} FROM orders), edges AS (SELECT {_sql(_EDGES)} FROM orders), entities AS (SELECT {_sql(_ENTITIES)} FROM customer)"
_RESOLVED = "resolved AS (SELECT e.*, s.id AS source_id, t.id AS target_id FROM edges e JOIN ids s ON s.norm_key = source_key JOIN ids t ON t.norm_key = target_key WHERE s.id <> t.id)"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).where("id % 17 <> 0").select("norm_key", "id")


@catalog.query(f"""
{_WITH}, ids AS (SELECT norm_key, id FROM entities WHERE id % 17 <> 0), {_RESOLVED}
SELECT source_id, target_id, rel, max(confidence) AS confidence, min(seen) AS first_seen, max(seen) AS last_seen, NOT bool_or(early) AS added, arg_max(pri, seen) AS pri, count(DISTINCT pri) AS n_names
FROM resolved GROUP BY 1, 2, 3
""")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = casebook.resolve(_edges(spark, sf_dir), _ids(spark, sf_dir)).withColumn("props", F.create_map(F.lit("pri"), "pri", F.concat(F.lit("by "), "pri"), F.lit("x")))
    merged = casebook.upsert_edges(resolved.where("early"), resolved.where("not early"), "seen")
    return merged.select("source_id", "target_id", "rel", "confidence", "first_seen", "last_seen", "added", F.col("props")["pri"].alias("pri"), (F.size("props") - 1).cast("long").alias("n_names"))


@catalog.query(f"""
{_WITH}, held AS (SELECT norm_key FROM entities WHERE id % 17 <> 0), batch AS (SELECT norm_key FROM entities WHERE id % 3 = 0),
known AS (SELECT norm_key FROM held UNION SELECT norm_key FROM batch)
SELECT (SELECT count(*) FROM (SELECT norm_key FROM batch EXCEPT SELECT norm_key FROM held)) AS entities,
  (SELECT count(*) FROM edges JOIN known s ON s.norm_key = source_key JOIN known t ON t.norm_key = target_key WHERE source_key <> target_key) AS edges, (SELECT count(*) FROM events) AS evidence
""")
def apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casebook.apply_counts(_ids(spark, sf_dir), _entities(spark, sf_dir).where("id % 3 = 0"), _edges(spark, sf_dir), read(spark, sf_dir, "events"))


@catalog.query(f"""
{_WITH}, ids AS (SELECT norm_key, id FROM entities), {_RESOLVED},
ev AS (SELECT CASE WHEN event_id % 9 > 0 THEN user_id END AS id, event_type AS collector FROM events),
hint AS (SELECT source_id AS id, rel FROM resolved UNION ALL SELECT target_id, rel FROM resolved),
c AS (SELECT id, collector FROM ev WHERE id IS NOT NULL UNION SELECT id, CASE rel WHEN 'lookalike_of' THEN 'lookalike_domains' ELSE 'dns_resolve' END FROM hint WHERE rel <> 'same_as')
SELECT e.id, (SELECT count(*) FROM ev WHERE ev.id = e.id) AS n_evidence, (SELECT count(*) FROM c WHERE c.id = e.id) AS n_collectors, (SELECT count(*) FROM resolved WHERE target_id = e.id) AS degree_in,
  (SELECT count(*) FROM resolved WHERE source_id = e.id) AS degree_out, (SELECT count(*) FROM hint WHERE hint.id = e.id AND rel = 'same_as') AS strong FROM entities e WHERE coalesce(merged_into_id, '') = ''
""")
def score_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = _entities(spark, sf_dir)
    evidence = read(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 9 > 0 THEN user_id END AS entity_id", "event_type AS collector")
    return casebook.score_inputs(entities, casebook.resolve(_edges(spark, sf_dir), entities.select("norm_key", "id")), evidence, ["same_as"])


@catalog.query(f"""
{_WITH} SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.35 THEN 'low' ELSE 'speculative' END AS band, count(*) AS n, max(confidence) AS best FROM entities WHERE coalesce(merged_into_id, '') = '' GROUP BY 1
""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scores import confidence_band

    return casebook.unmerged(_entities(spark, sf_dir)).groupBy(confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


_FILTERS = [dict(kind="Reputation", basis="own_asset"), dict(kind="other", status="open", q=" work"), dict(kind="unheard of", basis="?", status="", q="100%_2"), dict(kind="intent", status="closed"), dict(kind="sentinel", q="URGENT")]


@catalog.query(f"""
{_WITH}, k AS (SELECT *, starts_with(name, 'Scanned us:') AS s, starts_with(name, 'Reputation:') OR starts_with(name, 'Phone:') AS r, coalesce(starts_with(note, 'ui-intent:') OR starts_with(note, 'intent:'), false) AS i FROM cases)
SELECT 0 AS filter, case_id FROM k WHERE r AND basis = 'own_asset' UNION ALL SELECT 1, case_id FROM k WHERE NOT (s OR r OR i) AND NOT closed AND name ILIKE '%work%'
UNION ALL SELECT 2, case_id FROM k WHERE contains(name, '100%_2') UNION ALL SELECT 3, case_id FROM k WHERE i AND closed UNION ALL SELECT 4, case_id FROM k WHERE s AND contains(lower(name), 'urgent')
""")
def case_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, out = _cases(spark, sf_dir), None
    for i, asked in enumerate(_FILTERS):
        own = cases.where(rules.case_filter(F.col("name"), F.col("note"), F.col("basis"), F.col("closed"), **asked)).select(F.lit(i).alias("filter"), "case_id")
        out = own if out is None else out.unionByName(own)
    return out


@catalog.query(f"""
{_WITH} SELECT case_id, coalesce(owner_id = 3, false) AS to_owner, true AS to_operator, made > TIMESTAMP '1997-06-01' AS muted, coalesce(owner_id = -1, false) AS to_stranger FROM cases
""")
def case_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.col("owner_id")
    return _cases(spark, sf_dir).select("case_id", rules.visible_to(owner, 3).alias("to_owner"), rules.visible_to(owner, None, operator=True).alias("to_operator"), rules.muted(F.col("made"), F.expr("timestamp_ntz '1997-06-01 00:00:00'")).alias("muted"), rules.visible_to(owner, -1).alias("to_stranger"))


_PROPS = "CASE c_custkey % 4 WHEN 0 THEN '2024-01-05 00:00:00' WHEN 1 THEN '2023-11-01 00:00:00' WHEN 2 THEN 'never' END"


@catalog.query(f"""
SELECT c_custkey, coalesce(TRY_CAST({_PROPS} AS TIMESTAMP) > TIMESTAMP '2024-01-10' - INTERVAL 7 DAY, false) OR c_custkey % 5 = 0 AS enriched FROM customer
""")
def enriched_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("passive_enriched_at"), F.expr(_PROPS), F.lit("asn"), F.expr("CASE c_custkey % 5 WHEN 0 THEN 'AS1' WHEN 1 THEN '' WHEN 2 THEN '[]' END"))
    return read(spark, sf_dir, "customer").select("c_custkey", rules.enriched(props, F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("enriched"))


_HOSTS = "CASE c_custkey % 8 WHEN 0 THEN 'example.com' WHEN 1 THEN '*.bad' || c_custkey || '.net' WHEN 2 THEN 'localhost' WHEN 3 THEN 'x.github.io' WHEN 4 THEN '-bad.org' WHEN 5 THEN 'a_b.org' WHEN 6 THEN 'ok-' || c_custkey || '.org' ELSE 'h..org' END"


@catalog.query("SELECT c_custkey, c_custkey % 8 IN (1, 6) AS blockable FROM customer")
def blockable_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", rules.blockable(F.expr(_HOSTS), ["example.com"], [".github.io"]).alias("blockable"))


@catalog.query("""
SELECT p_partkey, contains(lower(p_name), split_part(lower(p_type), ' ', 1)) OR contains(split_part(lower(p_type), ' ', 1), lower(p_name)) OR contains(lower(p_brand), 'brand#11') OR contains('brand#11', lower(p_brand)) AS mentions FROM part
""")
def product_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split(F.lower("p_type"), " ")[0]
    return read(spark, sf_dir, "part").select("p_partkey", (rules.mentions_product(first, F.col("p_name")) | rules.mentions_product(F.lit("brand#11"), F.col("p_brand"))).alias("mentions"))


@catalog.query("SELECT n_nationkey, contains(n_name, 'UNITED') AND contains(n_name, 'STATES') AS both_tokens, contains(n_name, 'NIT') AS one FROM nation")
def token_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", rules.has_tokens(F.col("n_name"), "states; of--united %").alias("both_tokens"), rules.has_tokens(F.col("n_name"), "nit _%").alias("one"))


_NOTES = "CASE c_custkey % 7 WHEN 0 THEN 'mail  me@ex.org' WHEN 1 THEN 'see WWW.x.org' WHEN 2 THEN 'my 123-45-6789' WHEN 3 THEN '1234 5678 9012 3456' WHEN 4 THEN 'at 12 Long Oak Street' WHEN 5 THEN '  asked   for ' || c_mktsegment END"


@catalog.query("""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'an email address' WHEN 1 THEN 'a link' WHEN 2 THEN 'something shaped like an SSN' WHEN 3 THEN 'something shaped like a card number' WHEN 4 THEN 'a street address' END AS refusal, CASE c_custkey % 7 WHEN 5 THEN 'asked for ' || c_mktsegment END AS note FROM customer
""")
def note_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", rules.note_refusal(F.expr(_NOTES)).alias("refusal"), rules.kept_note(F.expr(_NOTES)).alias("note"))


@catalog.query("SELECT c_custkey, c_custkey % 5 IN (0, 1, 2) AS refused FROM customer")
def refused_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE c_custkey % 5 WHEN 0 THEN ' 9-1 1' WHEN 1 THEN '55 123' WHEN 2 THEN '0' ELSE '+1 555 010 1234' END")
    full = F.expr("CASE c_custkey % 5 WHEN 2 THEN '+112' WHEN 3 THEN '+15550101234' END")
    return read(spark, sf_dir, "customer").select("c_custkey", rules.refused_number(raw, full).alias("refused"))


_PATHS = "CASE event_id % 5 WHEN 0 THEN '/' WHEN 1 THEN '/static/x.js' WHEN 2 THEN '/healthz' WHEN 3 THEN '/healthz2' ELSE '/case/' || event_id END"


@catalog.query("SELECT event_id, event_type IN ('click', 'view') AND event_id % 5 IN (0, 3, 4) AS recorded FROM events")
def recorded_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.expr("CASE event_type WHEN 'click' THEN 'get' WHEN 'view' THEN 'HEAD' ELSE 'POST' END")
    return read(spark, sf_dir, "events").select("event_id", rules.recordable(F.expr(_PATHS), method, ["/healthz"], ["/static/"]).alias("recorded"))


@catalog.query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'listed' WHEN 1 THEN 'XBL — compromised device, open proxy or worm; PBL — end-user address, should not send mail directly' WHEN 2 THEN 'PBL — end-user address, should not send mail directly' WHEN 3 THEN 'SBL DROP — hijacked or leased-to-criminals netblock; unrecognised code 127.0.0.99' ELSE 'unrecognised code 127.9.9.9' END AS label,
  CASE c_custkey % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.6 WHEN 2 THEN 0 WHEN 3 THEN 0.85 ELSE 0.6 END AS weight, c_custkey % 5 = 2 AS policy_only FROM customer
""")
def zen_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.split(F.expr("CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '127.0.0.5 127.0.0.10 127.0.0.4' WHEN 2 THEN '127.0.0.11 127.0.0.10' WHEN 3 THEN '127.0.0.99 127.0.0.9' ELSE '127.9.9.9' END"), " ")
    verdict = rules.zen(F.filter(codes, lambda c: c != ""))
    return read(spark, sf_dir, "customer").select("c_custkey", verdict.alias("z")).select("c_custkey", "z.*")


@catalog.query("SELECT l_orderkey, l_linenumber, round_even(l_discount + CASE WHEN l_quantity > 25 THEN l_tax ELSE 0 END, 6) AS mass FROM lineitem")
def benign_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = F.map_concat(F.create_map(F.lit("parked"), "l_discount", F.lit("phish"), F.lit(0.3)), F.when(F.col("l_quantity") > 25, F.create_map(F.lit("shop"), F.col("l_tax"))).otherwise(F.create_map(F.lit("other"), F.col("l_tax"))))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(rules.mass_on(answers, ["parked", "shop"]), 6).alias("mass"))


@catalog.query("""
SELECT c_custkey, c_custkey % 4 = 1 OR (c_custkey % 4 = 0 AND EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey % 4 = 1 AND x.c_custkey % 3 = 0 AND x.c_custkey = c.c_custkey - 3)) OR c_custkey % 4 = 3 AS pivots FROM customer c
""")
def pivot_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import pivots

    k = F.col("c_custkey")
    value = F.when(k % 4 == 0, F.concat(F.lit("WWW.Apex"), k - 3, F.lit(".org"))).when(k % 4 == 1, F.concat(F.lit("apex"), k, F.lit(".org"))).when(k % 4 == 3, F.lit("me@x.org")).otherwise(F.lit("phone"))
    entities = read(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 4 < 2, "domain").when(k % 4 == 3, "email").otherwise("phone").alias("type"), value.alias("value"), (k % 4 == 1).alias("is_seed"))
    apexes = entities.where((F.col("id") % 4 == 1) & (F.col("id") % 3 == 0)).select(F.col("value").alias("apex"))
    return pivots(entities, apexes, ["domain", "email", "url"]).select(F.col("id").alias("c_custkey"), "pivots")


@catalog.query("""
WITH q AS (SELECT c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION SELECT s_name FROM supplier UNION SELECT 'Nobody'),
hits AS (SELECT c_name AS name, 0 AS r, c_custkey AS o, 'registry' AS corpus, c_mktsegment AS shown FROM customer WHERE c_acctbal > 5000
  UNION ALL SELECT c_name, 1, c_custkey, 'filings', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_name, 2, s_suppkey, 'licences', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, o) AS n FROM hits)
SELECT q.name, corpus, shown FROM q LEFT JOIN b ON b.name = q.name AND n = 1
""")
def first_corpus_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    asked = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name")).union(s.select("s_name")).union(spark.createDataFrame([("Nobody",)], "name string"))
    table = lambda df, name, order, shown: df.select(F.col(name).alias("name"), F.col(order).alias("k"), F.col(shown).cast("string").alias("shown"))
    corpora = [("registry", table(c.where("c_acctbal > 5000"), "c_name", "c_custkey", "c_mktsegment")), ("filings", table(c.where("c_acctbal > 0"), "c_name", "c_custkey", "c_nationkey")), ("licences", table(s.where("s_acctbal > 0"), "s_name", "s_suppkey", "s_nationkey"))]
    return casebook.first_hits(asked, corpora, "name", "k")


@catalog.query("""
WITH h AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders WHERE o_custkey % 100 = 0) SELECT o_custkey, o_orderkey, o_totalprice, CAST(nth AS INTEGER) AS nth FROM h WHERE nth <= 25
""")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return casebook.lookup(asked, read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@catalog.query("""
WITH d AS (SELECT s_suppkey AS cert_id, 'org.ex' || (s_suppkey % 7) || CASE WHEN s_suppkey % 2 = 0 THEN '.www' ELSE '' END AS rdn FROM supplier), c AS (SELECT s_suppkey AS cert_id, s_acctbal AS ts FROM supplier WHERE s_suppkey % 5 > 0)
SELECT d.cert_id, rdn, ts FROM d JOIN c ON c.cert_id = d.cert_id WHERE rdn = 'org.ex3' OR starts_with(rdn, 'org.ex3.')
""")
def cert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import under

    s = read(spark, sf_dir, "supplier")
    domains = s.selectExpr("s_suppkey AS cert_id", "'org.ex' || (s_suppkey % 7) || CASE WHEN s_suppkey % 2 = 0 THEN '.www' ELSE '' END AS rdn")
    return under(domains, "rdn", "org.ex3").join(s.where("s_suppkey % 5 > 0").selectExpr("s_suppkey AS cert_id", "s_acctbal AS ts"), "cert_id")


@catalog.query("""
SELECT o_orderkey, n_name AS model, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS kind FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 WHERE o_orderkey % 100 = 0
""")
def optional_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("filled"))
    craft = read(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return craft.join(read(spark, sf_dir, "nation").where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", F.col("n_name").alias("model"), F.element_at(kinds, F.col("o_orderstatus")).alias("kind"))


@catalog.query("""
WITH o AS (SELECT o_custkey AS k, 'old' || max(o_orderkey) AS name, CASE WHEN count(*) % 3 > 0 THEN 'p' || min(o_orderkey) END AS place, max(o_orderkey % 2) AS hit FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
n AS (SELECT o_custkey AS k, CASE WHEN count(*) % 2 > 0 THEN 'new' || max(o_orderkey) END AS name, 'q' || min(o_orderkey) AS place, max(o_orderkey % 2) AS hit FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(o.place, n.place) AS place, coalesce(n.name, o.name) AS name, greatest(o.hit, n.hit) AS hit FROM o FULL JOIN n ON o.k = n.k
""")
def person_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    cut = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    k = F.col("o_custkey").alias("k")
    held = orders.where(cut).groupBy(k).agg(F.expr("'old' || max(o_orderkey)").alias("name"), F.expr("CASE WHEN count(*) % 3 > 0 THEN 'p' || min(o_orderkey) END").alias("place"), F.expr("max(o_orderkey % 2)").alias("hit"))
    new = orders.where(~cut).groupBy(k).agg(F.expr("CASE WHEN count(*) % 2 > 0 THEN 'new' || max(o_orderkey) END").alias("name"), F.expr("'q' || min(o_orderkey)").alias("place"), F.expr("max(o_orderkey % 2)").alias("hit"))
    return casebook.fill(held, new, ["k"], keep=["place"], refresh=["name"], most=["hit"])


@catalog.query("SELECT c_custkey, CASE WHEN n_regionkey = 2 AND c_acctbal > 0 THEN 'R' || n_nationkey ELSE c_mktsegment END AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def region_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("layer"), F.col("c_mktsegment").alias("region"), "c_acctbal")
    updates = read(spark, sf_dir, "nation").where("n_regionkey = 2").selectExpr("n_nationkey AS layer", "'R' || n_nationkey AS region")
    return casebook.update_from(held, updates, ["layer"], ["region"], F.col("c_acctbal") > 0).select("c_custkey", "region")


@catalog.query(f"""
{_WITH}, gone AS (SELECT case_id FROM cases WHERE made < TIMESTAMP '1998-06-01' - INTERVAL 730 DAY)
SELECT 'cases' AS held, count(*) AS n FROM cases WHERE case_id NOT IN (SELECT case_id FROM gone) UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT case_id FROM gone)
UNION ALL SELECT 'disabled', count(*) FROM cases
""")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, now = _cases(spark, sf_dir), F.expr(NOW)
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"))
    left = casebook.purge({"cases": cases, "lines": lines}, cases.where(casebook.older_than(F.col("made"), 730, now)), "case_id")
    left["disabled"] = casebook.purge({"cases": cases}, cases.where(casebook.older_than(F.col("made"), 0, now)), "case_id")["cases"]
    counts = [df.agg(F.lit(name).alias("held"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@catalog.query("""
WITH l AS (SELECT o_custkey, count(*) - 1 AS reports, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT o_custkey, o_custkey % 4 > 0 AND reports > 0 AND last < TIMESTAMP '1998-06-01' - INTERVAL 200 DAY AS delisted, o_custkey % 4 > 0 AND NOT (reports > 0 AND last < TIMESTAMP '1998-06-01' - INTERVAL 200 DAY) AS active FROM l
""")
def listing_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count("*") - 1).alias("report_count"), F.max("o_orderdate").alias("last_report_at")).withColumn("active", F.col("o_custkey") % 4 > 0)
    return casebook.expire(listings, 200, F.expr(NOW)).select("o_custkey", "delisted", "active")


@catalog.query("""
SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 365 DAY)
""")
def closed_event_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'wontfix' ELSE 'open' END").alias("status"), F.col("o_orderdate").alias("last_seen"))
    return casebook.prune_closed(events, 365, F.expr(NOW)).select("o_orderkey")


@catalog.query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def capped_with_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return casebook.cap_with_note(urgent, [F.desc("o_totalprice"), F.col("o_orderkey")], 40).select("o_orderkey", "total")
