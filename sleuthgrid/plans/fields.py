"""Queries of small fields and of lookups without regard to letter case, on analogues in the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, nested
from ..tables import read
from .catalog import Catalog

catalog = Catalog()

_IDS = "CASE o_orderkey % 8 WHEN 0 THEN ' cve 2021 ' || (10000 + o_orderkey % 9000000) WHEN 1 THEN 'Cwe-079' WHEN 2 THEN 'capec12' WHEN 3 THEN 't1059.001' WHEN 4 THEN 'rfc 00791' WHEN 5 THEN 'd3-abc' WHEN 6 THEN 'see CVE-2021-44228' ELSE 'T1003 ' END"


@catalog.query("""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'cve' WHEN 1 THEN 'cwe' WHEN 2 THEN 'capec' WHEN 3 THEN 'attack' WHEN 4 THEN 'rfc' WHEN 5 THEN 'd3fend' WHEN 7 THEN 'attack' END AS kind,
  CASE o_orderkey % 8 WHEN 0 THEN 'CVE-2021-' || (10000 + o_orderkey % 9000000) WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CAPEC-12' WHEN 3 THEN 'T1059.001' WHEN 4 THEN 'RFC791' WHEN 5 THEN 'D3-ABC' WHEN 7 THEN 'T1003' END AS canonical FROM orders
""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", fields.identifier(F.expr(_IDS)).alias("i")).select("o_orderkey", "i.*")


_RAW_HOSTS = "CASE c_custkey % 7 WHEN 0 THEN ' HTTP://A' || c_custkey || '.Org:8080/x?y ' WHEN 1 THEN 'b.org.' WHEN 2 THEN '[::1]:80' WHEN 3 THEN '' WHEN 4 THEN 'c.org?q/z' WHEN 5 THEN '10.0.0.1:22' ELSE '::1' END"


@catalog.query("""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'a' || c_custkey || '.org' WHEN 1 THEN 'b.org' WHEN 2 THEN '::1' WHEN 4 THEN 'c.org' WHEN 5 THEN '10.0.0.1' WHEN 6 THEN '::1' END AS host FROM customer
""")
def bare_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", fields.bare_host(F.expr(_RAW_HOSTS)).alias("host"))


_RUN_NOTES = "CASE event_id % 6 WHEN 0 THEN 'cap reached after error' WHEN 1 THEN 'whois: skipped (no key)' WHEN 2 THEN 'dns: SERVFAIL' WHEN 3 THEN 'http 503 from x' WHEN 4 THEN 'terror of the deep' END"


@catalog.query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'limit' WHEN 1 THEN 'not_configured' WHEN 2 THEN 'source_failed' WHEN 3 THEN 'source_failed' ELSE 'result' END AS kind FROM events
""")
def note_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", fields.note_kind(F.expr(_RUN_NOTES)).alias("kind"))


@catalog.query("SELECT c_custkey, c_custkey % 4 = 0 AS is_email, CASE c_custkey % 3 WHEN 0 THEN '12-34.5' WHEN 1 THEN 'A99' END AS apn FROM customer")
def mail_and_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.expr("CASE c_custkey % 4 WHEN 0 THEN ' me+x@ex-1.org ' WHEN 1 THEN 'me@ex' WHEN 2 THEN 'a me@ex.org' ELSE '@ex.org' END")
    detail = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'lot 5, Parcel no: 12-34.5., owner' WHEN 1 THEN 'APN#A99;' ELSE 'spin 12345' END")
    return read(spark, sf_dir, "customer").select("c_custkey", fields.is_email(mail).alias("is_email"), fields.parcel_number(detail).alias("apn"))


@catalog.query("""
SELECT n_nationkey, n_name || CASE WHEN n_name <> r_name THEN ', ' || r_name ELSE '' END || CASE WHEN n_nationkey % 2 = 0 THEN ', X' ELSE '' END AS label, CASE WHEN n_nationkey % 5 = 0 THEN 'unknown' ELSE r_name END AS other FROM nation JOIN region ON r_regionkey = n_regionkey
""")
def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    none = F.lit(None).cast("string")
    return both.select("n_nationkey", fields.place_label(F.col("n_name"), F.col("r_name"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'X' ELSE '' END")).alias("label"), fields.place_label(none, F.expr("CASE WHEN n_nationkey % 5 > 0 THEN r_name END"), none).alias("other"))


@catalog.query("""
SELECT event_id, '[redacted]' AS a, event_type AS b, '[redacted]' AS c, left(repeat(event_type, 3), 10) || CASE WHEN length(event_type) * 3 > 10 THEN '…[+' || (length(event_type) * 3 - 10) || ' chars]' ELSE '' END AS d, left(sha256('k|two words ' || event_type), 32) AS print FROM events
""")
def event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    detail = fields.redact(F.create_map(F.lit("API_Key"), t, F.lit("kind"), t, F.lit("x-session-id"), t))
    return read(spark, sf_dir, "events").select("event_id", detail["API_Key"].alias("a"), detail["kind"].alias("b"), detail["x-session-id"].alias("c"), fields.shorten(F.repeat(t, F.lit(3)), 10).alias("d"), fields.event_print(F.lit("k"), F.concat(F.lit(" Two  \n WORDS "), F.upper(t), F.lit(" "))).alias("print"))


@catalog.query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS names, CASE c_custkey % 2 WHEN 0 THEN 'OWNER_NAME' ELSE '' END AS field FROM customer
""")
def sampled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.expr("CASE c_custkey % 5 WHEN 0 THEN array('DOE JANE', '1 ELM', null) WHEN 1 THEN array('1 ELM', '2 OAK', 'ROE') WHEN 2 THEN array(' ROE R ', '', '7') WHEN 3 THEN array('', null) ELSE array('7', 'x1', '8') END")
    names = F.expr("CASE c_custkey % 2 WHEN 0 THEN array('OWNER_ADDR', 'mailto', 'OWNER_NAME', 'NAME_2') ELSE array('OWNER_ADDR', 'zip') END")
    return read(spark, sf_dir, "customer").select("c_custkey", fields.reads_as_names(values).alias("names"), fields.pick_field(names, ["taxpayer", "owner", "name"], ["addr"]).alias("field"))


@catalog.query("""
SELECT o_custkey, CASE o_custkey % 7 WHEN 0 THEN 'crypto_screen' WHEN 1 THEN 'phone_reputation' WHEN 2 THEN 'person_footprint' WHEN 3 THEN 'person_footprint' WHEN 4 THEN 'domain_dossier' WHEN 5 THEN 'person_footprint' ELSE 'custom' END AS playbook FROM (SELECT DISTINCT o_custkey FROM orders)
""")
def playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.expr("CASE o_custkey % 7 WHEN 0 THEN array('crypto_address') WHEN 1 THEN array('phone', 'phone') WHEN 2 THEN array('phone', 'person') WHEN 3 THEN array('username', 'domain') WHEN 4 THEN array('url', 'email') WHEN 5 THEN array('email', 'ip') ELSE array('username') END")
    return read(spark, sf_dir, "orders").select("o_custkey").distinct().select("o_custkey", fields.playbook(kinds).alias("playbook"))


@catalog.query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'ex.org' WHEN 1 THEN 'local' WHEN 2 THEN 'corp' || c_custkey || '.com' END AS apex FROM customer
""")
def seed_apexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE WHEN c_custkey % 6 < 2 THEN 'domain' WHEN c_custkey % 6 < 5 THEN 'email' ELSE 'ip' END")
    value = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'A.b.Ex.org' WHEN 1 THEN 'Local' WHEN 2 THEN 'me@mail.Corp' || c_custkey || '.com' WHEN 3 THEN 'me@gmail.com' WHEN 4 THEN 'me@host' ELSE '1.2.3.4' END")
    return read(spark, sf_dir, "customer").select("c_custkey", fields.seed_apex(kind, value, ["gmail.com", "yahoo.com"]).alias("apex"))


@catalog.query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'unknown' WHEN l_returnflag = 'R' THEN 'malicious' WHEN l_returnflag = 'A' THEN 'clean' ELSE 'suspicious' END AS verdict,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 's1' WHEN l_returnflag = 'R' THEN 's1,lake' WHEN l_returnflag = 'A' THEN '' ELSE 's1' END AS sources, CASE WHEN l_quantity > 25 THEN l_discount WHEN l_linestatus = 'O' THEN 0.1 ELSE 0.5 END AS confidence FROM lineitem
""")
def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.expr("CASE l_returnflag WHEN 'A' THEN 'clean' WHEN 'N' THEN 'suspicious' END")
    lake = F.expr("CASE WHEN l_returnflag = 'R' THEN array('s1', 'lake') END")
    found = fields.listing(verdict, F.array(F.lit("s1")), lake, F.expr("CASE WHEN l_linestatus = 'O' THEN 'a platform' END"))
    confidence = fields.evidence_confidence(F.col("l_quantity") > 25, F.col("l_linestatus") != "O", F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found["verdict"].alias("verdict"), F.array_join(found["sources"], ",").alias("sources"), confidence.alias("confidence"))


@catalog.query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Exit,Guard,Running' WHEN 1 THEN 'BadExit' ELSE '' END AS names, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events WHERE microsecond(ts) % 1000000 > 0")
def relay_flags_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.expr("CASE event_id % 3 WHEN 0 THEN 'EGR' WHEN 1 THEN 'B?' ELSE '' END")
    rows = read(spark, sf_dir, "events").where(F.date_format("ts", "SSSSSS") != "000000")
    return rows.select("event_id", F.array_join(fields.flag_names(letters), ",").alias("names"), fields.iso(F.col("ts")).alias("at"))


@catalog.query("""
WITH p AS (SELECT CASE n_nationkey % 2 WHEN 0 THEN n_name ELSE lower(n_name) END AS slug FROM nation), q AS (SELECT upper(n_name) AS asked FROM nation UNION SELECT 'NOWHERE')
SELECT asked, CASE WHEN slug <> asked THEN slug END AS canonical FROM q LEFT JOIN p ON lower(slug) = lower(asked)
""")
def canonical_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import other_spelling

    nation = read(spark, sf_dir, "nation")
    asked = nation.select(F.upper("n_name").alias("asked")).union(spark.createDataFrame([("NOWHERE",)], "asked string"))
    return other_spelling(asked, nation.select(F.expr("CASE n_nationkey % 2 WHEN 0 THEN n_name ELSE lower(n_name) END").alias("slug")))


@catalog.query("""
WITH t AS (SELECT s_suppkey, lower(s_name) AS n FROM supplier), q AS (SELECT c_custkey, right(c_name, 4) AS part FROM customer WHERE c_custkey % 100 = 0)
SELECT c_custkey, s_suppkey FROM q JOIN t ON contains(n, part)
""")
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import containing

    asked = read(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select("c_custkey", F.expr("right(c_name, 4)").alias("part"))
    return containing(asked, read(spark, sf_dir, "supplier").select("s_suppkey", F.lower("s_name").alias("n")), "part", "n").select("c_custkey", "s_suppkey")


@catalog.query("""
WITH e AS (SELECT event_id, '{"k": ' || props || ', "list": [' || user_id || ', {"kind": "' || event_type || '", "pair": [true, null, ["' || event_id || '"]]}], "none": {}}' AS j FROM events WHERE props IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL)
SELECT event_id, list(path || '=' || CASE WHEN type = 'BOOLEAN' THEN lower(CAST(atom AS VARCHAR)) ELSE json_extract_string(atom, '$') END ORDER BY path || '=' || CASE WHEN type = 'BOOLEAN' THEN lower(CAST(atom AS VARCHAR)) ELSE json_extract_string(atom, '$') END) AS leaves
FROM (SELECT e.event_id, t.type, t.atom, regexp_replace(regexp_replace(t.fullkey, '\\[[0-9]+\\]', '', 'g'), '^\\$\\.', '') AS path FROM e, json_tree(e.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')) GROUP BY 1
""")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"k": '), "props", F.lit(', "list": ['), "user_id", F.lit(', {"kind": "'), "event_type", F.lit('", "pair": [true, null, ["'), "event_id", F.lit('"]]}], "none": {}}'))
    rows = read(spark, sf_dir, "events").where("props is not null and user_id is not null and event_type is not null").select("event_id", nested.json_leaves(text).alias("leaves"))
    return rows.select("event_id", F.array_sort(F.transform("leaves", lambda x: F.concat(x["path"], F.lit("="), x["value"]))).alias("leaves"))
