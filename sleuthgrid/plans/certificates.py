"""Queries of certificate logs: entries are encoded from the given pages by built-in functions, then decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.certificates import certificate_domains, decode_entries, new_certificates
from ..tables import read
from .catalog import Catalog

catalog = Catalog()


def _hex(n: Column | str, digits: int) -> Column:
    return F.lpad(F.hex(F.col(n) if isinstance(n, str) else n), digits, "0")


def _element(tag: str, content: Column) -> Column:
    """A DER element; its content is named once, so that nested ones don't repeat it."""
    head = lambda n: F.unhex(F.concat(F.lit(tag), F.when(n < 128, _hex(n, 2)).when(n < 256, F.concat(F.lit("81"), _hex(n, 2))).when(n < 65536, F.concat(F.lit("82"), _hex(n, 4))).otherwise(F.concat(F.lit("83"), _hex(n, 6)))))
    return F.element_at(F.transform(F.array(content), lambda c: F.concat(head(F.octet_length(c)), c)), 1)


def _raw(hex_digits: str) -> Column:
    return F.unhex(F.lit(hex_digits))


def _name(oid: str, text: Column) -> Column:
    return _element("31", _element("30", F.concat(_raw("06035504" + oid), _element("0c", F.encode(text, "UTF-8")))))


def _time(at: Column) -> Column:
    """A date of a validity: with two digits of the year up to 2049, with all four from 2050 on."""
    text = lambda tag, form: _element(tag, F.encode(F.date_format(at, form), "UTF-8"))
    return F.when(F.year(at) < 2050, text("17", "yyMMddHHmmss'Z'")).otherwise(text("18", "yyyyMMddHHmmss'Z'"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log entry for each page: its host and names from its links, its title as issuer, every second one a precertificate, every seventh cut."""
    host = F.lower(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1))
    links = F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), 1)
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    rows = read(spark, sf_dir, "pages").where("url is not null and html is not null").select("page_id", host.alias("host"), F.transform(links, lambda x: F.concat(x, F.lit("."), host)).alias("names"), title.alias("title"))
    serial = F.lpad(F.hex(F.col("page_id") + 1), 16, "0")
    begin = F.expr("timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(cast(page_id % 20000 as int), cast(page_id % 24 as int))")
    names = F.aggregate("names", _raw(""), lambda all_, x: F.concat(all_, _element("82", F.encode(x, "UTF-8"))))
    own = F.encode(F.concat(F.lit("*."), "host"), "UTF-8")
    rows = rows.select("*", _element("30", F.concat(_element("82", own), names)).alias("san"))
    rows = rows.select("*", _element("a3", _element("30", _element("30", F.concat(_raw("0603551d11"), _element("04", F.col("san")))))).alias("extensions"))
    issuer = F.when(F.col("title") == "", _name("03", F.lit("unnamed"))).otherwise(_name("0a", F.col("title")))
    rows = rows.select("*", _element("30", issuer).alias("issuer"), _element("30", F.concat(_time(begin), _time(begin + F.expr("interval 90 days")))).alias("validity"), _element("30", _name("03", F.concat(F.upper("host"), F.lit(".")))).alias("subject"))
    head = F.concat(_raw("a003020102"), _element("02", F.unhex(serial)), _raw("3003060100"))
    rows = rows.select("*", _element("30", F.concat(head, "issuer", "validity", "subject", _raw("3003060100"), "extensions")).alias("body"))
    rows = rows.select("page_id", "body", _element("30", F.concat("body", _raw("300306010003020000"))).alias("whole"))
    held = F.concat(F.unhex(_hex(F.octet_length("whole"), 6)), F.expr("CASE WHEN page_id % 7 = 3 THEN substring(whole, 1, octet_length(whole) div 2) ELSE whole END"))
    rows = rows.select("page_id", "whole", held.alias("held"), F.unhex(F.concat(F.lit("0000"), _hex(F.col("page_id") * 1000, 16), F.expr("CASE WHEN page_id % 2 = 0 THEN '0000' ELSE '0001' END"))).alias("head"))
    even = F.col("page_id") % 2 == 0
    return rows.select(
        F.concat(F.lit("log"), F.col("page_id") % 3).alias("log"), F.col("page_id").alias("entry_index"),
        F.base64(F.when(even, F.concat("head", "held")).otherwise(F.concat("head", _raw("00000000")))).alias("leaf_input"), F.when(even, F.lit("")).otherwise(F.base64("held")).alias("extra_data"), F.sha2("whole", 256).alias("sha256"),
    )


_NAMES = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host, regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1) AS links, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), n AS (
  SELECT page_id, trim(host, '.') AS name FROM p UNION SELECT page_id, '*.' || host FROM p UNION SELECT page_id, lower(unnest(links)) || '.' || host FROM p
)"""


@catalog.query(_NAMES + """
, d AS (SELECT page_id, list(name ORDER BY name) AS domains FROM n WHERE name <> '' GROUP BY 1)
SELECT 'log' || page_id % 3 AS log, page_id AS entry_index, CAST(page_id % 2 AS INTEGER) AS entry_type, page_id * 1000 AS timestamp_ms, CASE WHEN ok THEN domains ELSE [] END AS domains, CASE WHEN ok THEN upper(host) || '.' END AS cn,
  CASE WHEN ok THEN CASE WHEN title = '' THEN 'unnamed' ELSE title END END AS issuer, CASE WHEN ok THEN lower(to_hex(page_id + 1)) END AS serial,
  CASE WHEN ok THEN TIMESTAMP '2020-01-01' + to_days(CAST(page_id % 20000 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) END AS not_before,
  CASE WHEN ok THEN TIMESTAMP '2020-01-01' + to_days(CAST(page_id % 20000 + 90 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) END AS not_after, NOT ok AS broken, ok AS fingerprint_fits
FROM (SELECT *, page_id % 7 <> 3 AS ok FROM p) JOIN d USING (page_id)
""")
def certificate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = entries(spark, sf_dir)
    out = decode_entries(made).withColumn("broken", F.col("error").isNotNull())
    right = made.select("log", "entry_index", "sha256")
    out = out.join(right, ["log", "entry_index"]).withColumn("fingerprint_fits", F.coalesce(F.col("fingerprint_sha256") == F.col("sha256"), F.lit(False)))
    return out.drop("error", "fingerprint_sha256", "fingerprint_sha1", "sha256")


@catalog.query(_NAMES + """
SELECT 'log' || page_id % 3 AS log, page_id AS entry_index, name, array_to_string(list_reverse(string_split(name, '.')), '.') AS rdn FROM n WHERE name <> '' AND page_id % 7 <> 3 AND page_id % 3 <> 1
""")
def certificate_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_entries(entries(spark, sf_dir))
    stored = decoded.where("log = 'log1'")  # one log is in the store, the others aren't; all entries come a second time
    return certificate_domains(new_certificates(decoded.unionByName(decoded), stored))
