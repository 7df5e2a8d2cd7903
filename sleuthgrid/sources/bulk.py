"""Readers of bulk files. Schemas are stated, so nothing is scanned to infer them; rows that can't be read are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import any_date, filing_date
from ..functions.names import canonical
from ..functions.network import address_key, ip_number
from ..functions.web import host_of


def _fields(spark: SparkSession, path: str, names: dict[int, str], width: int, sep: str = "|") -> DataFrame:
    """The named fields of lines without a header; empty ones are null."""
    schema = ", ".join(f"`{names.get(i, f'_{i}')}` string" for i in range(width))
    lines = spark.read.csv(path, sep=sep, schema=schema, quote="" if sep == "|" else '"', mode="PERMISSIVE")
    return lines.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in names.values()))


def contributions(spark: SparkSession, path: str) -> DataFrame:
    """Individual contributions from pipe-delimited lines: norm name, city, state, zip, employer, occupation, day, amount."""
    at = {6: "entity", 7: "name", 8: "city", 9: "state", 10: "zip", 11: "employer", 12: "occupation", 13: "date", 14: "amount"}
    rows = _fields(spark, path, at, 21).where("entity = 'IND' and name is not null")
    return rows.select(canonical(F.col("name")).alias("norm"), "name", "city", "state", F.substring("zip", 1, 5).alias("zip"), "employer", "occupation", filing_date(F.col("date")).alias("day"), F.expr("try_cast(amount as double)").alias("amount")).where("norm <> ''")


def contributor_totals(rows: DataFrame) -> DataFrame:
    """One row for each name, state and zip: count, sum, first and last day, and the set of employers."""
    return rows.groupBy("norm", "state", "zip").agg(
        F.count("*").alias("contributions"), F.sum("amount").alias("total"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.array_sort(F.collect_set("employer")).alias("employers"))


def providers(spark: SparkSession, path: str) -> DataFrame:
    """Individual providers from a headed CSV; organisations and rows without a number or name are left out."""
    rows = spark.read.csv(path, header=True, escape='"')
    get = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    people = rows.where(get("Entity Type Code") == "1").select(get("NPI").alias("npi"), F.concat_ws(" ", get("Provider First Name"), get("Provider Middle Name"), get("Provider Last Name (Legal Name)")).alias("name"),
        get("Provider Business Practice Location Address State Name").alias("state"), get("Healthcare Provider Taxonomy Code_1").alias("taxonomy"), any_date(get("Provider Enumeration Date")).alias("enumerated"))
    return people.where("npi is not null and name <> ''").withColumn("norm", canonical(F.col("name")))


def licences(spark: SparkSession, headers: str, entities: str) -> DataFrame:
    """Personal licences: header lines joined to entity lines by their system number; of repeated entities the last by callsign."""
    hd = _fields(spark, headers, {1: "usi", 4: "callsign", 5: "status", 6: "service"}, 50)
    en = _fields(spark, entities, {1: "usi", 4: "en_callsign", 5: "kind", 7: "entity", 8: "first", 10: "last", 15: "street", 16: "city", 17: "state", 18: "zip"}, 30)
    last = en.withColumn("_i", F.row_number().over(Window.partitionBy("usi").orderBy(F.desc_nulls_last("en_callsign"), F.desc("entity")))).where("_i = 1").drop("_i", "en_callsign")
    return hd.join(last, "usi").withColumn("norm", canonical(F.concat_ws(" ", "first", "last")))


def exploit_scores(spark: SparkSession, path: str) -> DataFrame:
    """cve, score, percentile from a CSV whose first lines begin with #; bad rows are left out."""
    rows = spark.read.csv(path, schema="cve string, score string, percentile string", comment="#")
    return rows.where(F.col("cve").rlike(r"^CVE-\d{4}-\d{4,}$")).select("cve", F.expr("try_cast(score as double)").alias("score"), F.expr("try_cast(percentile as double)").alias("percentile")).where("score is not null")


def score_header(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the # line; a value may itself hold colons."""
    pairs = spark.read.text(path).where(F.col("value").startswith("#")).select(F.explode(F.split(F.expr("substring(value, 2)"), ",")).alias("p"))
    return pairs.select(F.substring_index("p", ":", 1).alias("key"), F.expr("substring(p, length(substring_index(p, ':', 1)) + 2)").alias("value"))


def ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Ranges of addresses with places from lines of 8 fields, or 7 without the continent: version, start and end (IPv4 as a number, null for IPv6), start_key and end_key (keys in the order of a version's addresses, for both). Rows whose ends are of two versions are left out."""
    raw = spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(8)))
    short = F.expr("try_cast(c6 as double) is not null and c7 is null")
    at = lambda long_, short_: F.when(short, F.col(f"c{short_}")).otherwise(F.col(f"c{long_}"))
    out = raw.select(F.when(F.contains("c0", F.lit(":")), 6).otherwise(4).alias("version"), ip_number(F.col("c0")).alias("start"), ip_number(F.col("c1")).alias("end"), address_key(F.col("c0")).alias("start_key"), address_key(F.col("c1")).alias("end_key"), at(3, 2).alias("country"), at(4, 3).alias("region"), at(5, 4).alias("city"), at(6, 5).try_cast("double").alias("lat"), at(7, 6).try_cast("double").alias("lon"))
    return out.where("start_key is not null and end_key is not null and (start is null) = (end is null) and start_key <= end_key")


def malware_urls(spark: SparkSession, path: str) -> DataFrame:
    """URL reports from a commented, quoted CSV; rows need a url with a host."""
    names = "id dateadded url url_status last_online threat tags urlhaus_link reporter".split()
    rows = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), comment="#", quote='"', ignoreLeadingWhiteSpace=True)
    return rows.withColumn("host", host_of(F.col("url"))).where("host is not null").select("id", "url", "host", F.col("url_status").alias("status"), "threat", F.split("tags", ",").alias("tags"))


def command_servers(spark: SparkSession, path: str) -> DataFrame:
    """ip:port and confidence (100 online, 50 else) from a JSON array of objects."""
    rows = spark.read.json(path, schema="ip_address string, port long, status string, malware string", multiLine=True)
    return rows.where("ip_address is not null").select(F.concat_ws(":", "ip_address", "port").alias("ioc"), "malware", F.when(F.col("status") == "online", 100).otherwise(50).alias("confidence"))


def sanctioned_addresses(spark: SparkSession, path: str) -> DataFrame:
    """One row for each digital currency address of a sanctions list in XML."""
    ids = "array<struct<idType:string, idNumber:string>>"
    rows = spark.read.format("xml").option("rowTag", "sdnEntry").schema(f"uid string, lastName string, programList struct<program:array<string>>, idList struct<id:{ids}>").load(path)
    each = rows.select("uid", F.col("lastName").alias("name"), F.col("programList.program").alias("programs"), F.explode("idList.id").alias("i")).where(F.col("i.idType").startswith("Digital Currency Address - "))
    return each.select("uid", "name", "programs", F.substring_index("i.idType", " - ", -1).alias("asset"), F.col("i.idNumber").alias("address"), F.lit(0.98).alias("confidence"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """slug, title, page_type, tags and body of Markdown files that begin with frontmatter."""
    raw = spark.read.text(path, wholetext=True)
    head, body = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?(.*)$", 1), F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?(.*)$", 2)
    field: dict[str, Column] = {k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*\"?([^\n\"]*)", 1)), F.lit("")) for k in ("slug", "title", "page_type", "tags")}
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(field["tags"], F.lit("")), r"[\[\]]", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    return raw.where(F.col("value").startswith("---\n")).select(field["slug"].alias("slug"), field["title"].alias("title"), F.coalesce(field["page_type"], F.lit("other")).alias("page_type"), tags.alias("tags"), body.alias("body")).where("slug is not null")
