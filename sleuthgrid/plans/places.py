"""Queries of counties, regions and platforms, on names and texts made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web
from ..operators import places
from ..tables import dealt, read
from .catalog import Catalog

catalog = Catalog()
_CODES = list(places.STATES)


def _counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("element_at(array('County', 'Parish', 'Borough'), p_size % 3 + 1)")
    code = F.element_at(F.array(*(F.lit(c) for c in _CODES)), (F.col("p_partkey") % len(_CODES) + 1).cast("int"))
    return read(spark, sf_dir, "part").select(code.alias("state"), F.concat(F.initcap("p_name"), F.lit(" "), kind).alias("name"), F.col("p_partkey").alias("place"))


_SQL = f"""
WITH codes AS (SELECT {_CODES!r} AS s), c AS (
  SELECT s[p_partkey % 51 + 1] AS state, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) || ' ' || ['County', 'Parish', 'Borough'][p_size % 3 + 1] AS name, p_partkey AS place FROM part, codes
), b AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS want, s[o_custkey % 51 + 1] AS st, o_orderkey % 4 <> 1 AS told FROM orders JOIN part ON p_partkey = o_custkey, codes
), w AS (SELECT DISTINCT want FROM b), m AS (
  SELECT want, state, min_by(name, place) AS name, min(place) AS place FROM w JOIN c ON contains(lower(name), want) GROUP BY ALL
), f AS (SELECT want, min_by(name, (state, place)) AS name, min(state) AS state FROM m GROUP BY want)
"""


@catalog.query(_SQL + """
SELECT o_orderkey, coalesce(m.name, f.name) AS county, coalesce(m.state, f.state) AS state FROM b JOIN f USING (want) LEFT JOIN m ON m.want = b.want AND m.state = b.st AND b.told
""")
def named_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("o_custkey"))
    want = F.when(F.col("o_orderkey") % 3 == 0, F.initcap(F.split("p_name", " ")[1])).otherwise(F.initcap("p_name"))
    code = F.element_at(F.array(*(F.lit(c) for c in _CODES)), (F.col("o_custkey") % len(_CODES) + 1).cast("int"))
    text = F.concat(F.lit("as filed in "), want, F.lit(" county"), F.when(F.col("o_orderkey") % 4 != 1, F.concat(F.lit(", "), F.lower(code))).otherwise(""))
    return places.lookup_counties(joined.select("o_orderkey", text.alias("text")), _counties(spark, sf_dir), ["o_orderkey"], "text")


@catalog.query(_SQL + """
, x AS (SELECT o_orderkey, o_orderkey % 5 AS form, want, st, told FROM b WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey, CASE WHEN form = 0 THEN st WHEN form IN (1, 2) THEN coalesce(m.state, f.state) END AS state, CASE WHEN form IN (1, 2) THEN coalesce(m.name, f.name) END AS county,
  form = 0 AS statewide, CASE WHEN form = 0 THEN 'statewide' WHEN form IN (1, 2) THEN 'metadata' ELSE 'unresolved' END AS basis
FROM x JOIN f USING (want) LEFT JOIN m ON m.want = x.want AND m.state = x.st
""")
def layer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").where("o_orderkey % 3 <> 0")).join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("o_custkey"))
    at = (F.col("o_custkey") % len(_CODES) + 1).cast("int")
    code, name = (F.element_at(F.array(*(F.lit(c) for c in x)), at) for x in (_CODES, list(places.STATES.values())))
    form = F.col("o_orderkey") % 5
    meta = F.when(form == 0, F.concat(F.lit("all parcels, "), name, F.lit(" Statewide, of each of its counties"))).when(form == 1, F.concat(F.initcap("p_name"), F.lit(" County, "), code)).when(form == 2, F.concat(F.lit("by "), F.initcap("p_name"), F.lit(" County, "), name))
    url = F.when(form == 3, "https://gis.example.org/rest/services/Nowhereville_County_Parcels/FeatureServer/0").when(form == 4, F.concat(F.lit("https://gis.example.com/rest/services/"), F.split("p_name", " ")[0], F.lit("_Feature_Service/FeatureServer")))
    return places.region_of_layers(joined.select("o_orderkey", url.alias("url"), meta.alias("meta")), _counties(spark, sf_dir), ["o_orderkey"], "url", "meta")


@catalog.query("""
WITH h AS (SELECT page_id, rtrim(lower(regexp_extract(url, '^[^:]*://([^/?#:]*)', 1)), '.') AS host FROM pages WHERE contains(url, '://')),
p AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-k:], '.') AS domain FROM h, (VALUES (2), (3)) v(k) WHERE len(string_split(host, '.')) >= k AND (k = 2 OR length(host) % 2 = 0))
SELECT page_id, host, max_by(domain, length(domain)) AS domain, length(max_by(domain, length(domain))) AS size FROM h LEFT JOIN p ON host = domain OR ends_with(host, '.' || domain) GROUP BY ALL
""")
def page_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = read(spark, sf_dir, "pages").where("contains(url, '://')").select("page_id", web.host_of(F.col("url")).alias("host"))
    labels = F.split("host", r"\.")
    some = lambda k: hosts.where(F.size(labels) >= k).where("true" if k == 2 else "length(host) % 2 = 0").select(F.array_join(F.slice(labels, -k, k), ".").alias("domain"))
    platforms = some(2).union(some(3)).distinct().withColumn("size", F.length("domain").cast("long"))
    return places.platform_of_hosts(hosts, platforms).select("page_id", "host", "domain", "size")
