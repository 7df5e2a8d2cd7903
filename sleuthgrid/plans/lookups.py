"""Join and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import web
from ..operators import graph, joins, search
from ..tables import read
from .catalog import Catalog

catalog = Catalog()


@catalog.query("""
WITH b AS (SELECT p_partkey AS band, (p_partkey * 40)::BIGINT AS lo, (p_partkey * 40 + 55 + p_partkey % 7)::BIGINT AS hi FROM part)
SELECT l_orderkey, l_linenumber, count(*) AS bands, min(band) AS first_band FROM lineitem JOIN b ON l_extendedprice::BIGINT BETWEEN lo AND hi GROUP BY 1, 2
""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("band"), (F.col("p_partkey") * 40).alias("lo"), (F.col("p_partkey") * 40 + 55 + F.col("p_partkey") % 7).alias("hi"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround("l_extendedprice").cast("long").alias("v"))
    return joins.range_join(items, bands, "v", "lo", "hi").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("bands"), F.min("band").alias("first_band"))


@catalog.query("""
WITH c AS (SELECT c_custkey, (c_custkey * 37 % 1801)::DOUBLE / 10 - 90 AS lat, (c_custkey * 61 % 3600)::DOUBLE / 10 - 180 AS lon FROM customer), s AS (SELECT s_suppkey, (s_suppkey * 53 % 1801)::DOUBLE / 10 - 90 AS lat2, (s_suppkey * 97 % 3600)::DOUBLE / 10 - 180 AS lon2 FROM supplier),
d AS (SELECT *, 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))) AS km FROM c, s)
SELECT c_custkey, s_suppkey, round_even(km, 4) AS km FROM d WHERE km <= 300
""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda key, a, m, to: (F.col(key) * a % m).cast("double") / 10 - to
    left = read(spark, sf_dir, "customer").select("c_custkey", place("c_custkey", 37, 1801, 90).alias("lat"), place("c_custkey", 61, 3600, 180).alias("lon"))
    right = read(spark, sf_dir, "supplier").select("s_suppkey", place("s_suppkey", 53, 1801, 90).alias("lat2"), place("s_suppkey", 97, 3600, 180).alias("lon2"))
    return joins.radius_join(left, right, 300.0).select("c_custkey", "s_suppkey", F.bround("km", 4).alias("km"))


@catalog.query("""
WITH p AS (SELECT DISTINCT left(p_name, n) AS prefix FROM part, (VALUES (3), (5), (8)) v(n) WHERE p_partkey % 3 = 0 AND length(p_name) >= n)
SELECT p_partkey, max_by(prefix, length(prefix)) AS prefix FROM part JOIN p ON starts_with(p_name, prefix) GROUP BY 1
""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    prefixes = part.where("p_partkey % 3 = 0").select("p_name", F.explode(F.array(F.lit(3), F.lit(5), F.lit(8))).alias("n")).where("length(p_name) >= n").select(F.expr("left(p_name, n)").alias("prefix")).distinct()
    return joins.longest_prefix_join(part, prefixes, "p_name", "prefix", ["p_partkey"]).select("p_partkey", "prefix")


@catalog.query("""
WITH h AS (SELECT page_id, regexp_extract(lower(url), '://([^/?#:]+)', 1) AS host FROM pages), r(root) AS (VALUES ('example.com'), ('example.net'), ('org'))
SELECT page_id, host, root FROM h JOIN r ON host = root OR ends_with(host, '.' || root)
""")
def prefix_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = read(spark, sf_dir, "pages").select("page_id", web.host_of(F.col("url")).alias("host"))
    roots = spark.createDataFrame([("example.com",), ("example.net",), ("org",)], "root string")
    return joins.subtree_join(hosts, roots, "host", "root")


@catalog.query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def semi_or_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.semi_any(items, read(spark, sf_dir, "part").where("p_size = 7"), ["l_partkey", "l_suppkey"], "p_partkey")


@catalog.query("""
SELECT 'customer' AS grp, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2
""")
def unified_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.lit("customer").alias("grp"), F.col("c_nationkey").alias("nation"))
    b = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("grp"), F.col("s_nationkey").alias("nation"))
    return a.union(b).groupBy("grp", "nation").agg(F.count("*").alias("n"))


_TOKENS = "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]{3,}')) AS token FROM documents), q(query_id, token) AS (VALUES (1, 'the'), (1, 'and'), (2, 'les'), (2, 'que'), (2, 'pour')) "


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "The and"), (2, "les que pour")], "query_id int, query string")


@catalog.query(_TOKENS + "SELECT query_id, doc_id, count(*) AS hits FROM t JOIN q USING (token) GROUP BY 1, 2 HAVING count(*) = CASE query_id WHEN 1 THEN 2 ELSE 3 END")
def token_index_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_tokens(search.token_index(read(spark, sf_dir, "documents"), "doc_id", "text", only=_queries(spark)), _queries(spark), "doc_id")


@catalog.query(_TOKENS + "SELECT query_id, doc_id, count(*) AS hits FROM t JOIN q USING (token) GROUP BY 1, 2")
def token_index_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_tokens(search.token_index(read(spark, sf_dir, "documents"), "doc_id", "text", only=_queries(spark)), _queries(spark), "doc_id", every=False)


def _found(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", tx.found(F.col("text"), pattern).alias("found"))
    return docs.where(F.size("found") > 0)


_FOUND = "SELECT doc_id, found FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '{}'))) AS found FROM documents) WHERE len(found) > 0"


@catalog.query(_FOUND.format(tx.EMAIL))
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, tx.EMAIL)


@catalog.query(_FOUND.format(tx.IPV4))
def ip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, tx.IPV4)


@catalog.query("SELECT page_id, list_sort(list_distinct(regexp_extract_all('see ' || coalesce(url, '') || ' and (HTTP://B.org/x) <' || coalesce(url, '') || '>', '{}'))) AS found FROM pages".format(tx.URL.replace("'", "''")))
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see "), F.coalesce("url", F.lit("")), F.lit(" and (HTTP://B.org/x) <"), F.coalesce("url", F.lit("")), F.lit(">"))
    return read(spark, sf_dir, "pages").select("page_id", tx.found(text, tx.URL).alias("found"))


@catalog.query(r"""
WITH h AS (SELECT doc_id, upper(lpad(to_hex(CAST(CAST(doc_id AS HUGEINT) * 2654435761 % 281474976710656 AS BIGINT)), 12, '0')) AS x FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, x[1:2] || ':' || x[3:4] || ':' || x[5:6] || ':' || x[7:8] || ':' || x[9:10] || ':' || x[11:12] AS mac, (('0x' || x[1:2])::INT >> 1) % 2 = 1 AS is_local FROM h
""")
def mac_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the product modulo 2**48, by halves of 24 bits so that it stays a long for every doc_id
    raw = F.lower(F.lpad(F.hex(F.expr("(((shiftright(doc_id, 24) & 16777215L) * 2654435761L & 16777215L) * 16777216L + (doc_id & 16777215L) * 2654435761L) & 281474976710655L")), 12, "0"))
    dashed = F.regexp_replace(raw, "(....)(?!$)", "$1.")
    mac = tx.mac_canonical(dashed)
    return read(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", mac.alias("mac"), tx.mac_is_local(mac).alias("is_local"))


@catalog.query(r"""
WITH n AS (SELECT regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://[^\s<>"'']+', '<url>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '<email>', 'g'), '[0-9]+(?:\.[0-9]+)*', '<n>', 'g') AS template, doc_id FROM documents)
SELECT template, count(*) AS n, min(doc_id) AS first_doc FROM n GROUP BY 1
""")
def note_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.template(F.coalesce("text", F.lit(""))).alias("template")).groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@catalog.query("""
WITH h AS (SELECT DISTINCT string_split(regexp_extract(lower(url), '://([^/?#:]+)', 1), '.') AS p FROM pages), d AS (SELECT DISTINCT p[-2] AS label, p[-1] AS tld FROM h WHERE len(p) >= 2),
i AS (SELECT label, tld, unnest(range(1, length(label) + 1)) AS i FROM d),
x AS (SELECT label, tld, left(label, i - 1) || substr(label, i + 1) || '.' || tld AS name FROM i UNION SELECT label, tld, left(label, i) || substr(label, i) || '.' || tld FROM i
  UNION SELECT label, tld, left(label, i - 1) || label[i + 1] || label[i] || substr(label, i + 2) || '.' || tld FROM i WHERE i < length(label) UNION SELECT label, tld, label || '.' || t FROM d, (VALUES ('com'), ('net'), ('org'), ('co'), ('io')) v(t))
SELECT label || '.' || tld AS domain, name FROM x WHERE name <> label || '.' || tld AND name[1] <> '.'
""")
def lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(web.host_of(F.col("url")), r"\.")
    domains = read(spark, sf_dir, "pages").select(F.try_element_at(parts, F.lit(-2)).alias("label"), F.element_at(parts, -1).alias("tld")).distinct()
    return domains.where("label is not null").select(F.concat_ws(".", "label", "tld").alias("domain"), F.explode(tx.lookalikes(F.col("label"), F.col("tld"))).alias("name"))


_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    return items.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_linestatus").alias("rel"))


@catalog.query(f"""
WITH RECURSIVE {_EDGES}, r(node, hops) AS (SELECT 's1', 0 UNION SELECT e.b, hops + 1 FROM r JOIN e ON e.a = r.node WHERE hops < 3)
SELECT node, min(hops)::INT AS hops FROM r GROUP BY 1
""")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hops_from(_edges(spark, sf_dir), "s1", 3)


@catalog.query(f"""
WITH RECURSIVE {_EDGES}, s(node, rank) AS (VALUES ('s1', 0), ('s2', 1), ('s3', 2)), r(node, seed, rank, hops) AS (SELECT node, node, rank, 0 FROM s UNION SELECT e.b, seed, rank, hops + 1 FROM r JOIN e ON e.a = r.node WHERE hops < 3),
d AS (SELECT node, seed, rank, min(hops) AS hops FROM r GROUP BY ALL), m AS (SELECT node, min(hops) AS hops FROM d GROUP BY 1)
SELECT m.node, m.hops::INT AS hops, min_by(seed, rank) AS seed, m.hops = 1 AND count(*) > 1 AS shared FROM m JOIN d ON d.node = m.node AND d.hops = m.hops GROUP BY 1, m.hops
""")
def group_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("s1", 0), ("s2", 1), ("s3", 2)], "node string, rank int")
    return graph.nearest_seed(_edges(spark, sf_dir), seeds, 3)


@catalog.query("""
WITH e AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_linestatus AS rel FROM lineitem)
SELECT node, count(*) AS degree, count(*) FILTER (rel = 'O') AS strong FROM (SELECT source AS node, rel FROM e UNION ALL SELECT target, rel FROM e) GROUP BY 1
""")
def degree_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir), ["O"])
