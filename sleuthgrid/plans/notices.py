"""Queries of notices of deaths and of the graphs that they make; notices are written around the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kinship
from ..tables import dealt, read
from .catalog import Catalog

catalog = Catalog()


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    letters = lambda n: F.translate(n.cast("string"), "0123456789", "abcdefghij")
    own, other = F.concat(F.lit("K"), letters(k)), F.concat(F.lit("M"), letters(k * 7 + 11))
    text = F.concat(
        F.lit("Anna "), own, F.lit(", "), (k % 90 + 10).cast("string"), F.lit(", of Port "), F.initcap(F.lower("c_mktsegment")), F.lit(", passed away on March "), (k % 28 + 1).cast("string"), F.lit(", 2024. She is survived by her husband Carl "), own,
        F.when(k % 2 == 0, "; children Dora, Emil and Fred").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("; sisters Gina "), other, F.lit(" and Hanna "), other)).otherwise(""), F.when(k % 5 == 0, F.concat(F.lit("; son-in-law Ivo "), other)).otherwise(""),
        F.lit(". "), F.when(k % 7 == 0, F.concat(F.lit("She was preceded in death by her father Jan "), own, F.lit(" and mother Karla "), other, F.lit(". "))).otherwise(""), F.lit("Services will be held at Lind Funeral Home. Interment at "), F.initcap(F.lower("c_mktsegment")), F.lit(" Hill Cemetery."),
    )
    return dealt(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select(k.alias("k"), F.concat(F.lit("Anna "), own).alias("name"), text.alias("text"))


_KIN = """
WITH c AS (SELECT c_custkey AS k, 'K' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS own, 'M' || translate(CAST(c_custkey * 7 + 11 AS VARCHAR), '0123456789', 'abcdefghij') AS other, upper(c_mktsegment[1]) || lower(substr(c_mktsegment, 2)) AS seg FROM customer),
kin AS (
  SELECT k, 'Carl ' || own AS relative, 'spouse' AS role, true AS living FROM c UNION ALL SELECT k, unnest(['Dora ', 'Emil ', 'Fred ']) || own, 'child', true FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, unnest(['Gina ', 'Hanna ']) || other, 'sibling', true FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'Ivo ' || other, 'in_law', true FROM c WHERE k % 5 = 0
  UNION ALL SELECT k, 'Jan ' || own, 'parent', false FROM c WHERE k % 7 = 0 UNION ALL SELECT k, 'Karla ' || other, 'parent', false FROM c WHERE k % 7 = 0
)
"""


@catalog.query(_KIN + "SELECT k, relative, role, living FROM kin")
def notice_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinship.obituary_kin(_notices(spark, sf_dir), ["k"], "text", "name").drop("span")


@catalog.query(_KIN + """
, p AS (SELECT k, seg FROM c), e AS (
  SELECT k, lower('person:Anna ' || own) AS a, lower('person:' || relative) AS b, 'related_to' AS rel, role FROM kin JOIN c USING (k)
  UNION ALL SELECT k, lower('person:' || relative), lower('person:Anna ' || own), 'related_to', CASE role WHEN 'child' THEN 'parent' WHEN 'parent' THEN 'child' ELSE role END FROM kin JOIN c USING (k)
  UNION ALL SELECT k, lower('person:Anna ' || own), lower('location:Port ' || seg), 'located_in', 'residence' FROM c UNION ALL SELECT k, lower('person:Anna ' || own), lower('location:' || seg || ' Hill Cemetery'), 'located_in', 'cemetery' FROM c
  UNION ALL SELECT k, lower('person:Anna ' || own), 'org:lind funeral home', 'associated_with', 'funeral_home' FROM c
  UNION ALL SELECT o_custkey, lower('person:Anna ' || own), 'order:' || o_orderkey, 'owns', 'order' FROM orders JOIN c ON k = o_custkey
), n AS (SELECT k, a AS id FROM e UNION SELECT k, b FROM e)
SELECT e.k, CAST(count(*) AS BIGINT) AS n_edges, any_value(m) AS n_nodes, list(DISTINCT rel || '>' || b ORDER BY rel || '>' || b) AS ends, bool_and(contains(a, ':')) AS whole FROM e JOIN (SELECT k, CAST(count(*) AS BIGINT) AS m FROM n GROUP BY 1) n USING (k) GROUP BY 1
""")
def notice_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = _notices(spark, sf_dir)
    facts, kin = kinship.obituary_facts(notices, ["k"], "text", "name"), kinship.obituary_kin(notices, ["k"], "text", "name")
    owned = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("value"), F.lit("owns").alias("rel"), F.lit("order").alias("role"), F.lit(0.6).alias("confidence"))
    graphs = kinship.graphs_as_json(kinship.attach_records(kinship.kinship_edges(facts, kin, ["k"]), facts, owned, ["k"]), ["k"])
    g = F.from_json("graph", "nodes array<struct<id:string>>, edges array<struct<source_id:string,target_id:string,rel:string>>")
    ids = F.transform("g.nodes", lambda n: n["id"])
    inside = F.forall("g.edges", lambda e: F.array_contains(ids, e["source_id"]) & F.array_contains(ids, e["target_id"]))
    ends = F.array_sort(F.array_distinct(F.transform("g.edges", lambda e: F.concat(e["rel"], F.lit(">"), e["target_id"]))))
    return graphs.select("k", g.alias("g")).select("k", F.size("g.edges").cast("long").alias("n_edges"), F.size("g.nodes").cast("long").alias("n_nodes"), ends.alias("ends"), inside.alias("whole"))
