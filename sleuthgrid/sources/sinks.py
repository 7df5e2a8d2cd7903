"""Writers of block lists and case bundles, as folders of text or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How each format writes a host.
FORMATS = {"plain": "{}", "hosts": "0.0.0.0 {}", "adblock": "||{}^"}


def blocklist(hosts: DataFrame, column: str, form: str, path: str) -> None:
    """Write the distinct hosts, sorted, in one of FORMATS."""
    before, after = FORMATS[form].split("{}")
    lines = hosts.select(F.lower(F.trim(F.col(column))).alias("h")).where("h <> ''").distinct().orderBy("h")
    lines.select(F.concat(F.lit(before), "h", F.lit(after)).alias("value")).write.mode("overwrite").text(path)


def graph_lines(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """Write entities and edges as JSON lines, each with its kind; edges only between the entities written."""
    ids = entities.select("node")
    kept = edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")
    lines = entities.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("value")).union(kept.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("value")))
    lines.select(F.to_json(F.struct("kind", "value")).alias("value")).write.mode("overwrite").text(path)


def _xml(text: Column) -> Column:
    """A text as it stands in XML; characters that XML can't hold go."""
    out = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F￾￿]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def graphml_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, place, value): the lines of a GraphML document, in the order of part and place.

    entities: node and further columns, which become data of the nodes; edges: source, target and further ones. Edges stand
    between written nodes alone, and parallel edges stay; null data are left out. A node that repeats is written once.
    """
    own, ties = [c for c in entities.columns if c != "node"], [c for c in edges.columns if c not in ("source", "target")]
    nodes = entities.where("node is not null").dropDuplicates(["node"])
    ids = nodes.select("node")
    kept = edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")
    data = lambda side, names: F.concat(F.lit(""), *(F.when(F.col(f"`{c}`").isNull(), "").otherwise(F.concat(F.lit(f'<data key="{side}{i}">'), _xml(F.col(f"`{c}`")), F.lit("</data>"))) for i, c in enumerate(names)))
    name = lambda c: c.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    keys = "".join(f'<key id="{s}{i}" for="{what}" attr.name="{name(c)}" attr.type="string"/>' for s, what, names in (("n", "node", own), ("e", "edge", ties)) for i, c in enumerate(names))
    frame = entities.sparkSession.createDataFrame([(0, "", f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "part int, place string, value string")
    as_node = nodes.select(F.lit(1).alias("part"), F.col("node").cast("string").alias("place"), F.concat(F.lit('<node id="'), _xml(F.col("node")), F.lit('">'), data("n", own), F.lit("</node>")).alias("value"))
    as_edge = kept.select(F.lit(2).alias("part"), F.concat_ws(" ", "source", "target").alias("place"), F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), data("e", ties), F.lit("</edge>")).alias("value"))
    return frame.unionByName(as_node).unionByName(as_edge)


def graphml(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a GraphML document as text files: executors write their ranges, and the files of the folder, joined by name, are the document. Nothing is collected."""
    graphml_lines(entities, edges).orderBy("part", "place").select("value").write.mode("overwrite").text(path)
