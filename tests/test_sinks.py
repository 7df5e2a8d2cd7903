from pathlib import Path
from xml.etree import ElementTree

from sleuthgrid.sources.sinks import graphml


def test_parts_make_one_valid_graph(spark, tmp_path):
    nodes = [(f"n{i}", f'<&"> \n\t\x01é {i}' if i % 2 else None) for i in range(50)] + [("n1", "again"), (None, "x")]
    edges = [(f"n{i}", f"n{i * 7 % 60}", "r&d") for i in range(50)] + [("n1", "n7", "second"), (None, "n1", "x")]
    at = tmp_path / "g"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts, however little there is
    graphml(spark.createDataFrame(nodes, "node string, `a label` string"), spark.createDataFrame(edges, "source string, target string, rel string"), str(at))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(Path(at).glob("part-*"))
    assert len(files) > 1
    root = ElementTree.fromstring("".join(f.read_text() for f in files))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    ids = [n.get("id") for n in root.iter(f"{ns}node")]
    ends = [(e.get("source"), e.get("target")) for e in root.iter(f"{ns}edge")]
    assert sorted(ids) == sorted({f"n{i}" for i in range(50)})
    assert sorted(ends) == sorted((s, t) for s, t, _ in edges if s in ids and t in ids) and ends.count(("n1", "n7")) == 2
    labels = {n.get("id"): n[0].text for n in root.iter(f"{ns}node") if len(n)}
    assert labels["n3"] == '<&"> \n\té 3' and "n2" not in labels
    assert [k.get("attr.name") for k in root.iter(f"{ns}key")] == ["a label", "rel"]
