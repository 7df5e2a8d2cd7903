import json

from pyspark.sql import functions as F

from sleuthgrid.functions.nested import flat_object, json_records
from sleuthgrid.operators import alerts


def test_forms_of_records(spark):
    texts = ['{"A": {"b": [3, 4], "C": ""}, "d": true}', '{"x": 1}\nnoise\n{"x": "2"}', '{"hits": {"hits": [{"_source": {"y": {"z": "v"}}}]}}', '[{"a": null}, 5]', "plain", "", None, "[" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    found = rows.select("i", F.explode(json_records(F.col("t"))).alias("v")).select("i", flat_object(F.col("v")).alias("f"))
    assert [tuple(r) for r in found.collect()] == [(0, {"a.b": "3", "d": "true"}), (1, {"x": "1"}), (1, {"x": "2"}), (2, {"y.z": "v"}), (3, {})]


def test_kinds_and_indicators(spark):
    records = [
        {"destination": {"ip": "8.8.8.8", "port": 443}, "source": {"ip": "10.0.0.5"}, "rule": {"name": "r"}, "host": {"name": "h"}, "event": {"count": "7"}},
        {"src_ip": "9.9.9.9", "dest_ip": "10.0.0.5", "dest_port": 22, "http": {"hostname": "us.ex.com", "uri": "/x"}},
        {"dns": {"question": {"name": "Bad.Ex.COM."}}, "user": "u"},
        {"url": {"full": "https://a.ex.org:8/p?q"}, "url.domain": "a.ex.org", "user_agent": {"original": "UA"}},
        {"direction": "Inbound", "client": {"ip": "2a01::7"}, "query": "printer.local", "dest_port": "-1"},
        {"url": "/only/a/path", "domain": "x.lan"},
    ]
    raw = spark.createDataFrame([(1, "\n".join(map(json.dumps, records)), 0)], "id int, text string, nth int").drop("nth")
    got = {r["nth"]: r for r in alerts.normalise(raw, ["id"], "text").collect()}
    assert [got[i]["kind"] for i in range(6)] == ["outbound_conn", "inbound_conn", "dns_query", "web_request", "inbound_conn", "outbound_conn"]
    assert [[tuple(x) for x in got[i]["indicators"]] for i in range(6)] == [[("ip", "8.8.8.8")], [("ip", "9.9.9.9")], [("domain", "bad.ex.com")], [("url", "https://a.ex.org:8/p?q"), ("domain", "a.ex.org")], [("ip", "2a01::7")], []]
    assert [got[i]["context"] for i in range(6)] == [{"remote port": "443", "detection rule": "r"}, {"our port": "22"}, {}, {}, {}, {}]
    assert [got[i]["untrusted"] for i in range(6)] == [{}, {"requested path": "/x"}, {}, {"user agent": "UA"}, {}, {}]
    assert [got[i]["kept_local"] for i in range(6)] == [["host.name", "internal address"], ["internal address"], ["user"], [], [], []] and got[0]["events"] == 7


def test_no_records_no_rows(spark):
    assert alerts.normalise(spark.createDataFrame([(1, None), (2, "text")], "id int, text string"), ["id"], "text").count() == 0
