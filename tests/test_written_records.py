import hashlib
import hmac

from pyspark.sql import functions as F

from sleuthgrid.functions.phones import hmac_sha256, phone, reporter_key
from sleuthgrid.sources import records


def test_phones_and_keys(spark):
    given = ["(212) 555-0123", "+1 800 555 0100", "1-900-555-0199", "555-0123", "+44 20 7946 0958", "112 555 0123", "2115550123", "2121115550", "212-ABC-0123", None, "12125550123"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, raw string").select("i", phone(F.col("raw")).alias("p")).orderBy("i").collect()
    assert [r["p"]["e164"] for r in rows] == ["+12125550123", "+18005550100", "+19005550199", *[None] * 7, "+12125550123"]
    assert [r["p"]["kind"] for r in rows[:3]] == ["fixed_or_mobile", "toll_free", "premium"] and rows[0]["p"]["national"] == "(212) 555-0123" and not rows[3]["p"]["valid"]
    for secret in (b"key", b"k" * 100):
        got = spark.createDataFrame([("é|x",), ("",)], "m string").select(hmac_sha256(F.col("m"), secret).alias("h"), reporter_key(F.col("m"), secret, "p").alias("k")).collect()
        assert [r["h"] for r in got] == [hmac.new(secret, m.encode(), hashlib.sha256).hexdigest() for m in ("é|x", "")]
        assert got[0]["k"] == hmac.new(secret, "é|x|p".encode(), hashlib.sha256).hexdigest()[:48]


def test_views_payloads_and_snapshots(spark, tmp_path):
    views = spark.createDataFrame([("2024-01-01 10:00:00", "get", "/a" + "x" * 400, None, " 1.2.3.4", "ua"), ("2024-01-01 11:00:00", "HEAD", "/a", "r", "1.2.3.4", "ua"), ("2024-01-02 00:00:00", "GET", "/a", None, "1.2.3.4", "ua"), ("2024-01-02 00:00:00", "POST", "/a", None, "", ""), ("2024-01-02 00:00:00", "GET", "/static/x", None, "", "")], "at string, method string, path string, referrer string, ip string, user_agent string").withColumn("at", F.to_timestamp("at"))
    out = sorted(records.page_views(views, ["/healthz"], ["/static/"], "salt").collect(), key=lambda r: r["at"])
    assert len(out) == 3 and out[0]["visitor"] == out[1]["visitor"] != out[2]["visitor"] and len(out[0]["path"]) == 300
    assert out[0]["visitor"] == hashlib.sha256(b"salt:2024-01-01|1.2.3.4|ua").hexdigest()[:16]
    payloads = spark.createDataFrame([("c", "r", "k", "p"), ("c", "r", "k", "p"), ("c", None, "k", "q"), ("c", "r", "k", None)], "case_id string, run_id string, collector string, payload string")
    records.store_payloads(payloads, f"file://{tmp_path}/raw")
    back = spark.read.json(f"file://{tmp_path}/raw")
    assert sorted((r["run_id"], r["payload"], r["sha256"]) for r in back.collect()) == [("norun", "q", hashlib.sha256(b"q").hexdigest()), ("r", "p", hashlib.sha256(b"p").hexdigest())]
    readings = spark.createDataFrame([("a", 5, "t"), ("b", None, "t"), ("c", 0, "t")], "lake string, rows long, at string")
    assert records.append_snapshot(readings, f"file://{tmp_path}/snap") == 2 and records.append_snapshot(readings.where("rows is null"), f"file://{tmp_path}/snap") == 0
    assert sorted(r["lake"] for r in spark.read.parquet(f"file://{tmp_path}/snap").collect()) == ["a", "c"]


def test_kinds_of_files(spark):
    given = {
        "a.txt": (b"%PDF-1.7 x", "pdf"), "b": (b"\x89PNG\r\n\x1a\nxx", "png"), "c.dat": (b"PK\x03\x04", "zip"), "d": (b"Received: from x\n by y\nSubject: z\n\nbody", "email"), "e.csv": (b"{\"a\": 1}", "json"),
        "f": (b"name,mail\nx,y\n", "csv"), "g.eml": (b"plain words", "email"), "h": (b"\x00\x01\x02", "binary"), "i": (b"plain words", "text"), "j.md": (b"", "text"), "k": (b"\xff\xfe,\xfa", "text"),
    }
    rows = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in given.items()], "name string, content binary")
    assert {r["name"]: r["kind"] for r in rows.select("name", records.file_kind(F.col("name"), F.col("content")).alias("kind")).collect()} == {n: k for n, (_, k) in given.items()}
    cells = spark.createDataFrame([("a", "me@x.org", 1), (None, " me@x.org ", 2), ("you@y.org", "-", 3)], "a string, b string, c int")
    assert sorted(r["value"] for r in records.cell_values(cells, "@").collect()) == ["me@x.org", "you@y.org"]
