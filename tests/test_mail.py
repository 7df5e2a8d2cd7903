from pyspark.sql import functions as F

from sleuthgrid.functions import mail
from tests.test_functions import one

BLOB = (
    "Received: from mx2.ours.com (mx2.ours.com [10.0.0.2])\r\n\tby mx1.ours.com (Postfix) with ESMTPS id 1; Mon, 1 Jan 2024 00:00:02 +0000\r\n"
    "Received: from mail.sender.example (unknown by nobody [198.51.100.30])\r\n by mx2.ours.com (using TLS (bits=256)) with ESMTP id 2; Mon, 1 Jan 2024 00:00:01 +0000\r\n"
    "Received: from forged.bank.com ([9.9.9.9]) by mail.sender.example with SMTP; Mon, 1 Jan 2024 00:00:00 +0000\r\n"
    "From: Bob <bob@Mail.Sender.example>\r\nDKIM-Signature: v=1; d=sender.example;\r\n s=k1; d=other.com; bh=a=b\r\nSubject: x\r\n\r\nReceived: from body by body.com\r\n"
)


def test_chain_and_origin(spark):
    fields = mail.headers(F.col("v"))
    chain = mail.hops(fields)
    rows = spark.createDataFrame([(BLOB,), (None,), ("",), ("no headers",)], "v string").withColumn("c", chain).withColumn("t", mail.trusted_hops(F.col("c")))
    got = rows.select("c", "t", mail.origin(F.col("c"), F.col("t")).alias("o"), mail.address_domain(mail.header(fields, "from")).alias("d"), mail.tags(mail.header(fields, "dkim-signature")).alias("g")).collect()
    assert [(h["from_host"], h["from_ip"], h["by_host"], h["protocol"]) for h in got[0]["c"]] == [
        ("mx2.ours.com", "10.0.0.2", "mx1.ours.com", "ESMTPS"), ("mail.sender.example", "198.51.100.30", "mx2.ours.com", "ESMTP"), ("forged.bank.com", "9.9.9.9", "mail.sender.example", "SMTP")]
    assert (got[0]["t"], got[0]["o"], got[0]["d"], got[0]["g"]) == (2, "198.51.100.30", "mail.sender.example", {"v": "1", "d": "sender.example", "s": "k1", "bh": "a=b"})
    assert [(r["c"], r["t"], r["o"], r["d"], r["g"]) for r in got[1:]] == [([], 0, None, None, {})] * 3


def test_trust_ends_where_another_family_begins(spark):
    hop = lambda by, ip: {"from_host": None, "from_ip": ip, "by_host": by, "protocol": None}
    chains = [[hop(None, "1.1.1.1"), hop("a.google.com", "10.0.0.1"), hop("b.gmail.com", "8.8.8.8"), hop("x.com", "7.7.7.7"), hop("c.google.com", "6.6.6.6")], [hop(None, "1.1.1.1")], [hop("a.co.uk", None)], [hop("a.b.co.uk", "10.1.1.1")], [hop("mx.x.com", "2.2.2.2"), hop(None, "3.3.3.3"), hop("mx.x.com", "4.4.4.4")]]
    rows = spark.createDataFrame([(c,) for c in chains], "c array<struct<from_host:string, from_ip:string, by_host:string, protocol:string>>").withColumn("t", mail.trusted_hops(F.col("c")))
    assert [tuple(r) for r in rows.select("t", mail.origin(F.col("c"), F.col("t"))).collect()] == [(3, "8.8.8.8"), (0, None), (1, None), (1, None), (1, "2.2.2.2")]


def test_organisations(spark):
    assert one(spark, mail.org_domain, "a.b.co.uk", "x.github.io", "A.B.Com.", "q.blob.core.windows.net", "com", "::1", None) == ["b.co.uk", "x.github.io", "b.com", "blob.core.windows.net", None, None, None]
    rows = spark.createDataFrame([("a.x.com", "x.com"), ("a.github.io", "b.github.io"), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(mail.aligned(F.col("a"), F.col("b"))).collect()] == [True, False, False]
