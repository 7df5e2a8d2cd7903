"""What mail_findings works out for a message: each step once, in a time that grows with the message's length."""

import re
import time

import pytest
from pyspark.sql import functions as F

from sleuthgrid.functions import mail
from sleuthgrid.functions.network import address_key, is_address
from sleuthgrid.operators.mail import address, domain_of, mail_findings, sent_at


def test_times_are_read_once_from_a_text(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(sent_at(F.col("t")).alias("at"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\[A-Za-z\]\{3\}", plan)) == 1


def test_a_long_hop_takes_linear_time(spark):
    text = "Received: from a.org by b.org " + "x" * 150_000 + "; Mon, 1 Jan 2024 10:00:00 +0000\nDate: Wed, 3 Jan 2024 10:00:00 +0000\nFrom: " + "a" * 150_000 + " b\n"
    df = spark.createDataFrame([(1, text)], "i int, blob string")
    begin = time.monotonic()
    found = mail_findings(df, ["i"], "blob").first()["findings"]
    assert "date_skew" in {f["key"] for f in found} and time.monotonic() - begin < 60


@pytest.mark.parametrize("text, want", [
    ("Mon, 1 Jan 2024 10:00 +0100", "2024-01-01 09:00:00"), ("1 Jan 2024 1:02:03 GMT", "2024-01-01 01:02:03"), ("1 Jan 2024 10:00:00 Z x", "2024-01-01 10:00:00"), ("1 Jan 2024 10:00:00 -0000", None), ("99 Jan 2024 10:00:00 UT", None),
    ("never", None), ("", None), (None, None),
])
def test_times(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(sent_at(F.col("t")).cast("string")).first()[0] == want


def test_parts_of_headers(spark):
    cases = ["A <News@X.org> ", "a@b@c.org", "<>", "<a@b.org> x", "c@d.org, e@f.org", '"a@b.org" <c@-d.org>', "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    got = rows.select(address(F.col("t")).alias("a"), domain_of(address(F.col("t"))).alias("d")).collect()
    assert [tuple(r) for r in got] == [("news@x.org", "x.org"), ("a@b@c.org", "c.org"), (None, None), (None, None), ("e@f.org", "f.org"), ("c@-d.org", None), (None, None), (None, None)]


def test_tag_and_addresses_as_their_longer_forms(spark):
    tags = spark.createDataFrame([("v=1; D = x.org ; d=y.org",), (";=;d",), ("d=a=b",), ("",), (None,)], "t string")
    assert [r[0] for r in tags.select(mail.tag(F.col("t"), "d")).collect()] == [r[0] for r in tags.select(F.try_element_at(mail.tags(F.col("t")), F.lit("d"))).collect()] == ["x.org", None, "a=b", None, None]
    words = spark.createDataFrame([(w,) for w in ["8.8.8.8", " 1.2.3.4 ", "1.2.3.256", "::", "fe80::1%eth0", "1:2", "2001:DB8::1", "", None]], "w string")
    assert [r[0] for r in words.select(is_address(F.col("w"))).collect()] == [r[0] for r in words.select(address_key(F.col("w")).isNotNull()).collect()] == [True, True, False, True, True, False, True, False, False]
