import pytest
from pyspark.sql import functions as F

from sleuthgrid.functions import dates, names, network, scores, text, web


def one(spark, column, *values):
    """The results of a column over string values v."""
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_automation(spark):
    assert one(spark, web.is_bot, None, " ", "Mozilla/5.0 (Windows)", "Googlebot/2.1", "curl/8", "robotics fan") == [True, True, False, True, True, False]
    assert one(spark, web.is_probe, None, "/", "/x/.ENV", "/wp-admin/a") == [False, False, True, True]


def test_urls(spark):
    assert one(spark, web.canonical_url, "HTTPS://Ex.COM/A/?utm_source=x&b=1&ref=q#f", "http://a.b/") == ["https://ex.com/A?b=1", "http://a.b"]
    assert one(spark, web.host_of, "https://u@A.B.com:80/x", "localhost", None) == ["a.b.com", None, None]


def test_names(spark):
    assert one(spark, names.canonical, "García, José Jr.", "Smith, MD", None, "  ") == ["jose garcia", "smith", "", ""]
    assert one(spark, names.name_keys, "ruth bader ginsburg", "cher", "bob lee", "") == [["ruth bader ginsburg", "~sn:ginsburg", "ruth ginsburg", "r ginsburg"], ["cher", "~sn:cher"], ["bob lee", "~sn:lee", "b lee", "robert lee", "r lee"], []]
    rows = spark.createDataFrame([("bob lee", s) for s in ("bob lee", "robert x lee", "barry lee", "ann lee", "ann poe")], "q string, s string")
    assert [r[0] for r in rows.select(names.match_strength(F.col("q"), F.col("s"))).collect()] == ["exact", "partial", "weak", "surname", None]


@pytest.mark.parametrize(("reporters", "spam", "legit", "want"), [(0, 0.0, 0.0, "unknown"), (1, 2.0, 0.0, "unconfirmed"), (4, 3.0, 3.0, "disputed"), (4, 8.0, 1.0, "likely_spam"), (4, 0.0, 3.0, "likely_legit"), (3, 2.0, 0.0, "mixed")])
def test_phone_verdict(spark, reporters, spam, legit, want):
    assert spark.range(1).select(scores.phone_verdict(F.lit(reporters), F.lit(spam), F.lit(legit))).first()[0] == want


def test_unchecked_is_not_clean(spark):
    rows = spark.createDataFrame([(0.0, 0, 0), (0.0, 0, 3), (0.1, 1, 3), (0.8, 2, 3)], "c double, l int, n int")
    assert [r[0] for r in rows.select(scores.listing_verdict(F.col("c"), F.col("l"), F.col("n"))).collect()] == ["unknown", "clean", "suspicious", "malicious"]
    assert spark.createDataFrame([], "d string").agg(scores.worst_disposition(F.col("d"))).first()[0] == "needs_analyst"


def test_dates_addresses_text(spark):
    assert [str(x) for x in one(spark, dates.any_date, "2024-02-30", "02/03/2024", "20240203", "x")] == ["None", "2024-02-03", "2024-02-03", "None"]
    assert one(spark, network.ip_number, "1.2.3.4", "256.1.1.1", None) == [16909060, None, None]
    assert one(spark, network.is_private, "10.1.1.1", "8.8.8.8", "172.31.0.1") == [True, False, True]
    assert one(spark, text.mac_canonical, "aabb.ccdd.eeff", "AA-BB-CC", "zz") == ["AA:BB:CC:DD:EE:FF", "AA:BB:CC", None]
    assert one(spark, text.template, "took 3.5 at a@b.co via http://x.y/1") == ["took <n> at <email> via <url>"]
