import time

import pytest
from pyspark.sql import functions as F

from sleuthgrid.llm import url_filter
from sleuthgrid.llm.queries import URL_RULES
from sleuthgrid.llm.url_filter import cascade, judge_urls, listed

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [
    None, "", "no scheme.com/", "http://", "https://example.com", "https://Example.COM/en/x", "https://www.example.com/en/x?y#z", "https://m.example.com/en/", "http://a.net/es/q", "http://net/fr/", "http://x.org/fr/",
    "http://example.com/EN/", "ftp://a.b.example.com/en/?a", "http://notexample.com/en/", "http://a.net/e", "http://.com/", "http://com./", "http://a.net?es/", "x://y://example.com/en/", "http://ünï.net/es/é", "http://www.example.com/en",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].translate(LOWER), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, keys in URL_RULES.items():
        for key in keys:
            h, p = key[: key.index("/")], key[key.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(key) > len(best[0])):
                best = (key, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


@pytest.mark.parametrize(("bits", "block"), [(24, 32768), (3, 8)])
def test_verdicts_as_brute_force(spark, bits, block):
    df = spark.createDataFrame([*enumerate(URLS), (None, URLS[5]), (3, URLS[5])], "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    got = sorted(map(tuple, judge_urls(df, URL_RULES, bits_per_key=bits, block=block).collect()), key=str)
    assert got == sorted([(r["page_id"], *brute(r["url"])) for r in df.collect()], key=str)


def test_cascade_is_exact_with_few_bits(spark):
    keys = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 5 == 0).alias("want"))
    levels = cascade(keys.where("want"), keys, bits_per_key=4, block=1)
    assert len(levels) > 2
    assert keys.where(listed(F.col("key"), levels) != F.col("want")).count() == 0


def test_no_rules_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judge_urls(df, {}).collect()[0]["verdict"] == "allow"
    assert judge_urls(df.limit(0), URL_RULES).collect() == []


def test_rules_as_a_table_in_parts(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = spark.createDataFrame([(k, v) for v, keys in URL_RULES.items() for k in keys] + [("no path", "block"), (None, "block")], "rule string, verdict string")
    want = sorted(((i, *brute(u)) for i, u in enumerate(URLS)), key=str)
    assert sorted(map(tuple, judge_urls(df, rules, part_keys=2).collect()), key=str) == want
    monkeypatch.setattr(url_filter, "MAX_BITS", 24)  # too small for a level of several keys: more parts
    assert sorted(map(tuple, judge_urls(df, rules, bits_per_key=12, block=8, part_keys=99).collect()), key=str) == want


def test_long_hosts_take_little(spark):
    df = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "example.com/en/" + "x" * 100_000)] * 8, "page_id long, url string")
    began = time.time()
    assert {r["rule"] for r in judge_urls(df, URL_RULES).select("rule").collect()} == {"example.com/en/"}
    assert time.time() - began < 30
