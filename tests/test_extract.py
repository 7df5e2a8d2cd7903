import time

import pytest
from pyspark.sql import functions as F

from sleuthgrid.functions import extract

CASES = {
    "Brand example-brand.com and GH example-user; email hello@example-brand.com. Check lookalikes and breaches.": {("domain", "example-brand.com", 0.92), ("email", "hello@example-brand.com", 0.95), ("username", "github:example-user", 0.9)},
    "See https://example.com/path and host 8.8.8.8 plus github.com/octocat": {("url", "https://example.com/path", 0.85), ("domain", "example.com", 0.9), ("ip", "8.8.8.8", 0.9), ("username", "github:octocat", 0.95)},
    "Robocall from (415) 555-2671 last night": {("phone", "+14155552671", 0.92)},
    "person: Jane Doe": {("person", "jane doe", 0.9)},
    "0x" + "11" * 20: {("crypto_address", "eth:0x" + "11" * 20, 0.93)},
    "look into Acme Inc and their domains": {("org", "acme inc", 0.8)},
    "Siemens AG": {("org", "siemens ag", 0.8)},
    "Cloudflare": {("org", "cloudflare", 0.55)},
    "dustin moore": {("person", "dustin moore", 0.6)},
    "met John Smith at 00:1a:2B:3c:4d:5E or N123AB": {("person", "john smith", 0.6), ("mac", "00:1A:2B:3C:4D:5E", 0.95), ("aircraft", "N123AB", 0.9)},
    "n123ab.example.com n123ab@example.com": {("domain", "n123ab.example.com", 0.92), ("email", "n123ab@example.com", 0.95), ("domain", "example.com", 0.92)},
    "me@gmail.com x: @some_one @alone": {("email", "me@gmail.com", 0.95), ("username", "twitter:some_one", 0.88), ("username", "unknown:some_one", 0.55), ("username", "unknown:alone", 0.55)},
    "company: Globex Systems": {("org", "globex systems", 0.7)},
    "version 1.2.3 of it": set(), "Check this domain for me please": set(), "please help me": set(), "what is this": set(), "find everything": set(), "": set(),
    "twitter.com/home reddit.com/user/abc linkedin.com/in/j-d%20 instagram.com/a.b": {("username", "reddit:abc", 0.9), ("username", "linkedin:j-d%20", 0.95), ("username", "instagram:a.b", 0.9)},
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(t,) for t in [*CASES, None]], "t string")
    return {r["t"]: r for r in df.select("t", extract.hits(F.col("t")).alias("h"), extract.seeds(F.col("t")).alias("s"), extract.flags(F.col("t")).alias("f")).collect()}


def test_kinds_and_confidences(found):
    for text, want in CASES.items():
        got = {(h["type"], h["value"], h["confidence"]) for h in found[text]["h"]}
        if text.startswith("0x") or text.startswith("See"):
            assert want <= got
        else:
            assert {x for x in got if x[0] not in ("person", "org") or any(w[0] == x[0] for w in want)} == want, text
    assert found[None]["h"] == [] and not any(found[None]["f"])


def test_seeds_are_ordered_and_guesses_are_left_out(found):
    row = found["met John Smith at 00:1a:2B:3c:4d:5E or N123AB"]["s"]
    assert [(s["type"], s["include"]) for s in row] == [("mac", True), ("aircraft", True), ("person", False)]
    assert found["person: Jane Doe"]["s"][0]["include"] and found["Cloudflare"]["s"][0]["include"] and "assumed" in found["Cloudflare"]["s"][0]["notes"]
    assert not found["dustin moore"]["s"][0]["include"]
    assert [s["include"] for s in found["me@gmail.com x: @some_one @alone"]["s"]] == [True, True, False, False]


def test_flags(found):
    f = found["Brand example-brand.com and GH example-user; email hello@example-brand.com. Check lookalikes and breaches."]["f"]
    assert f["want_lookalikes"] and f["want_breaches"] and not f["want_web_search"]
    assert found["look into Acme Inc and their domains"]["f"].asDict() == dict.fromkeys(extract.FLAGS, False) | {"want_corp_records": True}


@pytest.mark.parametrize("text", ["a" * 500_000, "a." * 250_000, "A.A-" * 125_000, "A " * 250_000, "a@" * 250_000, "x" + " " * 500_000, "Aa Bb " * 80_000, "1." * 250_000, "N1" * 250_000, "-" * 500_000, "a@a.b1." * 70_000])
def test_long_texts_take_linear_time(spark, text):
    df = spark.createDataFrame([(text[: len(text) // 8],), (text,)], "t string")
    began = time.time()
    df.select(F.size(extract.hits(F.col("t")))).collect()
    assert time.time() - began < 15
