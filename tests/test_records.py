from pyspark.sql import functions as F

from sleuthgrid.functions import identity, network, web
from sleuthgrid.operators import records
from tests.test_functions import one


def test_wallets(spark):
    evm, btc, sol = "0x" + "Ab" * 20, "1" + "a" * 30, "5" + "b" * 35
    rows = spark.createDataFrame([(evm, None), (evm, "bsc"), (evm, "btc"), (btc, None), (sol, None), (sol, "Solana"), ("BC1QXYZ123", " BTC "), (None, None), ("x", "")], "v string, h string")
    got = [tuple(r[0]) if r[0] else None for r in rows.select(identity.chain_address(F.col("v"), F.col("h"))).collect()]
    assert got == [("eth", evm.lower()), ("bsc", evm.lower()), None, ("btc", btc), None, ("sol", sol), ("btc", "bc1qxyz123"), None, None]


def test_canonical_values(spark):
    cases = [
        ("domain", "HTTPS://www.Ex.com:80/a", "ex.com"), ("domain", "a b.com", None), ("url", "Ex.com/A/?q#f", "https://ex.com/A"), ("username", "@Bob", "unknown:bob"), ("username", "GitHub:@Bob", "github:bob"),
        ("asn", "as 13335", "AS13335"), ("malware", "Cobalt Strike", "cobaltstrike"), ("org", "  Acme \t Inc ", "acme inc"), ("repo", "https://github.com/A/b/", "a/b"), ("vulnerability", "cve-2024-12345", "CVE-2024-12345"),
        ("vulnerability", "CVE-1", None), ("aircraft", "n-123 ab", "N123AB"), ("aircraft", "737KL", "N737KL"), ("aircraft", "ZZ1", None), ("ip", "fe80::1%eth0", "fe80::1"), ("crypto_address", "odd", "odd"), ("domain", " ", None), ("domain", None, None), ("other", " x ", "x"),
    ]
    rows = spark.createDataFrame([(k, v) for k, v, _ in cases], "k string, v string")
    assert [r[0] for r in rows.select(identity.canonical_value(F.col("k"), F.col("v"))).collect()] == [w for _, _, w in cases]
    assert spark.range(1).select(identity.entity_key(F.lit("email"), F.lit("A@b.co"))).first()[0] == "email:a@b.co"


def test_mailboxes(spark):
    assert one(spark, identity.mailbox, "J.Doe+x@GoogleMail.com", "j.doe+x@ex.org", "+x@ex.org", "none", None) == ["jdoe@gmail.com", "j.doe@ex.org", "ex.org", "none", ""]
    assert one(spark, identity.mail_class, "a@yopmail.com", "a@gmail.com", "a@ex.org", None) == ["disposable", "free_mail", "other", "other"]
    assert one(spark, identity.is_role, "Info+x@ex.org", "infodev@ex.org", None) == [True, False, False]


def test_address_ranges(spark):
    assert one(spark, network.ip6_hex, "::1", "2001:DB8::5:6", "1:2:3:4:5:6:7:8", "1::2::3", "::", "1:2", ":::", "12345::", None) == ["0" * 31 + "1", "20010db8" + "0" * 16 + "00050006", "00010002000300040005000600070008", None, "0" * 32, None, None, None, None]
    assert one(spark, network.is_eligible, "8.8.8.8", "104.17.1.1", "10.0.0.1", "2606:4700::1", "2a01::1", "fd00::1", "x", None) == [True, False, False, False, True, False, False, False]
    assert one(spark, network.is_public, "104.17.1.1", "100.64.1.1", "192.0.2.1") == [True, False, False]
    assert one(spark, network.is_routable, "192.0.2.1", "10.1.1.1", "fe80::1", None) == [True, False, False, False]


def test_suffixes_with_exceptions(spark):
    rules = spark.createDataFrame([("com", "rule"), ("co.uk", "rule"), ("uk", "rule"), ("ck", "wildcard"), ("www.ck", "exception")], "rule string, kind string")
    want = {"a.b.com": ("com", "b.com"), "x.co.uk": ("co.uk", "x.co.uk"), "co.uk": ("co.uk", None), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "b.foo.ck": ("foo.ck", "b.foo.ck"), "foo.ck": ("foo.ck", None), "a.zz": (None, None)}
    hosts = spark.createDataFrame([(h.upper() + ".",) for h in want] + [(None,), ("localhost",), ("a.b.com",)], "h string")
    assert {r["host"]: (r["public_suffix"], r["registrable"]) for r in records.suffixes(hosts, rules, "h").collect()} == want


def test_lookups_keep_what_is_not_found(spark):
    scores = spark.createDataFrame([("CVE-2024-1000", 0.7, 0.9)], "cve string, score double, percentile double")
    wanted = spark.createDataFrame([(" cve-2024-1000 ",), ("CVE-2024-2000",), (None,)], "c string")
    assert sorted((r["score"] for r in records.scores_of(wanted, scores, "c").collect()), key=str) == [0.7, None, None]
    urls = spark.createDataFrame([("http://a.b/x/",), ("http://a.b/y",), (None,)], "u string")
    assert [r[0] for r in records.known_urls(urls, spark.createDataFrame([("http://a.b/x",), (None,)], "url string"), "u").collect()] == ["http://a.b/x/"]
    services = spark.createDataFrame([("eth", "0xA", "m", "mixer"), ("eth", "0xa", "e", "exchange")], "chain string, address string, name string, kind string")
    pairs = spark.createDataFrame([("eth", "0xA"), ("eth", "0xB"), ("btc", None)], "chain string, a string")
    assert sorted((r["services"] for r in records.touched_services(pairs, services, "a").collect()), key=str) == sorted([None, None, ["e", "m"]], key=str)


def test_transfers_alert_once(spark):
    labels = spark.createDataFrame([("eth", "0xAA", "x", True), ("eth", "0xaa", "w", True), ("eth", "0xBB", "old", False)], "chain string, address string, tag string, active boolean")
    services = spark.createDataFrame([("eth", "0xCC", "mixer")], "chain string, address string, kind string")
    moves = spark.createDataFrame([(1, "eth", "0xaa", "0xcc"), (2, "eth", "0xBB", "0xcc"), (3, "eth", "0xdd", "0xAA"), (4, None, None, None)], "id int, chain string, sender string, receiver string")
    got = sorted((r["id"], r["severity"], r["direction"], r["mixer_involved"], r["tags"]) for r in records.transfer_alerts(moves, labels, services).collect())
    assert got == [(1, "S2", "sent", True, "w, x"), (3, "S3", "received", False, "w, x")]
    assert sorted(r["id"] for r in records.transfers_of(moves, "0xcc").collect()) == [1, 2]


def test_scan_reasons(spark):
    rows = spark.createDataFrame([("/a/.env", "curl/8"), ("/static/x", "curl/8"), ("/", "curl/8"), ("/", "Mozilla/5.0 (X11)"), (None, None)], "p string, a string")
    assert [r[0] for r in rows.select(web.scan_reason(F.col("p"), F.col("a"))).collect()] == ["probe_path", None, "bot_ua", None, "bot_ua"]
