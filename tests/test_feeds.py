import json

import pytest

from sleuthgrid.sources import feeds, replace

CONSENSUS = """network-status-version 3
vote-status consensus
valid-after 2024-01-01 00:00:00
r one AAA BBB 2024-01-01 00:00:00 1.2.3.4 9001 0
s Exit Fast Guard Unheard
v Tor 0.4.8
p accept 80,443
r two AAA BBB 2024-01-01 00:00:00 1.2.3.5 x 0
s Exit BadExit
p reject 1-65535
r again AAA BBB 2024-01-01 00:00:00 1.2.3.4 9009 0
s Exit
p accept 80
r bad AAA
directory-footer
"""


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
        return f"file://{tmp_path}/{name}"

    return write


def test_indicators_and_certificates(spark, put):
    rows = feeds.indicators(spark, put("i.csv", '# banner\n"2024-01-01", "1", "5.6.7.8:80", "ip:port", "c2", "js.fake", "", "Fake", "x", "75"\n"d", "2", "http://Bad.org/x", "url", "c2", "win.a", "", "", "x", "many"\n"d", "3", "", "url", "c2", "a", "", "b", "x", "1"\n"short", "row"\n'))
    assert sorted((r["ioc"], r["host"], r["malware"], r["confidence"]) for r in rows.collect()) == [("5.6.7.8:80", "5.6.7.8", "Fake", 75), ("http://Bad.org/x", "bad.org", "win.a", 0)]
    certs = feeds.bad_certificates(spark, put("c.csv", "# x\n2024,AABB01,Cobalt Strike C2\n2024,zz,Bad\n2023,CC02,C&C\n2022,DD03,Plain Botnet Malware\n")).collect()
    assert sorted((r["sha1"], r["malware"], r["listed_at"]) for r in certs) == [("aabb01", "Cobalt Strike", "2024"), ("cc02", "C&C", "2023"), ("dd03", "Plain", "2022")]


def test_relays(spark, put):
    rows = {r["ip"]: r for r in feeds.relay_consensus(spark, put("consensus", CONSENSUS)).collect()}
    one, two = rows["1.2.3.4"], rows["1.2.3.5"]
    assert set(rows) == {"1.2.3.4", "1.2.3.5"} and one["nickname"] == "one" and one["valid_after"] == "2024-01-01 00:00:00"
    assert (one["flags"], one["is_exit"], one["is_guard"], one["version"], one["or_port"]) == ("EFG", True, True, "Tor 0.4.8", 9001)
    assert (two["flags"], two["is_exit"], two["is_bad_exit"], two["or_port"]) == ("BE", False, True, None)
    assert feeds.relay_consensus(spark, put("page.html", "<html>blocked</html>\nr x\n")).count() == 0
    table = feeds.relay_table(spark, put("t.txt", "<html>\n1.1.1.1|nick|9001|0|EFG|5|Tor 1|me\n1.1.1.1|later|1|0|B|5|v|x\nx|y|1|1|E|1|v\n2.2.2.2||a|b||1\n")).collect()
    assert sorted((r["ip"], r["nickname"], r["or_port"], r["is_exit"], r["is_bad_exit"], r["version"]) for r in table) == [("1.1.1.1", "nick", 9001, True, False, "Tor 1"), ("2.2.2.2", None, None, False, False, None)]
    api = {"relays": [{"nickname": "n", "flags": ["Exit", "Guard", "Odd"], "or_addresses": ["3.3.3.3:9001", "[::1]:9001"]}, {"nickname": "m", "or_addresses": ["3.3.3.3:1", "4.4.4.4:x"]}]}
    found = feeds.relay_api(spark, put("a.json", json.dumps(api))).collect()
    assert sorted((r["ip"], r["nickname"], r["or_port"], r["flags"], r["is_exit"]) for r in found) == [("3.3.3.3", "n", 9001, "EG", True), ("4.4.4.4", "m", None, "", False)]


def test_registries(spark, put):
    rules = feeds.public_suffixes(spark, put("psl.dat", "// c\n\ncom\nCO.uk\n*.ck\n!www.ck\ncom\n")).collect()
    assert sorted(map(tuple, rules)) == [("ck", "wildcard"), ("co.uk", "rule"), ("com", "rule"), ("www.ck", "exception")]
    ports = feeds.port_names(spark, put("p.csv", 'Service Name,Port Number,Transport Protocol,Description\nhttp,80,TCP,"Web,\nall"\nx,1-5,tcp,\n,81,tcp,\nq,82,,\nssh,22,tcp,\n')).collect()
    assert sorted((r["port"], r["proto"], r["service"]) for r in ports) == [(22, "tcp", "ssh"), (80, "tcp", "http")]
    blocks = feeds.vendors(spark, put("o.csv", "prefix,bits,registry,vendor\naabbcc,,MA-L,Acme | Other\n,24,x,y\n112233a,28,MA-M,Solo\n")).collect()
    assert sorted((r["prefix"], r["bits"], r["vendors"]) for r in blocks) == [("112233A", 28, ["Solo"]), ("AABBCC", 24, ["Acme", "Other"])]
    master = put("master.csv", "﻿N-NUMBER, MFR MDL CODE ,Name,year mfr\n1AB ,07,JANE DOE,1999\n2CD,99,, \n,07,x,1\n")
    craft = feeds.aircraft(spark, master, put("ref.csv", "﻿CODE,MFR, MODEL\n07,CESSNA,172\n")).collect()
    assert sorted(map(tuple, craft)) == [("N1AB", "JANE DOE", 1999, "07", "CESSNA", "172"), ("N2CD", None, None, "99", None, None)]


def test_officers(spark, put):
    group = "<Form990PartVIISectionAGrp><PersonNm>{}</PersonNm><TitleTxt>{}</TitleTxt></Form990PartVIISectionAGrp>"
    put("f/a.xml", f'<Return xmlns="u"><Filer><EIN> 12 </EIN><BusinessNameLine1Txt>ACME</BusinessNameLine1Txt></Filer>{group.format("JANE DOE", "CHAIR &amp; CEO")}{group.format("", "x")}<CityNm>Town</CityNm><EIN>99</EIN><TaxYr>2022</TaxYr></Return>')
    put("f/b.xml", f"<Return><EIN>1</EIN>{group.format('RICHARD ROE', '')}")
    rows = feeds.officers(spark, put("f/c.xml", "not xml").rsplit("/", 1)[0]).collect()
    assert [(r["ein"], r["org_name"], r["norm"], r["title"], r["city"], r["state"], r["tax_year"]) for r in rows] == [("12", "ACME", "jane doe", "CHAIR & CEO", "Town", None, "2022")]


def test_parcels_complaints_and_news(spark, put):
    page = {"layer": 1, "features": [{"attributes": {"OWN": "DOE JANE", "ADR": " N/A ", "PID": "7", "OBJECTID": "1"}}, {"attributes": {"OWN": "ROE RICHARD", "ADR": "1 Elm", "PID": "null", "OBJECTID": "2"}}, {"attributes": {"OWN": " "}}]}
    sources = spark.createDataFrame([(1, "u", "OWN", "ADR", "CITY", "PID", "AK", "X")], "layer long, layer_url string, owner_field string, address_field string, city_field string, parcel_field string, state string, county string")
    rows = sorted(feeds.parcels(spark, put("l.json", json.dumps(page)), sources).collect(), key=lambda r: r["object_id"])
    assert [(r["owner"], r["address"], r["parcel_id"]) for r in rows] == [("DOE JANE", None, "7"), ("ROE RICHARD", "1 Elm", None)]
    assert rows[0]["key"].startswith("u|7|") and rows[1]["key"].startswith("u|oid:2|")
    text = "Company_Phone_Number,Created_Date,Violation_Date,Consumer_City,Consumer_State,Consumer_Area_Code,Subject,Recorded_Message_Or_Robocall\n"
    text += "2125550123,2024-01-02 00:00:00,2024-01-01 10:00:00,NYC,New York,212,Debt,Y\n2125550123,2024-01-02 00:00:00,2024-01-01 10:00:00,NYC,New York,212,Debt,Y\n12125550124,1/3/2024,,X,,,,N\n555,2024-01-01,,X,,,,N\n2125550125,,,X,,,,N\n1125550125,2024-01-01,,X,,,,N\n"
    found = feeds.complaints(spark, put("ftc.csv", text), "2024-01-02").collect()
    assert sorted((r["e164"], str(r["at"]), r["robocall"], r["state"]) for r in found) == [("+12125550123", "2024-01-01 10:00:00", True, "New York"), ("+12125550124", "2024-01-03 00:00:00", False, None)]
    rss = "<rss><channel><item><title>A &lt;b&gt;bold&lt;/b&gt; one</title><link>http://x/1</link><description>d</description><guid>g</guid><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"
    items = feeds.news(spark, put("r.xml", rss)).collect()
    assert [(r["title"], r["url"], str(r["published_at"])) for r in items] == [("A bold one", "http://x/1", "2024-01-02 03:04:05")]


def test_replaced_tables_and_ledgers(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    assert replace.current(spark, path) is None and replace.replace_all(rows(), path) == 0 and replace.current(spark, path) is None
    assert replace.replace_all(rows(1, 2), path) == 2 and replace.replace_all(rows(3), path) == 1
    assert replace.replace_all(rows(), path) == 0 and [r["v"] for r in replace.current(spark, path).collect()] == [3]
    files = spark.createDataFrame([("b", bytearray(b"x")), ("a", bytearray(b"x")), ("c", bytearray(b"y"))], "path string, content binary")
    ledger = f"file://{tmp_path}/ledger"
    first = replace.import_once(files.where("content = X'78'"), ledger)
    assert [r["path"] for r in first.collect()] == ["a"]
    replace.imported(first, ledger)
    assert [r["path"] for r in replace.import_once(files, ledger).collect()] == ["c"]


def test_upserted_feeds_and_skipped_rows(spark):
    held = spark.createDataFrame([("u1", "online", "a"), ("u2", "online", "b")], "url string, status string, tags string")
    new = spark.createDataFrame([("u1", "offline", None), ("u3", "online", "c")], "url string, status string, tags string")
    out = feeds.upsert_feed(held, new, ["url"], ["status", "tags"])
    assert sorted(map(tuple, out.collect())) == [("u1", "offline", "a"), ("u2", "online", "b"), ("u3", "online", "c")]
    rows = spark.createDataFrame([("1", "x"), ("2", "x"), ("1", None), (None, None)], "kind string, name string")
    assert tuple(feeds.kept_and_skipped(rows, organization=rows["kind"] == "2", incomplete=rows["name"].isNull()).first()) == (1, 2, 1)
    files = spark.createDataFrame([(i,) for i in (5, 3, 1, 4)], "id int")
    assert [r["id"] for r in feeds.next_files(files, files.where("id = 3"), "id", 2).collect()] == [1, 4]
