from sleuthgrid.sources import bulk, sinks


def test_files(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    line = lambda kind, name, amount: "|".join(["C"] * 6 + [kind, name, "TOWN", "NY", "123456789", "ACME", "", "02032024", amount] + ["x"] * 6)
    rows = bulk.contributions(spark, put("itcont.txt", "\n".join([line("IND", "DOE, JANE", "10"), line("IND", "DOE, JANE", "5.5"), line("ORG", "ACME", "9"), line("IND", "", "1")]) + "\n"))
    total = bulk.contributor_totals(rows).first()
    assert (total["norm"], total["zip"], total["contributions"], total["total"], str(total["first_day"])) == ("jane doe", "12345", 2, 15.5, "2024-02-03")
    scores = put("scores.csv", "#model_version:v1,score_date:2024-01-01T00:00:00\ncve,epss,percentile\nCVE-2024-0001,0.5,0.9\nCVE-2024-0002,bad,1\n")
    assert [tuple(r) for r in bulk.exploit_scores(spark, scores).collect()] == [("CVE-2024-0001", 0.5, 0.9)]
    assert dict(map(tuple, bulk.score_header(spark, scores).collect()))["score_date"] == "2024-01-01T00:00:00"
    ranges = bulk.ip_ranges(spark, put("geo.csv", "1.0.0.0,1.0.0.255,OC,AU,Q,Town,1.5,2.5\n2.0.0.0,2.0.0.9,FR,P,Ville,3.5,4.5\n::1,::2,EU,X,Y,Z,1,2\n1.0.0.0,::2,EU,X,Y,Z,1,2\n")).collect()
    assert sorted((r["start"], r["country"], r["city"], r["lat"]) for r in ranges if r["version"] == 4) == [(16777216, "AU", "Town", 1.5), (33554432, "FR", "Ville", 3.5)]
    assert [(r["start"], r["end_key"][-1], r["city"]) for r in ranges if r["version"] == 6] == [(None, "2", "Z")]
    urls = bulk.malware_urls(spark, put("urls.csv", '# banner\n"1","d","http://Bad.example.com/x","online","","t","a,b","l","r"\n"2","d","nohost","online","","t","","l","r"\n')).collect()
    assert [(r["host"], r["tags"]) for r in urls] == [("bad.example.com", ["a", "b"])]
    assert bulk.command_servers(spark, put("c.json", '[{"ip_address":"1.2.3.4","port":8,"status":"online","malware":"m"}]')).first()["ioc"] == "1.2.3.4:8"
    xml = "<l><sdnEntry><uid>7</uid><lastName>X</lastName><programList><program>P</program></programList><idList><id><idType>Digital Currency Address - XBT</idType><idNumber>abc</idNumber></id><id><idType>Passport</idType><idNumber>1</idNumber></id></idList></sdnEntry></l>"
    assert [(r["uid"], r["asset"], r["address"]) for r in bulk.sanctioned_addresses(spark, put("s.xml", xml)).collect()] == [("7", "XBT", "abc")]
    people = bulk.providers(spark, put("npi.csv", "NPI,Entity Type Code,Provider Last Name (Legal Name),Provider First Name,Provider Middle Name,Provider Business Practice Location Address State Name,Healthcare Provider Taxonomy Code_1,Provider Enumeration Date\n1,1,DOE,JANE,,NY,T1,05/23/2005\n2,2,ACME,,,NY,T,\n,1,ROE,RICHARD,,NY,T,\n3,1,,,,NY,T,\n")).collect()
    assert [(r["npi"], r["name"], r["norm"], str(r["enumerated"])) for r in people] == [("1", "JANE DOE", "jane doe", "2005-05-23")]
    page = bulk.wiki_pages(spark, put("p.md", "---\nslug: arp\ntitle: ARP\npage_type: protocol\ntags: [a, b]\n---\nBody text\n")).first()
    assert (page["slug"], page["page_type"], page["tags"], page["body"].strip()) == ("arp", "protocol", ["a", "b"], "Body text")
    hd, en = ["HD", "9", "", "", "K1AA", "A", "HA"], ["EN", "9", "", "", "K1AA", "L", "", "Doe, Jane", "Jane", "", "Doe"] + [""] * 12
    licence = bulk.licences(spark, put("HD.dat", "|".join(hd) + "\n"), put("EN.dat", "|".join(en) + "\n")).first()
    assert (licence["callsign"], licence["norm"]) == ("K1AA", "jane doe")


def test_sinks(spark, tmp_path):
    hosts = spark.createDataFrame([("B.com",), ("a.com",), ("b.com ",), (None,)], "h string")
    sinks.blocklist(hosts, "h", "adblock", f"file://{tmp_path}/list")
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/list").collect()) == ["||a.com^", "||b.com^"]
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("a", "b", "r"), ("a", "z", "r")], "source string, target string, rel string")
    sinks.graph_lines(nodes, edges, f"file://{tmp_path}/graph")
    assert spark.read.text(f"file://{tmp_path}/graph").count() == 3
