import json

import pytest

from sleuthgrid.operators import kinship

NOTICES = [
    ("Mary Jane Doe", "Mary Jane Doe, 84, of Bentonville, AR, passed away on March 3, 2024. She is survived by her husband John Doe; children Robert Doe and Susan Smith; sister Helen Brown; and grandchildren Emma Doe and Liam Doe. She was preceded in death by her parents Frank Miller and Alice Miller. Funeral services will be held at Smith Funeral Home. Interment at Benton County Memorial Cemetery.", "Mary Jane Doe Obituary",
     {("John Doe", "spouse", True), ("Robert Doe", "child", True), ("Susan Smith", "child", True), ("Helen Brown", "sibling", True), ("Emma Doe", "grandchild", True), ("Liam Doe", "grandchild", True), ("Frank Miller", "parent", False), ("Alice Miller", "parent", False)}),
    ("John Smith", "John Smith, loving husband of Jane Smith, died Monday. He is survived by sons Michael Smith and David Smith.", None, {("Jane Smith", "spouse", True), ("Michael Smith", "child", True), ("David Smith", "child", True)}),
    ("Steve Jobs", "Steve Jobs is survived by his wife Laurene, and their three children, Erin, Reed and Eve. His sister is Mona Simpson.", "Steve Jobs (1955-2011) - Memorial", {("Laurene Jobs", "spouse", True), ("Erin Jobs", "child", True), ("Reed Jobs", "child", True), ("Eve Jobs", "child", True), ("Mona Simpson", "sibling", True)}),
    ("Steve Jobs", "He is survived by his daughter Lisa Brennan-Jobs and wife Laurene Powell Jobs.", None, {("Lisa Brennan-Jobs", "child", True), ("Laurene Powell Jobs", "spouse", True)}),
    ("William Taylor", "Survivors include his stepson Mark Taylor; daughter-in-law Amy Taylor; and brother-in-law Paul Green.", None, {("Mark Taylor", "child", True), ("Amy Taylor", "in_law", True), ("Paul Green", "in_law", True)}),
    ("Anna Brown", "She was preceded in death by her husband Carl Brown and son Timothy Brown.", None, {("Carl Brown", "spouse", False), ("Timothy Brown", "child", False)}),
    ("James Lee", "James Lee, 79, of Tulsa, died May 1, 2020. He served in the U.S. Marine Corps and later worked as a firefighter for the City of Tulsa. He is survived by his wife Patricia Lee.", None, {("Patricia Lee", "spouse", True)}),
    ("Dorothy White", "Born January 12, 1940, in Little Rock, she passed away on June 4, 2022 in Rogers, AR. Survivors include her son Kevin White.", None, {("Kevin White", "child", True)}),
    ("Steve Jobs", "Survived by his sister Mona Simpson and wife Laurene.", None, {("Mona Simpson", "sibling", True), ("Laurene Jobs", "spouse", True)}),
    ("Nobody", "", None, set()), ("Nobody", None, None, set()), (None, "Survived by his son Al Berg.", None, {("Al Berg", "child", True)}),
]


@pytest.fixture(scope="module")
def notices(spark):
    return spark.createDataFrame([(i, *n[:3]) for i, n in enumerate(NOTICES)], "i int, name string, text string, title string")


def test_relatives_and_their_roles(notices):
    got = {}
    for r in kinship.obituary_kin(notices, ["i"], "text", "name").collect():
        got.setdefault(r["i"], set()).add((r["relative"], r["role"], r["living"]))
    for i, (_, text, _, want) in enumerate(NOTICES):
        assert got.get(i, set()) == want, text


def test_facts(notices):
    f = {r["i"]: r for r in kinship.obituary_facts(notices, ["i"], "text", "name", "title").collect()}
    assert (f[0]["age"], f[0]["death_date"], f[0]["residence"], f[0]["funeral_home"], f[0]["cemetery"]) == (84, "March 3, 2024", "Bentonville, AR", "Smith Funeral Home", "Benton County Memorial Cemetery")
    assert (f[2]["birth_date"], f[2]["death_date"]) == ("1955", "2011") and (f[7]["birth_date"], f[7]["death_date"]) == ("January 12, 1940", "June 4, 2022")
    assert "Marine" in f[6]["military"] and "firefighter" in f[6]["occupation"] and f[6]["age"] == 79 and f[10]["age"] is None


def test_graph_with_inverse_edges_records_and_json(notices):
    facts, kin = kinship.obituary_facts(notices, ["i"], "text", "name", "title"), kinship.obituary_kin(notices, ["i"], "text", "name")
    edges = kinship.kinship_edges(facts, kin, ["i"])
    rows = {(r["i"], r["source_id"], r["target_id"]): r for r in edges.collect()}
    assert rows[0, "person:mary jane doe", "person:robert doe"]["role"] == "child" and rows[0, "person:robert doe", "person:mary jane doe"]["role"] == "parent"
    assert rows[0, "person:mary jane doe", "location:bentonville, ar"]["rel"] == "located_in" and rows[0, "person:mary jane doe", "org:smith funeral home"]["rel"] == "associated_with"
    assert not any(i in (9, 10, 11) for i, _, _ in rows)
    records = edges.sparkSession.createDataFrame([(0, "parcel", "12-34", "owns", "land", 0.6), (0, "person", "John Doe", "related_to", "record", 0.4), (9, "org", " ", "owns", "x", 0.1)], "i int, kind string, value string, rel string, role string, confidence double")
    more = kinship.attach_records(edges, facts, records, ["i"])
    assert more.count() == edges.count() + 2
    graphs = {r["i"]: json.loads(r["graph"]) for r in kinship.graphs_as_json(more, ["i"]).collect()}
    ids = {n["id"] for n in graphs[0]["nodes"]}
    assert len(ids) == len(graphs[0]["nodes"]) and all({e["source_id"], e["target_id"]} <= ids for e in graphs[0]["edges"]) and "parcel:12-34" in ids
    assert {n["id"] for n in graphs[2]["nodes"]} & {n["id"] for n in graphs[3]["nodes"]} == {"person:steve jobs"}  # one id, two graphs
