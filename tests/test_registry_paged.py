import json

import pytest

from sleuthgrid.sources import paged, registry

SCHEMA = "name string, disposition string, offense string, finding_date string, source_url string, record_id string, city string, county string, state string, statute string, citation string"


def row(name="Ann Bee", disposition="Convicted", offense="Cruelty", date="2020-02-29", url=None, record=None, city=None):
    return (name, disposition, offense, date, url, record, city, None, "tx", None, None)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as verdict", "1 as removed_at")


def test_relisting_suppression_and_failed_imports(spark, tmp_path):
    at, url = str(tmp_path / "registry"), "https://r.example.org/"
    counts = lambda c: tuple(c[k] for k in registry.COUNTS)
    first = [row(record="1"), row("Cy Dee", record="2"), row("Ed", record="3"), row("Fay Gee", "charged"), row("Hal Ivy", "pleaded guilty"), row("Jo Kay", None), row("Lo Moe", url="ftp://x"), row(record="1")]
    assert counts(registry.import_registry(table(spark, first), at, "s", url, years=5)) == (8, 4, 1, 3, 0, 0)
    held = {r["entry_id"]: r for r in registry.entries(spark, at).collect()}
    hashed = next(k for k in held if k.startswith("s:h"))
    assert set(held) == {"s:1", "s:2", hashed} and held["s:1"]["state"] == "TX" and str(held["s:1"]["expires_at"]) == "2025-02-28"
    assert {r["entry_id"] for r in registry.entries(spark, at, "keys").where("key = 'ann bee'").collect()} == {"s:1"}
    # an upheld dispute, set by another edition of the same table
    registry.entries(spark, at).createOrReplaceTempView("held")
    suppressed = spark.sql("select * except (suppressed_at), case when entry_id = 's:1' then timestamp '2021-01-01' end as suppressed_at from held")
    folded = registry.fold(suppressed, registry.checked_rows(table(spark, [row(record="1", city="New")]), url, "s"), "s", registry.F.current_timestamp())
    again = {r["entry_id"]: r for r in folded.collect()}
    assert again["s:1"]["suppressed_at"] is not None and again["s:1"]["city"] == "New" and again["s:1"]["first_seen_at"] == held["s:1"]["first_seen_at"] and again["s:2"]["removed_at"] is not None
    assert counts(registry.import_registry(table(spark, [row(record="1")]), at, "s", url)) == (1, 1, 0, 0, 2, 0)
    with pytest.raises(registry.NothingValid):
        registry.import_registry(table(spark, [row("One")]), at, "s", url)
    assert sum(r["removed_at"] is None for r in registry.entries(spark, at).collect()) == 1
    assert counts(registry.import_registry(table(spark, [row("Cy Dee", record="2")]), at, "s", url, snapshot=False)) == (1, 1, 0, 0, 0, 1)
    assert counts(registry.import_registry(table(spark, [row("Pat Quo", record="1")]), at, "other", url)) == (1, 1, 0, 0, 0, 0)
    assert {r["entry_id"] for r in registry.entries(spark, at).where("removed_at is null").collect()} == {"s:1", "s:2", "other:1"}


def test_pages_of_a_folder(spark, tmp_path):
    feature = lambda i: {"attributes": {"id": i, "owner": f"o{i}"}}
    for offset, n in ((0, 10), (10, 10), (30, 10), (40, 3)):
        (tmp_path / f"page-{offset}.json").write_text(json.dumps({"features": [feature(i) for i in range(offset, offset + n)]}))
    (tmp_path / "page-50.json").write_text('{"error": {"code": 500}}')
    (tmp_path / "page-60.json").write_text("<html>")
    pages = paged.pages_of_folder(spark, str(tmp_path)).selectExpr("'l' as layer", "*")
    totals = spark.createDataFrame([("l", 65), ("none", None)], "layer string, reported_total long")
    got = {r["layer"]: r for r in paged.paged_account(pages, totals, ["layer"], 10).collect()}
    assert (got["l"]["rows"], got["l"]["capped"], [tuple(e) for e in got["l"]["errors"]]) == (33, False, [(20, "missing"), (50, "error 500"), (60, "no JSON object")])
    assert (got["none"]["rows"], got["none"]["capped"], got["none"]["errors"]) == (0, False, [])
    assert sorted(r["row"] for r in paged.paged_rows(pages, ["layer"], "id long, owner string").collect()) == [*range(20), *range(30, 43)]
    capped = paged.paged_account(pages, totals, ["layer"], 10, 15).where("layer = 'l'").first()
    assert (capped["rows"], capped["capped"], capped["errors"]) == (15, True, []) or capped["errors"][-1]["offset"] >= 50
    rows = paged.paged_rows(pages, ["layer"], "id long, owner string", 15).collect()
    assert len(rows) == 15 and {(r["row"], r["id"], r["owner"]) for r in rows} == {(i, i, f"o{i}") for i in range(15)}
