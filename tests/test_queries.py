import math
import os

import duckdb
import pytest

from sleuthgrid.plans import casebook, certificates, entities, fields, files, imports, lookups, mentions, notices, places, records, status, traffic, views

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
PLANS = (traffic, entities, lookups, records, casebook, status, fields, views, certificates, mentions, places, files, notices, imports)
QUERIES = {n: q for p in PLANS for n, q in p.catalog.queries.items()}
SQL = {n: q for p in PLANS for n, q in p.catalog.sql.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 8)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_as_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=str)
    found = duck.execute(SQL[name])
    place = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(found.description) == len(columns)
    assert got == sorted((plain(tuple(r[i] for i in place)) for r in found.fetchall()), key=str)
