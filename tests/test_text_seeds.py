import duckdb
import pytest
from pyspark.sql import functions as F

from sleuthgrid.functions import extract
from sleuthgrid.plans import lookups, mentions

TEXTS = [
    "Para ció. Ñqueque.ahh Uellie ñtamiue ción que os.", "ist engeöach.ase Die erkeit berein der dem", "ÑRRUE.HLOA!! QUE!! CIÓN!! ES!! PARA", "cióneci ción queci. La. Co.\nQue asesci ción",
    "ées é44.161.181.40 la ontrepa 10.0.0.1é 8.8.8.8", "de é212-555-1234 ou 415-555-2671é mais (415) 555-2672 ça", "La Co", "La. Co.", "uno\n", " Von.*** Keitkeit.&&& ", "uno dos tres cuatro", " \n ", "", None,
    "at 12.1.2.3.4 _1.2.3.4 1.2.3.4_ v1.2.3.4", "écrit à Juan Peréz, John Smith Éa et joe@mail.example.org",
]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{at}/documents.parquet/*.parquet')")
    return at, con


@pytest.mark.parametrize("plans, name", [(mentions, "text_seeds"), (lookups, "ip_extract")])
def test_letters_beyond_ascii_and_company_endings_as_in_sql(spark, documents, plans, name):
    at, con = documents
    found = con.execute(plans.catalog.sql[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r)) for r in getattr(plans, name)(spark, at).select(*columns).collect()) == want and want


def test_passes_are_chosen_by_name_and_all_are_the_default(spark):
    text = F.lit("rue Ñqueque.ahh, Acme Inc")
    values = lambda c: {(h["type"], h["value"]) for h in spark.range(1).select(c.alias("h")).first()["h"]}
    assert values(extract.hits(text)) == {("domain", "queque.ahh"), ("org", "acme inc"), ("person", "acme inc")}
    assert values(extract.hits(text, ["domain"])) == {("domain", "queque.ahh")}
    assert values(extract.hits(F.lit("La. Co."), ["domain"])) == {("org", "la. co.")} and values(extract.hits(F.lit("La. Co."), ["domain"], org_words=[])) == {("person", "la. co.")}
    for passes in ([], ["domains"]):
        with pytest.raises(ValueError, match="passes are some of"):
            extract.hits(text, passes)
