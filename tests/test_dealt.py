import pytest
from pyspark.sql import functions as F

from sleuthgrid.operators import search
from sleuthgrid.plans import files, mentions, notices, records

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [lambda s: mentions.written_seeds(s, SF), lambda s: mentions.mail_verdicts(s, SF), lambda s: records.mail_origins(s, SF), lambda s: files.file_fields(s, SF), lambda s: notices._notices(s, SF)])
def test_costly_rows_are_dealt_to_several_tasks(spark, made):
    assert made(spark).rdd.getNumPartitions() > 1


def test_a_name_that_many_bear_is_dealt(spark):
    people = spark.range(2000).select(F.col("id"), F.lit("Ann Lee").alias("name"))
    asked = spark.range(3).select(F.concat(F.lit("q"), "id").alias("query_id"), F.lit("Ann Lee").alias("query"))
    found = search.search_names(search.name_index(people, "id", "name"), asked, "id")
    assert found.count() == found.distinct().count() == 6000
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 3000
