from pyspark.sql import functions as F

from sleuthgrid.operators import status


def test_places_go_on_over_all_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("r"), (F.col("id") * 37 % 101).alias("at"), F.col("id").alias("host"))
    got = {r["host"]: r["place"] for r in status.placed(rows, [F.col("r"), F.desc("at"), F.col("host")], "place").collect()}
    order = sorted(got, key=lambda i: (i % 3, -(i * 37 % 101), i))
    assert [got[i] for i in order] == list(range(1, 1001))
