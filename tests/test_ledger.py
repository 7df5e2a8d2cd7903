from pyspark.sql import functions as F

from sleuthgrid.streaming.ledger import incident_stream, spoken, tail


def test_what_arrivals_say():
    assert [spoken(0, 1, 10, True), spoken(0, 12, 10, True), spoken(1, 8, 10, False), spoken(9, 1, 10, False), spoken(10, 5, 10, False), spoken(0, 0, 10, True)] == [[("new", 1)], [("new", 1), ("burst", 10)], [], [("burst", 10)], [], []]


def write(spark, rows, at):
    spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(at)


def test_each_key_enters_once(spark, tmp_path):
    given, table, checkpoint = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/state"
    write(spark, [("a", 1), ("a", 1), ("b", 2)], given)
    stream = lambda: spark.readStream.schema("k string, ts timestamp").parquet(given)
    assert tail(stream(), ["k"], table, checkpoint).awaitTermination(60)
    write(spark, [("b", 3), ("c", 4), ("c", 4)], given)
    assert tail(stream(), ["k"], table, checkpoint).awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def test_incidents_speak_twice(spark, tmp_path):
    given = f"{tmp_path}/in"
    hour = 3600
    for rows in ([("a", hour), ("b", hour), (None, hour)], [("a", 2 * hour + i) for i in range(12)], [("a", 4 * hour)]):
        write(spark, rows, given)
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(given)
    query = incident_stream(stream, "k", "ts").writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert sorted((r["key"], r["reason"], r["n"]) for r in spark.table("said").collect()) == [("a", "burst", 10), ("a", "new", 1), ("b", "new", 1)]
