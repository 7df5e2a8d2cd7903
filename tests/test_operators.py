import random

from pyspark.sql import functions as F

from sleuthgrid.operators import graph, joins, merge
from sleuthgrid.streaming.detector import HOUR_US, alert_times, burst_alerts, deduplicated


def test_range_join_as_nested_loop(spark):
    rng = random.Random(1)
    points = [(i, rng.randint(-500, 500)) for i in range(80)]
    ranges = [(i, (a := rng.randint(-500, 500)), a + rng.choice([-1, 0, 1, 3, 70, 900])) for i in range(60)]
    out = joins.range_join(spark.createDataFrame(points, "p int, v long"), spark.createDataFrame(ranges, "r int, lo long, hi long"), "v", "lo", "hi")
    assert sorted((r["p"], r["r"]) for r in out.collect()) == sorted((p, r) for p, v in points for r, lo, hi in ranges if lo <= v <= hi)


def test_radius_join_as_all_pairs(spark):
    import math
    import random

    rng = random.Random(2)
    place = lambda: (rng.choice([rng.uniform(-90, 90), 89.9, -90.0, 0.0, rng.uniform(80, 90)]), rng.choice([rng.uniform(-180, 180), 180.0, -180.0, 179.95, -179.9]))
    a, b = ([(i, *place()) for i in range(120)] for _ in range(2))

    def distance(p, q):
        x = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * joins.EARTH_KM * math.asin(min(1, math.sqrt(x)))

    left = spark.createDataFrame([*a, (500, None, 1.0), (501, float("nan"), 1.0)], "a int, lat double, lon double")
    right = spark.createDataFrame([*b, (500, None, None)], "b int, lat2 double, lon2 double")
    for km in (1.0, 100.0, 3000.0, 20_100.0):
        got = sorted((r["a"], r["b"]) for r in joins.radius_join(left, right, km).collect())
        assert got == sorted((p[0], q[0]) for p in a for q in b if distance(p, q) <= km) and len(got) > 0


def test_longest_prefix_and_subtree(spark):
    values = spark.createDataFrame([(1, "abcd"), (2, "abx"), (3, "zz"), (4, None)], "id int, v string")
    prefixes = spark.createDataFrame([("a", 1), ("abc", 2), ("abcde", 3)], "p string, n int")
    assert sorted(tuple(r) for r in joins.longest_prefix_join(values, prefixes, "v", "p", ["id"]).select("id", "p", "n").collect()) == [(1, "abc", 2), (2, "a", 1)]


def test_merges_do_not_depend_on_arrival(spark):
    rows = [("k", 2, None, 0.5), ("k", 1, "first", 0.9), ("k", 3, "last", 0.1)]
    for order in (rows, rows[::-1]):
        r = merge.upsert(spark.createDataFrame(order, "k string, seq int, name string, c double"), ["k"], F.col("seq"), most=["c"], first=["name"]).first()
        assert (r["n_observations"], r["c"], r["name"]) == (3, 0.9, "first")


def test_nearest_seed_and_growth(spark):
    edges = spark.createDataFrame([(a, b, "r") for a, b in ["ax", "bx", "xy", "yz", "bq", "mm"]], "source string, target string, rel string")
    seeds = spark.createDataFrame([("a", 0), ("b", 1)], "node string, rank int")
    got = {r["node"]: (r["hops"], r["seed"], r["shared"]) for r in graph.nearest_seed(edges, seeds, 5).collect()}
    assert got == {"a": (0, "a", False), "b": (0, "b", False), "x": (1, "a", True), "y": (2, "a", False), "z": (3, "a", False), "q": (1, "b", False)}
    assert {r["node"] for r in graph.expand(edges, seeds.select("node"), 5, 4).collect()} == {"a", "b", "x", "q"}


def test_alerts_and_cooldown(spark, tmp_path):
    times = [0, 1, 2, 3, 30, 31, 32, 200, 201, 202]
    found, recent, minutes, counts, last = alert_times([t * HOUR_US for t in times], [], [], [], None, 3, 24 * HOUR_US, 168 * HOUR_US)
    assert len(minutes) == len(counts) == 3
    many = alert_times([i * 1_000_000 for i in range(500)], [], [], [], None, 3, 24 * HOUR_US, 1)[0]
    assert [n for _, n in many] == list(range(3, 501))  # all hits of the window count, however many
    assert [t // HOUR_US for t, _ in found] == [2, 202] and len(recent) <= 3 and last == 202 * HOUR_US
    rows = [(k, (1000 + t) * HOUR_US) for k in (1, 2) for t in times]
    at = f"{tmp_path}/in"
    spark.createDataFrame(rows, "k long, us long").select("k", F.timestamp_micros("us").alias("ts")).write.parquet(at)
    stream = spark.readStream.schema("k long, ts timestamp").parquet(at)
    query = burst_alerts(stream, "k", "ts").writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["key"], r["alerted_at"].timestamp() // 3600) for r in spark.table("alerts").collect()) == [(1, 1002.0), (1, 1202.0), (2, 1002.0), (2, 1202.0)]
    assert deduplicated(stream, ["k"], "ts", "1 hour").isStreaming
