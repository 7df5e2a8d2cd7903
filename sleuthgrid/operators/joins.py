"""Joins that Spark would plan as nested loops, rewritten as equi-joins with a residual filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import dealt

EARTH_KM = 6371.0


def range_join(points: DataFrame, ranges: DataFrame, value: str, start: str, end: str) -> DataFrame:
    """Inner join where start <= value <= end, all whole numbers; ranges may overlap.

    A range belongs to the level at which it touches two bins at most, so wide and narrow ranges mix
    and no bin width has to be guessed. A point looks up one bin on each level in use, 63 at most.
    """
    width = F.col(end) - F.col(start)
    level = F.when(width <= 0, 0).otherwise(F.length(F.bin(width)))
    leveled = ranges.where(width >= 0).withColumn("_level", level.cast("int"))
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect())  # at most 63 numbers
    bins = F.sequence(F.expr(f"shiftright({start}, _level)"), F.expr(f"shiftright({end}, _level)"))
    left = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", F.expr(f"shiftright({value}, _level)"))
    joined = left.join(leveled.withColumn("_bin", F.explode(bins)), ["_level", "_bin"])
    return joined.where(F.col(value).between(F.col(start), F.col(end))).drop("_level", "_bin")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def radius_join(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs within km of each other on a sphere, with the distance km; left has lat, lon, right has lat2, lon2. Rows without a place have none.

    A grid makes it an equi-join: a point of left looks up the cells that its circle's box meets. Cells go around at 180
    degrees, and a circle that holds a pole meets all cells of its latitudes, 1,024 in a row at most. Points of left
    are dealt evenly to tasks, which a small table of right comes to.
    """
    angle = km / EARTH_KM
    high = max(math.degrees(angle), 180 / 1024)
    around = max(1, min(1024, int(360 // max(math.degrees(angle), 1e-9))))
    size = 360 / around
    slack = 1e-6  # degrees, more than rounding can be off
    reach = F.when(F.abs("lat") + math.degrees(angle) >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(F.radians("lat"))))))
    row = lambda c: F.floor(c / high)
    first, last = F.floor((F.col("lon") - reach - slack) / size), F.floor((F.col("lon") + reach + slack) / size)
    columns = F.when(last - first + 1 >= around, F.sequence(F.lit(0), F.lit(around - 1).cast("long"))).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, F.lit(around))))
    rows = F.sequence(row(F.col("lat") - math.degrees(angle) - slack), row(F.col("lat") + math.degrees(angle) + slack))
    placed = left.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    a = dealt(placed).withColumn("_y", F.explode(rows)).withColumn("_x", F.explode(columns))
    b = right.withColumn("_y", row(F.col("lat2"))).withColumn("_x", F.pmod(F.floor(F.col("lon2") / size), F.lit(around)))
    joined = a.join(b, ["_y", "_x"]).drop("_y", "_x")
    return joined.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("km") <= km)


def longest_prefix_join(left: DataFrame, prefixes: DataFrame, value: str, prefix: str, key: list[str]) -> DataFrame:
    """Each row of left with the longest prefix that its value starts with; rows without one are left out.

    Prefix lengths in use are few, so a value looks up one substring for each; `key` identifies rows of left.
    """
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).where(F.length(prefix) > 0).distinct().collect())
    looked = left.withColumn("_n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).where(F.length(value) >= F.col("_n"))
    looked = looked.withColumn("_prefix", F.expr(f"substring({value}, 1, _n)"))
    hits = looked.join(prefixes.withColumnRenamed(prefix, "_prefix"), "_prefix")
    columns = [c for c in hits.columns if c not in ("_n", "_prefix") and c not in key]
    best = hits.groupBy(*key).agg(F.max_by(F.struct(*columns, F.col("_prefix").alias(prefix)), "_n").alias("_best"))
    return best.select(*key, "_best.*")


def subtree_join(hosts: DataFrame, roots: DataFrame, host: str, root: str) -> DataFrame:
    """Pairs of a host and a root that it equals or lies under: an equi-join on the host's parents."""
    labels = F.split(F.col(host), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return hosts.withColumn("_root", F.explode(parents)).join(roots.withColumnRenamed(root, "_root"), "_root").withColumnRenamed("_root", root)


def semi_any(left: DataFrame, watched: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows of left of which any of `columns` is a watched key; each row once."""
    keys = watched.select(F.col(key).alias("_w")).distinct()
    out = left
    for c in columns:
        out = out.join(keys.withColumnsRenamed({"_w": f"_{c}"}), F.col(c) == F.col(f"_{c}"), "left")
    return out.where(F.coalesce(*(F.col(f"_{c}") for c in columns)).isNotNull()).drop(*(f"_{c}" for c in columns))
