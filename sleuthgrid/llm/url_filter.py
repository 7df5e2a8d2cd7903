"""URL filters by a Bloom filter cascade, in DataFrame functions alone.

The rules' keys of one verdict are the listed keys. The universe is every key that some URL of the
corpus looks up: a suffix of its host of as many labels as some rule's host, with a prefix of its path as
long as some rule's path. Level 1 is a Bloom filter of the
listed keys, level 2 one of the universe's keys that level 1 takes wrongly, level 3 one of the
listed keys that level 2 takes, and so on until a level takes none wrongly. A key is listed if the
first level that refuses it is an even one; so the answer is exact for all of the corpus, without joins.
Lists whose first level would be larger than MAX_BITS are dealt by a hash into parts with a cascade each, and the
corpus is judged by one part after the other, so what is sent with a plan is bounded, however long the list is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

#: Bits for a key, hashes for a key at most, and the most bits of a level that is sent with the plan.
BITS_PER_KEY, HASHES, MAX_BITS = 24, 7, 1 << 27


class TooManyKeys(ValueError):
    """A level would be larger than what may be sent with a plan; with more parts it is smaller."""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys a URL looks up: host suffixes of as many labels as some rule's host, with path prefixes as long as some rule's path."""
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*(F.when(n >= i, F.substring_index(host, ".", -i)) for i in labels)))
    prefixes = F.array_compact(F.array(*(F.when(F.length(path) >= i, F.substring(path, 1, i)) for i in lengths)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _slot(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    filled: bytes

    def takes(self, key: Column) -> Column:
        def bit(slot: Column) -> Column:
            byte = F.substring(F.lit(self.filled), (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))
            return F.bit_get(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(slot, F.lit(8)).cast("int")) == 1

        return F.forall(F.array(*(_slot(key, self.number, i, self.bits) for i in range(self.hashes))), bit)  # the filter stands in the plan once


def _level(number: int, keys: DataFrame, count: int, bits_per_key: int, block: int) -> Level:
    bits = -(-max(1, count * bits_per_key) // block) * block
    if bits > MAX_BITS:
        raise TooManyKeys(f"level {number} needs {bits} bits for {count} keys; the most is {MAX_BITS}")
    hashes = max(1, min(HASHES, bits_per_key * 7 // 10))
    slots = keys.select(F.explode(F.array(*(_slot(F.col("key"), number, i, bits) for i in range(hashes)))).alias("slot"))
    parts = slots.groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("part")).collect()
    filled = bytearray(-(-bits // 32768) * 4096)
    for r in parts:
        filled[4096 * (r["bucket"] - 1) : 4096 * r["bucket"]] = r["part"]
    return Level(number, bits, hashes, bytes(filled))


def cascade(listed: DataFrame, universe: DataFrame, *, bits_per_key: int = BITS_PER_KEY, block: int = 32768) -> list[Level]:
    """Levels that tell the listed keys among those of the universe without error; both have the column key.

    Null keys are left out; repeated ones count once. No listed keys, no levels. `block`: bits a level has at least.
    """
    listed = listed.select("key").where("key is not null").distinct()
    wrong = universe.select("key").where("key is not null")
    right, levels = listed, []
    while n := right.count():
        level = _level(len(levels) + 1, right, n, bits_per_key << len(levels) // 4, block)  # more bits later on, so that it ends however few are asked for
        levels.append(level)
        # what this level must not take, and takes, is what the next one encodes
        taken = wrong.where(level.takes(F.col("key")))
        if len(levels) == 1:
            taken = taken.distinct().join(listed, "key", "left_anti")
        right, wrong = materialize(taken, "url-cascade"), right
    return levels


def listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is a listed one."""
    verdict = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        verdict = F.when(level.takes(key), verdict).otherwise(F.lit(level.number % 2 == 0))
    return verdict


def rule_table(spark: SparkSession, rules: DataFrame | dict[str, list[str]]) -> DataFrame:
    """rule, verdict, host and path of each rule; those without a `/` are left out."""
    if isinstance(rules, dict):
        rules = spark.createDataFrame([(r, v) for v, keys in rules.items() for r in keys], "rule string, verdict string")
    at = F.instr("rule", "/")
    return rules.select("rule", "verdict", F.expr("substring(rule, 1, instr(rule, '/') - 1)").alias("host"), F.expr("substring(rule, instr(rule, '/'))").alias("path")).where(at > 0)


def judge_urls(pages: DataFrame, rules: DataFrame | dict[str, list[str]], *, default: str = "allow", bits_per_key: int = BITS_PER_KEY, block: int = 32768, part_keys: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row's url.

    rules: keys such as `example.com/en/` by verdict, or a table of `rule` and `verdict`. A rule fits its host and
    all subdomains, if the path starts with the rule's; the longest one wins, of equally long ones that with the
    longer host, of one key under several verdicts the first in order (of a table: in the alphabet). Without a
    rule, verdict is default. part_keys: listed keys in a cascade at most, by default as many as MAX_BITS holds.

    Null url or one without ://: host and path are empty, so no rule fits. Rows are judged each for
    itself, whatever repeats; an empty table gives no rows; further columns are ignored. No rules: all default.
    Time grows with a url's length, however many labels its host has.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    listed_rules = rule_table(spark, rules)
    shape = listed_rules.select((F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"), F.length("path").alias("length"))
    shape = shape.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("length")).alias("lengths"), F.count("*").alias("n")).first()  # numbers of labels and lengths alone
    if not shape["n"]:
        return own.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    verdicts = list(rules) if isinstance(rules, dict) else sorted(r["verdict"] for r in listed_rules.select("verdict").distinct().collect())
    keys = keys_of(F.col("host"), F.col("path"), shape["labels"], shape["lengths"])
    parts = -(-shape["n"] // (part_keys or MAX_BITS // bits_per_key))
    own = own.withColumn("best", F.lit(None).cast("struct<n:int,host:int,rule:string,verdict:string>"))
    while True:
        try:
            judged = _judged(own, listed_rules, keys, verdicts, parts, bits_per_key, block)
            break
        except TooManyKeys:  # of the universe, more keys than a level holds were taken wrongly
            parts *= 2
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _judged(own: DataFrame, rules: DataFrame, keys: Column, verdicts: list[str], parts: int, bits_per_key: int, block: int) -> DataFrame:
    """own with the best rule of all parts in `best`."""
    in_part = lambda k, part: F.pmod(F.xxhash64(k, F.lit("part")), F.lit(parts)) == part if parts > 1 else F.lit(True)
    for part in range(parts):
        universe = own.select(F.explode(keys).alias("key")).where(in_part(F.col("key"), part))
        cascades = {v: cascade(rules.where(F.col("verdict") == v).select(F.concat("host", "path").alias("key")).where(in_part(F.col("key"), part)), universe, bits_per_key=bits_per_key, block=block) for v in verdicts}
        judged = lambda k: reduce(lambda rest, v: F.when(listed(k, cascades[v]), F.lit(v)).otherwise(rest), reversed(verdicts), F.lit(None).cast("string"))  # noqa: B023, E731
        found = F.transform(F.filter(keys, lambda k: in_part(k, part)), lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("host"), k.alias("rule"), judged(k).alias("verdict")))  # noqa: B023
        best = F.array_max(F.filter(found, lambda x: x["verdict"].isNotNull()))
        own = own.withColumn("best", F.greatest("best", best))
        if parts > 1:
            own = materialize(own, "url-judged")
    return own
