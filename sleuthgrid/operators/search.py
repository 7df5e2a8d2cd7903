"""Inverted-index search: keys are exploded once, and a lookup is an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import STRENGTHS, canonical, match_strength, name_keys
from ..functions.text import tokens


#: Parts to which the bearers of a name are dealt.
SALTS = 64
#: Tokens of queries by which an index is cut before it is made.
FEW_TOKENS = 1000


def token_index(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(key, token), each once. only: queries (query_id, query) whose tokens alone are wanted; up to FEW_TOKENS of them are picked out before any row is made."""
    own = tokens(F.col(text))
    if only is not None:
        wanted = [r["token"] for r in only.select(F.explode(tokens(F.col("query"))).alias("token")).distinct().limit(FEW_TOKENS + 1).collect()]
        if len(wanted) <= FEW_TOKENS:
            own = F.array_intersect(own, F.array(*map(F.lit, wanted)).cast("array<string>"))
    return docs.select(key, F.explode(own).alias("token"))


def save_index(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Write a token index in folders by a hash of the token, so that a search reads its own tokens' folders alone."""
    index.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets))).repartition("bucket", "token").sortWithinPartitions("token").write.partitionBy("bucket").mode("overwrite").parquet(path)


def saved_index(spark: SparkSession, path: str, queries: DataFrame, buckets: int = 256) -> DataFrame:
    """The rows of a saved index that queries (query_id, query) may need; buckets as saved."""
    asked = queries.select(F.explode(tokens(F.col("query"))).alias("token")).select(F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("b")).distinct().collect()  # at most `buckets` rows
    index = spark.read.parquet(path)
    return index.where(F.col("bucket").isin([r["b"] for r in asked])).drop("bucket")


def search_tokens(index: DataFrame, queries: DataFrame, key: str, *, every: bool = True) -> DataFrame:
    """(query_id, key, hits): rows with all tokens of a query, or with any. queries: query_id, query."""
    wanted = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token"))
    hits = index.join(wanted, "token").groupBy("query_id", key).agg(F.count("*").alias("hits"))
    if not every:
        return hits
    return hits.join(wanted.groupBy("query_id").agg(F.count("*").alias("_all")), "query_id").where("hits = _all").drop("_all")


def name_index(people: DataFrame, key: str, name: str) -> DataFrame:
    """(key, norm, name_key) for each key of each name."""
    named = people.select(key, canonical(F.col(name)).alias("norm"))
    return named.select(key, "norm", F.explode(name_keys(F.col("norm"))).alias("name_key"))


def search_names(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query_id, key, strength): each person whom a query's keys find, with the strongest match. queries: query_id, query.

    Names are compared once, however many bear them. A name's bearers are dealt to SALTS parts by their key, and its queries go to all of
    these, so that a name that many bear and ask for is no single task's, and no pairs are held to be told apart.
    """
    asked = queries.select("query_id", canonical(F.col("query")).alias("q")).distinct()
    keyed = asked.select("q").distinct().withColumn("name_key", F.explode(name_keys(F.col("q"))))
    pairs = index.select("norm", "name_key").distinct().join(keyed, "name_key").select("q", "norm").distinct()
    matched = pairs.withColumn("strength", match_strength(F.col("q"), F.col("norm"))).where("strength is not null")
    wanted = asked.join(matched, "q").select("query_id", "norm", "strength", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    people = index.select(key, "norm").distinct().withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return people.repartition(SALTS, "norm", "_salt").join(wanted.hint("merge"), ["norm", "_salt"]).select("query_id", key, "strength")


def ranked(matches: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` matches of each query, strongest first, then by key."""
    strength = F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("strength"))
    by = Window.partitionBy("query_id").orderBy(strength, key)
    return matches.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)


def under(rows: DataFrame, column: str, root: str) -> DataFrame:
    """Rows whose dotted name is root or stands below it."""
    return rows.where((F.col(column) == root) | F.col(column).startswith(f"{root}."))


def pivots(entities: DataFrame, apexes: DataFrame, types: list[str]) -> DataFrame:
    """entities with `pivots`: a seed, or of an allowed type and, for a domain, an apex or below one, for a url, one that holds an apex (any, without apexes).

    entities: id, type, value, is_seed; apexes: apex, a seed's domain each, in lower case. Domains are joined by their parents, so no pairs are tried.
    """
    from ..functions.web import parents

    value = F.lower("value")
    parts = F.when(F.col("type") == "domain", parents(value)).when(F.col("type") == "url", F.flatten(F.transform(F.expr("split(lower(value), '[^a-z0-9.-]+')"), parents)))
    roots = apexes.select(F.col("apex").alias("_part")).distinct()
    hits = entities.where(F.col("type").isin("domain", "url")).select("id", F.explode(parts).alias("_part")).join(roots, "_part").select("id", F.lit(True).alias("_hit")).distinct()
    out = entities.join(hits, "id", "left")
    allowed = F.col("type").isin(types) & (F.coalesce("value", F.lit("")) != "")
    shaped = F.when(F.col("type").isin("domain", "url"), F.coalesce("_hit", F.lit(False))).otherwise(True)
    return out.withColumn("pivots", F.col("is_seed") | (allowed & shaped)).drop("_hit").select(*entities.columns, "pivots")


def other_spelling(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Of each asked slug the stored one that differs in letter case alone, the least of several; null without one, and where it is spelled the same."""
    stored = held.groupBy(F.lower("slug").alias("_key")).agg(F.min("slug").alias("_slug"))
    hits = asked.select("asked").distinct().withColumn("_key", F.lower("asked")).join(stored, "_key", "left")
    return hits.select("asked", F.when(F.col("_slug") != F.col("asked"), F.col("_slug")).alias("canonical"))


def containing(asked: DataFrame, held: DataFrame, part: str, whole: str, gram: int = 3) -> DataFrame:
    """Pairs of which the held text contains the asked one, of `gram` letters or more.

    Texts are joined by the asked text's first gram among the held text's, and then compared, so no pairs without a gram
    in common are tried.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - gram + 1, F.lit(1))), lambda i: F.substring(F.col(whole), i, F.lit(gram))))
    left = asked.where(F.length(part) >= gram).withColumn("_gram", F.substring(F.col(part), 1, gram))
    return left.join(held.withColumn("_gram", F.explode(grams)), "_gram").where(F.contains(F.col(whole), F.col(part))).drop("_gram")
