"""How a case is built: keys resolved to entities, edges and evidence merged in, scores' inputs, rows kept and dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relations that tell which collector must have seen both their ends.
RELATION_HINTS = {
    "lookalike_of": "lookalike_domains",
    "resolves_to": "dns_resolve",
    "has_mx": "dns_resolve",
    "has_ns": "dns_resolve",
    "member_of": "asn_cymru",
    "issued_for": "tls_cert",
    "security_contact": "security_txt",
    "exposed_in": "hibp_breach",
    "uses_tech": "tech_fingerprint",
    "subdomain_of": "crtsh",
}


def resolve(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with source_id and target_id for source_key and target_key; those with an end that isn't held, or with one entity at both ends, go. ids: norm_key, id."""
    out = edges
    for end in ("source", "target"):
        out = out.join(ids.select(F.col("norm_key").alias(f"{end}_key"), F.col("id").alias(f"{end}_id")), f"{end}_key")
    return out.where("source_id <> target_id")


def merged_props(observations: DataFrame, key: list[str], props: str, order: str) -> DataFrame:
    """Of each key its properties, a map, each with the value seen last; two keys without properties have an empty one."""
    each = observations.select(*key, F.explode(props).alias("_name", "_value"), order).groupBy(*key, "_name").agg(F.max_by("_value", order).alias("_value"))
    maps = each.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_value")))).alias(props))  # as many entries as names
    return observations.select(*key).distinct().join(maps, key, "left").withColumn(props, F.coalesce(props, F.create_map().cast("map<string,string>")))


def upsert_edges(held: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Edges by (source_id, target_id, rel): the highest confidence, properties of both with the later values, first_seen and last_seen, and whether they are new.

    held and incoming: source_id, target_id, rel, confidence, props (map) and the order in which they were seen.
    """
    key = ["source_id", "target_id", "rel"]
    both = held.select(*key, "confidence", "props", order, F.lit(False).alias("_new")).unionByName(incoming.select(*key, "confidence", "props", order, F.lit(True).alias("_new")))
    sums = both.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), F.bool_and("_new").alias("added"))
    return sums.join(merged_props(both, key, "props", order), key)


def apply_counts(ids: DataFrame, entities: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a collector's batch brings in, as one row: entities that weren't held, edges written (also those that only refresh one) and evidence.

    ids: norm_key and id held before; entities: norm_key; edges: source_key, target_key.
    """
    new = entities.select("norm_key").distinct().join(ids, "norm_key", "left_anti")
    after = ids.select("norm_key", F.col("norm_key").alias("id")).unionByName(new.select("norm_key", F.col("norm_key").alias("id")))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(new, "entities").crossJoin(count(resolve(edges, after), "edges")).crossJoin(count(evidence, "evidence"))  # three single rows


def score_inputs(entities: DataFrame, edges: DataFrame, evidence: DataFrame, strong: list[str]) -> DataFrame:
    """Of each entity that isn't merged away: n_evidence, n_collectors, degree_in, degree_out and strong edges.

    A collector counts by its evidence of the entity, or by an edge of a relation that only it makes. entities: id, merged_into_id;
    edges: source_id, target_id, rel; evidence: entity_id, collector.
    """
    hint = F.element_at(F.create_map(*(F.lit(x) for pair in RELATION_HINTS.items() for x in pair)), F.col("rel"))
    ends = edges.select(F.col("rel").isin(strong).cast("int").alias("strong"), hint.alias("collector"), F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("out")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("out")))).alias("e"))
    ends = ends.select("e.id", "e.out", "strong", "collector")
    by_edge = ends.groupBy("id").agg(F.sum("out").alias("degree_out"), F.sum(1 - F.col("out")).alias("degree_in"), F.sum("strong").alias("strong"))
    seen = evidence.where("entity_id is not null").select(F.col("entity_id").alias("id"), "collector")
    by_evidence = seen.groupBy("id").agg(F.count("*").alias("n_evidence"))
    named = seen.unionByName(ends.select("id", "collector")).where("collector is not null and collector <> ''").groupBy("id").agg(F.count_distinct("collector").alias("n_collectors"))
    out = unmerged(entities).select("id").join(by_evidence, "id", "left").join(named, "id", "left").join(by_edge, "id", "left")
    return out.fillna(0, ["n_evidence", "n_collectors", "degree_in", "degree_out", "strong"])


def unmerged(entities: DataFrame) -> DataFrame:
    """Entities that no other has taken in."""
    return entities.where(F.coalesce(F.col("merged_into_id").cast("string"), F.lit("")) == "")


def fill(held: DataFrame, incoming: DataFrame, key: list[str], keep: list[str] = (), refresh: list[str] = (), most: list[str] = ()) -> DataFrame:
    """Rows of both by key: `keep` columns stay unless null, `refresh` ones are replaced unless the new one is null, `most` take the greater."""
    a = held.select(*key, *(F.col(c).alias(f"_a_{c}") for c in [*keep, *refresh, *most]))
    b = incoming.select(*key, *(F.col(c).alias(f"_b_{c}") for c in [*keep, *refresh, *most]))
    rules = [F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in keep] + [F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in refresh] + [F.greatest(f"_a_{c}", f"_b_{c}").alias(c) for c in most]
    return a.join(b, key, "full_outer").select(*key, *rules)


def update_from(held: DataFrame, updates: DataFrame, key: list[str], columns: list[str], only: Column | None = None) -> DataFrame:
    """held with columns replaced from the row of updates with its key, where there is one and `only` holds."""
    new = updates.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    hit = F.col("_hit") if only is None else F.col("_hit") & only
    joined = held.join(new, key, "left")
    return joined.select(*(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in held.columns))


def first_hits(asked: DataFrame, corpora: list[tuple[str, DataFrame]], key: str, order: str) -> DataFrame:
    """Of each asked key the first row found: corpora in their order, then `order` within one. corpora: name and a table of key, order and what it shows."""
    hits = None
    for rank, (name, held) in enumerate(corpora):
        found = held.join(asked.select(key).distinct(), key, "left_semi").select(key, F.lit(rank).alias("_rank"), F.lit(name).alias("corpus"), F.col(order).alias("_order"), "shown")
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy(key).agg(F.min(F.struct("_rank", "_order", "corpus", "shown")).alias("b"))
    return asked.select(key).distinct().join(best, key, "left").select(key, "b.corpus", "b.shown")


def lookup(asked: DataFrame, held: DataFrame, key: list[str], order: list[Column], limit: int = 25) -> DataFrame:
    """For each asked key the first `limit` rows held under it, numbered `nth`. Spark limits each key before the shuffle of the ranking."""
    hits = held.join(asked.select(*key).distinct(), key, "left_semi")
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("nth") <= limit)


def older_than(at: Column, days: int, now: Column) -> Column:
    """Whether a time is more than `days` days ago; 0 or less days turn this off, and null times are never old."""
    return F.coalesce(at < now - F.expr(f"interval {days} days"), F.lit(False)) if days > 0 else F.lit(False)


def purge(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the keys in gone."""
    return {name: held.join(gone.select(key), key, "left_anti") for name, held in tables.items()}


def expire(listings: DataFrame, days: int, now: Column) -> DataFrame:
    """Listings with reports, of which the last is more than `days` ago, are no longer active. Columns: active, report_count, last_report_at."""
    stale = F.col("active") & (F.col("report_count") > 0) & older_than(F.col("last_report_at"), days, now)
    return listings.withColumns({"delisted": F.coalesce(stale, F.lit(False)), "active": F.col("active") & ~F.coalesce(stale, F.lit(False))})


def prune_closed(events: DataFrame, days: int, now: Column) -> DataFrame:
    """Events without those closed (done, wontfix) and last seen more than `days` ago; open ones stay."""
    return events.where(~(F.col("status").isin("done", "wontfix") & older_than(F.col("last_seen"), days, now)))


def cap_with_note(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in order, each with how many there were in all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))  # one row
