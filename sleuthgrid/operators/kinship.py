"""Notices of deaths: facts and relatives by a shallow grammar, and the graph of persons, places and organisations that they make.

A clause begins with words such as "survived by" and goes on until words of another kind. It is a list; a word for a kinship
gives the role of its own item and of those after it, until the next such word. Children named by given names alone
share the surname of the one who died.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of kinship by role, the first that fits counts; words that begin and end clauses; what looks like a name and is none.
ROLES = {
    "in_law": r"-in-law\b", "spouse": r"\b(?:wife|husband|spouse|partner|widow|widower|fiancée?|fiance|companion)\b", "grandchild": r"\b(?:great-?)?grand(?:son|daughter|child(?:ren)?)s?\b",
    "child": r"\b(?:step-?)?(?:sons?|daughters?|child(?:ren)?)\b", "sibling": r"\b(?:step-?|half-?)?(?:brothers?|sisters?|siblings?)\b", "parent": r"\b(?:step)?(?:mother|father|parents?|mom|dad)\b", "extended": r"\b(?:nieces?|nephews?|uncles?|aunts?|cousins?|god(?:son|daughter|child)|friends?)\b",
}
SURVIVED = r"survived\s+by|survivors?\s+(?:include|are|were)|leaves?\s+behind|remembered\s+by|mourned\s+by|missed\s+by"
PRECEDED = r"preceded\s+in\s+death\s+by|predeceased\s+by"
ENDS = r"(?:was\s+)?preceded\s+in\s+death|predeceased|(?:is|was)\s+survived|funeral\s+(?:service|mass|arrangements|home)|services?\s+(?:will|are)|visitation|in\s+lieu\s+of|memorials?\s+may|interment|burial"
NO_NAMES = [
    "United States", "New York", "San Francisco", "Los Angeles", "Las Vegas", "Funeral Home", "Memorial Chapel", "Catholic Church", "Baptist Church", "Methodist Church", "Lutheran Church", "High School", "Guest Book", "Memorial Service", "Funeral Service",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Son", "Daughter", "Children", "Child", "Brother", "Sister", "Wife", "Husband", "Mother", "Father", "He", "She", "His", "Her", "The", "They",
]
WORD = r"(?:Mc|Mac|O')?\p{Lu}\p{Ll}+(?:['-]\p{Lu}\p{Ll}+)*"
NAME = rf"\b({WORD}(?:\s+(?:van|von|de|del|della|di|da|la|le|st\.?))?(?:\s+{WORD}){{1,4}})"
PLACE = r"(\p{Lu}[\p{L} .'-]{2,40}(?:, [A-Z]{2}\b)?)"
DATE = r"([A-Za-z]+ \d{1,2},? \d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
# How sure an edge is, by what it rests on.
KNOWN_ROLE, UNKNOWN_ROLE, PLACED, FUNERAL, SERVED, ALIAS = 0.5, 0.4, 0.55, 0.5, 0.45, 0.6
INVERSE = {"spouse": "spouse", "child": "parent", "parent": "child", "sibling": "sibling", "grandchild": "grandparent", "in_law": "in_law", "extended": "extended", "unknown": "unknown"}


def plain_text(text: Column) -> Column:
    """Quotes and dashes as ASCII, white space as single spaces."""
    return F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "“”’‘–— ", "\"\"''-- "), r"\s+", " "))


def obituary_facts(notices: DataFrame, key: list[str], text: str, name: str, title: str | None = None) -> DataFrame:
    """key, name, age, birth_date, death_date, residence, death_place, funeral_home, cemetery, occupation, military and aka of each notice; nulls where it doesn't say."""
    whole = F.col("_t")
    first = lambda pattern, group=1, of=whole: F.nullif(F.btrim(F.regexp_extract(of, pattern, group), F.lit(" ,")), F.lit(""))
    head, head_title = F.substring(whole, 1, 500), plain_text(F.col(title)) if title else F.lit("")
    rows = notices.select(*key, F.btrim(F.col(name)).alias("name"), head_title.alias("_title"), plain_text(F.concat_ws(" ", head_title, F.col(text))).alias("_t"))
    age = F.coalesce(*(first(p, 1, head).try_cast("int") for p in (r"(?i)\baged? (\d{1,3})\b", r"(?i)\b(\d{1,3}) years? old\b", r"\((\d{1,3})\)", r", ?(\d{1,3}) ?,")))
    span = lambda g: F.nullif(F.regexp_extract("_title", r"\((\d{4}) ?- ?(\d{4})\)", g), F.lit(""))
    return rows.select(
        *key, "name", F.when(age.between(1, 120), age).alias("age"), F.coalesce(first(rf"(?i)\b(?:born|birth) (?:on )?{DATE}"), span(1)).alias("birth_date"),
        F.coalesce(first(rf"(?i)\b(?:died|passed away|entered (?:into )?rest|departed this life) (?:peacefully )?(?:on )?{DATE}"), span(2)).alias("death_date"),
        F.coalesce(first(rf"\bformerly of {PLACE}"), first(rf"\bof {PLACE}", 1, head)).alias("residence"), first(rf"\b(?:passed away|died)(?: peacefully)? (?:at|in) {PLACE}").alias("death_place"),
        first(r"\b((?:\p{Lu}[\p{L}&'.-]+ ){1,5}(?:Funeral Home|Mortuary|Funeral Chapel|Memorial (?:Home|Chapel|Services?)))").alias("funeral_home"),
        first(r"(?:Interment|interment|Burial|burial|laid to rest)(?: will be)? (?:at|in) (?:the )?(\p{Lu}[\p{L} &'.-]{2,60}?(?:Cemetery|Memorial Park|Gardens?))").alias("cemetery"),
        first(r"(?i)\b(?:worked (?:as|for)|retired (?:from|as)|career (?:as|with|in)|employed (?:as|by|with)) ([^.]{5,80})").alias("occupation"),
        first(r"\b((?:U\.?S\.? )?(?:Army|Navy|Air Force|Marine Corps|Coast Guard|Space Force|National Guard)[^.]{0,60})").alias("military"), first(r"\b(?:known as|nicknamed|aka|a\.k\.a\.) [\"']?(\p{Lu}[\p{L} .'-]{1,40}\p{L})").alias("aka"),
    )


def obituary_kin(notices: DataFrame, key: list[str], text: str, name: str) -> DataFrame:
    """key, relative, role, living and span: each relative that a notice names, once; the first with a known role counts. key tells notices apart."""
    rows = notices.select(*key, F.btrim(F.coalesce(F.col(name), F.lit(""))).alias("_of"), plain_text(F.col(text)).alias("_t"))
    clauses = lambda begin, living: F.transform(F.regexp_extract_all("_t", F.lit(rf"(?i)(?:{begin})[:\- ]*(.+?)(?=\b(?:{ENDS})|$)"), F.lit(1)), lambda c: F.struct(c.alias("clause"), F.lit(living).alias("living")))
    spouse = F.transform(F.regexp_extract_all("_t", F.lit(r"\b(?:[Hh]usband|[Ww]ife|[Ss]pouse) of ([^,.;]{1,60}?)(?=[,.;]| and |$)"), F.lit(1)), lambda c: F.struct(F.concat(F.lit("spouse "), c).alias("clause"), F.lit(True).alias("living")))
    married = F.transform(F.regexp_extract_all("_t", F.lit(rf"\b(?:married|wed) (?:to )?{NAME}"), F.lit(1)), lambda c: F.struct(F.concat(F.lit("spouse "), c).alias("clause"), F.lit(True).alias("living")))
    rows = rows.select(*key, "_of", F.posexplode(F.concat(clauses(SURVIVED, True), spouse, married, clauses(PRECEDED, False))).alias("_c", "_x")).select(*key, "_of", "_c", "_x.*")
    items = rows.select("*", F.posexplode(F.split("clause", r"(?i)\s*[;,]\s*|\s+and\s+|\s+as well as\s+|\.\s+(?=\p{Lu})")).alias("_i", "_item"))
    role = F.coalesce(*(F.when(F.col("_item").rlike(f"(?i){pattern}"), F.lit(role)) for role, pattern in ROLES.items()))
    held = F.last(F.col("_own"), ignorenulls=True).over(Window.partitionBy(*key, "_c").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    items = items.withColumn("_own", role).withColumn("role", F.coalesce(held, F.lit("unknown")))
    surname = F.when(F.col("_of").contains(" "), F.substring_index("_of", " ", -1))
    known = lambda n: ~n.isin(NO_NAMES) & ~F.substring_index(n, " ", 1).isin(NO_NAMES) & (F.lower(n) != F.lower("_of"))
    full = F.filter(F.regexp_extract_all("_item", F.lit(NAME), F.lit(1)), known)
    given = F.filter(F.regexp_extract_all(F.regexp_replace("_item", NAME, " "), F.lit(rf"\b({WORD})(?![\p{{L}}'-])"), F.lit(1)), lambda g: ~g.isin(NO_NAMES) & ~F.array_contains(F.split("_of", " "), g))
    shares = surname.isNotNull() & F.col("role").isin("spouse", "child", "parent", "grandchild") & (F.size(full) == 0) & (F.col("role").isin("child", "spouse") | F.col("_own").isNotNull())
    named = F.concat(full, F.when(shares, F.transform(given, lambda g: F.concat(g, F.lit(" "), surname))).otherwise(F.array().cast("array<string>")))
    found = items.select(*key, "_c", "_i", "role", "living", F.substring("clause", 1, 280).alias("span"), F.explode(named).alias("relative"))
    first = Window.partitionBy(*key, F.lower("relative")).orderBy(F.col("role") == "unknown", "_c", "_i")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*key, "relative", "role", "living", "span")


def node_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(F.btrim(F.regexp_replace(value, r"\s+", " "))))


def kinship_edges(facts: DataFrame, kin: DataFrame, key: list[str], source: str = "obituary") -> DataFrame:
    """key, source_id, target_id, rel, role, confidence, living, span and the ends' type and value, of each thing that a notice ties to the one it is about.

    A relative has an edge to and one from, of the inverse role. One name in two notices is two persons until someone
    says otherwise: nodes are told apart by key and id. Notices without a name have none.
    """
    person = F.col("name")
    about = facts.where("trim(name) <> ''")
    edge = lambda rel, role, conf, kind, value, living=F.lit(None).cast("boolean"), span=F.lit(None).cast("string"): F.struct(
        node_id(F.lit("person"), person).alias("source_id"), node_id(F.lit(kind), value).alias("target_id"), F.lit(rel).alias("rel"), role.alias("role"), conf.alias("confidence"), living.alias("living"), span.alias("span"),
        F.lit("person").alias("source_type"), person.alias("source_value"), F.lit(kind).alias("target_type"), value.alias("target_value"), F.lit(source).alias("basis"))
    to = lambda c, kind, role, conf, rel: F.when(F.length(F.btrim(c)) > 2, edge(rel, F.lit(role), F.lit(conf), kind, F.col(c)))
    places = F.array(
        to("residence", "location", "residence", PLACED, "located_in"), to("death_place", "location", "death_place", PLACED, "located_in"), to("cemetery", "location", "cemetery", PLACED, "located_in"),
        to("funeral_home", "org", "funeral_home", FUNERAL, "associated_with"), to("military", "org", "military", SERVED, "associated_with"), to("aka", "person", "alias", ALIAS, "same_as"),
    )
    tied = about.select(*key, F.explode(F.array_compact(places)).alias("e")).select(*key, "e.*")
    sure = F.when(F.col("role") == "unknown", UNKNOWN_ROLE).otherwise(KNOWN_ROLE)
    related = about.select(*key, "name").join(kin, key).where("lower(relative) <> lower(name)").select(*key, edge("related_to", F.col("role"), sure, "person", F.col("relative"), F.col("living"), F.col("span")).alias("e")).select(*key, "e.*")
    inverse = F.create_map(*(F.lit(x) for pair in INVERSE.items() for x in pair))
    swap = {"source_id": "target_id", "target_id": "source_id", "source_type": "target_type", "target_type": "source_type", "source_value": "target_value", "target_value": "source_value"}
    back = related.select(*(F.col(swap.get(c, c)).alias(c) if c != "role" else F.try_element_at(inverse, F.col("role")).alias("role") for c in related.columns))
    return related.unionByName(back).unionByName(tied)


def attach_records(edges: DataFrame, about: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """edges with one for each record (key, kind, value, rel, role, confidence) from the person whom key is about (key, name). A record of a same name makes no identity: it is a node of its own."""
    joined = about.where("trim(name) <> ''").select(*key, "name").join(records.where("trim(value) <> ''"), key)
    added = joined.select(
        *key, node_id(F.lit("person"), F.col("name")).alias("source_id"), node_id(F.col("kind"), F.col("value")).alias("target_id"), "rel", "role", F.col("confidence").cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("living"),
        F.lit(None).cast("string").alias("span"), F.lit("person").alias("source_type"), F.col("name").alias("source_value"), F.col("kind").alias("target_type"), F.col("value").alias("target_value"), F.lit("record").alias("basis"),
    )
    return edges.unionByName(added)


def graph_nodes(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, id, type, value and confidence (the highest of its edges) of each end of an edge."""
    ends = edges.select(*key, "confidence", F.explode(F.array(*(F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_type").alias("type"), F.col(f"{s}_value").alias("value")) for s in ("source", "target")))).alias("e")).select(*key, "e.*", "confidence")
    return ends.groupBy(*key, "id", "type").agg(F.min("value").alias("value"), F.max("confidence").alias("confidence"))


def graphs_as_json(edges: DataFrame, key: list[str]) -> DataFrame:
    """key and graph, one JSON text {nodes, edges} for each key, both in the order of their ids; nothing passes through the driver."""
    nodes = graph_nodes(edges, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("id", "type", "value", "confidence"))).alias("nodes"))
    kept = F.struct("source_id", "target_id", "rel", "role", "confidence", "living", "basis", "span")
    both = edges.groupBy(*key).agg(F.array_sort(F.collect_list(kept)).alias("edges")).join(nodes, key)
    return both.select(*key, F.to_json(F.struct("nodes", "edges")).alias("graph"))
