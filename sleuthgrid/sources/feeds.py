"""Readers of feeds and registries. Schemas are stated, nothing is scanned to infer them; rows that can't be read are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import canonical
from ..functions.web import host_of

# The letters of relay flags, words that follow a family's name, strings that stand for nothing.
RELAY_FLAGS = {"Authority": "A", "BadExit": "B", "V2Dir": "D", "Exit": "E", "Fast": "F", "Guard": "G", "HSDir": "H", "Running": "R", "Stable": "S", "Valid": "V", "NoEdConsensus": "X"}
ROLE_WORDS = ["C&C", "C2", "CnC", "Botnet", "Malware"]
NULLISH = ["", "null", "none", "n/a", "na", "<null>"]
_IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"
_RELAY = ["ip", "nickname", "or_port", "flags", "is_exit", "is_guard", "is_bad_exit", "version"]


def _known(c: Column | str) -> Column:
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.nullif(text, F.lit(""))


def _csv(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n fields, c0, c1, ..., of the lines that don't begin with #."""
    return spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(n)), comment="#", quote='"', ignoreLeadingWhiteSpace=True)


def indicators(spark: SparkSession, path: str) -> DataFrame:
    """Indicators from a commented, quoted CSV of ten fields or more: a name for the malware that people know comes before its key; a confidence that isn't a number is 0."""
    ioc = _known("c2")
    port = F.regexp_replace(ioc, r"^([^:]+):\d*$", "$1")
    host = F.when(F.contains(ioc, F.lit("://")), host_of(ioc)).otherwise(F.lower(F.trim(port, F.lit("."))))
    out = _csv(spark, path, 14).where("c9 is not null").select(ioc.alias("ioc"), host.alias("host"), F.trim("c3").alias("ioc_type"), F.trim("c4").alias("threat_type"), F.coalesce(_known("c7"), F.trim("c5")).alias("malware"), F.coalesce(F.expr("try_cast(trim(c9) as int)"), F.lit(0)).alias("confidence"), F.trim("c0").alias("first_seen"))
    return out.where("ioc is not null and host <> ''")


def bad_certificates(spark: SparkSession, path: str) -> DataFrame:
    """sha1, reason, malware (the reason without the role words at its end) and listed_at of a commented CSV."""
    reason, words = F.trim("c2"), "|".join(w.replace("&", "\\&") for w in ROLE_WORDS)
    family = _known(F.regexp_replace(reason, rf"(?:\s*\b(?:{words})(?=\s|$))+\s*$", ""))
    rows = _csv(spark, path, 3).select(F.lower(F.trim("c1")).alias("sha1"), reason.alias("reason"), F.coalesce(family, reason).alias("malware"), F.trim("c0").alias("listed_at"))
    return rows.where(F.col("sha1").rlike("^[0-9a-f]{4,64}$") & F.col("reason").isNotNull())


def _flags(words: Column) -> Column:
    """The letters of the flags that are known, sorted."""
    letters = F.create_map(*(F.lit(x) for pair in RELAY_FLAGS.items() for x in pair))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: letters[w]), lambda x: x.isNotNull()))), "")


def relay_table(spark: SparkSession, path: str) -> DataFrame:
    """Relays of a |-separated table: ip, nickname, ports, flag letters, version; of a repeated ip the first line."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    part = F.split("line", r"\|")
    get = lambda i: F.trim(F.get(part, F.lit(i)))
    port = lambda i: F.when(get(i).rlike(r"^\d+$"), get(i).cast("int"))
    rows = lines.where(F.size(part) > 5).where(get(0).rlike(_IPV4)).select(
        "_at", get(0).alias("ip"), _known(F.substring(get(1), 1, 64)).alias("nickname"), port(2).alias("or_port"), get(4).alias("flags"), *(F.contains(get(4), F.lit(x)).alias(n) for n, x in (("is_exit", "E"), ("is_guard", "G"), ("is_bad_exit", "B"))), F.substring(get(6), 1, 48).alias("version")
    )
    return _first(rows).select(*_RELAY)


def _first(rows: DataFrame) -> DataFrame:
    """Of rows that repeat an ip the first one."""
    rest = [c for c in rows.columns if c not in ("ip", "_at")]
    return rows.groupBy("ip").agg(F.min_by(F.struct(*rest), "_at").alias("_r")).select("ip", "_r.*")


def relay_consensus(spark: SparkSession, path: str) -> DataFrame:
    """Relays of consensus documents, whole files, with valid_after. An exit has the flag and a policy that doesn't reject every port; a file that isn't a consensus has no relays."""
    docs = spark.read.text(path, wholetext=True).where(F.contains(F.substring("value", 1, 400), F.lit("network-status-version 3")) & F.contains(F.substring("value", 1, 400), F.lit("vote-status consensus")))
    entries = docs.select(F.nullif(F.trim(F.regexp_extract("value", r"(?m)^valid-after (.+)$", 1)), F.lit("")).alias("valid_after"), F.posexplode(F.split("value", r"(?m)^(?=r )")).alias("_at", "e")).where("_at > 0")
    words = F.split(F.trim(F.regexp_extract("e", r"^(r [^\n]*)", 1)), r"\s+")
    line = lambda kind: F.trim(F.regexp_extract("e", rf"(?m)^{kind} ([^\n]*)", 1))
    flags = F.split(line("s"), r"\s+")
    get = lambda i: F.get(words, F.lit(i))
    policy = line("p")
    exit_ = F.array_contains(flags, "Exit") & (policy != "") & ~policy.startswith("reject 1-65535")
    rows = entries.where((F.size(words) >= 8) & get(6).rlike(_IPV4)).select(
        "valid_after", "_at", get(6).alias("ip"), F.substring(get(1), 1, 64).alias("nickname"), F.when(get(7).rlike(r"^\d+$"), get(7).cast("int")).alias("or_port"), _flags(flags).alias("flags"), exit_.alias("is_exit"),
        F.array_contains(flags, "Guard").alias("is_guard"), F.array_contains(flags, "BadExit").alias("is_bad_exit"), F.nullif(F.substring(line("v"), 1, 48), F.lit("")).alias("version"), F.nullif(F.substring(policy, 1, 120), F.lit("")).alias("exit_policy"),
    )
    return _first(rows).select(*_RELAY, "exit_policy", "valid_after")


def relay_api(spark: SparkSession, path: str) -> DataFrame:
    """Relays of a JSON document, a row for each IPv4 address; of a repeated one the first."""
    docs = spark.read.json(path, schema="relays array<struct<nickname:string,or_addresses:array<string>,flags:array<string>>>", multiLine=True)
    each = docs.select(F.posexplode("relays").alias("_r", "r")).select("_r", "r.nickname", "r.flags", F.posexplode("r.or_addresses").alias("_a", "address"))
    host, port = F.regexp_extract("address", r"^\[?(.*?)\]?:(\w*)$", 1), F.regexp_extract("address", r":(\w*)$", 1)
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    rows = each.where(host.rlike(_IPV4)).select(
        (F.col("_r").cast("long") * 100_000 + F.col("_a")).alias("_at"), host.alias("ip"), _known(F.substring("nickname", 1, 64)).alias("nickname"), F.when(port.rlike(r"^\d+$"), port.cast("int")).alias("or_port"), _flags(flags).alias("flags"),
        *(F.array_contains(flags, f).alias(n) for n, f in (("is_exit", "Exit"), ("is_guard", "Guard"), ("is_bad_exit", "BadExit"))), F.lit(None).cast("string").alias("version"),
    )
    return _first(rows).select(*_RELAY)


def public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """rule and kind (rule, wildcard, exception) of a suffix list, without comments and marks."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '//')")
    kind = F.when(F.col("line").startswith("!"), "exception").when(F.col("line").startswith("*."), "wildcard").otherwise("rule")
    return lines.select(F.lower(F.regexp_replace("line", r"^(!|\*\.)", "")).alias("rule"), kind.alias("kind")).distinct()


def port_names(spark: SparkSession, path: str) -> DataFrame:
    """port, proto, service and description of a port registry; ranges and rows without a name are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    port, proto, name = (F.trim(F.col(f"`{c}`")) for c in ("Port Number", "Transport Protocol", "Service Name"))
    return rows.where(port.rlike(r"^\d+$") & (proto != "") & (name != "")).select(port.cast("int").alias("port"), F.lower(proto).alias("proto"), name.alias("service"), F.trim(F.coalesce("Description", F.lit(""))).alias("description"))


def vendors(spark: SparkSession, path: str) -> DataFrame:
    """prefix, bits (24 where none are given), registry, vendor and the list of its claimants, of an address block registry; of a repeated prefix any."""
    rows = spark.read.csv(path, schema="prefix string, bits string, registry string, vendor string", header=True)
    claimants = F.filter(F.transform(F.split(F.coalesce("vendor", F.lit("")), r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    out = rows.select(F.upper(F.trim("prefix")).alias("prefix"), F.coalesce(F.expr("try_cast(bits as int)"), F.lit(24)).alias("bits"), F.trim("registry").alias("registry"), F.trim("vendor").alias("vendor"), claimants.alias("vendors"))
    return out.where("prefix <> ''").dropDuplicates(["prefix"])


def officers(spark: SparkSession, path: str) -> DataFrame:
    """ein, org_name, name, norm, title, city, state, tax_year and source of each officer of filings in XML, a file each; a filing that can't be parsed has none.

    Of the filer's fields the first in the document counts, wherever it stands.
    """
    docs = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"<(/?)[A-Za-z][\w.-]*:", "<$1").alias("x"), F.col("_metadata.file_path").alias("source"))
    first = lambda tag: _known(F.regexp_extract("x", rf"(?s)<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", 1))
    whole = docs.where(F.col("x").rlike(r"(?s)^\s*(<\?.*?\?>\s*)?<([\w.-]+)[\s>].*</\2>\s*$"))
    groups = F.regexp_extract_all("x", F.lit(r"(?s)<Form990PartVIISectionAGrp(?:\s[^>]*)?>(.*?)</Form990PartVIISectionAGrp>"), F.lit(1))
    rows = whole.select(first("EIN").alias("ein"), first("BusinessNameLine1Txt").alias("org_name"), first("TaxYr").alias("tax_year"), first("CityNm").alias("city"), first("StateAbbreviationCd").alias("state"), "source", F.explode(groups).alias("g"))
    text = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("g", rf"(?s)<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", 1), "&lt;", "<"), "&gt;", ">"), "&amp;", "&"))
    named = rows.withColumn("name", _known(text("PersonNm"))).withColumn("title", _known(text("TitleTxt"))).where("name is not null")
    return named.select(F.coalesce("ein", F.lit("")).alias("ein"), "org_name", "name", canonical(F.col("name")).alias("norm"), "title", "city", "state", "tax_year", "source").where("norm <> ''")


def headed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose header may have a byte order mark, blanks around names and any case: names in upper case, values trimmed, empty ones null."""
    rows = spark.read.csv(path, header=True)
    names: list[str] = []
    for i, c in enumerate(rows.columns):
        name = c.replace("\ufeff", "").strip().upper()
        names.append(name if name and name not in names and not name.startswith("_C") else f"_{i}")
    return rows.toDF(*names).select(*(_known(F.col(f"`{c}`")).alias(c) for c in names))


def aircraft(spark: SparkSession, master: str, models: str) -> DataFrame:
    """Registered aircraft with maker and model where the model's code is held."""
    craft, kinds = headed(spark, master), headed(spark, models)
    kinds = kinds.where("CODE is not null").dropDuplicates(["CODE"]).select(F.col("CODE").alias("code"), F.col("MFR").alias("maker"), F.col("MODEL").alias("model"))
    own = craft.where("`N-NUMBER` is not null").select(F.concat(F.lit("N"), "N-NUMBER").alias("n_number"), F.col("MFR MDL CODE").alias("code"), F.col("NAME").alias("owner"), F.expr("try_cast(`YEAR MFR` as int)").alias("year"))
    return own.join(kinds, "code", "left").select("n_number", "owner", "year", "code", "maker", "model")


def parcels(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Owners of parcels from JSON pages of features; each layer names its fields. Rows without an owner go; `key` is the layer, the parcel's number or else the feature's, and the owner.

    sources: layer_url, owner_field, address_field, city_field, parcel_field, state, county; files lie in folders layer=N, N a source's `layer`.
    """
    pages = spark.read.json(path, schema="layer long, features array<struct<attributes:map<string,string>>>", multiLine=True)
    each = pages.select("layer", F.explode("features.attributes").alias("a")).join(sources, "layer")
    get = lambda field: F.when(~F.lower(F.trim(F.col("a")[F.col(field)])).isin(NULLISH), F.trim(F.col("a")[F.col(field)]))
    number = F.coalesce(*(F.nullif(F.col("a")[n], F.lit("")) for n in ("OBJECTID", "objectid", "OBJECTID_1")))
    rows = each.select("layer_url", "state", "county", get("owner_field").alias("owner"), get("address_field").alias("address"), get("city_field").alias("city"), get("parcel_field").alias("parcel_id"), number.alias("object_id"))
    named = rows.where("owner is not null").withColumn("norm", canonical(F.col("owner"))).where("norm <> ''")
    identity = F.coalesce("parcel_id", F.concat(F.lit("oid:"), "object_id"), F.lit(""))
    return named.withColumn("key", F.concat_ws("|", "layer_url", identity, "norm"))


def complaints(spark: SparkSession, path: str, source_day: str) -> DataFrame:
    """Complaints of one day's CSV, keyed by their content: a number of the North American plan and a date are needed.

    Numbers need ten digits, or eleven after a 1, with area and exchange codes that begin with 2 to 9. The date is of the violation, else of the entry.
    """
    rows = spark.read.csv(path, header=True, escape='"')
    digits = F.regexp_replace(F.coalesce("Company_Phone_Number", F.lit("")), r"\D", "")
    full = F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits)
    e164 = F.when(full.rlike(r"^1[2-9]\d{2}[2-9]\d{6}$"), F.concat(F.lit("+"), full))
    when = lambda c: F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy")))
    subject, state, area = F.substring(F.trim(F.coalesce("Subject", F.lit(""))), 1, 160), F.substring(F.trim(F.coalesce("Consumer_State", F.lit(""))), 1, 40), F.substring(F.trim(F.coalesce("Consumer_Area_Code", F.lit(""))), 1, 8)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.substring(F.sha2(F.concat_ws("|", e164, text("Created_Date"), text("Violation_Date"), text("Consumer_City"), state, area, subject), 256), 1, 32)
    out = rows.select(digest.alias("id"), F.lit(source_day).alias("source_day"), e164.alias("e164"), F.coalesce(when("Violation_Date"), when("Created_Date")).alias("at"), subject.alias("subject"), (F.upper(text("Recorded_Message_Or_Robocall")) == "Y").alias("robocall"), F.nullif(state, F.lit("")).alias("state"), F.nullif(area, F.lit("")).alias("area_code"))
    return out.where("e164 is not null and at is not null").dropDuplicates(["id"])


def news(spark: SparkSession, path: str) -> DataFrame:
    """title, url, summary (600 characters), external_id and published_at of RSS items; tags in them are left out, items without a link too."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, guid string, pubDate string").load(path)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "), r"\s+", " "))
    day = F.regexp_replace(F.trim("pubDate"), r"^\w{3},\s*", "")
    zone = F.regexp_replace(F.regexp_replace(day, r"\b(GMT|UT|UTC|Z)$", "+0000"), r"\s+", " ")
    at = F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim("pubDate")))
    out = items.select(plain("title").alias("title"), plain("link").alias("url"), F.substring(plain("description"), 1, 600).alias("summary"), F.nullif(plain("guid"), F.lit("")).alias("external_id"), at.alias("published_at"))
    return out.where("url <> ''").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "url"))


def kept_and_skipped(rows: DataFrame, **reasons: Column) -> DataFrame:
    """One row: how many are kept, and how many are skipped for each reason, the first that fits counting."""
    reason = F.lit(None).cast("string")
    for name, c in reversed(list(reasons.items())):
        reason = F.when(F.coalesce(c, F.lit(True)), F.lit(name)).otherwise(reason)
    return rows.select(reason.alias("_why")).agg(F.count_if(F.col("_why").isNull()).alias("kept"), *(F.count_if(F.col("_why") == n).alias(n) for n in reasons))


def next_files(held: DataFrame, ledger: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` files, in the order of their key, that the ledger doesn't name yet."""
    return held.join(ledger.select(key).distinct(), key, "left_anti").orderBy(key).limit(limit)


def upsert_feed(held: DataFrame, incoming: DataFrame, key: list[str], refresh: list[str]) -> DataFrame:
    """Rows of both: of known keys the `refresh` columns are the incoming ones unless null; rows that are in held alone stay."""
    new = incoming.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc_nulls_last(c) for c in refresh)))).where("_i = 1").drop("_i")
    rest = [c for c in held.columns if c not in key]
    a = held.select(*key, *(F.col(c).alias(f"_a_{c}") for c in rest))
    b = new.select(*key, *(F.col(c).alias(f"_b_{c}") for c in rest))
    return a.join(b, key, "full_outer").select(*key, *(F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) if c in refresh else F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in rest)).select(*held.columns)
