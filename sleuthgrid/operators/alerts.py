"""Alerts of several systems in one form: who is on the far side, what the rule said, what stays local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import flat_object, json_records
from ..functions.network import address_key, is_public

# The names under which systems give each field, the first that holds something counts; and fields of our own side.
FIELDS = {
    "dest_ip": "destination.ip dest_ip dst_ip dstip data.dstip destination_ip dest.ip ip.dst id.resp_h remote_ip remote.ip", "src_ip": "source.ip src_ip srcip data.srcip source_ip src.ip ip.src id.orig_h client.ip",
    "dest_port": "destination.port dest_port dst_port dstport data.dstport id.resp_p remote_port",
    "domain": "dns.question.name dns.rrname rrname dns.query query destination.domain url.domain http.hostname tls.sni tls.server_name server_name domain", "url": "url.full url.original http.url url request_url",
    "user_agent": "user_agent.original http.http_user_agent http.user_agent user_agent useragent http_user_agent", "path": "url.path http.uri uri request_path path",
    "rule": "rule.name alert.signature signature rule.description rule_name alert_name event.action", "direction": "network.direction direction flow.direction", "count": "event.count count occurrences hits", "subject": "email.subject subject",
}
DNS_FIELDS = "dns.question.name dns.rrname rrname dns.query query"
LOCAL_ONLY = "host.name hostname host.hostname user.name user username process.command_line process.executable file.path agent.name observer.name source.user.name destination.user.name".split()
DOMAIN = r"^(?=.{1,253}$)(?:[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"
RESERVED = r"\.(local|internal|lan|corp|home\.arpa)$"


def field(flat: Column, names: str) -> Column:
    return F.coalesce(*(F.try_element_at(flat, F.lit(n)) for n in names.split()))


def _address(value: Column) -> Column:
    bare = F.btrim(F.trim(value), F.lit("[]"))
    return F.when(address_key(bare).isNotNull(), bare)


def _domain(value: Column) -> Column:
    name = F.rtrim(F.lower(F.trim(value)), F.lit("."))
    return F.when(name.rlike(DOMAIN) & ~name.rlike(RESERVED), name)


def _indicator(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("type"), value.alias("value")))


def normalise(raw: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, nth (from 0), kind, indicators, context, untrusted, kept_local, events of each record in each text.

    Texts without records give no rows. Only public addresses and valid domains become indicators, and
    fields of our own side are named in kept_local, never shown. In an inbound alert the host and url
    are ours, so the caller's address alone is one.
    """
    rows = raw.select(*key, F.posexplode(json_records(F.col(text))).alias("nth", "_v")).select(*key, "nth", flat_object(F.col("_v")).alias("_f"))
    flat = F.col("_f")
    for name, names in FIELDS.items():
        rows = rows.withColumn(f"_{name}", field(flat, names))
    host = F.lower(F.regexp_extract(F.trim(F.col("_url")), r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    rows = rows.withColumn("_host", host).withColumn("_host_name", _domain(F.col("_host")))
    for outside, address in (("_to", "_dest_ip"), ("_from", "_src_ip"), ("_host_ip", "_host")):
        rows = rows.withColumn(address, _address(F.col(address))).withColumn(outside, F.when(is_public(F.col(address)), F.col(address)))
    inside = lambda given, outside: F.col(given).isNotNull() & F.col(outside).isNull()
    rows = rows.withColumn("_inbound", F.coalesce(F.lower("_direction").isin("inbound", "ingress", "in", "incoming"), F.lit(False)) | inside("_dest_ip", "_to")).withColumn("_inbound", F.col("_inbound") & F.col("_from").isNotNull())
    ours = F.col("_inbound")
    rows = rows.withColumn("_link", F.when(~ours & F.coalesce("_host_ip", "_host_name").isNotNull(), F.trim("_url"))).withColumn("_name", F.when(~ours, _domain(F.col("_domain"))))
    kind = F.when(ours, "inbound_conn").when(F.col("_name").isNotNull() & field(flat, DNS_FIELDS).isNotNull(), "dns_query").when(F.col("_link").isNotNull() | (F.col("_name").isNotNull() & F.col("_user_agent").isNotNull()), "web_request").otherwise("outbound_conn")
    rows = rows.withColumn("kind", kind)
    linked = F.col("_link").isNotNull()
    hosts = [_indicator("domain", F.when(linked, F.col("_host_name"))), _indicator("ip", F.when(linked, F.col("_host_ip")))]
    own_name = F.when(~(linked & F.coalesce(F.col("_host_name") == F.col("_name"), F.lit(False))), F.col("_name"))
    remote = F.when(ours, F.col("_from")).otherwise(F.col("_to"))
    found = F.array_distinct(F.array_compact(F.array(_indicator("url", F.col("_link")), _indicator("domain", own_name), _indicator("ip", remote), *hosts)))
    number = lambda c: F.when(F.col(c).try_cast("long") >= 0, F.col(c).try_cast("long"))
    port, path = number("_dest_port").cast("string"), F.coalesce(F.col("_path"), F.when(F.col("_url").startswith("/"), F.col("_url")))
    given = lambda pairs: F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    context = given({"remote port": F.when(F.col("kind") == "outbound_conn", port), "our port": F.when(ours, port), "detection rule": F.substring("_rule", 1, 200)})
    untrusted = given({"user agent": F.col("_user_agent"), "requested path": F.when(F.col("kind").isin("inbound_conn", "web_request"), path), "subject": F.col("_subject")})
    local = F.array_sort(F.filter(F.map_keys(flat), lambda k: k.isin(LOCAL_ONLY)))
    kept = F.when(inside("_dest_ip", "_to") | inside("_src_ip", "_from"), F.concat(local, F.array(F.lit("internal address")))).otherwise(local)
    return rows.select(*key, "nth", "kind", found.alias("indicators"), context.alias("context"), untrusted.alias("untrusted"), kept.alias("kept_local"), number("_count").alias("events"))
