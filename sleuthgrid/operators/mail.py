"""What the headers of messages say about their senders: a table of rules, worked out as one array of findings a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mail
from ..functions.nested import let
from ..functions.network import is_address

# Severities in their order, results of DMARC that are no failure, headers that name where a message came from.
SEVERITIES = ["high", "medium", "low", "info"]
DMARC_FINE = ["pass", "none", "bestguesspass"]
ORIGINATING = ["x-originating-ip", "x-sender-ip", "x-source-ip"]
ONCE = ["from", "sender", "reply-to", "return-path", "subject", "date", "message-id"]


def _some(text: Column) -> Column:
    """A text that isn't empty, else null."""
    return let(text, lambda t: F.when(t != "", t))


def address(value: Column) -> Column:
    """The address in a header such as From, in lower case; null if there is none."""
    bare = F.regexp_extract(value, r"(?<![^\s<>,;\"])([^\s<>,;\"]+@[^\s<>,;\"]+)\s*$", 1)
    found = let(F.regexp_extract(value, r"<([^<>]*)>\s*$", 1), lambda angle: F.when(angle != "", angle).otherwise(bare))
    return _some(F.lower(F.trim(found)))


def display_name(value: Column) -> Column:
    """What stands before an address in angle brackets, without quotes."""
    return _some(F.substring(F.trim(F.btrim(F.trim(F.regexp_extract(value, r"^(.*)<[^<>]*>\s*$", 1)), F.lit('"'))), 1, 200))


def domain_of(text: Column) -> Column:
    """The host after the last @, without what brackets it; null if it is none."""
    host = F.when(text.contains("@"), F.lower(F.btrim(F.substring_index(text, "@", -1), F.lit("<>\"' ."))))
    return let(host, lambda h: F.when(h.rlike(f"^{mail.HOSTNAME}$"), h))


def sent_at(text: Column) -> Column:
    """The time in a Date header or at a hop's end; null for other texts and for times of no known zone."""
    found = F.regexp_extract(text, r"\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}(?::\d{2})? (?:[+-]\d{4}|GMT|UTC|UT|Z)", 0)
    whole = lambda t: F.regexp_replace(F.regexp_replace(t, "[A-Z]+$", "+0000"), r"( \d{1,2}:\d{2}) ", "$1:00 ")
    return let(found, lambda t: F.when((t != "") & ~t.endswith("-0000"), F.try_to_timestamp(whole(t), F.lit("d MMM yyyy H:mm:ss Z"))))


def _results(value: Column, families: Column) -> Column:
    """One Authentication-Results header; families: those of the trusted servers."""
    head = F.trim(F.substring_index(value, ";", 1))
    server = F.when(~head.contains("="), _some(F.lower(F.regexp_extract(head, r"^(\S+)", 1))))
    result = lambda tag: _some(F.lower(F.regexp_extract(value, rf"(?i)(?:^|[;\s]){tag}\s*=\s*([a-z0-9]+)", 1)))
    named = lambda tag: _some(F.btrim(F.lower(F.regexp_extract(value, rf"(?i){tag}\s*=\s*([^\s;]+)", 1)), F.lit("<>@")))
    trusted = lambda server: F.when(server.isNotNull() & (F.size(families) > 0), let(mail.family(server), lambda own: F.exists(families, lambda f: f == own)))
    fields = {"spf": result("spf"), "dkim": result("dkim"), "dmarc": result("dmarc"), "compauth": result("compauth"), "header_d": named(r"header\.d"), "header_from": named(r"header\.from"), "mailfrom": named(r"smtp\.mailfrom")}
    return let(server, lambda s: F.struct(s.alias("server"), trusted(s).alias("trusted"), *(v.alias(k) for k, v in fields.items())))


def parse_mail(messages: DataFrame, key: list[str], blob: str) -> DataFrame:
    """key and the fields of each header block that rules look at; each step is a column, so that none is worked out twice."""
    c = F.col
    one = lambda name: c(f"said.`{name}`")
    every = lambda name: let(c("names"), lambda names: F.filter("values", lambda _, i: F.get(names, i) == name))
    first = lambda hosts: F.slice(hosts, 1, F.greatest("trusted", F.lit(0)))
    noted = lambda cond, note: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(note))).otherwise(F.array().cast("array<string>"))
    rows = messages.select(*key, mail.lines(c(blob)).alias("block")).select(*key, mail.names(c("block")).alias("names"), mail.values(c("block")).alias("values"))
    said = F.struct(*(F.get("values", (F.array_position("names", h) - 1).cast("int")).alias(h) for h in ONCE + ORIGINATING))
    twice = F.concat(*(noted(F.size("names") - F.size(F.array_remove("names", h)) > 1, f"several headers {h}, of which programs show one or another") for h in ONCE))
    rows = rows.select(*key, every("received").alias("received"), every("authentication-results").alias("results"), every("dkim-signature").alias("signatures"), said.alias("said"), twice.alias("twice"))
    rows = rows.withColumn("chain", F.transform("received", mail.hop))
    rows = rows.withColumn("families", F.transform("chain", lambda h: mail.family(h["by_host"])))
    rows = rows.withColumn("trusted", mail.trusted_families(c("families"))).withColumn("origin_ip", mail.origin(c("chain"), c("trusted")))
    rows = rows.withColumn("servers", F.array_compact(first("families")))
    rows = rows.withColumn("auth", F.transform("results", lambda v: _results(v, c("servers")))).withColumn("top", F.get("auth", F.lit(0)))
    rows = rows.withColumn("used", F.when(F.coalesce(c("top.trusted"), F.lit(True)), c("top")))
    rows = rows.withColumns({"from_addr": address(one("from")), "display_name": display_name(one("from")), "reply_to": address(one("reply-to")), "return_path": address(one("return-path")), "message_domain": domain_of(one("message-id"))})
    rows = rows.withColumn("from_domain", domain_of(c("from_addr"))).withColumn("from_org", mail.org_domain(c("from_domain")))
    signed = F.array_compact(F.transform("signatures", lambda v: _some(F.lower(mail.tag(v, "d")))))
    rows = rows.withColumn("signed", F.array_distinct(F.array_compact(F.concat(F.array("used.header_d"), signed))))
    envelope = let(F.coalesce("return_path", "used.mailfrom"), lambda a: domain_of(F.concat(F.lit("@"), F.substring_index(a, "@", -1))))
    claims = F.when(c("display_name").contains("@"), F.lower(F.btrim(F.substring_index("display_name", "@", -1), F.lit("<>\"' "))))
    rows = rows.withColumns({"signer": F.get(F.filter("signed", lambda d: _of_sender(d)), F.lit(0)), "envelope_domain": envelope, "claims": claims, "reply_domain": domain_of(c("reply_to"))})
    rows = rows.withColumns({f"{name}_aligned": _of_sender(c(name)) for name in ("envelope_domain", "claims", "reply_domain", "message_domain")})
    claimed = F.coalesce(*(F.get(F.filter(F.split(one(h), r"[\s,;\[\]()<>]+"), is_address), F.lit(0)) for h in ORIGINATING))
    below = F.slice("chain", F.greatest("trusted", F.lit(0)) + 1, F.greatest(F.size("chain"), F.lit(1)))
    handed = mail.org_domain(F.when(c("trusted") > 0, F.get("chain", c("trusted") - 1))["from_host"])
    rows = rows.withColumns({"claimed_ip": claimed, "handed": handed, "below": F.array_distinct(F.array_compact(F.transform(below, lambda h: mail.org_domain(F.coalesce(h["from_host"], h["by_host"])))))})
    rows = rows.withColumn("alien", let(c("handed"), lambda own: F.sort_array(F.filter("below", lambda o: F.coalesce(o != own, F.lit(True))))))
    rows = rows.withColumns({"dated": one("date"), "received_at": F.get(F.array_compact(F.transform("received", lambda v: sent_at(F.substring_index(v, ";", -1)))), F.lit(0))})
    rows = rows.withColumn("date", sent_at(c("dated"))).withColumn("hours", F.abs(F.unix_seconds("received_at") - F.unix_seconds("date")) / 3600)
    undated = noted(c("dated").isNotNull() & ~c("dated").rlike(r"\d{1,2} [A-Za-z]{3} \d{4}"), "no date in the Date header")
    return rows.withColumn("notes", F.concat("twice", undated))


def _of_sender(host: Column) -> Column:
    """mail.aligned with from_domain, whose organisation is worked out once a message."""
    return F.coalesce((F.lower(host) == F.lower("from_domain")) | (mail.org_domain(host) == F.col("from_org")), F.lit(False))


def _rules() -> list[tuple[str, str, Column, Column]]:
    """(key, severity, condition, detail) of each finding, in the order in which findings of one severity stand."""
    c = F.col
    of, said = c("from_domain"), F.concat_ws
    known, signed, checked = of.isNotNull(), F.size("signed") > 0, c("used.dkim").isNotNull()
    planted = F.filter(F.slice("auth", 2, F.greatest(F.size("auth"), F.lit(1))), lambda r: ~r["trusted"])
    untrusted = c("top").isNotNull() & ~F.coalesce(c("top.trusted"), F.lit(True))
    failed = checked & (c("used.dkim") != "pass")
    claims, reply, hours = c("claims"), c("reply_domain"), c("hours")
    alien = c("origin_ip").isNotNull() & (F.size("alien") > 0)
    own_alien = F.coalesce(F.array_contains("alien", c("from_org")), F.lit(False))
    return [
        ("auth_untrusted", "high", untrusted, said(" ", F.lit("results are signed by"), c("top.server"), F.lit("outside of the trusted chain, where anyone may write them"))),
        ("auth_self_asserted", "low", ~untrusted & (F.size(planted) > 0), said(" ", F.lit("below the receiver's own results stand some by"), F.array_join(F.transform(planted, lambda r: r["server"]), ", "))),
        ("auth_not_checked", "info", F.size("auth") == 0, F.lit("no results of SPF, DKIM or DMARC are recorded, which is no failure")),
        ("dkim_fail", "medium", known & signed & c("signer").isNotNull() & failed, said(" ", F.lit("the sender's own signature was checked with the result"), c("used.dkim"))),
        ("dkim_aligned", "info", known & signed & c("signer").isNotNull() & ~F.coalesce(failed, F.lit(False)), said(" ", F.lit("signed by"), c("signer"), F.lit("of the sender's organisation"))),
        ("dkim_unaligned", "high", known & signed & c("signer").isNull(), said(" ", F.lit("signed by"), F.element_at("signed", 1), F.lit("while the sender is"), of)),
        ("spf_aligned", "info", known & c("envelope_domain").isNotNull() & c("envelope_domain_aligned"), said(" ", F.lit("bounces go to"), c("envelope_domain"), F.lit("of the sender's organisation"))),
        ("spf_unaligned", "medium", known & c("envelope_domain").isNotNull() & ~c("envelope_domain_aligned"), said(" ", F.lit("bounces go to"), c("envelope_domain"), F.lit("while the sender is"), of)),
        ("dmarc_fail", "high", c("used.dmarc").isNotNull() & ~c("used.dmarc").isin(DMARC_FINE), said(" ", F.lit("the receiver recorded dmarc ="), c("used.dmarc"))),
        ("compauth_fail", "medium", c("used.compauth").isNotNull() & (c("used.compauth") != "pass"), said(" ", F.lit("the receiver recorded compauth ="), c("used.compauth"))),
        ("origin_established", "info", c("origin_ip").isNotNull(), said(" ", c("origin_ip"), F.lit("handed the message to the trusted chain"))),
        ("origin_unproven", "info", c("origin_ip").isNull(), F.lit("the chain doesn't show where the message came from")),
        ("chain_claims_another_origin", "high", alien & known & own_alien, said(" ", F.lit("hops that the sender may have written claim"), F.array_join(F.slice("alien", 1, 4), ", "))),
        ("chain_below_boundary", "low", alien & ~(known & own_alien), said(" ", F.lit("hops below the trusted chain name"), F.array_join(F.slice("alien", 1, 4), ", "))),
        ("originating_ip_disagrees", "low", c("claimed_ip") != c("origin_ip"), said(" ", F.lit("a header claims"), c("claimed_ip"), F.lit("where the chain saw"), c("origin_ip"))),
        ("reply_to_mismatch", "medium", c("reply_to").isNotNull() & known & ~c("reply_domain_aligned"), said(" ", F.lit("replies go to"), reply, F.lit("while the sender is"), of)),
        ("display_name_spoof", "medium", known & (claims != "") & ~c("claims_aligned"), said(" ", F.lit("the name reads as an address at"), claims, F.lit("while the sender is"), c("from_addr"))),
        ("message_id_mismatch", "low", c("message_domain").isNotNull() & known & ~c("message_domain_aligned"), said(" ", F.lit("the message's id is of"), c("message_domain"))),
        ("date_skew", "low", hours > 24, said(" ", F.lit("date and receipt are"), F.round(hours).cast("long"), F.lit("hours apart"))),
    ]


def mail_findings(messages: DataFrame, key: list[str], blob: str) -> DataFrame:
    """key and findings, array(struct(severity, key, detail)) of each header block, the worst first.

    Each note on how the block was read is a finding parse_note. A condition that isn't known doesn't hold. A null or empty
    block has origin_unproven and auth_not_checked: nothing read isn't nothing wrong.
    """
    none = F.array().cast("array<struct<severity:string,key:string,detail:string>>")
    found = lambda severity, name, detail: F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("key"), detail.alias("detail"))
    made = {s: [F.when(F.coalesce(cond, F.lit(False)), F.array(found(s, name, detail))).otherwise(none) for name, severity, cond, detail in _rules() if severity == s] for s in SEVERITIES}
    made["low"].append(F.transform(F.sort_array("notes"), lambda n: found("low", "parse_note", n)))
    return parse_mail(messages, key, blob).select(*key, F.concat(*(x for s in SEVERITIES for x in made[s])).alias("findings"))
