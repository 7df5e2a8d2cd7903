"""Mail headers: the chain of servers that a message passed, how far it can be trusted, and where it came from.

All of it is built from expressions. A header block is read as it stands: folded lines joined, names
compared without case. Nulls, empty texts and texts without headers have an empty chain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nested import let
from .network import is_address, is_routable

# Domains between which one provider routes, and suffixes under which organisations register.
FAMILIES = {
    "outlook.com": "microsoft365", "office365.com": "microsoft365", "microsoft.com": "microsoft365", "google.com": "google", "googlemail.com": "google", "gmail.com": "google", "amazonses.com": "amazon-ses",
    "amazonaws.com": "amazon-ses", "pphosted.com": "proofpoint", "proofpoint.com": "proofpoint", "mimecast.com": "mimecast", "messagelabs.com": "broadcom-cloud", "barracudanetworks.com": "barracuda",
    "protonmail.ch": "proton", "proton.me": "proton", "icloud.com": "apple", "me.com": "apple", "apple.com": "apple", "zoho.com": "zoho", "fastmail.com": "fastmail", "messagingengine.com": "fastmail",
}
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk net.uk co.jp ne.jp or.jp ac.jp com.au net.au org.au edu.au gov.au co.nz com.br com.mx com.ar co.za co.in com.sg com.tr com.cn com.hk com.tw "
    "github.io gitlab.io herokuapp.com herokudns.com azurewebsites.net cloudapp.net trafficmanager.net web.app firebaseapp.com appspot.com run.app pages.dev workers.dev r2.dev amazonaws.com elasticbeanstalk.com "
    "cloudfront.net netlify.app vercel.app onrender.com fly.dev githubusercontent.com blogspot.com wordpress.com myshopify.com squarespace.com wixsite.com weebly.com zendesk.com freshdesk.com atlassian.net "
    "sharepoint.com s3.amazonaws.com blob.core.windows.net core.windows.net"
).split()
HOSTNAME = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}\.?"


def org_domain(host: Column) -> Column:
    """The organisation's domain by the suffixes held here; operators.records.suffixes does it by a whole list."""

    def of(name: Column) -> Column:
        last = lambda k: F.substring_index(name, ".", -k)
        return F.when((last(3) != name) & last(3).isin(SUFFIXES), last(4)).when((last(2) != name) & last(2).isin(SUFFIXES), last(3)).when(name.contains("."), last(2))

    bare = let(F.lower(F.trim(host)), lambda t: F.when(t.endswith("."), F.rtrim(t, F.lit("."))).otherwise(t))
    return F.when(host.contains(".") & ~host.contains(":"), let(bare, of))


def family(host: Column) -> Column:
    """The provider whose domain it is, else the organisation's domain."""
    table = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    return let(org_domain(host), lambda o: F.coalesce(F.try_element_at(table, o), o))


def aligned(claim: Column, other: Column) -> Column:
    """Whether two hosts belong to one organisation; false when either isn't known."""
    same = (F.lower(claim) == F.lower(other)) | (org_domain(claim) == org_domain(other))
    return F.coalesce(same, F.lit(False))


def lines(blob: Column) -> Column:
    """The header block as a text of lines that end in \\n, folded ones joined."""
    whole = F.ltrim(F.replace(F.replace(F.coalesce(blob, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\n"))
    return F.regexp_replace(F.substring_index(whole, "\n\n", 1), "[ \t]*+\n[ \t]++", " ")


def names(block: Column) -> Column:
    """The names of the headers in lines(blob), in order, in lower case."""
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?dm)^([!-9;-~]+[ \t]*):"), F.lit(1)), lambda n: F.lower(F.trim(n)))


def values(block: Column) -> Column:
    """The values of the headers in lines(blob), in order."""
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?dm)^[!-9;-~]+[ \t]*:(.*)$"), F.lit(1)), lambda v: F.trim(v))


def headers(blob: Column) -> Column:
    """array<struct(name, value)> of the header block, in order, names in lower case."""
    return let(lines(blob), lambda t: F.zip_with(names(t), values(t), lambda n, v: F.struct(n.alias("name"), v.alias("value"))))


def header(fields: Column, name: str) -> Column:
    """The first value of a header; null when there is none."""
    return F.get(fields["value"], (F.array_position(fields["name"], name) - 1).cast("int"))


def address_domain(value: Column) -> Column:
    """The domain of the address in a header such as From."""
    return F.nullif(F.lower(F.regexp_extract(value, "@([A-Za-z0-9.-]*[A-Za-z0-9])[ \t]*>?[ \t]*$", 1)), F.lit(""))


def tag(value: Column, name: str) -> Column:
    """tags(value)[name], without the others."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), ";"), lambda p: p.contains("=") & (F.lower(F.trim(F.substring_index(p, "=", 1))) == name))
    return let(F.get(parts, F.lit(0)), lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))))


def tags(value: Column) -> Column:
    """map of the tags (k=v; …) of a signature, names in lower case; the first of repeated ones counts."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), ";"), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("key"), F.trim(F.regexp_extract(p, "^[^=]*=(?s)(.*)$", 1)).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["key"] == n), 1)))


def _address_in(text: Column) -> Column:
    """The first IPv4 or IPv6 address in a text. Only words of digits, dots and colons are looked at closer."""
    edge = r"[^\s,;\[\]()<>'\"]"
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<!{edge})(?:ipv6:)?([0-9a-f.:]++(?:%{edge}*+)?)(?!{edge})"), F.lit(1))
    return F.get(F.filter(words, is_address), F.lit(0))


def hop(value: Column) -> Column:
    """A Received value as struct(from_host, from_ip, by_host, protocol).

    Clause words inside brackets don't count, so blanks inside them are hidden, from the innermost
    brackets outwards; brackets four deep and more count as text.
    """
    closed = lambda t: t.contains(")") | t.contains("]")
    hide = lambda t: F.regexp_replace(F.regexp_replace(t, r"[ \t]+(?=[^()\[\]]*[)\]])", "\u0001"), r"[(\[]([^()\[\]]*)[)\]]", "\u0002$1\u0003")
    hidden = F.regexp_replace(F.substring(value, 1, 4000), r";[^;]*$", "")
    for _ in range(3):
        hidden = let(hidden, lambda t: F.when(closed(t), hide(t)).otherwise(t))
    clause = lambda text, word: F.regexp_extract(text, rf"(?i)[ \t]{word}[ \t]+(.*?)(?=[ \t](?:from|by|with|id|for|via|using)[ \t]|$)", 1)
    shown = lambda text: F.translate(text, "\u0001\u0002\u0003", " ()")
    host = lambda text: F.nullif(F.rtrim(F.lower(F.regexp_extract(text, rf"^({HOSTNAME})(?=[\s\u0002]|$)", 1)), F.lit(".")), F.lit(""))
    clauses = let(F.concat(F.lit(" "), hidden), lambda t: F.struct(*(clause(t, word).alias(word) for word in ("from", "by", "with"))))
    # what is hidden and the clauses are worked out once each
    return let(clauses, lambda c: F.struct(host(c["from"]).alias("from_host"), _address_in(shown(c["from"])).alias("from_ip"), host(c["by"]).alias("by_host"), F.nullif(F.trim(F.regexp_extract(shown(c["with"]), r"^[^(]*", 0)), F.lit("")).alias("protocol")))


def hops(fields: Column) -> Column:
    """The chain of a message, newest first: an array of hop structs."""
    return F.transform(F.filter(fields, lambda h: h["name"] == "received"), lambda h: hop(h["value"]))


def trusted_families(families: Column) -> Column:
    """trusted_hops of a chain whose servers are of these families."""

    def count(begin: Column) -> Column:
        other = F.filter(F.sequence(begin, F.size(families).cast("long")), lambda i: F.coalesce(F.get(families, (i - 1).cast("int")) != F.get(families, (begin - 1).cast("int")), F.lit(True)))
        return F.when(begin == 0, 0).otherwise(F.coalesce(F.get(other, F.lit(0)) - 1, F.size(families).cast("long"))).cast("int")

    return let(F.array_position(F.transform(families, lambda f: f.isNotNull()), True), count)


def trusted_hops(chain: Column) -> Column:
    """How many hops from the top can be trusted: up to the last one, from the first that names its server, of that server's family."""
    return let(F.transform(chain, lambda h: family(h["by_host"])), trusted_families)


def origin(chain: Column, trusted: Column) -> Column:
    """The outside address that handed the message to the last trusted hop; null if none is named or it is internal."""
    address = F.try_element_at(chain, F.when(trusted > 0, trusted).otherwise(F.lit(None).cast("int")))["from_ip"]
    return let(address, lambda a: F.when(is_routable(a), a))
