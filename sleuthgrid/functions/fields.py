"""Small fields: identifiers, hosts, kinds of notes, labels, redaction, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of identifiers (the whole text, letter case aside), in the order in which they are tried.
IDENTIFIERS = {
    "cve": r"(?i)^\s*CVE[-\s]?(\d{4})[-\s]?(\d{4,7})\s*$",
    "cwe": r"(?i)^\s*CWE[-\s]?(\d{1,4})\s*$",
    "capec": r"(?i)^\s*CAPEC[-\s]?(\d{1,4})\s*$",
    "attack": r"(?i)^\s*T(\d{4})(?:\.(\d{3}))?\s*$",
    "rfc": r"(?i)^\s*RFC[-\s]?0*(\d{1,5})\s*$",
    "d3fend": r"(?i)^\s*D3[-\s]?([A-Z]{2,8})\s*$",
}
# What a run's note is about, in the order in which the kinds are tried.
NOTE_KINDS = {
    "limit": r"(?i)job wall-clock|max_entities|stopping early|cap reached|truncat",
    "not_configured": r"(?i)skipped \(no |not loaded|never synced|no [A-Z_]*API_KEY|run `\w+ |not configured|no key\b",
    "source_failed": r"(?i)\berror\b|unavailable|unreachable|timeout|timed out|SERVFAIL|refused|HTTP [45]\d\d|could not|failed",
}
# Names of fields that are never shown, and what stands in their place.
SECRET_HINTS = ["password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "auth", "cookie", "session", "credential", "private_key"]
REDACTED = "[redacted]"
DETAIL_MAX = 4000
PARCEL_NUMBER = r"(?i)\b(?:apn|parcel(?:\s*(?:id|no|number|#))?|pin)\b\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9\-./]{2,})"
EMAIL_WHOLE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def identifier(text: Column) -> Column:
    """struct(kind, canonical) of a text that is an identifier as a whole; nulls for free text."""
    get = lambda kind, i: F.regexp_extract(text, IDENTIFIERS[kind], i)
    number = lambda kind: get(kind, 1).cast("int").cast("string")
    forms = {
        "cve": F.concat(F.lit("CVE-"), get("cve", 1), F.lit("-"), get("cve", 2)), "cwe": F.concat(F.lit("CWE-"), number("cwe")), "capec": F.concat(F.lit("CAPEC-"), number("capec")),
        "attack": F.concat(F.lit("T"), get("attack", 1), F.when(get("attack", 2) != "", F.concat(F.lit("."), get("attack", 2))).otherwise("")), "rfc": F.concat(F.lit("RFC"), number("rfc")), "d3fend": F.concat(F.lit("D3-"), F.upper(get("d3fend", 1))),
    }
    pick = lambda of: reduce(lambda rest, k: F.when(text.rlike(IDENTIFIERS[k]), of(k)).otherwise(rest), reversed(list(IDENTIFIERS)), F.lit(None).cast("string"))
    return F.struct(pick(F.lit).alias("kind"), pick(lambda k: forms[k]).alias("canonical"))


def bare_host(raw: Column) -> Column:
    """A host without scheme, path, query, port, brackets and dot at its end, in lower case; null if nothing is left."""
    h = F.rtrim(F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit("."))
    h = F.regexp_replace(h, r"(?s)^.*?://", "")
    h = F.regexp_replace(F.regexp_replace(h, r"(?s)/.*$", ""), r"(?s)\?.*$", "")
    h = F.when(h.rlike(r"^[^:]*:\d+$") & F.contains(h, F.lit(".")), F.substring_index(h, ":", 1)).otherwise(h)
    h = F.when(h.rlike(r"^\[[^\]]*\]"), F.regexp_extract(h, r"^\[([^\]]*)\]", 1)).otherwise(h)
    return F.nullif(h, F.lit(""))


def note_kind(note: Column) -> Column:
    """limit, not_configured, source_failed, or else result: the first that fits."""
    return reduce(lambda rest, k: F.when(note.rlike(NOTE_KINDS[k]), F.lit(k)).otherwise(rest), reversed(list(NOTE_KINDS)), F.lit("result"))


def is_email(text: Column) -> Column:
    return F.trim(text).rlike(EMAIL_WHOLE)


def first_and_last(norm: Column) -> Column:
    """struct(first, last) of a canonical name; a single token is both, an empty name two empty ones."""
    tokens = F.split(F.coalesce(norm, F.lit("")), " ")
    return F.struct(F.element_at(tokens, 1).alias("first"), F.element_at(tokens, -1).alias("last"))


def parcel_number(detail: Column) -> Column:
    """The first parcel number that a text names."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(detail, F.lit("")), PARCEL_NUMBER, 1), F.lit(" .,;")), F.lit(""))


def place_label(city: Column, region: Column, country: Column) -> Column:
    """City, region unless named as the city, and country; unknown without any."""
    known = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(", ", known(city), F.when(~city.eqNullSafe(region), known(region)), known(country)), F.lit("")), F.lit("unknown"))


def redact(detail: Column) -> Column:
    """A map without the values of the keys that look like secrets."""
    secret = lambda k: reduce(lambda a, b: a | b, [F.contains(F.lower(k), F.lit(h)) for h in SECRET_HINTS])
    return F.transform_values(detail, lambda k, v: F.when(secret(k), F.lit(REDACTED)).otherwise(v))


def shorten(text: Column, most: int = DETAIL_MAX) -> Column:
    """The text, or its beginning and how much was cut off."""
    over = F.length(text) - most
    return F.when(over > 0, F.concat(F.substring(text, 1, most), F.lit("…[+"), over, F.lit(" chars]"))).otherwise(text)


def event_print(kind: Column, key: Column) -> Column:
    """32 digits that name an event: its kind and its key, letter case and white space aside."""
    norm = F.regexp_replace(F.lower(F.trim(F.coalesce(key, F.lit("")))), r"\s+", " ")
    return F.substring(F.sha2(F.concat(kind, F.lit("|"), norm), 256), 1, 32)


def reads_as_names(values: Column) -> Column:
    """Whether sampled values read as names: at most half of those with content begin with a digit, and half of them at least, one in any case, have two letters together."""
    usable = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != "")
    digits, wordy = (F.size(F.filter(usable, lambda v: v.rlike(p))) for p in (r"^\d", "[A-Za-z]{2,}"))  # noqa: B023
    return (F.size(usable) > 0) & (digits * 2 <= F.size(usable)) & (wordy >= F.greatest(F.lit(1), F.floor(F.size(usable) / 2)))


def pick_field(names: Column, wanted: list[str], avoid: list[str] = ()) -> Column:
    """The first field that holds a wanted word and none to avoid, the wanted words in their order; empty if there is none."""
    def fits(word: str, name: Column) -> Column:
        out = F.contains(F.lower(name), F.lit(word))
        for bad in avoid:
            out = out & ~F.contains(F.lower(name), F.lit(bad))
        return out

    first = [F.try_element_at(F.filter(names, lambda n: fits(w, n)), F.lit(1)) for w in wanted]  # noqa: B023
    return F.coalesce(*first, F.lit(""))


def playbook(types: Column) -> Column:
    """The plan that a set of seed types calls for."""
    has = lambda t: F.array_contains(types, t)
    only = lambda t: (F.size(types) > 0) & F.forall(types, lambda x: x == t)
    return (F.when(only("crypto_address"), "crypto_screen").when(only("phone"), "phone_reputation").when(has("person") | (has("username") & has("domain")), "person_footprint")
            .when(has("domain") | has("url"), "domain_dossier").when(has("email"), "person_footprint").otherwise("custom"))


def seed_apex(kind: Column, value: Column, free_mail: list[str]) -> Column:
    """The last two labels of a seed's domain, or of its mail domain unless that is a free one; null for other kinds."""
    domain = F.lower(F.when(kind == "email", F.substring_index(value, "@", -1)).otherwise(value))
    labels = F.split(domain, r"\.")
    apex = F.when(F.size(labels) > 1, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1)))
    mail = (kind == "email") & F.contains(value, F.lit("@")) & ~domain.isin(free_mail) & ~F.coalesce(apex, domain).isin(free_mail)
    return F.when((kind == "domain") & (value != ""), F.coalesce(apex, domain)).when(mail, apex)


def listing(verdict: Column, sources: Column, lake: Column, platform: Column) -> Column:
    """struct(verdict, sources): hits in the lake make it malicious, unless the host is a platform that strangers upload to."""
    seen = F.coalesce(verdict, F.lit("unknown"))
    own = F.when(seen != "clean", F.coalesce(sources, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    bad = (F.size(F.coalesce(lake, F.array().cast("array<string>"))) > 0) & (F.coalesce(platform, F.lit("")) == "")
    return F.struct(F.when(bad, "malicious").otherwise(seen).alias("verdict"), F.when(bad, F.concat(own, F.array_except(lake, own))).otherwise(own).alias("sources"))


def evidence_confidence(listed: Column, checked: Column, weight: Column) -> Column:
    """A listing's weight; one tenth where nothing was checked, a half where it was and nothing found."""
    return F.when(listed, weight).when(~checked, 0.1).otherwise(0.5)


def flag_names(letters: Column) -> Column:
    """The names of relay flags from their letters, in the order of the letters; unknown ones are left out."""
    from ..sources.feeds import RELAY_FLAGS

    names = F.create_map(*(F.lit(x) for name, letter in RELAY_FLAGS.items() for x in (letter, name)))
    return F.filter(F.transform(F.split(letters, ""), lambda c: names[c]), lambda n: n.isNotNull())


def iso(at: Column) -> Column:
    """A time as ISO 8601, with microseconds where it has any."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
