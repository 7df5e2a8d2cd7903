"""Predicates and small verdicts as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What case names and notes begin with, and the bases that a case may have.
NAME_KINDS = {"sentinel": ["Scanned us:"], "reputation": ["Reputation:", "Phone:"]}
NOTE_KINDS = {"intent": ["ui-intent:", "intent:"]}
CASE_BASES = ["own_asset", "client_engagement", "public_cti", "training_lab", "other"]
# Numbers that get no reputation page, and the digits of a short code.
EMERGENCY = ["911", "999", "112", "000", "111", "119", "110", "115", "118", "122", "+1911", "+44999", "+112"]
SHORT_CODE = 6
# What a note may not hold, and its length.
NOTE_BANS = [
    (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+", "an email address"),
    (r"(?i)https?://|www\.", "a link"),
    (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "something shaped like an SSN"),
    (r"(?:\b\d{4}[-\s]?){3}\b\d{4}\b", "something shaped like a card number"),
    (r"(?i)\b\d{1,5}\s+[\p{L}\p{N}_]+(\s+[\p{L}\p{N}_]+)?\s+(street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd)\b", "a street address"),
]
NOTE_MAX = 280
# Return codes of a block list, what they mean and how much they weigh.
ZEN_CODES = {
    "127.0.0.2": ("SBL — direct spam source", 0.60),
    "127.0.0.3": ("SBL CSS — snowshoe spam infrastructure", 0.50),
    "127.0.0.4": ("XBL — compromised device, open proxy or worm", 0.60),
    "127.0.0.5": ("XBL — compromised device, open proxy or worm", 0.60),
    "127.0.0.6": ("XBL — compromised device, open proxy or worm", 0.60),
    "127.0.0.7": ("XBL — compromised device, open proxy or worm", 0.60),
    "127.0.0.9": ("SBL DROP — hijacked or leased-to-criminals netblock", 0.85),
    "127.0.0.10": ("PBL — end-user address, should not send mail directly", 0.0),
    "127.0.0.11": ("PBL — end-user address, should not send mail directly", 0.0),
}
UNKNOWN_CODE = 0.60
# Properties that show that an address was enriched before.
ENRICHED_KEYS = ["geo_country", "geo_city", "asn", "as_number", "asn_name", "rdap_name", "rdap_country", "cymru_asn", "cymru"]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def contains_text(column: Column, text: str) -> Column:
    """Whether text stands in the column, letter case aside; %, _ and \\ in it are themselves."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def case_filter(name: Column, note: Column, basis_of: Column, closed: Column, *, kind: str | None = None, basis: str | None = None, status: str | None = None, q: str | None = None) -> Column:
    """All of the asked conditions; a value that isn't known asks nothing."""
    kinds = {k: _any([name.startswith(x) for x in own]) for k, own in NAME_KINDS.items()} | {k: _any([F.coalesce(note, F.lit("")).startswith(x) for x in own]) for k, own in NOTE_KINDS.items()}
    kinds["other"] = ~_any(list(kinds.values()))
    asked = [F.lit(True)]
    if (kind or "").strip().lower() in kinds:
        asked.append(kinds[kind.strip().lower()])
    if (basis or "").strip() in CASE_BASES:
        asked.append(basis_of == basis.strip())
    if (status or "").strip().lower() in ("open", "closed"):
        asked.append(closed == (status.strip().lower() == "closed"))
    if (q or "").strip():
        asked.append(contains_text(name, q.strip()))
    return reduce(lambda a, b: a & b, asked)


def visible_to(owner: Column, asking: str | int | None, operator: bool = False) -> Column:
    """Whether a row is shown: an operator sees all, rows without an owner are operators' alone."""
    return F.lit(True) if operator else F.coalesce(owner == F.lit(asking), F.lit(False))


def muted(until: Column, now: Column) -> Column:
    return F.coalesce(until > now, F.lit(False))


def recordable(path: Column, method: Column, exact: list[str], prefixes: list[str]) -> Column:
    """Page views that are counted: GET and HEAD, outside the paths left out."""
    return F.upper(method).isin("GET", "HEAD") & ~path.isin(exact) & ~_any([path.startswith(p) for p in prefixes])


def enriched(props: Column, now: Column, days: int = 7) -> Column:
    """Whether an address has a passive stamp of the last `days` days, or any property of an earlier pass. props: map of strings."""
    stamp = F.try_to_timestamp(props["passive_enriched_at"])
    fresh = F.coalesce(now - F.make_dt_interval(F.lit(days)) < stamp, F.lit(False))
    return fresh | _any([~F.coalesce(props[k], F.lit("")).isin("", "[]", "{}") for k in ENRICHED_KEYS])


def blockable(host: Column, exact: list[str], suffixes: list[str]) -> Column:
    """Whether a host may go on a block list: a name of two labels or more that isn't left out; `*.` before it is allowed."""
    bare = F.regexp_replace(host, r"^\*\.", "")
    shaped = bare.rlike(r"^(?=.{1,253}$)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$")
    return shaped & ~host.isin(exact) & ~_any([host.endswith(s) for s in suffixes])


def mentions_product(query: Column, *fields: Column) -> Column:
    """Whether a vendor's or product's name and the query contain one another."""
    q = F.lower(F.trim(query))
    own = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    return _any([(f != "") & (F.contains(f, q) | F.contains(q, f)) for f in own])


def has_tokens(field: Column, name: str, least: int = 3) -> Column:
    """Whether every token of the name, of `least` letters or more, stands in the field, in any order; letters, digits, blanks, ' and - alone count."""
    import re

    clean = re.sub(r"-{2,}", "-", re.sub(r"[^A-Za-z0-9 '\-.&]", " ", name))
    tokens = [t for t in clean.split() if len(t) >= least]
    return reduce(lambda a, b: a & b, [F.contains(F.upper(field), F.lit(t.upper())) for t in tokens], F.lit(bool(tokens)))


def clean_note(note: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), r"\s+", " "))


def note_refusal(note: Column) -> Column:
    """What a note holds that it may not, the first of NOTE_BANS; null where it may stand."""
    text = clean_note(note)
    return reduce(lambda rest, ban: F.when(text.rlike(ban[0]), F.lit(ban[1])).otherwise(rest), reversed(NOTE_BANS), F.lit(None).cast("string"))


def kept_note(note: Column) -> Column:
    """The note as it is kept: white space made one blank, cut at NOTE_MAX; null where empty or refused."""
    text = clean_note(note)
    return F.when((text != "") & note_refusal(note).isNull(), F.substring(text, 1, NOTE_MAX))


def refused_number(raw: Column, e164: Column) -> Column:
    """Emergency numbers and short codes."""
    text = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "[ -]", "")
    digits, full = F.regexp_replace(text, r"\D", ""), F.coalesce(e164, F.lit(""))
    return text.isin(EMERGENCY) | full.isin(EMERGENCY) | digits.isin([x.lstrip("+") for x in EMERGENCY]) | (~full.startswith("+") & (F.length(digits) <= SHORT_CODE))


def zen(codes: Column) -> Column:
    """struct(label, weight, policy_only) of a list of return codes: the worst decides, unknown ones are named."""
    known = F.create_map(*(x for code, (label, weight) in ZEN_CODES.items() for x in (F.lit(code), F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight")))))
    meant = F.transform(codes, lambda c: F.coalesce(known[c], F.struct(F.concat(F.lit("unrecognised code "), c).alias("label"), F.lit(UNKNOWN_CODE).alias("weight"))))
    mine = F.filter(codes, lambda c: known[c].isNotNull())
    others = F.filter(codes, lambda c: known[c].isNull())
    labels = F.array_distinct(F.concat(F.transform(mine, lambda c: known[c]["label"]), F.transform(others, lambda c: F.concat(F.lit("unrecognised code "), c))))
    weight = F.coalesce(F.array_max(F.transform(meant, lambda m: m["weight"])), F.lit(0.0))
    policy = (F.size(codes) > 0) & F.forall(codes, lambda c: c.isin("127.0.0.10", "127.0.0.11"))
    return F.struct(F.when(F.size(labels) > 0, F.array_join(labels, "; ")).otherwise("listed").alias("label"), weight.alias("weight"), policy.alias("policy_only"))


def mass_on(probabilities: Column, options: list[str]) -> Column:
    """The probability that a map of options gives to some of them."""
    return F.aggregate(F.map_values(F.map_filter(probabilities, lambda k, _: k.isin(options))), F.lit(0.0), lambda a, p: a + p)
