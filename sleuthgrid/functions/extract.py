r"""Seeds in free text: entities of all kinds with a confidence each, and flags of what a text asks for. Built-in expressions alone.

Each pass finds the matches of one kind. Of matches with one type and canonical value the most confident one counts, of equally
confident ones that of the earlier pass. Patterns are bounded or can't begin again within a match, so that a long
text takes linear time: names, labels and words of more than a bound's characters aren't matched as a whole.
Links, IP addresses and phone numbers have their edges written out, as what `\b` makes of letters beyond ASCII depends on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import canonical_value, chain_address
from .nested import let
from .phones import phone
from .text import IPV4, ascii_edges

# Confidences, words and hosts that decide what counts as what.
FREE_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com"]
NO_SEED_DOMAINS = [*FREE_DOMAINS, "icloud.com", "proton.me", "protonmail.com"]
PLATFORM_HOSTS = ["github.com/", "linkedin.com/", "twitter.com/", "x.com/", "instagram.com/", "reddit.com/"]
PLATFORM_NAMES = {"gh": "github", "ig": "instagram", "li": "linkedin", "x": "twitter", "yt": "youtube"}
SITE_PAGES = {"github": ["settings", "orgs", "marketplace", "topics", "about", "login"], "twitter": ["intent", "share", "home", "i", "search"]}
SUFFIXES = r"Inc\.?|LLC|Ltd\.?|Limited|GmbH|AG|PLC|S\.A\.|SA|N\.V\.|NV|Corp\.?|Corporation|Co\.|Holdings|Group|SAS|Pty|B\.V\.|BV|Oy|AB"
NO_PERSONS = ["Certificate Transparency", "Team Cymru", "Have I", "Duck Duck", "United States", "New York", "Los Angeles", "San Francisco", "San Diego", "Internet Archive", "Open Corporates", "Cloud Flare"]
NO_FIRST_NAMES = ["the", "this", "that", "with", "from", "check", "need", "also", "domain", "email", "please", "using", "about"]
NO_NAMES = [
    "check", "find", "search", "look", "please", "help", "what", "who", "where", "why", "how", "the", "this", "that", "show", "tell", "give", "run", "scan", "investigate", "analyze", "analyse", "lookup", "test", "hello", "hi", "info",
    "information", "everything", "anything", "something", "all", "list", "me", "my", "about", "for", "of", "is", "it",
]
ORG_WORDS = [
    "inc", "inc.", "llc", "l.l.c.", "ltd", "ltd.", "limited", "corp", "corp.", "corporation", "co", "co.", "company", "plc", "gmbh", "ag", "sa", "nv", "bv", "pty", "llp", "lp", "holdings", "group", "partners", "ventures",
    "capital", "labs", "technologies", "technology", "systems", "solutions", "services", "industries", "foundation", "institute", "university", "college", "hospital", "bank", "insurance", "media", "studios", "games",
    "software", "security", "networks", "telecom", "energy", "motors", "&",
]
#: Words of a text that is a name as a whole.
NAME_WORDS = 3
FLAGS = {
    "want_lookalikes": r"(?iU)\b(lookalike|typosquat|typo-?squat|brand.?abuse|phishing.?domain|similar.?domain|domain.?watch|squatt)\w*\b",
    "want_breaches": r"(?iU)\b(breach|breached|pwned|have.?i.?been|hibp|leaked?|leak|compromised|credential|stuffed|infostealer|stealer)\w*\b",
    "want_corp_records": r"(?iU)\b(edgar|sec\.gov|corporation|llc|inc\b|company.?record|opencorporate|wikidata|filing|trademark)\w*\b",
    "aggressive_username_probe": r"(?iU)\b(username.?probe|sherlock|everywhere|all.?platforms|social.?presence|handle.?check)\b",
    "want_web_search": r"(?iU)\b(google|search.?web|web.?search|ddg|duckduckgo)\b",
    "want_wayback": r"(?iU)\b(wayback|archive\.org|historical.?site|old.?website)\b",
}

EMAIL = r"(?i)(?<![a-z0-9._%+-])[.%+-]*+([a-z0-9_][a-z0-9._%+-]*+@[a-z0-9.-]{1,253}\.[a-z]{2,63})(?![a-z0-9_])"
MAC = r"(?<![0-9A-Za-z:.-])(?:[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{4}(?:\.[0-9A-Fa-f]{4}){2})(?![0-9A-Za-z:.-])"
TAIL = r"(?<![A-Za-z0-9._@-])[Nn]-?\d(?:-?[A-Za-z0-9]){0,4}(?![A-Za-z0-9._@-])"
PHONE = r"(?<![\w\p{L}\p{M}+.-])(?:\+?1[\s.-]?)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[\s.-]?[2-9]\d{2}[\s.-]?\d{4}(?![\w\p{L}\p{M}-])"
COMPANY = r"(?U)\b((?:[A-Z][\w&.'-]{0,60}\s{1,20}){0,3}[A-Z][\w&.'-]{0,60})\s{1,20}(?:" + SUFFIXES + r")(?!\w)"
PLATFORM = r"(?i)\b(github|gh|twitter|x|instagram|ig|reddit|linkedin|li|tiktok|youtube|yt)\s{0,20}[:@]\s{0,20}@?([A-Za-z0-9._-]{2,40})(?![A-Za-z0-9_])"
SHORT_GITHUB = r"(?i)\b(?:gh|github)(?:\s|[:@]){1,20}([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}[A-Za-z0-9])?)\b"
LINK = r"(?i)(?<![a-z0-9_])(?:https?://)?(?:www\.)?[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?){1,126}(?:/\S*)?"
PROFILES = {
    "github": (r"(?i)github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}[A-Za-z0-9])?)", 0.95), "linkedin": (r"(?i)linkedin\.com/in/([A-Za-z0-9_%-]+)", 0.95), "twitter": (r"(?i)(?:twitter|x)\.com/([A-Za-z0-9_]{1,15})", 0.9),
    "instagram": (r"(?i)instagram\.com/([A-Za-z0-9_.]+)", 0.9), "reddit": (r"(?i)reddit\.com/u(?:ser)?/([A-Za-z0-9_-]+)", 0.9),
}
AT_HANDLE = r"(?<![A-Za-z0-9._%+-])@([A-Za-z0-9_]{2,30})(?![A-Za-z0-9_])"
ORG_HINT = r"(?i)\b(?:company|org|organization|employer|corp(?:oration)?)\s{0,20}[:-]?\s{1,20}([A-Z][\w&.'-]{1,60}(?:\s{1,20}[A-Z][\w&.'-]{1,60}){0,4})"
PERSON = r"(?U)\b([A-Z][a-z]{1,20})\s++([A-Z][a-z]{1,20})(?:\s++([A-Z][a-z]{1,20}))?\b"
NAMED_PERSON = r"(?i)\b(?:person|name|decedent)\s{0,20}:\s{0,20}([A-Z][a-z]{1,60}(?:\s{1,20}[A-Z][a-z'.-]{1,60}){1,4})\b"
WALLET = r"[A-Za-z0-9][A-Za-z0-9._:-]{15,90}"


def _hit(kind: str, value: Column, confidence: float, span: Column, notes: Column | str | None = None) -> Column:
    note = notes if isinstance(notes, Column) else F.lit(notes).cast("string")
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(confidence).alias("confidence"), F.substring(span, 1, 120).alias("span"), note.alias("notes"))


def plausible_domain(name: Column) -> Column:
    """Whether a dotted name may be a domain: two labels, none of them hyphened at an end, not all digits, an ending of two letters; not that of an open mail provider."""
    d = F.rtrim(F.lower(name), F.lit("."))
    return ~d.isin(FREE_DOMAINS) & d.rlike(r"^[^.]+(\.[^.]+)*\.[^.]{2,}$") & ~d.rlike(r"(^|\.)-|-(\.|$)") & ~d.rlike(r"^[0-9.]+$")


def _found(text: Column, pattern: str, hit: Callable[[Column], Column], group: int = 0) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), hit)


def _profile(platform: str, pattern: str, confidence: float) -> Callable[[Column], Column]:
    def hit(s: Column) -> Column:
        name = F.regexp_extract(s, pattern, 1)
        return _hit("username", F.when(~F.lower(name).isin(SITE_PAGES.get(platform, [""])), F.concat(F.lit(platform + ":"), name)), confidence, s)

    return hit


def _passes(text: Column) -> dict[str, Column]:
    """Arrays of hits by pass, in the passes' order, the values as they are written."""
    at = lambda s: F.lower(F.substring_index(s, "@", -1))
    one = lambda pattern: lambda s: F.regexp_extract(s, pattern, 1)
    weak = lambda s: F.when(plausible_domain(at(s)) & ~at(s).isin(NO_SEED_DOMAINS), at(s))
    out = {
        "email": _found(text, EMAIL, lambda s: _hit("email", s, 0.95, s), 1), "email_domain": _found(text, EMAIL, lambda s: _hit("domain", weak(s), 0.75, at(s), "from email"), 1), "ip": _found(text, ascii_edges(IPV4), lambda s: _hit("ip", s, 0.9, s)),
        "mac": _found(text, MAC, lambda s: _hit("mac", s, 0.95, s)), "aircraft": _found(text, TAIL, lambda s: _hit("aircraft", s, 0.9, s)), "phone": _found(text, PHONE, lambda s: _hit("phone", phone(s)["e164"], 0.92, phone(s)["e164"])),
        "company": _found(text, COMPANY, lambda s: _hit("org", s, 0.8, s)),
    }
    for platform, (pattern, confidence) in PROFILES.items():
        out[platform] = _found(text, pattern, _profile(platform, pattern, confidence))
        if platform == "github":
            out["short_github"] = _found(text, SHORT_GITHUB, lambda s: _hit("username", F.concat(F.lit("github:"), one(SHORT_GITHUB)(s)), 0.9, s))
    short = F.create_map(*(F.lit(x) for pair in PLATFORM_NAMES.items() for x in pair))
    named = lambda s: F.lower(F.regexp_extract(s, PLATFORM, 1))
    out["platform"] = _found(text, PLATFORM, lambda s: _hit("username", F.concat(F.coalesce(F.try_element_at(short, named(s)), named(s)), F.lit(":"), F.regexp_extract(s, PLATFORM, 2)), 0.88, s))
    link = lambda s: F.rtrim(s, F.lit(".,);]"))
    http = lambda s: F.lower(link(s)).rlike("^https?://")
    taken = lambda s: (s.contains("@") & ~s.startswith("http")) | F.lower(s).rlike("|".join(h.replace(".", r"\.") for h in PLATFORM_HOSTS))
    whole = lambda s: ~taken(link(s)) & (http(s) | F.substring_index(link(s), "://", -1).contains("/"))
    host = lambda s: F.regexp_extract(link(s), "(?i)^(?:https?://)?([^/:]*)", 1)
    bare = lambda s: F.when(~taken(link(s)) & plausible_domain(host(s)), host(s))
    full = lambda s: F.when(whole(s), F.when(link(s).contains("://"), link(s)).otherwise(F.concat(F.lit("https://"), link(s))))
    out["url"] = _found(text, LINK, lambda s: _hit("url", full(s), 0.85, s))
    out["url_domain"] = _found(text, LINK, lambda s: _hit("domain", F.when(whole(s), bare(s)), 0.9, host(s)))
    out["domain"] = _found(text, LINK, lambda s: _hit("domain", F.when(~whole(s), bare(s)), 0.92, s))
    out["handle"] = _found(text, AT_HANDLE, lambda s: _hit("username", F.concat(F.lit("unknown:"), F.substring(s, 2, 40)), 0.55, s, "bare @handle"))
    out["org_hint"] = _found(text, ORG_HINT, lambda s: _hit("org", one(ORG_HINT)(s), 0.7, s))
    name = lambda s: F.regexp_replace(s, r"(?U)\s+", " ")
    guess = lambda s: F.when(~name(s).isin(NO_PERSONS) & ~F.lower(F.substring_index(name(s), " ", 1)).isin(NO_FIRST_NAMES), name(s))
    out["person"] = _found(text, PERSON, lambda s: _hit("person", guess(s), 0.6, s, "capitalized name guess"))
    out["named_person"] = _found(text, NAMED_PERSON, lambda s: _hit("person", one(NAMED_PERSON)(s), 0.9, s, "explicit person: prefix"))
    wallet = lambda s: chain_address(s)
    out["wallet"] = _found(text, WALLET, lambda s: _hit("crypto_address", F.concat(wallet(s)["chain"], F.lit(":"), wallet(s)["address"]), 0.93, s, F.concat(F.lit("chain="), wallet(s)["chain"])))
    return out


def _canonical(hits: Column) -> Column:
    fields = ["confidence", "span", "notes"]
    known = F.transform(hits, lambda h: F.struct(h["type"].alias("type"), canonical_value(h["type"], h["value"]).alias("value"), *(h[f].alias(f) for f in fields)))
    return F.filter(known, lambda h: h["value"].isNotNull())


def _best(hits: Column) -> Column:
    """Of each type and value the most confident hit, of equal ones the first."""
    order = F.array_sort(F.transform(hits, lambda h, i: F.struct(h["type"], h["value"], (-h["confidence"]).alias("c"), i.alias("i"), h.alias("hit"))))
    first = let(order, lambda s: F.filter(s, lambda h, i: (i == 0) | ~F.coalesce((F.get(s, i - 1)["hit"]["type"] == h["hit"]["type"]) & (F.get(s, i - 1)["hit"]["value"] == h["hit"]["value"]), F.lit(False))))
    return F.transform(first, lambda h: h["hit"])


def _whole_name(text: Column, org_words: Collection[str]) -> Column:
    """The text as a name, if it is one to three words that make a name."""
    trimmed = F.regexp_replace(F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")), r"[^A-Za-z0-9&.'\- ]", "")
    plain = F.btrim(trimmed)
    words = F.filter(F.split(plain, " +"), lambda w: w != "")
    fits = plain.rlike("[A-Za-z]") & ~F.exists(words, lambda w: F.lower(w).isin(NO_NAMES))
    person = F.size(words).between(2, NAME_WORDS) & ~F.exists(words, lambda w: F.btrim(F.lower(w), F.lit(".,")).isin(list(org_words))) & F.forall(words, lambda w: F.regexp_replace(w, "['.-]", "").rlike("^[A-Za-z]+$"))
    hit = F.when(person, _hit("person", plain, 0.6, plain, "name-shaped text, declare a basis to use it")).otherwise(_hit("org", plain, 0.55, plain, "assumed from a bare name, uncheck if wrong"))
    few = text.rlike(rf"(?U)\A\s*+(?:\S++(?:\s++|\z)){{1,{NAME_WORDS}}}\z")  # a long text is read no further than its first words
    none = F.filter(F.array(_hit("org", F.lit(""), 0.55, F.lit(""))), lambda _: F.lit(False))
    return F.when(few, F.filter(F.array(hit), lambda _: fits)).otherwise(none)


def hits(text: Column, passes: Collection[str] | None = None, org_words: Collection[str] = ORG_WORDS) -> Column:
    """array(struct(type, value, confidence, span, notes)) of a text, by type and value; a text of a few words without any is a name. None for null.

    passes: those to take, by their names in `_passes`; all by default. org_words: words that make a whole text's name one of an organisation.
    """
    text = F.coalesce(text, F.lit(""))
    known = _passes(text)
    if passes is not None and not (passes and set(passes) <= set(known)):
        raise ValueError(f"passes are some of {', '.join(known)}")
    found = _best(_canonical(F.concat(*(some for name, some in known.items() if passes is None or name in passes))))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(_canonical(_whole_name(text, org_words))))


def seeds(text: Column, passes: Collection[str] | None = None, org_words: Collection[str] = ORG_WORDS) -> Column:
    """hits with `include`, whether to go on from one without asking; included ones first, then by confidence, type and value."""
    unsure = lambda h: ((h["type"] == "person") & (h["confidence"] < 0.8)) | ((h["type"] == "username") & h["value"].startswith("unknown:") & (h["confidence"] < 0.7))
    marked = F.transform(hits(text, passes, org_words), lambda h: F.struct((F.when((h["confidence"] >= 0.55) & ~unsure(h), 0).otherwise(1)).alias("out"), (-h["confidence"]).alias("c"), h["type"], h["value"], h.alias("hit")))
    return F.transform(F.array_sort(marked), lambda m: F.struct(m["hit"]["type"].alias("type"), m["hit"]["value"].alias("value"), F.round(m["hit"]["confidence"], 2).alias("confidence"), m["hit"]["span"].alias("span"), (m["out"] == 0).alias("include"), m["hit"]["notes"].alias("notes")))


def flags(text: Column) -> Column:
    """struct of booleans: what a text asks for by its words."""
    return F.struct(*(F.coalesce(text.rlike(pattern), F.lit(False)).alias(name) for name, pattern in FLAGS.items()))


# The same five kinds as engines read them whose classes, edges and white space are ASCII's. A long s and a Kelvin sign are s and k without case.
# Phones and persons have no characters beyond ASCII beside them. What must follow is looked for first, so that most words are left at once;
# a loop over labels is possessive, as nothing after it can fail.
ASCII_BLANK = r"[\t\n\f\r ]"
ASCII_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[.%+-]*+([A-Za-z0-9_][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
_LABEL = r"[A-Za-z0-9\u017F\u212A](?:[A-Za-z0-9\u017F\u212A-]{0,61}[A-Za-z0-9\u017F\u212A])?"
_SCHEME = r"(?:[Hh][Tt][Tt][Pp][Ss\u017F]?://)?"
ASCII_LINK = rf"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9_])(?=[\u017F\u212A]))(?={_SCHEME}[A-Za-z0-9\u017F\u212A-]{{1,63}}+\.){_SCHEME}(?:[Ww]{{3}}\.)?{_LABEL}(?:\.{_LABEL})++(?:/[^\t\n\f\r ]*+)?"
ASCII_PHONE = rf"(?=[+1(2-9])(?<![A-Za-z0-9_\x80-\x{{10FFFF}}+.-])(?:\+?1(?:{ASCII_BLANK}|[.-]|--)?)?(?:\([2-9]\d{{2}}\)|[2-9]\d{{2}})(?:{ASCII_BLANK}|[.-])?[2-9]\d{{2}}(?:{ASCII_BLANK}|[.-])?\d{{4}}(?![A-Za-z0-9_\x80-\x{{10FFFF}}-])"
ASCII_PERSON = rf"(?=[A-Z])(?<![A-Za-z0-9_\x80-\x{{10FFFF}}])[A-Z][a-z]{{1,20}}{ASCII_BLANK}++[A-Z][a-z]{{1,20}}(?:{ASCII_BLANK}++[A-Z][a-z]{{1,20}})?(?![A-Za-z0-9_\x80-\x{{10FFFF}}])"


def ascii_hits(text: Column, no_persons: Collection[str] = NO_PERSONS) -> Column:
    """array(struct(type, value, confidence)) of the emails, addresses, domains, phone numbers and guessed persons in a text by ASCII's rules, each once. Domains keep a www. before them."""
    every = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    emails = F.when(text.contains("@"), F.transform(every(ASCII_EMAIL, 1), lambda m: F.lower(m)))
    kept = lambda values: F.array_distinct(F.filter(values, lambda v: v.isNotNull()))
    hit = lambda kind, values, confidence: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(confidence).alias("confidence")))
    host = lambda m: F.when(~m.contains("/") & ~m.rlike(r"^[0-9.]+$") & m.rlike(r"\.[^.]{2,}$") & ~F.lower(m).isin(FREE_DOMAINS), F.lower(m))
    name = lambda m: let(F.regexp_replace(m, ASCII_BLANK + "+", " "), lambda n: F.when(~n.isin(list(no_persons)) & ~F.lower(F.substring_index(n, " ", 1)).isin(NO_FIRST_NAMES), F.lower(n)))
    found = {
        "email": (0.95, F.coalesce(emails, F.array().cast("array<string>"))), "ip": (0.9, every("(?=[0-9])" + ascii_edges(IPV4))), "domain": (0.92, F.transform(every(ASCII_LINK), host)),
        "phone": (0.92, F.transform(every(ASCII_PHONE), lambda m: phone(m)["e164"])), "person": (0.6, F.transform(every(ASCII_PERSON), name)),
    }
    return F.concat(*(hit(kind, kept(values), confidence) for kind, (confidence, values) in found.items()))


def ascii_whole_name(text: Column, no_names: Collection[str] = NO_NAMES) -> Column:
    """array(struct(type, value, confidence)) of a text of one to three words by ASCII's rules: a person or an organisation; empty for other texts. What is left out between words leaves its blanks."""
    few = text.rlike(rf"\A{ASCII_BLANK}*+(?:[^\t\n\f\r ]++(?:{ASCII_BLANK}++|\z)){{1,{NAME_WORDS}}}\z")
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, ASCII_BLANK + "+", " "), r"[^A-Za-z0-9&.'\- ]", ""))

    def hit(v: Column) -> Column:
        words = F.filter(F.split(v, " +"), lambda w: w != "")
        person = F.size(words).between(2, NAME_WORDS) & F.forall(words, lambda w: F.regexp_replace(w, "['.-]", "").rlike("^[A-Za-z]+$"))
        found = F.struct(F.when(person, "person").otherwise("org").alias("type"), F.lower(v).alias("value"), F.when(person, 0.6).otherwise(0.55).alias("confidence"))
        return F.when(v.rlike("[A-Za-z]") & ~F.exists(words, lambda w: F.lower(w).isin(list(no_names))), F.array(found)).otherwise(F.array().cast("array<struct<type:string,value:string,confidence:double>>"))

    return F.when(few, let(plain, hit)).otherwise(F.array().cast("array<struct<type:string,value:string,confidence:double>>"))
