"""Canonical values of entities: the keys under which observations of one thing meet. What isn't valid is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import mac_canonical

# Forms of addresses on chains, and the names by which a chain is asked for.
EVM, TRON = "^0x[0-9a-fA-F]{40}$", "^T[1-9A-HJ-NP-Za-km-z]{33}$"
BECH32, BASE58 = "(?i)^(bc1|tb1)[0-9a-z]{6,87}$", "^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$"
SOLANA = "^[1-9A-HJ-NP-Za-km-z]{32,44}$"
CHAIN_HINTS = {"eth": "eth ethereum arb optimism polygon evm", "bsc": "bsc", "btc": "btc bitcoin", "tron": "tron trx", "sol": "sol solana"}
# Mailboxes of functions, throwaway providers, providers open to all.
ROLES = "abuse admin administrator billing compliance contact dmarc help hello hostmaster info information legal mail marketing news newsletter noc noreply no-reply notifications office postmaster press privacy root sales security security-reports soc support sysadmin team webmaster welcome".split()
DISPOSABLE = "10minutemail.com 20minutemail.com 33mail.com dispostable.com fakeinbox.com getairmail.com getnada.com guerrillamail.com guerrillamail.net guerrillamail.org mailcatch.com maildrop.cc mailinator.com mailnesia.com mintemail.com mohmal.com sharklasers.com spam4.me temp-mail.org tempmail.com tempr.email throwawaymail.com trashmail.com yopmail.com".split()
FREE_MAIL = "gmail.com googlemail.com yahoo.com hotmail.com outlook.com live.com msn.com aol.com icloud.com me.com mac.com proton.me protonmail.com pm.me gmx.com gmx.net mail.com zoho.com yandex.com fastmail.com tutanota.com hey.com".split()


def known(text: Column) -> Column:
    """The trimmed text, null when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def chain_address(value: Column, hint: Column | None = None) -> Column:
    """struct(chain, address) of a wallet address; null if no form fits. A hint decides the chain; without one, Solana isn't guessed."""
    raw = known(value)
    asked = F.lower(F.trim(hint)) if hint is not None else F.lit(None).cast("string")
    means = lambda chain: F.coalesce(asked.isin(CHAIN_HINTS[chain].split()), F.lit(False))
    unasked = F.coalesce(asked, F.lit("")) == ""
    form = lambda chain, address: F.struct(F.lit(chain).alias("chain"), address.alias("address"))
    return (
        F.when(raw.rlike(EVM) & means("bsc"), form("bsc", F.lower(raw))).when(raw.rlike(EVM) & (means("eth") | unasked), form("eth", F.lower(raw)))
        .when(raw.rlike(TRON) & (means("tron") | unasked), form("tron", raw)).when(raw.rlike(BECH32) & (means("btc") | unasked), form("btc", F.lower(raw)))
        .when(raw.rlike(BASE58) & (means("btc") | unasked), form("btc", raw)).when(raw.rlike(SOLANA) & means("sol"), form("sol", raw))
    )


def tail_number(raw: Column) -> Column:
    """A US aircraft registration with its N, which a leading digit may lack."""
    text = F.upper(F.regexp_replace(raw, r"[\s-]", ""))
    full = F.when(text.rlike("^[0-9]"), F.concat(F.lit("N"), text)).otherwise(text)
    return F.when(full.rlike("^N[A-Z0-9]{1,5}$"), full)


def domain(value: Column) -> Column:
    """Lower case, without scheme, path, port, a www. before it or dots after it."""
    bare = F.regexp_replace(F.lower(known(value)), "^(http://)?(https://)?", "")
    host = F.rtrim(F.regexp_replace(F.regexp_extract(bare, "^[^/:]*", 0), r"^www\.", ""), F.lit("."))
    return F.when((host != "") & ~host.contains(" "), host)


def url_key(value: Column) -> Column:
    """Scheme and host in lower case with the path; no query, fragment or slash at the end. https where no scheme is given."""
    raw = known(value)
    full = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    origin, path = F.lower(F.regexp_extract(full, "^([^:]*://[^/?#]*)", 1)), F.regexp_extract(full, "^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.nullif(F.concat(origin, F.rtrim(path, F.lit("/"))), F.lit(""))


def handle(value: Column) -> Column:
    """platform:handle in lower case; unknown where no platform is named."""
    v = F.lower(known(value))
    platform = F.when(v.contains(":"), F.substring_index(v, ":", 1)).otherwise("unknown")
    name = F.when(v.contains(":"), F.regexp_extract(v, "^[^:]*:(.*)$", 1)).otherwise(v)
    return F.concat(platform, F.lit(":"), F.regexp_replace(name, "^@+", ""))


def _wallet(value: Column) -> Column:
    named = value.contains(":") & ~value.startswith("0x")
    found = F.when(named, chain_address(F.regexp_extract(value, "^[^:]*:(.*)$", 1), F.substring_index(value, ":", 1))).otherwise(chain_address(value))
    return F.coalesce(F.concat(found["chain"], F.lit(":"), found["address"]), value)


def canonical_value(kind: Column, value: Column) -> Column:
    """The canonical value of an entity of a kind; null for empty and invalid ones. Other kinds are trimmed."""
    v = known(value)
    letters = F.regexp_replace(F.lower(v), "[^a-z0-9]+", "")
    return (
        F.when(kind == "domain", domain(v)).when(kind == "email", F.lower(v)).when(kind == "ip", F.substring_index(v, "%", 1)).when(kind == "url", url_key(v)).when(kind == "username", handle(v))
        .when(kind == "asn", F.concat(F.lit("AS"), F.trim(F.replace(F.upper(v), F.lit("AS"), F.lit(""))))).when(kind == "malware", F.when(letters == "", F.lower(v)).otherwise(letters))
        .when(kind.isin("org", "person", "technology", "registrar", "location"), F.lower(F.trim(F.regexp_replace(v, r"\s+", " "))))
        .when(kind == "repo", F.btrim(F.regexp_replace(F.lower(v), "^https://github[.]com/", ""), F.lit("/"))).when(kind == "vulnerability", F.when(F.upper(v).rlike(r"^CVE-\d{4}-\d{4,}$"), F.upper(v)))
        .when(kind == "mac", mac_canonical(v)).when(kind == "aircraft", tail_number(v)).when(kind == "crypto_address", _wallet(v)).otherwise(v)
    )


def entity_key(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), canonical_value(kind, value))


def _mailbox(address: Column) -> tuple[Column, Column]:
    text = F.lower(F.trim(F.coalesce(address, F.lit(""))))
    whole = text.contains("@")
    return F.when(whole, F.trim(F.regexp_extract(text, "^(.*)@[^@]*$", 1))).otherwise(""), F.when(whole, F.trim(F.substring_index(text, "@", -1))).otherwise("")


def mailbox(address: Column) -> Column:
    """The address as its provider delivers it: no plus tag, and no dots at the one provider that ignores them."""
    local, at = _mailbox(address)
    host = F.when(at == "googlemail.com", "gmail.com").otherwise(at)
    base = F.substring_index(local, "+", 1)
    name = F.when(host == "gmail.com", F.replace(base, F.lit("."), F.lit(""))).otherwise(base)
    return F.when((local == "") | (at == ""), F.lower(F.trim(F.coalesce(address, F.lit(""))))).when(name == "", host).otherwise(F.concat(name, F.lit("@"), host))


def mail_class(address: Column) -> Column:
    """disposable, free_mail or other."""
    _, at = _mailbox(address)
    return F.when(at.isin(DISPOSABLE), "disposable").when(at.isin(FREE_MAIL), "free_mail").otherwise("other")


def is_role(address: Column) -> Column:
    """Whether the mailbox is that of a function; a plus tag doesn't matter."""
    return F.substring_index(_mailbox(address)[0], "+", 1).isin(ROLES)
