"""Scores, bands and verdicts as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trust in each collector, prior of each entity type, and relations that corroborate.
COLLECTOR_TRUST = {
    "dns_resolve": 0.9, "dns_email_auth": 0.85, "rdap_domain": 0.85, "rdap_ip": 0.8, "asn_cymru": 0.9, "ip_geo": 0.7, "tls_cert": 0.9, "crtsh": 0.8, "http_probe": 0.75, "tech_fingerprint": 0.7,
    "html_links": 0.65, "security_txt": 0.85, "email_split": 0.95, "email_profile": 0.95, "people_lake": 0.85, "gravatar": 0.7, "github_user": 0.85, "github_commits": 0.8, "username_presence": 0.45,
    "wayback_cdx": 0.7, "ddg_search": 0.35, "public_records_portals": 0.5, "county_records": 0.45, "court_records": 0.35, "wifi_maps": 0.4, "sex_offender_registry": 0.55, "animal_registry": 0.55,
    "inmate_locator": 0.5, "obituary_search": 0.45, "hibp_breach": 0.95, "edgar_search": 0.55, "opencorporates": 0.5, "lookalike_domains": 0.75, "ip_reputation": 0.85, "domain_reputation": 0.85,
    "ransomware_exposure": 0.9, "ct_lake": 0.9, "mac_oui": 0.9, "faa_registry": 0.85, "urlscan_io": 0.7, "internetdb": 0.65, "phone_validate": 0.9, "crypto_screen": 0.9, "wikidata": 0.7,
    "cve_lookup": 0.9, "malware_infra": 0.85, "sslbl_cert": 0.9,
}
TYPE_PRIOR = {
    "domain": 0.5, "ip": 0.55, "email": 0.5, "url": 0.4, "username": 0.4, "org": 0.45, "person": 0.35, "cert": 0.6, "asn": 0.7, "repo": 0.65, "technology": 0.5, "breach": 0.85, "nameserver": 0.6,
    "registrar": 0.6, "mac": 0.6, "location": 0.5, "vulnerability": 0.75, "malware": 0.7, "phone": 0.55, "crypto_address": 0.5,
}
STRONG_RELATIONS = "resolves_to has_ns has_mx registered_by issued_for uses_email exposed_in security_contact owns member_of same_as lookalike_of subdomain_of".split()
# Weights of phone report categories.
PHONE_WEIGHTS = {"scam": 2.0, "spam": 1.0, "robocall": 1.0, "telemarketing": 1.0, "debt": 1.0, "political": 0.5, "survey": 0.5, "other": 0.5, "not_spam": -1.0}
UNKNOWN_TRUST, NO_TRUST, UNKNOWN_PRIOR = 0.55, 0.4, 0.45


def of_table(values: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def clamp(x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def banded(x: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut (highest first) that x reaches."""
    out = F.lit(rest)
    for least, name in reversed(cuts):
        out = F.when(x >= least, name).otherwise(out)
    return out


def confidence_band(score: Column) -> Column:
    return banded(score, [(0.85, "high"), (0.6, "medium"), (0.35, "low")], "speculative")


def exploit_band(score: Column) -> Column:
    return F.when(score.isNotNull(), banded(score, [(0.5, "high"), (0.1, "elevated"), (0.01, "low")], "very low"))


def noisy_or(weight: Column) -> Column:
    """Aggregate: 1 - product of (1 - weight), at most .99; 0 for no rows."""
    return F.least(F.lit(0.99), 1 - F.coalesce(F.product(1 - weight), F.lit(1.0)))


def listing_verdict(combined: Column, listed: Column, checked: Column) -> Column:
    """unknown if nothing was checked, clean if nothing deciding is listed, else by thresholds .75 and any."""
    return F.when(listed > 0, F.when(combined >= 0.75, "malicious").otherwise("suspicious")).when(checked > 0, "clean").otherwise("unknown")


def phone_verdict(reporters: Column, spam: Column, legit: Column) -> Column:
    """From the number of reporters and the weights for and against."""
    share = F.when(spam + legit > 0, spam / (spam + legit)).otherwise(0.0)
    score = spam - legit
    return (
        F.when(reporters == 0, "unknown").when(reporters == 1, "unconfirmed").when((spam > 0) & (legit > 0) & share.between(0.3, 0.7), "disputed")
        .when((score >= 5) & (share > 0.7), "likely_spam").when((score <= -3) & (share < 0.3), "likely_legit").otherwise("mixed")
    )


def entity_score(c: dict[str, Column]) -> Column:
    """The weighted sum over an entity's factors, before verification.

    c: base (0 or null counts as missing), type, max_trust, mean_trust (null without collectors),
    n_collectors, n_evidence, strong, degree, same_as, is_seed, and the flags lookalike, breached,
    avatar, only_presence, disputed, verified (true, false or null).
    """
    prior = of_table(TYPE_PRIOR, c["type"], UNKNOWN_PRIOR)
    base = F.when(F.coalesce(c["base"], F.lit(0.0)) == 0, prior).otherwise(c["base"])
    more = lambda cap, rate, n: F.least(F.lit(cap), rate * n)
    flag = lambda x, by: F.when(x, by).otherwise(0.0)
    few = c["n_collectors"] <= 1
    total = (
        0.35 * base + 0.15 * prior + 0.20 * F.coalesce(c["max_trust"], F.lit(NO_TRUST)) + 0.10 * F.coalesce(c["mean_trust"], F.lit(NO_TRUST))
        + more(0.15, 0.04, F.greatest(F.lit(0), c["n_collectors"] - 1)) + more(0.10, 0.02, c["n_evidence"]) + more(0.12, 0.025, c["strong"]) + more(0.06, 0.008, c["degree"]) + more(0.08, 0.04, c["same_as"])
        + flag(c["is_seed"], 0.12) + flag(c["lookalike"], 0.08) + flag(c["breached"], 0.10) + flag(c["avatar"], 0.05)
        - flag((c["n_collectors"] == 0) & ~c["is_seed"] & (c["degree"] <= 1), 0.12) - flag((c["type"] == "username") & few & c["only_presence"], 0.15)
        - flag(c["type"].isin("url", "person") & few & ~c["is_seed"], 0.08) - flag(c["disputed"], 0.20)
    )
    return F.when(c["verified"], 0.97).when(~c["verified"], 0.05).otherwise(clamp(total))


def triage(malicious: Column, injected: Column, answered: Column, bad_role: Column, p: Column, blocked: Column) -> Column:
    """Order matters: listings and injection first, then answers, then probability (.465 and .115; null counts as .5)."""
    chance = F.coalesce(p, F.lit(0.5))
    return F.when(malicious | injected, "escalate").when(~answered, "needs_analyst").when(bad_role | (chance >= 0.465), "escalate").when(blocked | (chance > 0.115), "needs_analyst").otherwise("suggest_close")


def worst_disposition(disposition: Column) -> Column:
    """Aggregate: the worst one; no rows need an analyst."""
    worst = F.max(F.when(disposition == "escalate", 3).when(disposition == "needs_analyst", 2).when(disposition == "suggest_close", 1))
    return F.when(worst == 3, "escalate").when(worst == 1, "suggest_close").otherwise("needs_analyst")
