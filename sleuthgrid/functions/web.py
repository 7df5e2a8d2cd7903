"""Column builders for traffic, hosts and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings and names that mark automation, and paths that only scanners ask for.
BOT_MARKERS = "bot/|bot;|bot)|bot |+bot|-bot|_bot|crawler|crawl;|spider|slurp|scrapy|headless|python-requests|python-urllib|aiohttp|httpx/|okhttp|curl/|wget/|go-http-client|java/|libwww-perl|guzzle|facebookexternalhit|embedly|preview|monitoring|uptime|censys|masscan|zgrab|nuclei|nmap|internet-measurement".split("|")
BOT_NAMES = "googlebot bingbot yandexbot duckduckbot baiduspider ahrefsbot semrushbot mj12bot dotbot petalbot applebot gptbot ccbot claudebot bytespider amazonbot".split()
PROBE_MARKERS = "/wp-includes/ /wp-admin /wp-content/ /wordpress /xmlrpc.php /.env /.git/ /phpmyadmin /vendor/phpunit /administrator/ /cgi-bin/ /shell /config.json /.aws/".split()
# Query parameters that only track.
TRACKING_KEYS = "fbclid gclid mc_cid mc_eid ref source at_medium at_campaign _hsenc _hsmi".split()
STATIC_SUFFIXES = "css js png jpg jpeg gif svg ico woff woff2 ttf map webp".split()


def any_of(words: list[str]) -> str:
    """A pattern that finds any of the words as a substring."""
    return "|".join(re.escape(w) for w in words)


def is_bot(user_agent: Column) -> Column:
    """A missing or blank user agent counts as automation."""
    agent = F.lower(F.trim(F.coalesce(user_agent, F.lit(""))))
    return (agent == "") | agent.rlike(any_of(BOT_NAMES + BOT_MARKERS))


def is_probe(path: Column) -> Column:
    return F.lower(F.coalesce(path, F.lit(""))).rlike(any_of(PROBE_MARKERS))


def is_human(user_agent: Column, path: Column) -> Column:
    return ~is_bot(user_agent) & ~is_probe(path)


def is_static(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike(r"^[^?#]*\.(" + "|".join(STATIC_SUFFIXES) + r")([?#]|$)")


def host_of(url: Column) -> Column:
    """The host in lower case, without user or port; null when there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host.contains("."), host)


def reverse_labels(host: Column) -> Column:
    """com.example.www: subtrees of a domain become ranges of a prefix."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def parents(host: Column) -> Column:
    """The host and each parent domain, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, no slash at the end; other parameters keep their order."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    origin = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~_tracks(p))
    return F.concat(origin, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _tracks(parameter: Column) -> Column:
    key = F.lower(F.substring_index(parameter, "=", 1))
    return key.isin(TRACKING_KEYS) | key.startswith("utm_")


def visitor_key(salt: Column, address: Column, user_agent: Column) -> Column:
    """Sixteen hex digits of a salted hash; a salt that changes daily keeps visitors apart across days."""
    raw = F.concat(salt, F.lit("|"), F.trim(F.coalesce(address, F.lit(""))), F.lit("|"), F.substring(F.coalesce(user_agent, F.lit("")), 1, 200))
    return F.substring(F.sha2(raw, 256), 1, 16)


# Paths that the service asks of itself.
SELF_PATHS = "/health /favicon /static/ /robots.txt /sitemap".split()


def scan_reason(path: Column, user_agent: Column) -> Column:
    """Why a request counts as scanning: probe_path before bot_ua; null for others and for the service's own paths."""
    own = F.lower(F.coalesce(path, F.lit(""))).rlike(any_of(SELF_PATHS))
    return F.when(own, None).when(is_probe(path), "probe_path").when(is_bot(user_agent), "bot_ua")
