"""Entities, tokens and templates in text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
URL = r"https?://[^\s<>\"']+"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"


def ascii_edges(pattern: str) -> str:
    r"""A pattern of words with the `\b` at its ends written out for ASCII letters, digits and _, as SQL engines have it: before Java 19 letters of all alphabets make words."""
    head, tail = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    return "(?<![A-Za-z0-9_])" * head + pattern.removeprefix(r"\b").removesuffix(r"\b") + "(?![A-Za-z0-9_])" * tail


def found(text: Column, pattern: str) -> Column:
    """The distinct matches, sorted; none for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ascii_edges(pattern)})"), 1)))


def emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found(text, EMAIL), F.lower)))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits, three characters at least."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{3,})"), 1))


def template(note: Column) -> Column:
    """Addresses, URLs and numbers replaced by placeholders, so that like notes group."""
    out = F.regexp_replace(note, URL, "<url>")
    out = F.regexp_replace(out, EMAIL, "<email>")
    return F.regexp_replace(out, "[0-9]+(?:\\.[0-9]+)*", "<n>")


def mac_canonical(raw: Column) -> Column:
    """Upper-case colon pairs of 12 or 6 hex digits, whatever the separators; else null."""
    digits = F.upper(F.regexp_replace(raw, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(digits).isin(6, 12) & raw.rlike("^[0-9A-Fa-f:. -]+$"), F.regexp_replace(digits, "(..)(?!$)", "$1:"))


def mac_is_local(mac: Column) -> Column:
    """Whether the locally administered bit is set."""
    return F.shiftright(F.conv(F.substring(mac, 1, 2), 16, 10).cast("int"), 1).bitwiseAND(1) == 1


def lookalikes(label: Column, tld: Column) -> Column:
    """Names that resemble label.tld: a letter left out, doubled, or swapped with the next, and other endings."""
    at = F.sequence(F.lit(1), F.length(label))
    piece = lambda lo, hi: F.substring(label, lo, hi)
    omit = F.transform(at, lambda i: F.concat(piece(F.lit(1), i - 1), piece(i + 1, F.length(label))))
    double = F.transform(at, lambda i: F.concat(piece(F.lit(1), i), piece(i, F.length(label))))
    swap = F.transform(F.filter(at, lambda i: i < F.length(label)), lambda i: F.concat(piece(F.lit(1), i - 1), piece(i + 1, F.lit(1)), piece(i, F.lit(1)), piece(i + 2, F.length(label))))
    made = F.transform(F.concat(omit, double, swap), lambda x: F.concat(x, F.lit("."), tld))
    other = F.transform(F.array(*(F.lit(t) for t in ("com", "net", "org", "co", "io"))), lambda t: F.concat(label, F.lit("."), t))
    return F.array_sort(F.array_distinct(F.filter(F.concat(made, other), lambda x: (x != F.concat(label, F.lit("."), tld)) & ~x.startswith("."))))
