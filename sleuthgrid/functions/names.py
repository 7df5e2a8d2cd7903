"""Personal names: a canonical form and the keys under which a name is found."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that are no part of a name, and short forms of given names.
SUFFIXES = "jr sr ii iii iv v md phd dds esq jd rn dvm do cpa mba".split()
SHORT_FORMS = {
    "robert": "bob rob bobby", "william": "bill will billy", "richard": "rick dick richie", "james": "jim jimmy", "john": "jack johnny", "joseph": "joe joey", "michael": "mike mikey",
    "charles": "charlie chuck", "thomas": "tom tommy", "christopher": "chris", "daniel": "dan danny", "matthew": "matt", "anthony": "tony", "edward": "ed eddie ted", "margaret": "peggy maggie",
    "elizabeth": "liz beth betty eliza", "katherine": "kate kathy katie", "catherine": "cathy kate", "patricia": "pat patty tricia", "jennifer": "jen jenny", "deborah": "deb debbie", "barbara": "barb babs",
    "susan": "sue susie", "rebecca": "becky becca", "theodore": "ted teddy", "andrew": "andy drew", "benjamin": "ben benny", "samuel": "sam sammy", "nicholas": "nick", "alexander": "alex sandy",
}
SURNAME = "~sn:"
#: What a matched key says about the match, strongest first.
STRENGTHS = ["exact", "partial", "weak", "surname"]


def _alternatives() -> dict[str, list[str]]:
    """Of each given name its other forms, both ways."""
    out: dict[str, set[str]] = {}
    for formal, short in SHORT_FORMS.items():
        for s in short.split():
            out.setdefault(formal, set()).add(s)
            out.setdefault(s, set()).add(formal)
    return {k: sorted(v) for k, v in out.items()}


def _folds() -> tuple[str, str]:
    """Accented Latin letters and the plain letter that each decomposes to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha() and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def canonical(name: Column) -> Column:
    """Lower-case letters, accents folded, `last, first` turned round, suffixes dropped; null gives the empty string."""
    plain = F.translate(F.coalesce(name, F.lit("")), *_folds())
    text = F.lower(F.regexp_replace(F.regexp_replace(plain, "['’]", " "), "[^A-Za-z, ]+", " "))
    head, tail = F.trim(F.substring_index(text, ",", 1)), F.regexp_extract(text, r"^[^,]*,(.*)$", 1)
    words = lambda c: F.filter(F.split(c, "[ ,]+"), lambda t: t != "")
    only_suffixes = (F.size(words(tail)) > 0) & F.forall(words(tail), lambda t: t.isin(SUFFIXES))
    turned = F.when(~text.contains(","), text).when(only_suffixes, head).otherwise(F.concat(tail, F.lit(" "), head))
    return F.array_join(F.filter(words(turned), lambda t: ~t.isin(SUFFIXES)), " ")


def name_keys(norm: Column) -> Column:
    """Distinct keys of a canonical name: itself, surname, and first names' other forms with the last name."""
    tokens = F.split(norm, " ")
    first, last = F.element_at(tokens, 1), F.element_at(tokens, -1)
    known = _alternatives()
    table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    variants = F.array_sort(F.array_union(F.array(first), F.coalesce(F.try_element_at(table, first), F.array().cast("array<string>"))))
    rest = F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), " ")
    each = F.transform(variants, lambda v: F.when(F.size(tokens) > 2, F.array(F.concat_ws(" ", v, last), F.concat_ws(" ", F.substring(v, 1, 1), last), F.concat_ws(" ", v, rest))).otherwise(F.array(F.concat_ws(" ", v, last), F.concat_ws(" ", F.substring(v, 1, 1), last))))
    full = F.array_distinct(F.concat(F.array(norm, F.concat(F.lit(SURNAME), last)), F.flatten(each)))
    return F.when(F.coalesce(norm, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(tokens) == 1, F.array(norm, F.concat(F.lit(SURNAME), norm))).otherwise(full)


def match_strength(query: Column, stored: Column) -> Column:
    """exact: all tokens in order; partial: first name (or another form) and last; weak: initial and last; surname: last alone; else null."""
    q, s = F.split(query, " "), F.split(stored, " ")
    table = F.create_map(*(x for k, v in _alternatives().items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    same_last = F.element_at(q, -1) == F.element_at(s, -1)
    q1, s1 = F.element_at(q, 1), F.element_at(s, 1)
    alike = (q1 == s1) | F.coalesce(F.array_contains(F.try_element_at(table, q1), s1), F.lit(False))
    return F.when(query == stored, "exact").when(same_last & alike, "partial").when(same_last & (F.substring(q1, 1, 1) == F.substring(s1, 1, 1)), "weak").when(same_last, "surname")
