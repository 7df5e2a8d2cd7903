"""Values of nested JSON, as built-in expressions over variants. No depth of nesting needs a join or Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels that are walked; what lies deeper is left out.
DEPTH = 30


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def parsed(text: Column) -> Column:
    """The variant of a text that is JSON as a whole, else null. The parser leaves what follows a first value unread; within brackets it doesn't."""
    items = as_array(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def as_object(v: Column) -> Column:
    """The members of a variant that is an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    """A leaf as text, null for JSON's null; numbers in their shortest form."""
    return F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def _walk(v: Column, into_arrays: bool, depth: int) -> Column:
    """The leaves (path, value) below a variant; objects by name, arrays under their own path."""

    def below(x: Column) -> Column:
        members = F.transform(F.map_entries(as_object(x["value"])), lambda e: F.struct(F.concat_ws(".", x["path"], e["key"]).alias("path"), e["value"].alias("value")))
        items = F.transform(as_array(x["value"]), lambda e: F.struct(x["path"].alias("path"), e.alias("value"))) if into_arrays else F.lit(None)
        return F.coalesce(members, items, F.array(x))

    start = F.array(F.struct(F.lit(None).cast("string").alias("path"), v.alias("value")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, lambda all_, _: F.flatten(F.transform(all_, below)))
    ended = lambda x: as_object(x["value"]).isNull() & (as_array(x["value"]).isNull() if into_arrays else F.lit(True))
    return F.filter(found, lambda x: x["value"].isNotNull() & ended(x))


def json_leaves(text: Column, depth: int = DEPTH) -> Column:
    """array(struct(path, value)) of the strings, numbers and booleans in a JSON text; null if it isn't valid. Names don't count as values."""
    v = parsed(text)
    leaves = F.transform(_walk(v, True, depth), lambda x: F.struct(x["path"].alias("path"), _text(x["value"]).alias("value")))
    return F.when(v.isNotNull(), F.filter(leaves, lambda x: x["value"].isNotNull()))


def json_values(text: Column, depth: int = DEPTH) -> Column:
    """struct(values, valid): the leaf values of a JSON text; of any other text, the text as it is. Null and empty have none."""
    values = F.transform(json_leaves(text, depth), lambda x: x["value"])
    plain = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return let(values, lambda v: F.struct(F.coalesce(v, plain).alias("values"), v.isNotNull().alias("valid")))


def _last_of_each(pairs: Column) -> Column:
    """A map of (path, value) pairs; of a repeated path the last one."""
    order = F.array_sort(F.transform(pairs, lambda x, i: F.struct(x["path"].alias("path"), i.alias("at"), x["value"].alias("value"))))
    last = let(order, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["path"] != x["path"], F.lit(True))))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["path"], x["value"])))


def flat_object(v: Column, depth: int = DEPTH) -> Column:
    """A map from dotted lower-case names to what a variant holds under them: of an array the first element, nothing for null and empty ones.

    v is a column, not the variable of a lambda function: aggregate() in another lambda function ends after two steps.
    """
    first = lambda x: F.coalesce(_text(F.get(as_array(x), F.lit(0))), F.when(as_array(x).isNull(), _text(x)))
    pairs = F.transform(_walk(v, False, depth), lambda x: F.struct(F.lower(x["path"]).alias("path"), first(x["value"]).alias("value")))
    return _last_of_each(F.filter(pairs, lambda x: x["path"].isNotNull() & (x["value"] != "")))


def json_records(text: Column) -> Column:
    """The objects in a text, as variants: one, an array, the hits of a search response, or one for each line. Never null."""
    whole = parsed(text)
    hits = F.try_variant_get(whole, "$.hits.hits", "array<variant>")
    source = F.transform(F.filter(hits, lambda h: as_object(h).isNotNull()), lambda h: F.coalesce(F.try_variant_get(h, "$._source", "variant"), h))
    lines = F.transform(F.split(text, "\r\n|\r|\n"), parsed)
    one = F.when(as_object(whole).isNotNull(), F.array(whole))
    found = F.coalesce(source, one, as_array(whole), F.when(whole.isNull(), lines), F.array(F.lit(None).cast("variant")))
    return F.filter(found, lambda v: as_object(v).isNotNull())
