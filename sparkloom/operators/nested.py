"""Self-describing nested data as variants: typed reads, paths, updates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON text as a variant; null if it isn't JSON."""
    return F.try_parse_json(text)


def get(value: Column, path: str, kind: str) -> Column:
    """Value at a path such as ``$.a.b[0]`` as ``kind``; null if it is missing or of another kind that can't be widened to it."""
    return F.try_variant_get(value, path, kind)


def get_or_zero(value: Column, path: str, kind: str) -> Column:
    """The same, with the zero of its kind instead of null."""
    zero = F.lit("") if kind == "string" else F.lit(False) if kind == "boolean" else F.lit(0)
    return F.coalesce(get(value, path, kind), zero.cast(kind))


def get_any_case(fields: Column, name: str) -> Column:
    """Value of a map by exact name, else by the first name that is equal but for case."""
    exact = F.try_element_at(fields, F.lit(name))
    keys = F.filter(F.map_keys(fields), lambda k: F.lower(k) == name.lower())
    return F.coalesce(exact, F.try_element_at(fields, F.try_element_at(keys, F.lit(1))))


def put(fields: Column, name: str, value: Column) -> Column:
    """A map with ``name`` set: in its old place if it was there, else at the end."""
    there = F.map_contains_key(fields, F.lit(name))
    return F.when(there, F.transform_values(fields, lambda k, v: F.when(k == name, value).otherwise(v))).otherwise(F.map_concat(fields, F.create_map(F.lit(name), value)))


def quoted(text: Column) -> Column:
    """A name as it is written in text form: plain if it has only letters, digits and ``. _ + -``, else in quotes with ``"`` and ``\\`` escaped."""
    escaped = F.regexp_replace(text, r'(["\\])', r"\\$1")
    return F.when(text.rlike(r"^[A-Za-z0-9._+\-]+$"), text).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def literal_kind(text: Column) -> Column:
    """Kind that a literal of the text form has: by its suffix (``b s L f d``), as whole or real number, or as string."""
    whole = r"^[+-]?\d+"
    real = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    out = F.when(text.rlike(whole + r"[bB]$"), "byte").when(text.rlike(whole + r"[sS]$"), "short").when(text.rlike(whole + r"[lL]$"), "long")
    out = out.when(text.rlike(whole + r"$"), "int").when(text.rlike(real + r"[fF]$"), "float").when(text.rlike(real + r"[dD]?$"), "double")
    return out.otherwise("string")
