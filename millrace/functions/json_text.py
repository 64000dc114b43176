"""JSON documents as text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import _col


def to_strings(c: Column | str, shape: str = "map<string,string>") -> Column:
    """A JSON document with every scalar as text. ``shape`` tells how maps and lists nest."""
    return F.from_json(_col(c), shape)


def output_pairs(c: Column | str) -> Column:
    """A job's output document as key/value texts; missing, empty or bad is an empty map, not an error."""
    pairs = F.from_json(F.trim(_col(c)), "map<string,string>")
    return F.coalesce(pairs, F.create_map().cast("map<string,string>"))


def canonical(c: Column | str) -> Column:
    """A form that is the same text for equal documents: keys sorted, every scalar a text, lists in order.

    Null for what is no document, and for one that names a key twice. Numbers are equal by value (1.50 and 1.5).
    """
    compact = F.to_json(F.try_parse_json(_col(c)))
    return F.regexp_replace(compact, r"(?<=[:\[,]|^)(-?[0-9][0-9.eE+-]*|true|false)(?=[,}\]]|\z)", "\"$1\"")


def same_document(a: Column | str, b: Column | str) -> Column:
    """Whether two documents are equal, both missing included; null if one is there but is no document."""
    a, b = _col(a), _col(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(canonical(a) == canonical(b))
