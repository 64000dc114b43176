"""Typed reads of config texts. ``present`` tells a missing key from one with a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.functions.text import _col


def _or_default(value: Column, text: Column, default, strict: bool, kind: str) -> Column:
    if default is not None:
        missing = F.lit(default)
    elif strict:
        missing = F.raise_error(F.lit("missing required key"))
    else:
        missing = F.lit(None)
    bad = F.raise_error(F.concat(F.lit(f"not a {kind}: "), text)) if strict else F.lit(None)
    return F.when(text.isNull(), missing).when(value.isNotNull(), value).otherwise(bad)


def as_list(c: Column | str, separator: str = fixed.LIST_SEPARATOR) -> Column:
    """Items of a list text; blank or missing is no items, and empty items at the end do not count."""
    s = _col(c)
    kept = F.regexp_replace(s, f"(?:{separator})+$", "")
    none = F.array().cast("array<string>")
    return F.when(s.isNull() | (F.trim(s) == "") | (kept == ""), none).otherwise(F.split(kept, separator, -1))


def as_boolean(c: Column | str, default: bool | None = None, strict: bool = False) -> Column:
    s = _col(c)
    return _or_default(F.lower(F.trim(s)) == "true", s, default, strict, "boolean")


def as_long(c: Column | str, default: int | None = None, strict: bool = False) -> Column:
    s = _col(c)
    return _or_default(_whole(s).try_cast("bigint"), s, default, strict, "long").cast("bigint")


def as_int(c: Column | str, default: int | None = None, strict: bool = False) -> Column:
    s = _col(c)
    return _or_default(_whole(s).try_cast("int"), s, default, strict, "int").cast("int")


def as_double(c: Column | str, default: float | None = None, strict: bool = False) -> Column:
    s = _col(c)
    return _or_default(F.trim(s).try_cast("double"), s, default, strict, "double").cast("double")


def as_uri(c: Column | str, default: str | None = None, strict: bool = False) -> Column:
    """The text itself when it parses as a URI."""
    s = _col(c)
    ok = F.try_parse_url(s, F.lit("PATH")).isNotNull()
    return _or_default(F.when(ok, s), s, default, strict, "URI")


def _whole(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"^\s*([+-]?[0-9]+)\s*$", 1), F.lit(""))
