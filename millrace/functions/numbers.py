"""Arithmetic, sizes and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import _col

# Size units, each 1024 of the one before.
SIZE_UNITS = ("kb", "mb", "gb", "tb")


def add(a, b) -> Column:
    return _col(a) + _col(b)


def sub(a, b) -> Column:
    return _col(a) - _col(b)


def div(a, b) -> Column:
    """Integer division, cut toward zero."""
    return F.call_function("div", _col(a), _col(b))


def mul(a, b) -> Column:
    return _col(a) * _col(b)


def mod(a, b) -> Column:
    return _col(a) % _col(b)


def maximum(a, b) -> Column:
    return F.greatest(_col(a), _col(b))


def _at_most(value: Column, digits: int) -> Column:
    text = F.format_number(value, digits)
    return F.regexp_replace(text, r"\.?0+$", "") if digits > 0 else text


def display_bytes(c: Column | str) -> Column:
    """A size in the largest unit that fits, with at most two decimals."""
    size = _col(c)
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SIZE_UNITS, start=1):
        scaled = _at_most(size / F.lit(float(1024 ** power)), 2)
        out = F.when(size >= 1024 ** power, F.concat(scaled, F.lit(" " + unit))).otherwise(out)
    return out


def parse_bytes(c: Column | str) -> Column:
    """``10k``, ``10kb``, ``1m``, ``1gb`` ... as a number of bytes; anything else is null."""
    text = F.lower(F.trim(_col(c)))
    pattern = r"^([+-]?[0-9]+)([kmg]b?)?$"
    number = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    unit = F.substring(F.regexp_extract(text, pattern, 2), 1, 1)
    factor = (F.when(unit == "k", F.lit(1024)).when(unit == "m", F.lit(1024 ** 2))
              .when(unit == "g", F.lit(1024 ** 3)).otherwise(F.lit(1)))
    return number * factor.cast("bigint")


def format_percent(c: Column | str, digits: int) -> Column:
    """A share as percent with at most ``digits`` decimals."""
    return F.concat(_at_most(_col(c) * 100, digits), F.lit("%"))


def celsius(c: Column | str) -> Column:
    """Whole degrees Celsius of whole degrees Fahrenheit; half up, then cut toward zero."""
    return ((_col(c) - 32) * 5.0 / 9.0 + F.lit(0.5).cast("double")).cast("int")


def folded(c: Column | str, base: Column, fn) -> Column:
    """Fold an array from the left."""
    return F.aggregate(_col(c), base, fn)


def folded_from_first(c: Column | str, fn) -> Column:
    """Fold an array from its first element; an empty array is an error."""
    arr = _col(c)
    rest = F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0)))
    return (F.when(F.size(arr) == 0, F.raise_error(F.lit("cannot fold an empty array without a base")))
            .otherwise(F.aggregate(rest, F.get(arr, F.lit(0)), fn)))
