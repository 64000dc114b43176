"""Times, periods and run lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.functions.text import _col


def format_date(c: Column | str, pattern: str = fixed.PAGE_DATE_FORMAT) -> Column:
    return F.date_format(_col(c), pattern)


def format_time(c: Column | str) -> Column:
    return F.date_format(_col(c), fixed.PAGE_TIME_FORMAT)


def micros_between(a: Column | str, b: Column | str) -> Column:
    """Microseconds from a to b."""
    return F.timestamp_diff("MICROSECOND", _col(a), _col(b))


def minutes_between(a: Column | str, b: Column | str) -> Column:
    """Whole minutes from a to b."""
    return F.call_function("div", micros_between(a, b), F.lit(60_000_000))


def _counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))


def format_units(days: Column, hours: Column, minutes: Column) -> Column:
    """``2 days, 1 hour, 0 minutes``: zero days and hours are left out, minutes always shown."""
    return F.concat_ws(", ",
                       F.when(days != 0, _counted(days, "day")),
                       F.when(hours != 0, _counted(hours, "hour")),
                       _counted(minutes, "minute"))


def format_between(a: Column | str, b: Column | str) -> Column:
    """Run length from a to b in hours and minutes; hours do not turn into days."""
    minutes = minutes_between(a, b)
    hours = F.call_function("div", minutes, F.lit(60))
    return F.when(minutes.isNotNull(), format_units(F.lit(0), hours, minutes % 60))


def parse_period(c: Column | str, strict: bool = True) -> Column:
    """``3d``, ``2h``, ``10m``, ``5s`` as struct(n, unit); a text ending in ``n`` is null (no period).

    Any other text is an error, or null when not strict. The unit is kept: 25h is not 1d 1h.
    """
    s = _col(c)
    n = F.regexp_extract(s, r"^([+-]?[0-9]+)[dhms]$", 1).try_cast("int")
    bad = F.raise_error(F.concat(F.lit("invalid period: "), s)) if strict else F.lit(None)
    unit = F.substring(s, -1, 1)
    return (F.when(s.isNull() | s.endswith("n"), F.lit(None))
            .when(n.isNotNull(), F.struct(n.alias("n"), unit.alias("unit")))
            .otherwise(bad.cast("struct<n:int,unit:string>")))


def period_seconds(period: Column | str) -> Column:
    p = _col(period)
    unit = p.getField("unit")
    factor = (F.when(unit == "d", F.lit(86_400)).when(unit == "h", F.lit(3_600))
              .when(unit == "m", F.lit(60)).when(unit == "s", F.lit(1)))
    return p.getField("n").cast("bigint") * factor.cast("bigint")


def print_period(period: Column | str) -> Column:
    """The text of a period; ``n`` when there is none or it is not positive."""
    p = _col(period)
    return F.coalesce(F.when(p.getField("n") > 0, F.concat(p.getField("n").cast("string"), p.getField("unit"))),
                      F.lit("n"))


def format_period(period: Column | str) -> Column:
    """A period in words; seconds are not shown."""
    p = _col(period)
    n, unit = p.getField("n"), p.getField("unit")

    def part(letter: str) -> Column:
        return F.when(unit == letter, n).otherwise(F.lit(0))

    return F.when(p.isNotNull(), format_units(part("d"), part("h"), part("m")))



def date_parts(c: Column | str) -> list[Column]:
    """The start time of a flow in pieces, each a text. The zone is that of the session."""
    ts = _col(c)
    names = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH", "minute": "mm", "seconds": "ss",
             "milliseconds": "SSS", "timezone": "VV"}
    return [F.date_format(ts, pattern).alias(name) for name, pattern in names.items()]


def next_run(start: Column | str, period: Column | str, now: Column | str) -> Column:
    """The first start + k * period that is not before ``now``; without a period, start as it is.

    Worked out in closed form, however many periods have passed. A period that never gets there gives null.
    """
    start, now = _col(start), _col(now)
    step = period_seconds(period) * 1_000_000
    gap = micros_between(start, now)
    steps = F.when(step > 0, F.call_function("div", gap + step - 1, step))
    out = F.timestamp_add("SECOND", steps * period_seconds(period), start)
    return F.when(_col(period).isNull() | (gap <= 0), start).otherwise(out.cast("timestamp_ntz"))
