"""Text and array functions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(c: Column | str, fields: Sequence[int], delimiter: str = "\t") -> Column:
    """The given 0-based fields of a delimited text, as an array.

    ``delimiter`` is a regular expression. A field that is not there is null, and so is one in the run of
    empty fields at the end; an empty field before that is an empty string.
    """
    s = _col(c)
    kept = F.regexp_replace(s, f"(?:{delimiter})+\\z", "")
    all_empty = (kept == "") & (s != "")
    parts = F.when(~all_empty, F.split(kept, delimiter, -1))
    return F.array(*[F.get(parts, F.lit(i)) for i in fields])


def apply_at(c: Column | str, fn: Callable[[Column], Column], positions: int | Sequence[int]) -> Column:
    """Replace the elements at the given positions by ``fn`` of them; a position named twice is applied twice."""
    times = Counter([positions] if isinstance(positions, int) else positions)
    out = _col(c)
    for rounds in range(1, max(times.values(), default=0) + 1):
        now = [p for p, n in times.items() if n >= rounds]
        out = _at(out, fn, now)
    return out


def _at(arr: Column, fn: Callable[[Column], Column], positions: Sequence[int]) -> Column:
    return F.transform(arr, lambda x, i: F.when(i.isin(*positions), fn(x)).otherwise(x))


def tokens(c: Column | str) -> Column:
    """Split on white space, keeping empty tokens."""
    return F.split(_col(c), r"\s+", -1)


def words(c: Column | str) -> Column:
    """The words of a text: what stands between white space."""
    return F.array_remove(F.split(_col(c), r"\s+", -1), "")


def ngrams(word_array: Column | str, sizes: Sequence[int] = (1, 2)) -> Column:
    """The distinct n-grams of an array of words, joined by one space.

    Which sizes count as a phrase is our own definition, hence a parameter. Give the words as a column of
    their own: an expression would be worked out once for every time it is used here.
    """
    return F.array_distinct(F.concat(*[_grams(_col(word_array), n) for n in sizes]))


def _grams(words: Column, n: int) -> Column:
    """All runs of n words. The array is walked once per size, never looked up by index inside a lambda:
    Spark works the array out again for every element there."""
    grams = words
    for size in range(2, n + 1):
        many = F.greatest(F.size(words) - (size - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), many), F.slice(words, F.lit(size), many),
                           lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def shell_quote(c: Column | str, quote: str = "'") -> Column:
    """Wrap in a quote character, with that character escaped by a backslash inside."""
    q = F.lit(quote)
    return F.concat(q, F.replace(_col(c), q, F.lit("\\" + quote)), q)


def is_null_or_empty(c: Column | str) -> Column:
    return _col(c).isNull() | (F.coalesce(_col(c), F.lit("")) == "")


def required(c: Column | str, message: str) -> Column:
    """The value, or an error when it is null."""
    return F.coalesce(_col(c), F.raise_error(F.lit(message)))


def ellipsify(c: Column | str, length: int) -> Column:
    s = _col(c)
    return (F.when(s.isNull(), F.lit(""))
            .when(F.length(s) <= length, s)
            .otherwise(F.concat(F.substring(s, 1, max(length - 3, 0)), F.lit("..."))))


def newline_to_br(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[\r\n]", "<br/>")


def repeated(c: Column | str, n: Column | int) -> Column:
    return F.repeat(_col(c), n if isinstance(n, Column) else F.lit(n))


def counting(n: Column | str) -> Column:
    """The integers 0 .. n-1; none when n is 0 or less."""
    n = _col(n)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def base_name(c: Column | str) -> Column:
    """What follows the last dot."""
    return F.substring_index(_col(c), ".", -1)


def extract_hour(c: Column | str) -> Column:
    """HH of a yyMMddHHmmss text."""
    return F.substring(_col(c), 7, 2)


def is_query(c: Column | str, url: str = r"(?i)^\s*(https?://|ftp://|www\.)\S*") -> Column:
    """True for a search text that is neither blank nor a URL. What a URL looks like is our own definition."""
    s = _col(c)
    return F.coalesce((F.length(F.trim(s)) > 0) & ~s.rlike(url), F.lit(False))
