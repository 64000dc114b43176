"""Row-wise operators: map, filter, select, rename, project, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import fixed_values as fixed


def flat_map(df: DataFrame, outputs: Column, keep: Sequence[str] = ()) -> DataFrame:
    """0..n rows per row: ``outputs`` is an array of structs, one struct per output row."""
    return df.select(*keep, F.explode(outputs).alias("_out")).select(*keep, "_out.*")


def map_batches(df: DataFrame, setup: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                schema: T.StructType | str) -> DataFrame:
    """Map Arrow batches with a function that ``setup`` builds once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = setup()
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(condition)


def select_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named columns; names the table does not have are left out."""
    return df.select(*[n for n in names if n in df.columns])


def select_or_default(df: DataFrame, fields: Iterable[str | tuple[str, object]]) -> DataFrame:
    """Every named field: a column the table lacks is null, or the given default.

    A null in a column that is there stays null.
    """
    out = []
    for field in fields:
        name, default = (field, None) if isinstance(field, str) else field
        if name in df.columns:
            out.append(F.col(name))
        else:
            out.append((F.lit(None).cast("string") if default is None else F.lit(default)).alias(name))
    return df.select(*out)



def rename(df: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Rename one pair after the other, so that order matters.

    A name that is not there gives a null column; a name that is already taken is overwritten.
    """
    columns: dict[str, Column] = {c: F.col(c) for c in df.columns}
    for old, new in pairs:
        value = columns.pop(old, F.lit(None).cast("string"))
        columns[new] = value
    return df.select(*[c.alias(n) for n, c in columns.items()])


def project(df: DataFrame, columns: Iterable[tuple[str, Callable[[], Column] | Column | str]]) -> DataFrame:
    """Add columns one after the other; each sees those added before it."""
    for name, expr in columns:
        value = expr() if callable(expr) else F.expr(expr) if isinstance(expr, str) else expr
        df = df.withColumn(name, value)
    return df


def by_position(df: DataFrame, picks: Iterable[tuple[int, str]]) -> DataFrame:
    """Columns by position, under new names."""
    return df.select(*[F.col(df.columns[i]).alias(name) for i, name in picks])


def partitioned(df: DataFrame, parts: int | None) -> DataFrame:
    """Set how many tasks the next step has; None leaves it to Spark."""
    return df if parts is None else df.repartition(parts)


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The same rows, with their number observed while they pass; no second scan."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def missing_fields(df: DataFrame, present: Iterable[str] = (), kinds: Mapping[str, str] | None = None,
                   members: Mapping[str, Sequence[str]] | None = None, times: Iterable[str] = (),
                   optional: Iterable[str] = (), entries: str = "fields") -> DataFrame:
    """Add ``problems``: what is wrong with each row's map of texts, in the order of the rules.

    ``present``: keys that have to exist. ``kinds``: key -> SQL type its text has to parse as.
    ``members``: key -> allowed values. ``times``: keys that have to parse as ISO times.
    A key in ``optional`` may be missing, but is checked when there.
    """
    bag = F.col(entries)
    optional = set(optional)
    checks: list[Column] = []

    def check(key: str, ok: Callable[[Column], Column], message: str) -> None:
        value = F.element_at(bag, key)
        absent = F.lit(None) if key in optional else F.lit(f"{key} is missing")
        checks.append(F.when(value.isNull(), absent).when(~ok(value), F.lit(message)))

    for key in present:
        check(key, lambda v: F.lit(True), "")
    for key, kind in (kinds or {}).items():
        check(key, lambda v, kind=kind: v.try_cast(kind).isNotNull(), f"{key} is not a {kind}")
    for key, allowed in (members or {}).items():
        check(key, lambda v, allowed=allowed: v.isin(*allowed), f"{key} is not an allowed value")
    for key in times:
        check(key, lambda v: v.try_cast("timestamp").isNotNull(), f"{key} is not a time")
    return df.withColumn("problems", F.array_compact(F.array(*checks)))


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema; a column that is missing or left over is an error before any job runs."""
    have, want = set(df.columns), set(schema.names)
    if have != want:
        raise ValueError(f"missing columns {sorted(want - have)}, unexpected columns {sorted(have - want)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


# Type names of the schema texts.
TYPE_NAMES = {"int8": T.ByteType(), "int32": T.IntegerType(), "int64": T.LongType(), "string": T.StringType(),
              "boolean": T.BooleanType(), "bytes": T.BinaryType()}


def make_schema(fields: Iterable[tuple[str, str]]) -> str:
    """``{'f':'int32', ...}`` out of (name, quoted type) pairs."""
    return "{" + ", ".join(f"'{name}':{kind}" for name, kind in fields) + "}"


def schema_from_text(text: str) -> T.StructType:
    """The Spark schema of such a text; an unknown type name is an error."""
    import ast

    def kind(value) -> T.DataType:
        if isinstance(value, dict):
            return T.StructType([T.StructField(n, kind(v)) for n, v in value.items()])
        if isinstance(value, list):
            return T.ArrayType(kind(value[0]))
        if value not in TYPE_NAMES:
            raise ValueError(f"unknown type {value!r}")
        return TYPE_NAMES[value]

    return kind(ast.literal_eval(text))


def level_and_message(line: Column | str, default: str = "INFO") -> list[Column]:
    """A child process's line: a level name in front sets the level and is cut off."""
    line = F.col(line) if isinstance(line, str) else line
    level, message = F.lit(default), line
    for name in reversed(fixed.LOG_LEVELS):
        level = F.when(line.startswith(name), F.lit(name)).otherwise(level)
        message = F.when(line.startswith(name), F.substr(line, F.lit(len(name) + 1))).otherwise(message)
    return [level.alias("level"), message.alias("message")]


def tagged_union(inputs: Sequence[DataFrame], tag: str = "index") -> DataFrame:
    """All rows of several inputs with the number of the input each came from; missing columns are null."""
    tagged = [df.withColumn(tag, F.lit(i)) for i, df in enumerate(inputs)]
    out = tagged[0]
    for other in tagged[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
