"""Putting steps together. A step is a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.operators import rows

Step = Callable[[DataFrame], DataFrame]


def compose(*steps: Step) -> Step:
    """``compose(a, b, c)`` is a of b of c; no step at all changes nothing."""
    return lambda df: reduce(lambda out, step: step(out), reversed(steps), df)


def staged(df: DataFrame, *steps: Step) -> DataFrame:
    """The steps from top to bottom."""
    return reduce(DataFrame.transform, steps, df)


def run_in_order(*jobs: Callable[[], object]) -> list[object]:
    """Run jobs that write their own output one after the other; the first error stops the rest."""
    return [job() for job in jobs]


def with_parameters(spark: SparkSession, text: str, parameters: Mapping[str, object], **tables: DataFrame) -> DataFrame:
    """SQL with named parameters (``:name``) over the given tables (``{name}``)."""
    return spark.sql(text, args=dict(parameters), **tables)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, object]):
    """Session settings for the jobs run inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, str(value))
    try:
        yield spark
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def typed(schema: str | T.StructType) -> Step:
    """A step that fixes the types of what is shuffled next."""
    wanted = rows.schema_from_text(schema) if isinstance(schema, str) else schema
    return lambda df: rows.check_schema(df, wanted)


def columns_of(names: Sequence[str]) -> Step:
    return lambda df: rows.select_present(df, names)
