"""Table functions, to be called by name in SQL once ``register`` has been called.

Where a built-in does it, ``explode`` over an array expression is the better choice: it stays in the JVM and in compiled
code. A table function is for what has no such expression, and for rows of a partition in order (a table argument with
``PARTITION BY`` and ``ORDER BY``), whose state it may keep from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Flatten:
    """``flatten_words(text)``: (pos, word), a row for each word of a text between white space; null has none.

    To be called ``LATERAL``, for each row of another table; Spark hands rows to such a function one by one, in Arrow
    batches under the hood.
    """

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())


class Exchanges:
    """``exchanges(TABLE(...) PARTITION BY conv_id ORDER BY turn)``: (conv_id, turn, role, next_role) for each row of
    (conv_id, turn, role) whose role differs from the one before it, with the role it follows."""

    def __init__(self) -> None:
        self.before = None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        conv, turn, role = (rows.column(c) for c in ("conv_id", "turn", "role"))
        roles = role.to_pylist()
        earlier = [self.before, *roles[:-1]]
        changed = pa.array([a is not None and a != b for a, b in zip(earlier, roles)], pa.bool_())
        self.before = roles[-1] if roles else self.before
        yield pa.table({"conv_id": conv.filter(changed), "turn": turn.filter(changed), "role": role.filter(changed),
                        "after": pa.array(earlier, pa.string()).filter(changed)})


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL under their names."""
    spark.udtf.register("flatten_words", F.udtf(Flatten, returnType="pos int, word string", useArrow=True))
    spark.udtf.register("exchanges", F.arrow_udtf(Exchanges, returnType="conv_id bigint, turn bigint, role string, after string"))
