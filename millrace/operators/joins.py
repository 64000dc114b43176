"""Joins on equal keys.

No side is ever forced to be broadcast: Spark broadcasts a side whose size it knows to be small
(``spark.sql.autoBroadcastJoinThreshold``) and shuffles otherwise. A hot key on the left is split by
adaptive execution; a hot key on the right of a left join is not, so ``spread_join`` splits that itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import groups, ordering
from millrace.operators.rows import tagged_union

ROWS_PER_PIECE = 1_000_000


def equal_keys(left: str, right: str, keys: Sequence[str], null_safe: bool) -> Column:
    pairs = [(F.col(f"{left}.{k}"), F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                rows_per_piece: int = ROWS_PER_PIECE, null_safe: bool = False) -> DataFrame:
    """Left or inner join in which a right-hand key with many rows is cut into pieces.

    The left rows of such a key are repeated once per piece. The table of hot keys has at most
    rows / rows_per_piece rows. Column names besides the keys must differ.
    """
    hot = (right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_piece).alias("_pieces"))
           .filter("_pieces > 1"))
    rest_left = [c for c in left.columns if c not in keys]
    rest_right = [c for c in right.columns if c not in keys]
    l = (left.alias("l").join(hot.alias("h"), equal_keys("l", "h", keys, null_safe), "left")
         .select("l.*", F.coalesce("h._pieces", F.lit(1)).alias("_pieces"))
         .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1))))
    # By content and input partition: equal rows spread too, and a task that is run again does the same.
    spread = F.pmod(F.xxhash64(*[f"r.{c}" for c in ordering.hashable(right)], "r._from"), F.coalesce("h._pieces", F.lit(1)))
    right = right.withColumn("_from", F.spark_partition_id())
    r = (right.alias("r").join(hot.alias("h"), equal_keys("r", "h", keys, null_safe), "left")
         .select("r.*", spread.alias("_piece"), F.lit(True).alias("_matched")))
    on = equal_keys("l", "r", keys, null_safe) & (F.col("l._piece") == F.col("r._piece"))
    joined = l.alias("l").join(r.alias("r"), on, how)
    if how == "left":
        # A hot key has partners for sure; a copy that met an empty piece is not an unmatched row.
        joined = joined.filter(F.col("_matched") | (F.col("_pieces") == 1))
    return joined.select(*[F.col(f"l.{k}").alias(k) for k in keys], *[F.col(f"l.{c}") for c in rest_left],
                         *[F.col(f"r.{c}") for c in rest_right])


@dataclass
class JoinInput:
    """One input of ``join_inputs``: a table, the columns it brings, and whether its keys are unique."""

    table: DataFrame
    columns: Sequence[str]
    unique: bool = False


def join_inputs(fields: Sequence[str], inputs: Sequence[JoinInput], how: str = "left", null_safe: bool = False,
                rows_per_piece: int | None = ROWS_PER_PIECE) -> DataFrame:
    """Join any number of inputs on the same fields, keeping every row of the first one.

    Partners multiply. Where inputs share a column name, the last input that has a partner owns it, even if
    it holds null there. A column an input does not have is null. Inputs marked unique are joined plainly,
    and so are all when ``rows_per_piece`` is None; such a chain shuffles each input once.
    """
    first, *others = inputs
    names = list(dict.fromkeys(c for i in inputs for c in i.columns if c not in fields))

    def prepared(i: JoinInput) -> DataFrame:
        columns = [c for c in dict.fromkeys(i.columns) if c not in fields]
        return i.table.select(*fields, *[F.col(c) if c in i.table.columns else F.lit(None).cast("string").alias(c)
                                         for c in columns])

    out = prepared(first)
    for item in others:
        right = prepared(item)
        clash = [c for c in right.columns if c in out.columns and c not in fields]
        right = right.withColumnsRenamed({c: f"_new_{c}" for c in clash}).withColumn("_has", F.lit(True))
        if item.unique or rows_per_piece is None:
            l, r = out.alias("l"), right.alias("r")
            out = (l.join(r, equal_keys("l", "r", fields, null_safe), how)
                   .select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in fields]))
        else:
            out = spread_join(out, right, fields, how, rows_per_piece, null_safe)
        for c in clash:
            out = out.withColumn(c, F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(c)))
        out = out.drop("_has", *[f"_new_{c}" for c in clash])
    return out.select(*fields, *names)



def join_reduce(fields: Sequence[str], inputs: Sequence[JoinInput], start: Callable, state: str, merge: Callable,
                finish: Callable, schema: str, how: str = "left") -> DataFrame:
    """0..n rows per join key: all joined rows of a key go through a reducer in three parts (``reduce_groups``)."""
    return groups.reduce_groups(join_inputs(fields, inputs, how=how), fields, start, state, merge, finish, schema)


def join_reduce_ordered(fields: Sequence[str], tables: Sequence[DataFrame], order: Sequence[str | Column],
                        reducer: groups.Reducer, schema: str, tag: str = "input") -> DataFrame:
    """0..n rows per join key from a reducer that sees the rows of all tables one after the other: those of the first
    table, then those of the second, and so on, each in ``order``; ``tag`` holds the number of the table.

    Rows are never multiplied: a reducer keeps what it needs of the first tables and lets the rest stream by. Columns that
    a table does not have are null. See ``groups.reduce_ordered`` for what a hot key means.
    """
    return groups.reduce_ordered(tagged_union(tables, tag), fields, [tag, *order], reducer, schema)
