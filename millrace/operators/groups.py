"""Grouping operators.

Built-in aggregates are combined before the shuffle by Spark itself. A user's own accumulator gets the
same treatment from ``merge_by_key``: rows are merged inside each input partition, shuffled once, and merged
again as they stream by in key order. No step ever holds a whole group, so a key with a third of all rows
reaches its task as a few merged rows per input partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.ordering import ranked

#: Rows, and bytes of Arrow data, that a task merges at once.
HELD_ROWS = 100_000
HELD_BYTES = 64 << 20
#: Batches that are held side by side before they are copied into one.
SMALL_BATCHES = 256


def _mashed(name: str) -> Column:
    """Texts put together; sorted, so that the result does not depend on the order of rows."""
    return F.when(F.count(name) > 0, F.array_join(F.array_sort(F.collect_list(name)), ""))


# Accumulators with a built-in aggregate of the same result.
BUILT_IN = {"+": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or,
            "count": F.count, "&": F.bit_and, "|": F.bit_or, "^": F.bit_xor}

Merge = Callable[[pd.DataFrame], pd.DataFrame]
Reducer = Callable[[tuple, Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]

# Types that keep nulls apart from numbers, so that whole numbers stay whole.
_EXACT = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
          pa.float32(): pd.Float32Dtype(), pa.float64(): pd.Float64Dtype(), pa.bool_(): pd.BooleanDtype()}


def to_frame(table: pa.Table) -> pd.DataFrame:
    """Arrow rows as pandas rows with nullable types."""
    return table.to_pandas(types_mapper=_EXACT.get)


def merge_by_key(df: DataFrame, keys: Sequence[str], merge: Merge, held: int = HELD_ROWS) -> DataFrame:
    """One row per key, by a ``merge`` of your own.

    ``merge`` takes rows of the table (several keys mixed) and returns one row per key in the same columns; whole
    numbers and nulls come as they are. It must give the same result however the rows are split up and ordered.
    """
    keys = list(keys)

    def merged(rows: pd.DataFrame, schema: pa.Schema) -> pa.Table:
        return pa.Table.from_pandas(merge(rows)[schema.names], schema=schema, preserve_index=False)

    def in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, held):
            yield from merged(to_frame(table), table.schema).to_batches()

    def in_key_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = None  # what has been merged of the key that the last batch ended in
        for table in gathered(batches, held):
            rows = to_frame(table if open_key is None else pa.concat_tables([open_key, table]))
            last = _same_key(rows, keys, rows.iloc[-1])
            if not last.all():
                yield from merged(rows[~last], table.schema).to_batches()
            open_key = merged(rows[last], table.schema)
        if open_key is not None:
            yield from open_key.to_batches()

    partial = df.mapInArrow(in_partition, df.schema)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(in_key_order, df.schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int, most_bytes: int = HELD_BYTES) -> Iterator[pa.Table]:
    """Batches put together until they hold ``rows`` rows or ``most_bytes``."""
    kept: list[pa.RecordBatch] = []
    size = weight = small = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        small += 1
        if small == SMALL_BATCHES:  # a batch of few rows takes many times the memory of the rows
            kept[-small:] = pa.Table.from_batches(kept[-small:]).combine_chunks().to_batches()
            small = 0
        size, weight = size + batch.num_rows, weight + batch.nbytes
        if size >= rows or weight >= most_bytes:
            yield pa.Table.from_batches(kept)
            kept, size, weight, small = [], 0, 0, 0
    if kept:
        yield pa.Table.from_batches(kept)


def _same_key(rows: pd.DataFrame, keys: list[str], row: pd.Series) -> pd.Series:
    same = pd.Series(True, index=rows.index)
    for key in keys:
        value = row[key]
        same &= rows[key].isna() if pd.isna(value) else (rows[key] == value).fillna(False).astype(bool)
    return same


def pairwise(keys: Sequence[str], accumulators: Mapping[str, Callable]) -> Merge:
    """A merge that folds each column with its own function of two values; nulls are left out, as in aggregates.

    A numpy ufunc (``numpy.bitwise_xor``) works on whole columns at once; any other function is called per value.
    """
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        grouped = rows.groupby(list(keys), dropna=False, sort=False)
        number = grouped.ngroup().to_numpy()
        out = rows[list(keys)].iloc[np.unique(number, return_index=True)[1]].reset_index(drop=True)
        order = np.argsort(number, kind="stable")
        for name, fn in accumulators.items():
            values, own = rows[name].iloc[order], number[order]
            there = values.notna().to_numpy()
            values, own = values[there], own[there]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            if isinstance(fn, np.ufunc):
                folded = fn.reduceat(values.to_numpy(dtype=getattr(values.dtype, "numpy_dtype", None)), starts) if len(
                    starts) else []
            else:
                items = values.tolist()
                ends = [*starts[1:], len(items)]
                folded = [reduce(fn, items[a:b]) for a, b in zip(starts, ends)]
            # Folded values in the places of their keys; a key with nulls alone has none.
            at = pd.Series(folded.tolist() if isinstance(folded, np.ndarray) else folded, index=own[starts], dtype=object)
            column = at.reindex(range(len(out)))
            out[name] = column.where(column.index.isin(at.index), None)
        return out[list(rows.columns)]

    return merge


def group_fold(df: DataFrame, fields: Sequence[str],
               projections: Iterable[tuple[str, Column, str | Callable, str]]) -> DataFrame:
    """Group by ``fields``; per projection (name, first value of a row, accumulator, type).

    The first value is taken of every row and the accumulator joins two of them; there is no seed, so a
    group of one row keeps its first value. An accumulator is a built-in name, which becomes an aggregate whatever
    stands beside it, or an associative function, which leaves nulls out as aggregates do. ``+`` puts texts together.
    Output: the fields, then the projections, cast to their types. A projection with the name of a field
    replaces it.
    """
    projections = list(projections)
    names = [p[0] for p in projections]
    key_names = {f: f"_by_{f}" for f in fields}
    keyed = df.select(*[F.col(f).alias(k) for f, k in key_names.items()],
                      *[first.cast(kind).alias(name) for name, first, _, kind in projections])
    keys = list(key_names.values())
    built = [p for p in projections if isinstance(p[2], str)]
    own = {name: acc for name, _, acc, _ in projections if not isinstance(acc, str)}
    grouped = None
    if built or not own:
        grouped = keyed.groupBy(*keys).agg(*[_built_in(acc, name, keyed.schema[name].dataType).cast(kind).alias(name)
                                             for name, _, acc, kind in built])
    if own:
        folded = merge_by_key(keyed.select(*keys, *own), keys, pairwise(keys, own))
        if grouped is None:
            grouped = folded
        else:
            same = [F.col(f"b.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys] or [F.lit(True)]
            grouped = (grouped.alias("b").join(folded.alias("o"), reduce(lambda a, b: a & b, same))
                       .select("b.*", *[F.col(f"o.{n}").alias(n) for n in own]))
    return grouped.select(*[F.col(k).alias(f) for f, k in key_names.items() if f not in names], *names)


def _built_in(acc: str, name: str, kind: T.DataType) -> Column:
    return _mashed(name) if acc == "+" and isinstance(kind, T.StringType) else BUILT_IN[acc](name)


def group_no_combine(df: DataFrame, fields: Sequence[str], projections) -> DataFrame:
    """The same result as ``group_fold``. Whether rows are combined before the shuffle is Spark's choice."""
    return group_fold(df, fields, projections)


def reduce_groups(df: DataFrame, keys: Sequence[str], start: Callable[[pd.DataFrame], pd.DataFrame], state: str,
                  merge: Merge, finish: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """0..n rows per group from a reducer in three parts.

    ``start`` turns rows into state rows (keys and state columns), ``merge`` joins the states of a key into
    one, ``finish`` turns finished states into output rows. All three work on batches with many keys.
    """
    def each(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], made: str) -> DataFrame:
        arrow = to_arrow_schema(T._parse_datatype_string(made))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = fn(to_frame(pa.Table.from_batches([batch])))
                yield from pa.Table.from_pandas(out[arrow.names], schema=arrow, preserve_index=False).to_batches()
        return df.mapInArrow(run, made)

    return each(merge_by_key(each(df, start, state), keys, merge), finish, schema)


def reduce_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], reducer: Reducer, schema: str) -> DataFrame:
    """0..n rows per key from a reducer that sees the key's rows one after the other, in ``order``.

    ``reducer(key, batches)`` gets the key's values and an iterator of Arrow batches of its rows, and gives batches of
    ``schema``. Rows stream in from the sorted shuffle and results stream out, so a key of any size needs no more memory
    than a batch; but one task reads all of a key, one after the other, which only ``reduce_groups`` or windows over
    blocks avoid. Use it where what a row does depends on those before it and no merge of parts can tell.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (out.select(arrow.names).cast(arrow) for key, rows in runs_of_keys(batches, keys) for out in reducer(key, rows))
        for table in gathered(made, HELD_ROWS):  # many keys of few rows share a batch
            yield from table.combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def runs_of_keys(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """(key, batches of its rows) for rows in which those of a key lie together. A key's batches are cut off the stream
    as they are asked for, and what the caller leaves of them is passed over."""
    def slices() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:  # codes tell nulls and NaN apart from all else, and take each as equal to itself
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield tuple(batch.column(k)[a].as_py() for k in keys), batch.slice(a, b - a)

    def same(a: tuple, b: tuple) -> bool:
        return all(x == y or (x != x and y != y) for x, y in zip(a, b))

    stream = slices()
    ahead = next(stream, None)
    while ahead is not None:
        key = ahead[0]

        def own() -> Iterator[pa.RecordBatch]:
            nonlocal ahead
            while ahead is not None and same(ahead[0], key):
                part = ahead[1]
                ahead = next(stream, None)
                yield part

        rows = own()
        yield key, rows
        for _ in rows:
            pass


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_piece: int = 10_000) -> DataFrame:
    """Add ``rank`` and ``piece``: the place of a row in its group, and the piece of the group it falls in.

    For results that gather a group into one value: gather per (key, piece) instead. A piece has at most
    ``rows_per_piece`` rows, and the pieces in order are the whole group in order.
    """
    return (ranked(df, keys, order)
            .withColumn("piece", F.call_function("div", F.col("rank") - 1, F.lit(rows_per_piece))))


def grouped_order(df: DataFrame, keys: Sequence[str], then: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """All rows, those of one key next to each other.

    Rows are split by range over key and ``then``, so a hot key lies in several neighbouring tasks.
    """
    columns = [*keys, *then]
    ranged = df.repartitionByRange(*columns) if parts is None else df.repartitionByRange(parts, *columns)
    return ranged.sortWithinPartitions(*columns)


def last_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row per key: that with the greatest position."""
    return _pick(df, keys, position, F.max_by)


def first_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row per key: that with the smallest position."""
    return _pick(df, keys, position, F.min_by)


def _pick(df: DataFrame, keys: Sequence[str], position: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(position)).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]))

