"""Arrow batches of texts, and ragged numpy arrays made of them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to Python (Spark's own bound is eight times that), and of the part of it that
#: is worked on at once.
BATCH_BYTES = 8 << 20
SLICE_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``BATCH_BYTES``, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(key).lower().removesuffix("b")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: a worker lives on and waits while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType,
                most: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over slices of every partition; a slice holds whole rows and about ``most`` bytes."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                yield fn(part)
        release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes; a longer row is alone in its slice."""
    n = batch.num_rows
    size = np.zeros(n, np.int64)
    for column in columns_of(batch):
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            size += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    begin, ends = 0, np.cumsum(size)
    while begin < n:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def columns_of(batch: pa.RecordBatch) -> Iterator[pa.Array]:
    """The columns, and the fields of those that are structs."""
    for column in batch.columns:
        if pa.types.is_struct(column.type):
            yield from column.flatten()
        else:
            yield column


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.StringArray:
    """The texts of a batch; null is the empty text."""
    return pc.fill_null(batch.column(name), "")


def as_bytes(column: pa.StringArray) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of the runs begins, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``pool[start:start + length]`` one behind the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(ends[-1])
    return pool[at]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each run."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def int_lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def float_lists(lists: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate(lists).astype(np.float64, copy=False) if lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets_of(np.array([len(x) for x in lists], np.int64)).astype(np.int32)),
                                    pa.array(values))
