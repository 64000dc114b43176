"""Token ids as ORC files: run-length encoded integers, row indexes and Bloom filters on the document id.

Documents are dealt out by ranges of ``doc_id``, sorted, encoded and written by Spark's own ORC writer. A file's
stripes can be read by different tasks; a read for some ids skips stripes and row groups by their minima, maxima
and Bloom filters.

Null texts count as empty. Rows with equal ids stay apart, in the order of the input; null ids come first. Other
columns of the input are not looked at. Very long texts are encoded in whole and make one long row. An empty table gives
an empty set of files.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import batches, pretokens
from millrace.session import written

SCHEMA = "doc_id bigint, row bigint, ids array<int>"
STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX = 1000


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, row, ids): every text's ids and the end id, sorted by doc_id."""
    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
               .withColumn("row", F.monotonically_increasing_id())
               .repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row"))

    def ids_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = pretokens.lower_words(tokenizer)(batches.texts(batch))
        ended = np.insert(ids, offsets[1:], end_id)
        lists = batches.int_lists(ended.astype(np.int32), offsets + np.arange(len(offsets)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), lists], ["doc_id", "row", "ids"])

    return batches.map_batches(ordered, ids_of, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> str:
    """Write every document's ids under ``path``, in ascending order of doc_id over files and rows."""
    (encode(docs, tokenizer, end_id).write.option("compression", "zstd")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROWS_PER_INDEX).orc(path))
    return path


def read(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The rows of the files, or those of some ids; the condition reaches stripes, row groups and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def crc32s(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids if sys.byteorder == "little" else ids.byteswap())).cast("B")
    ends = (4 * offsets).tolist()
    return np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])), np.int64, len(ends) - 1)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files.

    ``start`` is summed up in two levels: over the files, of which there is one small row each, and inside a file.
    """
    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        crc = crc32s(lists.values.to_numpy(zero_copy_only=False), offsets)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), batch.column("file"), pa.array(np.diff(offsets)), pa.array(crc)],
            ["doc_id", "row", "file", "n_tokens", "ids_crc32"])

    rows = written(batches.map_batches(
        read(spark, path).select("doc_id", "row", F.col("_metadata.file_name").alias("file"), "ids"), digest,
        "doc_id bigint, row bigint, file string, n_tokens bigint, ids_crc32 bigint"), "token_digests")
    before = W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    files = (rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(F.struct("doc_id", "row")).alias("first"))
             .select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carry")))
    inside = W.partitionBy("file").orderBy("doc_id", "row").rowsBetween(W.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(files, "file")
            .select("doc_id", (F.col("carry") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
