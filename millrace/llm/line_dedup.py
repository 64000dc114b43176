"""Lines that several documents hold stay in the first of them only, found by two Bloom filters.

One pass counts the lines, which gives the filters' size. The next builds two filters, for hashes seen once and seen twice; the partitions' filters are merged
in a tree, cut into chunks. A second pass asks the twice-seen filter: only lines that it knows are suspects and are
shuffled, to be confirmed by 128-bit hashes and to find the first document. A filter that is too small makes more
suspects, never fewer. Texts are shuffled only where a document has suspects.

A line's key is the line without white space at its ends and with A-Z in lower case; only keys of ``least`` code
points count. Null texts are one empty line. Rows with the same id are one document; those without an id count as one
document behind all others. Other columns are carried along and can have any names. A very long text is worked on in whole. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import batches
from millrace.session import written

#: Bits of each filter for a line, and of each filter, as powers of two: from 2^20 to 2^30 (128 MB, which is also all
#: that is ever sent to the driver and the workers). Beyond 2^28 lines the filters fill up and more lines are suspects.
BITS_EACH, LEAST_BITS, MOST_BITS = 2, 20, 30
#: The bits that a line sets, bytes of a chunk, and filters merged at once.
PROBES = 2
CHUNK = 1 << 16
FAN = 64
LEAST = 10
#: Pieces that the holders of a line are dealt into when they are told which document holds it first.
SALTS = 32
FILTERS = "chunk int, part bigint, once binary, twice binary"


def keys_of(text: bytes, least: int) -> list[bytes]:
    """The keys of a text's lines, empty for lines that don't count. Bytes lower-case and strip ASCII only."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        n = len(key)
        out.append(key if n >= 4 * least or n >= least and len(key.decode()) >= least else b"")
    return out


def hashed(keys: set[bytes]) -> np.ndarray:
    """(n, 2) unsigned: the 128-bit hash of each key."""
    raw = b"".join(xxhash.xxh3_128_digest(k) for k in keys)
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bit of each probe."""
    return [(hashes[:, n % 2] >> np.uint64(64 - bits * (1 + n // 2))) & np.uint64((1 << bits) - 1)
            for n in range(PROBES)]


def holds(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in places(hashes, bits):
        out &= (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def put(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    for at in places(hashes, bits):
        np.bitwise_or.at(filter_, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def filters(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """The two filters of every partition, as chunks."""
    size = 1 << (bits - 3)
    batches.bound_batches(docs.sparkSession)

    def build(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in arriving:
            for part in batches.slices(batch):
                own = [hashed({k for k in keys_of(t, least) if k}) for t in batches.as_bytes(batches.texts(part))]
                hashes = np.concatenate(own) if own else np.zeros((0, 2), np.uint64)
                hashes, seen = np.unique(hashes.view("u8,u8").ravel(), return_counts=True)
                hashes = hashes.view(np.uint64).reshape(-1, 2)
                put(twice, hashes[(seen > 1) | holds(once, hashes, bits)], bits)
                put(once, hashes, bits)
        part, rows = TaskContext.get().partitionId(), []
        for n, a in enumerate(range(0, size, CHUNK)):
            if once[a:a + CHUNK].any():
                rows.append((n, part, *(zlib.compress(f[a:a + CHUNK], 1) for f in (once, twice))))
        yield chunk_rows(rows)
        del once, twice, rows
        batches.release()

    return docs.select("text").mapInArrow(build, FILTERS)


def chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(),
                                                                               pa.binary()))],
                                      ["chunk", "part", "once", "twice"])


def merged(chunks: DataFrame) -> DataFrame:
    """One level of the tree: the filters of ``FAN`` parts become one. What two parts saw once was seen twice."""
    def merge(table: pa.Table) -> pa.Table:
        once = twice = None
        for row in table.to_pylist():
            a, b = (np.frombuffer(zlib.decompress(row[k]), np.uint8) for k in ("once", "twice"))
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        part, chunk = table["part"][0].as_py() // FAN, table["chunk"][0].as_py()
        return pa.Table.from_batches([chunk_rows([(chunk, part, zlib.compress(once, 1), zlib.compress(twice, 1))])])

    return chunks.groupBy("chunk", F.expr(f"part div {FAN}L")).applyInArrow(merge, FILTERS)


def twice_seen(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The filter of what was seen twice, of ``2^bits`` bits."""
    chunks = written(filters(docs, least, bits), "filters")
    parts = (chunks.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        chunks, parts = merged(chunks), -(-parts // FAN)
        if parts == 1:
            break
        chunks = written(chunks, "filters")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in chunks.select("chunk", "twice").toLocalIterator():
        a = row["chunk"] * CHUNK
        out[a:a + CHUNK] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


def bits_for(docs: DataFrame) -> int:
    """The size of the filters for all lines of a table, as a power of two."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, lines.bit_length() + BITS_EACH))


def own_texts(batch: pa.RecordBatch) -> list[bytes]:
    """The texts inside the rows' structs."""
    return batches.as_bytes(pc.fill_null(pc.struct_field(batch.column("value"), ["text"]), ""))


def dedup(docs: DataFrame, least: int = LEAST, bits: int | None = None) -> DataFrame:
    """(value, text, n_lines, n_dropped): each row as a struct, its text as kept, its lines before and the dropped.

    The rows with their suspects are written once; confirming and dropping both start from that table.
    """
    spark = docs.sparkSession
    bits = bits or bits_for(docs)
    known = spark.sparkContext.broadcast(twice_seen(docs, least, bits))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("value")).select(
        "value", F.monotonically_increasing_id().alias("row"))

    def suspect(batch: pa.RecordBatch) -> pa.RecordBatch:
        filter_, n_lines, lengths, found = known.value, [], [], []
        for text in own_texts(batch):
            n_lines.append(text.count(b"\n") + 1)
            hashes = hashed({k for k in keys_of(text, least) if k})
            hashes = hashes[holds(filter_, hashes, bits)]
            lengths.append(len(hashes))
            found.append(hashes)
        flat = np.concatenate(found).astype(">u8").tobytes() if found else b""
        lists = pa.ListArray.from_arrays(
            pa.array(batches.offsets_of(np.array(lengths, np.int64)).astype(np.int32)),
            pa.array([flat[a:a + 16] for a in range(0, len(flat), 16)], pa.binary()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_lines, pa.int64()), lists],
                                          [*batch.schema.names, "n_lines", "suspects"])

    fields = rows.schema.fields
    looked = written(batches.map_batches(rows, suspect, T.StructType(
        [*fields, T.StructField("n_lines", T.LongType()),
         T.StructField("suspects", T.ArrayType(T.BinaryType()))])), "suspects")
    # The place of a document: its id, and behind all ids where there is none.
    held = looked.select("row", F.coalesce(F.col("value.doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"),
                         F.pmod("row", F.lit(SALTS)).alias("salt"), F.explode("suspects").alias("key"))
    repeated = (held.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                .filter("first < last").select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    losing = (held.join(repeated.withColumn("salt", F.col("salt").cast("bigint")), ["key", "salt"]).filter("doc > first")
              .groupBy("row").agg(F.collect_list("key").alias("lost")))

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, dropped = [], []
        for text, lost in zip(own_texts(batch), batch.column("lost").to_pylist()):
            lost, lines = set(lost or ()), text.split(b"\n")
            out = [line for line, key in zip(lines, keys_of(text, least))
                   if not key or xxhash.xxh3_128_digest(key) not in lost]
            kept.append(b"\n".join(out))
            dropped.append(len(lines) - len(out))
        return pa.RecordBatch.from_arrays(
            [batch.column("value"), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("n_lines"),
             pa.array(dropped, pa.int64())], ["value", "text", "n_lines", "n_dropped"])

    clean = looked.filter("size(suspects) = 0").select(
        "value", F.coalesce("value.text", F.lit("")).alias("text"), "n_lines", F.lit(0).cast("bigint").alias("n_dropped"))
    doubtful = looked.filter("size(suspects) > 0").drop("suspects").join(losing, "row", "left").drop("row")
    settled = batches.map_batches(doubtful, drop, T.StructType([
        fields[0], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType())]))
    return clean.unionByName(settled)
