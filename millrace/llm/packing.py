"""Packing into sequences of a fixed length with a bounded number of open windows.

Every partition cuts its documents into full sequences and a rest. Rests go to the open window that they fill
best; when none has room, the fullest is closed and a new one opened. What is open at the end of a partition is
merged in a tree of small groups, best fit again, so no task sees more than ``FAN * open_windows`` windows. A piece
carries its ids all the way. Those of open windows wait in memory, at most ``open_windows * length`` ids, and are told
apart from the others, so only they take part in the join that moves them.

A document's tokens are its ids and one end id. Null texts count as empty and give a piece of one token. Rows with
equal or null ids are documents of their own. Very long texts become many full sequences. Other columns are not looked at.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import batches, pretokens
from millrace.session import written

PIECES = ("doc_id bigint, start bigint, length bigint, ids array<int>, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, fill bigint, open boolean")
PACKED = ("doc_id bigint, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
WINDOWS = "part bigint, fill bigint, members array<struct<sequence_id: bigint, shift: bigint>>"
#: Bytes of text that are cut at once.
TEXT_BYTES = 3 << 20
#: Partitions, or groups of the level below, whose open windows are merged together.
FAN = 64


class Windows:
    """At most ``most`` open sequences of one partition."""

    def __init__(self, part: int, length: int, most: int):
        self.length, self.most, self.next = length, most, part << 33
        self.fill: dict[int, int] = {}
        #: The pieces of each open sequence, and those of sequences closed since they were last taken.
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def close(self, sequence: int) -> None:
        del self.fill[sequence]
        self.done += self.held.pop(sequence)

    def place(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        """Put a document's rest into a sequence, behind what is there."""
        best, most = None, -1
        for sequence, fill in self.fill.items():
            if most < fill <= self.length - len(ids):
                best, most = sequence, fill
        if best is None:
            if len(self.fill) == self.most:
                self.close(max(self.fill, key=self.fill.get))
            best, most = self.new(), 0
            self.held[best] = []
        self.fill[best] = most + len(ids)
        # A copy, so that no more of the batch than the rest stays in memory.
        self.held[best].append((doc_id, start, ids.copy(), doc_tokens, best, most))
        if self.fill[best] == self.length:
            self.close(best)

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def piece_rows(rows: list[tuple], fills: dict[int, int] | None = None) -> pa.RecordBatch:
    """Pieces as a batch; those of open windows come with the fills of these."""
    doc_ids, starts, ids, doc_tokens, sequences, offsets = zip(*rows) if rows else [()] * 6
    lengths = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths),
         batches.int_lists(flat.astype(np.int32, copy=False), batches.offsets_of(lengths)),
         pa.array(doc_tokens, pa.int64()), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()),
         pa.array([fills[s] if fills else None for s in sequences], pa.int64()),
         pa.array([fills is not None] * len(rows), pa.bool_())],
        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "fill", "open"])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, open_windows: int) -> DataFrame:
    """The pieces as each partition places them; ``open`` marks those in windows that were open at the end."""
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    batches.bound_batches(docs.sparkSession)

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(TaskContext.get().partitionId(), length, open_windows)
        for batch in arriving:
            for part in batches.slices(batch, TEXT_BYTES):
                yield cut(part, windows)
        batches.release()
        yield piece_rows([piece for held in windows.held.values() for piece in held], windows.fill)

    def cut(batch: pa.RecordBatch, windows: Windows) -> pa.RecordBatch:
        ids, offsets = pretokens.spaced_words(tokenizer)(batches.texts(batch))
        ids = np.insert(ids, offsets[1:], end_id).astype("<i4")
        offsets = (offsets + np.arange(len(offsets))).tolist()
        rows = []
        for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:]):
            whole = a + (b - a) // length * length
            rows += [(doc_id, at - a, ids[at:at + length], b - a, windows.new(), 0) for at in range(a, whole, length)]
            if whole < b:
                windows.place(doc_id, whole - a, ids[whole:b], b - a)
        return piece_rows(rows + windows.taken())

    return docs.mapInArrow(run, PIECES)


def merge_once(windows: DataFrame, length: int, keep: int) -> DataFrame:
    """Merge the windows of ``FAN`` parts each; only the ``keep`` emptiest of a group stay for the next level."""
    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["fill"], r["members"][0]["sequence_id"]))
        bins: list[dict] = []
        for row in rows:
            fits = [b for b in bins if b["fill"] + row["fill"] <= length]
            if fits:
                best = max(fits, key=lambda b: b["fill"])
                best["members"] += [{"sequence_id": m["sequence_id"], "shift": m["shift"] + best["fill"]}
                                    for m in row["members"]]
                best["fill"] += row["fill"]
            else:
                bins.append({"part": row["part"], "fill": row["fill"], "members": list(row["members"])})
        group = (rows[0]["part"] // FAN) if rows else 0
        bins.sort(key=lambda b: b["fill"])
        for n, b in enumerate(bins):
            b["part"] = group if n < keep else -1
        return pa.Table.from_pylist(bins, schema=pa.schema([
            ("part", pa.int64()), ("fill", pa.int64()),
            ("members", pa.list_(pa.struct([("sequence_id", pa.int64()), ("shift", pa.int64())])))]))

    return windows.groupBy(F.expr(f"part div {FAN}L")).applyInArrow(merged, WINDOWS)


def with_digests(packed: DataFrame) -> DataFrame:
    """Packed pieces with ``ids_crc32``, the crc32 of the ids that came out, as little-endian int32."""
    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        raw = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
        at = lists.offsets.to_pylist()
        crcs = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])], pa.int64())
        columns = dict(zip(batch.schema.names, batch.columns)) | {"ids_crc32": crcs}
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return batches.map_batches(packed, digest, PACKED)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, open_windows: int = 48) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    The placed pieces are written once, so that all that follows sees the same placement whatever is lost.
    """
    placed = written(pieces(docs, tokenizer, end_id, length, open_windows), "pieces")
    windows = placed.filter("open").groupBy("sequence_id").agg(F.max("fill").alias("fill")).select(
        F.shiftright("sequence_id", 33).alias("part"), "fill",
        F.array(F.struct("sequence_id", F.lit(0).cast("bigint").alias("shift"))).alias("members"))
    parts = (placed.filter("open").agg(F.max(F.shiftright("sequence_id", 33))).first()[0] or 0) + 1
    final = None
    while True:
        windows = written(merge_once(windows, length, open_windows), "windows")
        parts = -(-parts // FAN)
        closed = windows if parts == 1 else windows.filter("part < 0")
        final = closed if final is None else final.unionByName(closed)
        if parts == 1:
            break
        windows = windows.filter("part >= 0")
    moved = final.select(F.col("members")[0]["sequence_id"].alias("into"), F.explode("members").alias("m")).select(
        F.col("m.sequence_id").alias("sequence_id"), "into", "m.shift")
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]
    stayed = placed.filter("not open").select(*names, "sequence_id", "offset")
    merged = placed.filter("open").join(moved, "sequence_id").select(
        *names, F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return with_digests(stayed.unionByName(merged))
