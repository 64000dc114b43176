"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence, so that a repeated one counts every time. Each of a fixed
number of hash functions selects the few with the smallest hashes; these are put back in the order of the text, and a
hash of that tuple is an entry of the fingerprint. Two texts agree in an entry if the selected k-mers are the same and
stand in the same order, so the share of equal entries falls with the edit distance, not only with the overlap of sets.

The hash functions are one 64-bit hash of (k-mer, occurrence), taken apart by exclusive or with a number of each
function. The numbers differ in their first bits, so a function's smallest hashes begin with few bits out of many:
those with the same first bits and a small rest are sorted once for all functions, and a function that finds too few
among them looks at all.

Texts may be null (empty) or of any length; they are never cut. A text shorter than a k-mer is one k-mer; the empty
text has a fingerprint of zeros, equal only to that of another empty text. White space and case count.

``with_next`` needs each document together with the one behind it. Documents are sorted over the cluster by range, each
partition hands on its first and its last row, and those few are matched in a join, so nothing passes through one task.
Ids may be null (behind all others) or repeated (in the order of their texts' hashes; equal texts give equal results in
any order). Other columns are not looked at. An empty table gives an empty result; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import batches
from millrace.llm.words import mixed
from millrace.session import written

#: Entries of a fingerprint (a power of two), k-mers of a tuple, code points of a k-mer.
ENTRIES, TUPLE, SIZE = 128, 2, 6
#: Candidates that the bound leaves each function on the average.
CANDIDATES = 16
BITS = ENTRIES.bit_length() - 1

_random = np.random.default_rng(20250117)
# The function's number in the first bits, anything behind it.
_FIRSTS = np.arange(ENTRIES, dtype=np.uint64) << np.uint64(64 - BITS)
_RESTS = _random.integers(0, 2**(64 - BITS), ENTRIES, dtype=np.uint64)
_BEHIND = np.uint64(2**(64 - BITS) - 1)
_FUNCTIONS = _FIRSTS | _RESTS
_PLACES = _random.integers(0, 2**63, SIZE + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OCCURRENCE, _ORDER = _PLACES[-2:]

PAIRED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double")
EDGES = f"{PAIRED}, part bigint, place string, text string"


def kmers(text: str) -> np.ndarray:
    """A hash of every k-mer of a text, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = min(SIZE, len(codes))
    n = len(codes) - size + 1 if size else 0
    out = np.zeros(n, np.uint64)
    for p in range(size):
        out += codes[p:p + n] * _PLACES[p]
    return mixed(out + np.uint64(size))


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of k-mer and occurrence, place in the text) of every k-mer.

    K-mers are told apart by the bits of their hash that leave room for the place, so that one sort does.
    """
    bits = np.uint64(max(1, int(len(hashes) - 1).bit_length()))
    packed = np.sort((hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64))
    place = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    kmer = packed >> bits
    new = np.flatnonzero(np.concatenate([[True], kmer[1:] != kmer[:-1]]))
    occurrence = np.arange(len(kmer)) - np.repeat(new, np.diff(new, append=len(kmer)))
    return mixed(hashes[place] + occurrence.astype(np.uint64) * _OCCURRENCE), place


def selected(hashes: np.ndarray) -> np.ndarray:
    """For each function the indices of its smallest hashes, the smallest first; -1 where there are not that many."""
    n, out = len(hashes), np.full((ENTRIES, TUPLE), -1, np.int64)
    owner = hashes >> np.uint64(64 - BITS)
    key = hashes ^ _RESTS[owner.astype(np.intp)]  # the function's number, and the hash that it gives behind that
    near = np.arange(n)
    if n > CANDIDATES * ENTRIES:
        near = np.flatnonzero(key & _BEHIND < np.uint64(CANDIDATES * 2**64 // n))
    near = near[np.argsort(key[near], kind="stable")]
    begin = np.searchsorted(key[near], _FIRSTS)
    enough = np.diff(begin, append=len(near)) >= TUPLE
    out[enough] = near[begin[enough][:, None] + np.arange(TUPLE)]
    rest = np.flatnonzero(~enough)
    for f in rest:
        own = hashes ^ _FUNCTIONS[f]
        some = np.argpartition(own, TUPLE - 1)[:TUPLE] if n > TUPLE else np.arange(n)
        out[f, :len(some)] = some[np.argsort(own[some], kind="stable")]
    return out


def fingerprint(text: str) -> np.ndarray:
    """The entries of a text's fingerprint, 16 bits each."""
    if not text:
        return np.zeros(ENTRIES, np.uint16)
    kmer = kmers(text)
    hashes, place = numbered(kmer)
    chosen = selected(hashes)
    there = chosen >= 0
    places = np.sort(np.where(there, place[chosen], np.iinfo(np.int64).max), axis=1)  # the text's order
    value = np.where(places < len(kmer), kmer[np.minimum(places, len(kmer) - 1)], np.uint64(0))
    entry = np.zeros(ENTRIES, np.uint64)
    for i in range(TUPLE):
        entry = mixed(entry * _ORDER + value[:, i] + np.uint64(i + 1))
    return (entry % np.uint64(2**16 - 1) + np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal entries."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document, without a shuffle."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batches.texts(batch).to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()),
             pa.array([fingerprint(t).tobytes() for t in texts], pa.binary())], ["doc_id", "n_chars", "fingerprint"])

    return batches.map_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text"), run,
                               "doc_id bigint, n_chars bigint, fingerprint binary")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of another, or all of that."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def paired(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    """A row of ``PAIRED``."""
    changed = edited(text, following)
    entries = fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes(),
            entries.tobytes(), likeness(own, entries), likeness(own, other))


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)],
                                      [name for name, _ in fields])


def with_next(docs: DataFrame) -> DataFrame:
    """Every document beside the next one in descending order of ids, behind the last the first:
    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    ``edited`` is the text with its last third replaced by the beginning of the next text. Fingerprints are hexadecimal.
    """
    spark = docs.sparkSession
    batches.bound_batches(spark)
    order = [F.desc_nulls_last("doc_id"), F.asc("hash"), F.asc("row")]
    ordered = (docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
               .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in arriving:
            for piece in batches.slices(batch):
                out = []
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    entries = fingerprint(text)
                    if before is None:
                        out.append((doc_id, None, None, entries.tobytes(), None, None, None, part, "first", text))
                    else:
                        out.append((*paired(*before, text, entries), None, None, None))
                    before = doc_id, text, entries
                yield as_batch(out, EDGES)
        batches.release()
        if before is not None:
            doc_id, text, entries = before
            yield as_batch([(doc_id, None, None, entries.tobytes(), None, None, None, part, "last", text)], EDGES)

    rows = written(ordered.mapInArrow(run, EDGES), "paired")
    # One number for every partition that has rows: bounded by the partitions, and only numbers.
    parts = sorted(r["part"] for r in rows.filter("place = 'first'").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part bigint, after bigint")
    firsts = rows.filter("place = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"),
                                                   F.col("fingerprint").alias("other"))
    edges = (rows.filter("place = 'last'").select("part", "doc_id", "text", "fingerprint")
             .join(following, "part").join(firsts, "after").select("doc_id", "text", "fingerprint", "following", "other"))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text, own, after, other in zip(*(c.to_pylist() for c in batch.columns)):
            own, other = (np.frombuffer(x, np.uint16) for x in (own, other))
            out.append(paired(doc_id, text, own, after, other))
        return as_batch(out, PAIRED)

    done = rows.filter("place IS NULL").drop("part", "place", "text").unionByName(
        batches.map_batches(edges, finish, PAIRED))
    return done.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
