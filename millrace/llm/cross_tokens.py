"""Alignment of two tokenizers' tokens over the same bytes, by merge paths.

Both tokenizers cut the same bytes, so aligning them is merging two sorted lists of ends. The merge is divided along
diagonals: where the path of a merge crosses a diagonal is found by a binary search, for all diagonals at once, so the
merge falls into pieces of equal work that need nothing of each other. A piece gives the overlaps (links) between its
tokens and where both sides end. An end that a diagonal has parted, one side's in each piece, is put together when the
pieces are stitched; ends of both sides cut a text into groups.

How many documents hold a pair of ids linked is counted over the corpus. A document's pairs are numbers into a
dictionary of its chunk (the documents that a task holds at once), so only the dictionaries, which are small against
the texts, are shuffled by pair; they come back with the counts, and documents meet the dictionary of their chunk.

Texts that are null or empty, or whose tokens of either side do not stand for a space and the text, have no tokens:
all numbers are 0 and the digest is the empty text. A very long text is a chunk of its own, merged piece by piece.
Every row is a document of its own, whatever its id. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import batches, pretokens
from millrace.session import written

#: Bytes of text that are aligned at once, and of a chunk.
TEXT_BYTES, CHUNK_BYTES = 2 << 20, 12 << 20
#: Ends that a piece of the merge has, of both sides together.
WORK = 1 << 16


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` ends of the merge are from ``a``, for every diagonal ``d``; of equal ends, ``a``'s
    come first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        own = middle[open_]
        ahead = a[own] <= b[diagonals[open_] - own - 1]
        low[open_] = np.where(ahead, own + 1, low[open_])
        high[open_] = np.where(ahead, high[open_], own)
    return low


def piece(a: np.ndarray, b: np.ndarray, a0: int, b0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b, end, whether both end there) for every end of a piece, in order; ``a0`` and ``b0`` are
    the numbers of the piece's first tokens."""
    in_b = np.searchsorted(b, a)
    both = np.zeros(len(a), bool)
    inside = in_b < len(b)
    both[inside] = b[in_b[inside]] == a[inside]
    only_b = np.ones(len(b), bool)
    only_b[in_b[both]] = False
    rest = np.flatnonzero(only_b)
    tokens_a = np.concatenate([np.arange(len(a)), np.searchsorted(a, b[rest])])
    tokens_b = np.concatenate([in_b, rest])
    order = np.argsort(tokens_a + tokens_b, kind="stable")  # grows with every end
    ends = np.concatenate([a, b[rest]])[order]
    return tokens_a[order] + a0, tokens_b[order] + b0, ends, np.concatenate([both, np.zeros(len(rest), bool)])[order]


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b, whether both end with it) for every overlap of two lists of ends with a common last."""
    diagonals = np.minimum(np.arange(0, len(a) + len(b) + work, work), len(a) + len(b))
    from_a = crossings(a, b, diagonals)
    from_b = diagonals - from_a
    found, last = [], -1
    for a0, a1, b0, b1 in zip(from_a[:-1], from_a[1:], from_b[:-1], from_b[1:]):
        left, right, ends, both = piece(a[a0:a1], b[b0:b1], a0, b0)
        if len(ends) and ends[0] == last:  # this end of b meets the end of a that closed the piece before
            found[-1][2][-1] = True
            left, right, ends, both = left[1:], right[1:], ends[1:], both[1:]
        if len(ends):
            last = ends[-1]
            found.append((left, right, both))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


class PieceWords:
    """Ids of a sentencepiece vocabulary, worked out once per distinct word.

    No piece holds a line end beside another character, nor a space behind one, so texts are cut before line ends and
    before single spaces. Texts with other spaces (double, leading, trailing, beside a line end) go to the library whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = self.library.id_to_piece(list(range(n)))
        self.entries = [bytes([int(name[3:5], 16)]) if self.library.is_byte(i) else name.replace("▁", " ").encode()
                        for i, name in enumerate(names)]
        self.memory = pretokens.Memory(self.encode)

    def encode(self, words: list[str]) -> list[list[int]]:
        # The library puts a space before what it gets; a line end has none. -1 marks a text that can't be cut here.
        ids = self.library.encode([w or "\n" for w in words], num_threads=1)
        return [own[1:] if w[:1] == "\n" else own if w else [-1] for w, own in zip(words, ids)]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words = batches.offsets_of(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        codes = self.memory.codes(lists.flatten())
        lengths = self.memory.lengths[codes]
        ids = batches.gather(self.memory.pool, self.memory.starts[codes], lengths)
        offsets = batches.offsets_of(batches.sums(lengths, words))
        whole = np.flatnonzero(batches.sums(ids < 0, offsets))
        return pretokens.replaced(ids, offsets, whole, self.library.encode(texts.take(pa.array(whole)).to_pylist(),
                                                                           num_threads=1))


@lru_cache(maxsize=2)
def piece_words(path: str) -> PieceWords:
    """One per worker."""
    return PieceWords(path)


@dataclass
class Tokens:
    """Tokens of a side over a batch of texts: ids, where each text's begin, and where each token ends in all bytes."""

    ids: np.ndarray
    offsets: np.ndarray
    ends: np.ndarray

    def without(self, lost: np.ndarray, sizes: np.ndarray) -> Tokens:
        """The same without the tokens of some texts."""
        lengths = np.where(lost, 0, np.diff(self.offsets))
        ids = batches.gather(self.ids, self.offsets[:-1], lengths)
        return Tokens(ids, batches.offsets_of(lengths), np.cumsum(sizes[ids]))


class Side:
    """A vocabulary: the bytes of every id, and the ids as decimal numbers."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array(list(map(len, entries)), np.int64)
        self.starts = batches.offsets_of(self.sizes)[:-1]
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        digits = [b"%d," % n for n in range(len(entries))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_sizes = np.array(list(map(len, digits)), np.int64)
        self.digit_starts = batches.offsets_of(self.digit_sizes)[:-1]

    def tokens(self, ids: np.ndarray, offsets: np.ndarray) -> Tokens:
        return Tokens(ids, offsets, np.cumsum(self.sizes[ids]))

    def differs(self, tokens: Tokens, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the tokens don't stand for; ``data`` holds the bytes they should stand for."""
        lengths = batches.sums(self.sizes[tokens.ids], tokens.offsets)
        wrong = lengths != np.diff(offsets)
        mine = batches.gather(self.bytes, self.starts[tokens.ids], self.sizes[tokens.ids])
        if not wrong.any():
            return batches.sums(mine != data, offsets) > 0
        begins = batches.offsets_of(lengths)
        for n in np.flatnonzero(~wrong):
            wrong[n] = not np.array_equal(mine[begins[n]:begins[n + 1]], data[offsets[n]:offsets[n + 1]])
        return wrong


@lru_cache(maxsize=2)
def side_a(path: str) -> Side:
    return Side(pretokens.entries(path))


@lru_cache(maxsize=2)
def side_b(path: str) -> Side:
    return Side(piece_words(path).entries)


def spaced_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a space and each text, and where each begins."""
    spaced = pc.binary_join_element_wise(" ", texts, "")
    offsets = np.frombuffer(spaced.buffers()[1], np.int32, len(spaced) + 1).astype(np.int64)
    return np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def group_digests(a: Tokens, b: Tokens, side_a: Side, side_b: Side, common_a: np.ndarray, common_b: np.ndarray) -> list[str]:
    """The digest of each text's groups, written as ``a1,a2|b1;a3|b2,b3``; the empty text where there are no tokens."""
    ends_a, ends_b = np.append(np.flatnonzero(common_a), -1), np.append(np.flatnonzero(common_b), -1)
    group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
    # Where a token stands when every group has its tokens of a first: behind all tokens of b of the groups before it,
    # or all tokens of a up to its own group.
    place_a = np.arange(len(a.ids)) + np.where(group_a > 0, ends_b[group_a - 1] + 1, 0)
    place_b = np.arange(len(b.ids)) + ends_a[group_b] + 1
    n = len(a.ids) + len(b.ids)
    starts, sizes, signs = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.uint8)
    for place, tokens, side, common, sign, begin in ((place_a, a, side_a, common_a, b"|", 0),
                                                     (place_b, b, side_b, common_b, b";", len(side_a.digits))):
        starts[place], sizes[place] = side.digit_starts[tokens.ids] + begin, side.digit_sizes[tokens.ids]
        signs[place] = np.where(common, ord(sign), ord(","))
    text = batches.gather(np.concatenate([side_a.digits, side_b.digits]), starts, sizes)
    ends = np.cumsum(sizes)
    text[ends - 1] = signs
    raw, at = memoryview(text), np.append(0, ends)[a.offsets + b.offsets]
    return [hashlib.sha256(raw[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


#: A row for each document, with the numbers of its pairs in its chunk's dictionary and how often it holds each; and
#: one for each chunk, with the dictionary and how many of the chunk's documents hold each pair.
ALIGNED = ("chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "numbers binary, times binary, pairs array<bigint>, holders array<bigint>")


class Aligner:
    """Aligns texts and puts the pairs of a chunk's documents into its dictionary."""

    def __init__(self, path_a: str, path_b: str, work: int = WORK):
        self.words_a, self.words_b = pretokens.spaced_words(path_a, plain=True, spaced=True), piece_words(path_b)
        self.a, self.b, self.work = side_a(path_a), side_b(path_b), work
        self.width = len(self.b.sizes)

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers and digests of each text, pairs of all texts, times of each, where each text's begin)."""
        a, b = self.a.tokens(*self.words_a(texts)), self.b.tokens(*self.words_b(texts))
        data, offsets = spaced_bytes(texts)
        lost = (np.diff(offsets) == 1) | self.a.differs(a, data, offsets) | self.b.differs(b, data, offsets)
        if lost.any():
            a, b = a.without(lost, self.a.sizes), b.without(lost, self.b.sizes)
        left, right, both = merged(a.ends, b.ends, self.work)
        doc = np.searchsorted(a.offsets[1:], left, side="right")
        n = len(texts)
        n_links, n_groups = np.bincount(doc, minlength=n), np.bincount(doc[both], minlength=n)
        common_a, common_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        common_a[left[both]] = True
        common_b[right[both]] = True
        digests = group_digests(a, b, self.a, self.b, common_a, common_b)
        # A document's pairs in order, with how often each stands there.
        shift = (len(self.a.sizes) * self.width).bit_length()
        keys = np.sort(doc << shift | (a.ids[left].astype(np.int64) * self.width + b.ids[right]))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(first, append=len(keys))
        keys = keys[first]
        begins = np.searchsorted(keys, np.arange(n + 1) << shift)
        rows = (np.diff(a.offsets), np.diff(b.offsets), n_groups, n_links, digests)
        return rows, keys & ((1 << shift) - 1), times, begins


def smallest(values: np.ndarray) -> np.ndarray:
    """The same numbers, none below 0, in as few bytes as hold them."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def chunk_rows(chunk: int, held: list[tuple]) -> pa.RecordBatch:
    """The rows of a chunk's documents, and of its dictionary."""
    ids, aligned, pairs, times, begins = zip(*held)
    lengths = np.concatenate([np.diff(x) for x in begins])
    dictionary, numbers = np.unique(np.concatenate(pairs), return_inverse=True)
    holders, times = np.bincount(numbers, minlength=len(dictionary)), np.concatenate(times)
    numbers = numbers.astype("<u2" if len(dictionary) <= 1 << 16 else "<u4")
    at = batches.offsets_of(lengths).tolist()
    n = len(lengths)
    columns = [pa.array([chunk] * (n + 1), pa.int64()), pa.array([x for own in ids for x in own] + [None], pa.int64())]
    columns += [pa.array(np.concatenate([x[c] for x in aligned]).tolist() + [None], pa.int64()) for c in range(4)]
    columns.append(pa.array([d for x in aligned for d in x[4]] + [None], pa.string()))
    columns.append(pa.array([numbers[x:y].tobytes() for x, y in zip(at[:-1], at[1:])] + [None], pa.binary()))
    columns.append(pa.array([smallest(times[x:y]).tobytes() for x, y in zip(at[:-1], at[1:])] + [None], pa.binary()))
    columns += [pa.array([None] * n + [x], pa.list_(pa.int64())) for x in (dictionary, holders)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``ALIGNED`` rows of all documents."""
    batches.bound_batches(docs.sparkSession)

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in arriving:
            for part in batches.slices(batch, TEXT_BYTES):
                texts = batches.texts(part)
                held.append((part.column("doc_id").to_pylist(), *aligner(path_a, path_b)(texts)))
                size += pc.sum(pc.binary_length(texts)).as_py() or 0
                if size >= chunk_bytes:
                    yield chunk_rows(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield chunk_rows(chunk, held)
        batches.release()

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


RESULT = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
          "groups_sha256 string")


def with_counts(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's documents with the counts that came back for its dictionary."""
    docs, answers = docs.combine_chunks(), answers.sort_by("number")
    count = answers["count"].to_numpy()
    best = np.where(answers["is_best"].to_numpy(zero_copy_only=False), 1, 0)
    n_best, count_sum = [], []
    for numbers, times in zip(docs["numbers"].to_pylist(), docs["times"].to_pylist()):
        numbers = np.frombuffer(numbers, "<u2" if len(count) <= 1 << 16 else "<u4")
        times = np.frombuffer(times, f"<u{len(times) // len(numbers) if len(numbers) else 1}").astype(np.int64)
        n_best.append(int((best[numbers] * times).sum()))
        count_sum.append(int((count[numbers] * times).sum()))
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({c: columns[c] for c in (f.split()[0] for f in RESULT.split(", "))})


def align(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents with their numbers (``RESULT``), and all linked pairs of ids:
    (a_id, b_id, count, is_best), the count of documents that hold the pair linked.

    ``path_a`` is a byte-level vocabulary of the tokenizers library, given a space and the text; ``path_b`` one of
    sentencepiece, which puts that space itself. ``is_best`` marks the pairs with their a id's highest count.
    """
    rows = written(aligned(docs, path_a, path_b, chunk_bytes), "aligned")
    held = (rows.filter("pairs IS NOT NULL")
            .select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("number", "entry"))
            .select("chunk", "number", F.col("entry.pairs").alias("pair"), F.col("entry.holders").alias("holders")))
    width = F.lit(len(side_b(path_b).sizes)).cast("bigint")
    counts = (held.groupBy("pair").agg(F.sum("holders").alias("count"))
              .select("pair", F.call_function("div", F.col("pair"), width).alias("a_id"),
                      F.pmod("pair", width).alias("b_id"), "count"))
    counts = written(counts, "counts")
    # A row for each id of the first vocabulary at most.
    highest = F.broadcast(counts.groupBy("a_id").agg(F.max("count").alias("highest")))
    pairs = counts.join(highest, "a_id").withColumn("is_best", F.col("count") == F.col("highest")).drop("highest")
    answers = held.join(pairs, "pair").select(F.col("chunk").alias("for_chunk"), "number", "count", "is_best")
    columns = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "numbers", "times"]
    result = (rows.filter("pairs IS NULL").select(*columns).groupBy("chunk").cogroup(answers.groupBy("for_chunk"))
              .applyInArrow(with_counts, RESULT))
    return result, pairs.select("a_id", "b_id", "count", "is_best")
