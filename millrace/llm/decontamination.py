"""Documents that hold passages of a benchmark, found by spaced seeds.

A document is contaminated by an item if, with the two laid beside each other at some place, there is a stretch that
has at least ``least`` equal words, or four in five of a shorter item's, and at least four in five equal.

A seed is a mask over a window of words: it hashes the words at its places and ignores the others, so a passage with
words exchanged at ignored places still hits. The masks for items of ``SPAN`` words or more are such that every stretch
as above has a window where one of them is whole, whichever words are exchanged: the first six survive any two exchanged
words in a window of twelve, the others what is left where exchanged words stand closer. Shorter items have masks as
long as they are, of all places but those that one or two exchanged words may stand at; items of four words or fewer
allow none. Hashes of benchmark windows go into a Bloom filter of bounded size; a document's windows that it knows are
joined with the benchmark's hashes, and each hit's diagonal (document place less benchmark place) is verified word by
word: of all its stretches in which no more than one word for each ``LOSS`` equal ones differs, the one with most equal
words counts.

Words are runs of letters and digits (others separate them), in lower case. Items without words find nothing. Null and
empty texts have no words; very long texts are looked through in whole. Equal items are compared once; the smallest
item_id stands for them, null ids behind others. Rows of documents are told apart by their place; equal or null ids are
no matter. Other columns are carried along by ``clean`` and can have any names. An empty table of documents gives an
empty result, an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import batches, words
from millrace.llm.content import HASHES, KEY, text_hashes, without
from millrace.session import written

#: Equal words that make a passage, and how many of them an unequal one needs: at least four in five words are equal.
LEAST = 13
LOSS = 4
#: Words of the longest window.
SPAN = 12
PHASES = tuple(tuple(range(n, SPAN, 4)) for n in range(4))
#: The places that each mask looks at; a mask's window ends with its last place.
MASKS = (*(tuple(sorted(a + b)) for n, a in enumerate(PHASES) for b in PHASES[:n]), (0, 1, 2, 7, 9, 10), (0, 1, 3, 4, 5, 6))
#: Bits of the filter for each benchmark hash, and of the whole filter, as powers of two (2^28 bits: 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 6, 20, 28
FOUND = "row bigint, doc_id bigint, item_id bigint, n_words bigint, n_equal bigint, first_word bigint, last_word bigint"
#: Bytes of text that are looked through at once.
TEXT_BYTES = 4 << 20
#: Between the words of a plain text.
APART = " "


def plain(text: Column) -> Column:
    """The words of a text, one space apart."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", APART))


def seeds(hashes: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask of a span, one after the other: the hashes of all windows that lie within one text, and where they
    begin."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for number, mask in enumerate(masks_of(span)):
        width = mask[-1] + 1
        n = len(hashes) - width + 1
        if n <= 0:
            yield hashes[:0], np.zeros(0, np.int64)
            continue
        own = np.full(n, span * 64 + number, np.uint64)
        for p in mask:
            own += hashes[p:p + n] * words.PLACES[p]
        at = np.flatnonzero(owner[:n] == owner[width - 1:])
        yield words.mixed(own[at]), at


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of the filter that a hash sets."""
    mask = np.uint64((1 << bits) - 1)
    return [(h >> np.uint64(shift)) & mask for h in (hashes, words.mixed(hashes)) for shift in (0, 64 - bits)]


def unequal(n: int) -> int:
    """Words of an item that may be exchanged: one in five."""
    return n // (LOSS + 1)


def masks_of(span: int) -> list[tuple[int, ...]]:
    """The masks for items of ``span`` words, or of ``SPAN`` and more."""
    if span == SPAN:
        return [*MASKS]
    if not unequal(span):
        return [tuple(range(span))]
    # Any so many exchanged words leave two phases whole.
    phases = [range(n, span, unequal(span) + 2) for n in range(unequal(span) + 2)]
    return [tuple(sorted([*a, *b])) for n, a in enumerate(phases) for b in phases[:n]]


def item_seeds(items: DataFrame) -> DataFrame:
    """(hash, item, at): every window of every item of (item, text)."""
    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = words.word_hashes(batch.column("text"))
        rows = []
        for n, item in enumerate(batch.column("item").to_pylist()):
            own = hashes[offsets[n]:offsets[n + 1]]
            span = min(len(own), SPAN)
            if span:
                for h, at in seeds(own, np.array([0, len(own)]), span):
                    rows.append((h.view(np.int64), np.full(len(h), item), at))
        columns = [np.concatenate(c) if rows else np.zeros(0, np.int64) for c in (zip(*rows) if rows else [[], [], []])]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["hash", "item", "at"])

    return batches.map_batches(items.select("item", "text"), found, "hash bigint, item bigint, at bigint")


def bloom(hashed: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of the hashes, of a size between fixed bounds. Its words are made by Spark and or-ed there."""
    n = hashed.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, n)))) + BITS_EACH))

    def bit_numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = batch.column("hash").to_numpy().view(np.uint64)
        at = np.unique(np.concatenate(probes(h, bits)))
        return pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                           pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["w", "b"])

    out = np.zeros(1 << (bits - 6), np.int64)
    ored = batches.map_batches(hashed.select("hash"), bit_numbers, "w bigint, b bigint").groupBy("w").agg(
        F.bit_or("b").alias("b"))
    table = ored.toArrow()
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return out.view(np.uint8), bits


def known(filter_: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter may hold: most fail the first probe, the rest take all."""
    def is_set(bit: np.ndarray) -> np.ndarray:
        return (filter_[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

    at = np.flatnonzero(is_set(hashes & np.uint64((1 << bits) - 1)))
    good = np.ones(len(at), bool)
    for bit in probes(hashes[at], bits):
        good &= is_set(bit)
    return at[good]


def stretches(doc: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int, int]:
    """Most equal words of a stretch, over some diagonals, that has ``LOSS`` equal words for each unequal one, and that
    stretch in the document (end exclusive), without unequal words at its ends."""
    best = (0, 0, 0)
    for d in diagonals:
        a, b = max(0, d), min(len(doc), d + len(item))
        if b - a < 1:
            continue
        equal = doc[a:b] == item[a - d:b - d]
        score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -LOSS))])
        count = np.concatenate([[0], np.cumsum(equal)])
        # For each end, the first start whose score is not above the end's: the longest stretch, so most equal words.
        starts = np.searchsorted(-np.minimum.accumulate(score), -score)
        held = count - count[starts]
        end = int(np.argmax(held))
        n = int(held[end])
        if n > best[0]:
            start = int(starts[end])
            best = (n, a + start + int(np.argmax(equal[start:end])), a + end)
    return best


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, more: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, item_id, n_words, n_equal, first_word, last_word) of every document, of (row, doc_id, text), and
    item that it holds. Only documents with a hit are written, with their words' hashes. ``more`` names bigint columns of
    ``docs`` to carry along.
    """
    spark = docs.sparkSession
    items = benchmark.select(plain(F.col("text")).alias("text"), F.col("item_id").cast("bigint").alias("item_id")).filter(
        "text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id"))
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    hashed = written(item_seeds(items), "item_seeds")
    filter_, bits = bloom(hashed)
    spans = sorted({min(SPAN, r["n"]) for r in items.select(
        F.least(F.size(F.split("text", APART)), F.lit(SPAN)).alias("n")).distinct().collect()})
    sent = spark.sparkContext.broadcast(filter_)

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = words.word_hashes(batch.column("text"))
        found_at, found = [], []
        for span in spans:
            for h, at in seeds(hashes, offsets, span):
                hit = known(sent.value, bits, h)
                found_at.append(at[hit])
                found.append(h[hit])
        at = np.concatenate(found_at) if found_at else np.zeros(0, np.int64)
        hit_hashes = np.concatenate(found) if found else hashes[:0]
        owner = np.searchsorted(offsets, at, side="right") - 1
        order = np.argsort(owner, kind="stable")
        docs_hit, counts = np.unique(owner, return_counts=True)
        hits = batches.offsets_of(counts)
        lengths = np.diff(offsets)[docs_hit]
        own = batches.gather(hashes, offsets[:-1][docs_hit], lengths)
        rows = pa.array(docs_hit)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(rows) for c in ("row", "doc_id", *more)),
             batches.int_lists(own.view(np.int64), batches.offsets_of(lengths)),
             batches.int_lists(hit_hashes[order].view(np.int64), hits),
             batches.int_lists((at - offsets[owner])[order], hits)], ["row", "doc_id", *more, "words", "hashes", "ats"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain(F.col("text")).alias("text"),
                        F.col("row"), *more)
    carried = "".join(f"{c} bigint, " for c in more)
    hit = written(batches.map_batches(texts, look, f"row bigint, doc_id bigint, {carried}words array<bigint>, "
                                                   "hashes array<bigint>, ats array<bigint>", TEXT_BYTES), "hits")
    pairs = (hit.select("row", F.explode(F.arrays_zip("hashes", "ats")).alias("h"))
             .select("row", F.col("h.hashes").alias("hash"), F.col("h.ats").alias("doc_at"))
             .join(hashed, "hash").select("row", "item", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct()
             .groupBy("row", "item").agg(F.collect_list("diagonal").alias("diagonals")))
    # The items' texts come first, to the small pairs; the documents' words are shuffled by document only.
    aligned = (pairs.join(items.select("item", "item_id", "text"), "item")
               .join(hit.select("row", "doc_id", *more, "words"), "row"))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        theirs, offsets = words.word_hashes(batch.column("text"))
        rows = []
        for n, (own, diagonals) in enumerate(zip(batch.column("words"), batch.column("diagonals").to_pylist())):
            item = theirs[offsets[n]:offsets[n + 1]]
            equal, a, b = stretches(own.values.to_numpy().view(np.uint64), item, diagonals)
            if equal >= min(least, len(item) - unequal(len(item))):
                rows.append((n, len(item), equal, a, b))
        columns = np.array(rows, np.int64).reshape(-1, 5).T
        at = pa.array(columns[0])
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(at) for c in (*more, "row", "doc_id", "item_id")), *(pa.array(c) for c in columns[1:])],
            [*more, "row", "doc_id", "item_id", "n_words", "n_equal", "first_word", "last_word"])

    return batches.map_batches(aligned.select("row", "doc_id", *more, "item_id", "text", "words", "diagonals"), verify,
                               carried + FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, keyed: bool = False) -> DataFrame:
    """(row, doc_id, item_id, n_words, n_equal, first_word, last_word): a row for every document and item it holds;
    with ``keyed``, the document's hashes too."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return matches(rows, benchmark, least) if not keyed else matches(
        rows.withColumns(dict(zip(HASHES, text_hashes(F.col("text"))))), benchmark, least, HASHES)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no item.

    What holds an item is told by id and text, which stay the same in every scan, so rows need no numbers and no copy.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("value"))
    bad = written(contaminated(docs, benchmark, least, keyed=True).select(*KEY).distinct(), "contaminated")
    return without(keyed, bad).select("value.*")
