"""A byte-level convolutional network in numpy that scores a whole document's quality.

Filters over ``WIDTH`` bytes are looked up, not multiplied: a filter's weight for a byte at a place is a row of a
table. A document is cut into segments, two neighbours make a chunk, so chunks overlap by half and cover all of it.
Each filter's greatest response in a chunk (at least 0) goes through a hidden layer to a logit, and the mean of the
chunks' logits gives one probability. Only the text's bytes are ever seen.

The network is fitted on the driver from at most ``SAMPLE`` labelled rows of at most ``SAMPLE_BYTES`` each, those
with the smallest hash of doc_id; scoring takes place where the texts are, over all of every text.

Null texts count as empty, which is one chunk of padding. Of labels for one id the greatest counts; labels without
an id or a value do not. Without any label every score is 0.5. Every row is scored, equal or null ids included.
Very long texts are scored chunk by chunk, in whole. Other columns are carried along in a struct and can have any names. An
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import batches

FILTERS, WIDTH, HIDDEN = 16, 6, 16
#: Bytes of half a chunk, the symbol behind the end of a text, and segments worked on at once.
SEGMENT, PAD, AT_ONCE = 256, 256, 64
#: The bounds of the sample that is fitted on.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 16
EPOCHS, BATCH, RATE, DECAY = 12, 32, 4e-3, 1e-5
THRESHOLD = 0.3


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 257 x FILTERS
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def new(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.2, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        table[:, PAD] = 0
        return Network(table, rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
                       rng.normal(0, 0.3, HIDDEN).astype(np.float32), np.zeros(1, np.float32))

    def responses(self, symbols: np.ndarray) -> np.ndarray:
        """Each filter at each place of some segments (n + WIDTH - 1 symbols): n x FILTERS."""
        n = len(symbols) - WIDTH + 1
        out = self.table[0].take(symbols[:n], axis=0)
        for j in range(1, WIDTH):
            out += self.table[j].take(symbols[j:j + n], axis=0)
        return out

    def segment_maxima(self, symbols: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest response of each filter in each segment, and where, if ``places``."""
        n = (len(symbols) - WIDTH + 1) // SEGMENT
        best, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if places else None
        for a in range(0, n, AT_ONCE):
            b = min(n, a + AT_ONCE)
            got = self.responses(symbols[a * SEGMENT:b * SEGMENT + WIDTH - 1]).reshape(b - a, SEGMENT, FILTERS)
            if places:
                at = got.argmax(axis=1)
                best[a:b] = np.take_along_axis(got, at[:, None, :], axis=1)[:, 0]
                where[a:b] = at + (np.arange(a, b) * SEGMENT)[:, None]
            else:
                best[a:b] = got.max(axis=1)
        return best, where

    def chunk_logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        symbols, segments = lay_out(texts)
        best, _ = self.segment_maxima(symbols)
        pooled, chunks = chunked(np.maximum(best, 0), segments)
        logits = np.add.reduceat(self.chunk_logits(pooled).astype(np.float64), chunks[:-1]) / np.diff(chunks)
        return 1 / (1 + np.exp(-logits))


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each text padded to whole segments (one at least), and where its segments begin."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    segments = batches.offsets_of(np.maximum(1, -(-lengths // SEGMENT)))
    symbols = np.full(segments[-1] * SEGMENT + WIDTH - 1, PAD, np.int16)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.repeat(segments[:-1] * SEGMENT - (np.cumsum(lengths) - lengths), lengths)
    symbols[at + np.arange(len(data))] = data
    return symbols, segments


def chunked(best: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two neighbouring segments make a chunk; a text of one segment has one chunk."""
    counts = np.diff(segments)
    chunks = batches.offsets_of(np.maximum(1, counts - 1))
    first = batches.gather(np.arange(len(best)), segments[:-1], np.diff(chunks))
    last_of = np.repeat(segments[1:] - 1, np.diff(chunks))
    return np.maximum(best[first], best[np.minimum(first + 1, last_of)]), chunks


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> Network:
    """Minimise the cross entropy with Adam; only the places of the maxima pass gradients to the filters."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    if not len(texts):
        net.w2[:] = 0
        return net
    net.b2[:] = np.log((labels.mean() + 1e-2) / (1 - labels.mean() + 1e-2))
    names = ("table", "w1", "b1", "w2", "b2")
    first, second, step = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2)), 0, 0
    first, second = first
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            own = order[a:a + BATCH]
            grads = gradients(net, [texts[i] for i in own], labels[own])
            step += 1
            for n in names:
                value, g = getattr(net, n), grads[n]
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                value -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
            net.table *= 1 - DECAY
            net.table[:, PAD] = 0
    return net


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    symbols, segments = lay_out(texts)
    best, where = net.segment_maxima(symbols, places=True)
    counts = np.diff(segments)
    chunks = batches.offsets_of(np.maximum(1, counts - 1))
    first = batches.gather(np.arange(len(best)), segments[:-1], np.diff(chunks))
    second = np.minimum(first + 1, np.repeat(segments[1:] - 1, np.diff(chunks)))
    left = best[first] >= best[second]
    pooled = np.where(left, best[first], best[second])
    at = np.where(left, where[first], where[second])
    active = np.maximum(pooled, 0)
    hidden = active @ net.w1 + net.b1
    shown = np.maximum(hidden, 0)
    sizes = np.diff(chunks)
    logits = np.add.reduceat(shown @ net.w2 + net.b2[0], chunks[:-1]) / sizes
    error = (1 / (1 + np.exp(-logits)) - labels) / len(texts)
    d_logit = np.repeat(error / sizes, sizes).astype(np.float32)
    d_hidden = d_logit[:, None] * net.w2[None, :] * (hidden > 0)
    d_pooled = (d_hidden @ net.w1.T) * (pooled > 0)
    table = np.zeros_like(net.table)
    rows, filters = np.nonzero(d_pooled)
    for j in range(WIDTH):
        np.add.at(table[j], (symbols[at[rows, filters] + j], filters), d_pooled[rows, filters])
    return {"table": table, "w1": active.T @ d_hidden, "b1": d_hidden.sum(axis=0), "w2": shown.T @ d_logit,
            "b2": np.array([d_logit.sum()], np.float32)}


def held_out(doc_id: Column) -> Column:
    """One document in five is never learned from; those without an id are not either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """The network fitted on labelled rows of ``docs`` that are not held out."""
    chosen = (labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("quality"))
              .filter(F.col("quality").isNotNull() & ~held_out(F.col("id")))
              .groupBy("id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(sample))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("id"), text.alias("text"))
            .filter(F.octet_length("text") <= SAMPLE_BYTES).join(chosen, "id")
            .select("id", "text", "quality").orderBy(F.xxhash64("id"), "text").limit(sample).collect())
    return fit([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], np.float32))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(value, score): every row as a struct, and the probability that its quality is 1."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("value")).select(
        "value", F.col("value.text").alias("text"))

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        # A few texts at a time: the responses of a segment take sixty times its bytes.
        out = [net.scores(batches.as_bytes(batches.texts(part))) for part in batches.slices(batch, 1 << 20)]
        return pa.RecordBatch.from_arrays([batch.column("value"), pa.array(np.concatenate(out))], ["value", "score"])

    return batches.map_batches(rows, scored, T.StructType([rows.schema["value"], T.StructField("score", T.DoubleType())]))
