"""Hard negatives by summaries of vector segments.

A vector is cut into segments, and each segment's mean and deviation are stored beside it. The inner product of two
segments of n components is n times the product of their means, give or take n times the product of their deviations
(Cauchy and Schwarz), so sums over segments bound a score from both sides. Bounds start with whole vectors and are
refined by halving the segments; only pairs that no bound has ruled out are scored exactly.

1. Positives: anchors meet the rows of their label, in tiles of a block of anchors and a shard of rows.
2. Negatives: anchors meet all rows of other labels, with the range of scores that each of their positives leaves open.

A tile takes its rows in slices and carries its best scores along, so that what can still count gets less on the way. The best of every
tile are ranked per anchor, with a limit before the shuffle. Every anchor meets every row; ties are kept until the
smaller id decides.

Components become floor(256 * x). Rows with a null id or label, or a vector that is null or holds null, NaN or infinite
components, take no part; empty vectors have score 0. Vectors of different lengths are not compared. Rows with equal
ids are told apart: an anchor meets all rows but its own. Scores beyond a long stay at its limits. Other columns are
not looked at. Very long vectors make larger tiles. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import batches
from millrace.session import written

ANCHORS_PER_BLOCK = 512
ROWS_PER_SHARD = 8192
#: Rows of a tile that are bounded at once, of the first of them, and components of the smallest segments.
SLICE, FIRST_SLICE, LEAST = 2048, 256, 2
SCALE, EXACT = 256.0, 2.0**53
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
PREPARED = ("vec_id bigint, row bigint, label bigint, asks boolean, vector array<double>, means array<double>, "
            "deviations array<double>")
FOUND = "anchor_id bigint, anchor_row bigint, probe bigint, vec_id bigint, row bigint, score bigint"


def segment_starts(length: int, halvings: int) -> np.ndarray:
    """Where the segments begin after so many halvings; those of one halving more lie inside these."""
    return np.arange(2**halvings) * length >> halvings


def halvings_of(length: int) -> int:
    """Halvings until segments are about to get shorter than ``LEAST``."""
    return max(0, int(np.log2(length // LEAST))) if length >= LEAST else 0


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the smallest segments of every row."""
    length = vectors.shape[1]
    if not length:
        return np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1))
    starts = segment_starts(length, halvings_of(length))
    n = np.diff(starts, append=length)
    means = np.add.reduceat(vectors, starts, axis=1) / n
    apart = vectors - np.repeat(means, n, axis=1)
    return means, np.sqrt(np.add.reduceat(apart * apart, starts, axis=1) / n)


def prepared(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """The rows that take part, numbered, with whole components and the summaries of their segments."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["label"].cast("bigint").alias("label"),
                           vectors["embedding"].cast("array<double>").alias("embedding"),
                           F.coalesce(is_anchor, F.lit(False)).alias("asks"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
            .withColumn("row", F.monotonically_increasing_id()))

    def summarise(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        with np.errstate(over="ignore"):
            for x in batch.column("embedding"):
                vector = np.floor(SCALE * x.values.to_numpy(zero_copy_only=False).astype(np.float64))[None, :]
                out.append((vector[0], *(s[0] for s in summaries(vector))))
        lists = [batches.float_lists([o[i] for o in out]) for i in range(3)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "row", "label", "asks")), *lists],
                                          [c.split()[0] for c in PREPARED.split(", ")])

    return written(batches.map_batches(rows, summarise, PREPARED), "vectors")


@dataclass
class Side:
    """The vectors of one length on a side of a tile, in order of id and row."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    at: np.ndarray  # in the sorted table

    def part(self, which: slice) -> Side:
        return Side(*(getattr(self, f)[which] for f in self.__dataclass_fields__))

    def level(self, halvings: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations after so many halvings, times the root of the segments' lengths."""
        length = self.vectors.shape[1]
        finest = segment_starts(length, halvings_of(length))
        n = np.diff(finest, append=length).astype(np.float64)
        within = np.searchsorted(finest, segment_starts(length, halvings))
        total = np.add.reduceat(n, within)
        mean = np.add.reduceat(n * self.means, within, axis=1) / np.maximum(total, 1)
        square = np.add.reduceat(n * (self.deviations**2 + self.means**2), within, axis=1) / np.maximum(total, 1)
        root = np.sqrt(total)
        return mean * root, np.sqrt(np.maximum(square - mean**2, 0)) * root


def sides(table: pa.Table) -> Iterator[tuple[int, Side]]:
    """(length, vectors) of a side of a tile."""
    if not table.num_rows:
        return
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
    lengths = pc.list_value_length(table["vector"]).to_numpy(zero_copy_only=False)
    fixed = [table[c].to_numpy() for c in ("vec_id", "row", "label")]
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        part = table.take(pa.array(own))
        wide = [pc.list_flatten(part[c]).to_numpy(zero_copy_only=False).reshape(len(own), -1 if n else 0 if c == "vector" else 1)
                for c in ("vector", "means", "deviations")]
        yield int(n), Side(*(f[own] for f in fixed), *wide, own)


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in Python's whole numbers, for components too large for doubles."""
    whole = np.vectorize(int, otypes=[object])
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    return np.clip(whole(a) @ whole(b).T, LOWEST, HIGHEST).astype(np.int64)


def scored(a: Side, b: Side, alive: np.ndarray, floor: np.ndarray,
           top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs in ``alive`` whose score lies from ``floor`` to ``top`` of their anchor, out of bounds
    that get closer; ``alive`` keeps those that were scored."""
    length = a.vectors.shape[1]
    biggest = np.abs(a.vectors).max(initial=0) * np.abs(b.vectors).max(initial=0)
    if not biggest * max(length, 1) < EXACT:
        i, j = np.nonzero(alive)
        return i, j, whole_products(a.vectors, b.vectors)[i, j]
    floor, top = floor.astype(np.float64), top.astype(np.float64)
    r, c = np.arange(len(a.ids)), np.arange(len(b.ids))
    for halvings in range(halvings_of(length) + 1):
        r, c = r[alive[np.ix_(r, c)].any(axis=1)], c[alive[np.ix_(r, c)].any(axis=0)]
        if not len(r) or not len(c) or not length:
            break
        (ma, da), (mb, db) = a.part(r).level(halvings), b.part(c).level(halvings)
        middle, reach = ma @ mb.T, da @ db.T
        # Room for rounding.
        reach += 1e-9 * (np.abs(ma) @ np.abs(mb).T + reach) + 1e-6
        still = alive[np.ix_(r, c)]
        still &= (middle + reach >= floor[r][:, None]) & (middle - reach <= top[r][:, None])
        alive[np.ix_(r, c)] = still
    i, j = np.nonzero(alive)
    if len(i) * 8 > len(r) * len(c):
        place_r, place_c = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        place_r[r], place_c[c] = np.arange(len(r)), np.arange(len(c))
        scores = (a.vectors[r] @ b.vectors[c].T)[place_r[i], place_c[j]]
    else:
        step = max(1, (4 << 20) // max(length, 1))
        scores = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a.vectors[i[s:s + step]], b.vectors[j[s:s + step]])
                                                for s in range(0, len(i), step))])
    keep = (scores >= floor[i]) & (scores <= top[i])
    return i[keep], j[keep], scores[keep].astype(np.int64)


class Probes:
    """Ranges of scores, each of one anchor, and the best ``k`` (score, id, row) found for each so far."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.best = np.zeros((4, 0), np.int64)  # probe, score, id, row
        self.least = low.copy()

    def floors(self, anchors: int) -> tuple[np.ndarray, np.ndarray]:
        """The least score that can still count, and the greatest, of every anchor."""
        floor, top = np.full(anchors, HIGHEST), np.full(anchors, LOWEST)
        np.minimum.at(floor, self.anchor, self.least)
        np.maximum.at(top, self.anchor, self.high)
        return floor, top

    def add(self, i: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((rows, ids, ~scores, i))
        i, scores, ids, rows = i[order], scores[order], ids[order], rows[order]
        begins, ends = np.searchsorted(i, self.anchor), np.searchsorted(i, self.anchor, side="right")
        found = [self.best]
        for probe in np.flatnonzero(begins < ends):
            own = scores[begins[probe]:ends[probe]]
            first = np.searchsorted(~own, ~self.high[probe])
            last = min(first + self.k, np.searchsorted(~own, ~self.low[probe], side="right"))
            if first < last:
                at = slice(begins[probe] + first, begins[probe] + last)
                found.append(np.stack([np.full(last - first, probe), scores[at], ids[at], rows[at]]))
        best = np.concatenate(found, axis=1)
        best = best[:, np.lexsort((best[3], best[2], ~best[1], best[0]))]
        place = np.arange(best.shape[1]) - np.searchsorted(best[0], best[0])
        self.best = best[:, place < self.k]
        full = best[:, place == self.k - 1]
        self.least[full[0]] = full[1]


def slices_of(n: int) -> Iterator[tuple[int, int]]:
    """Slices of a tile's rows, a small one first: what it finds rules pairs out in the others."""
    begin, size = 0, FIRST_SLICE
    while begin < n:
        yield begin, min(begin + size, n)
        begin, size = begin + size, SLICE


def best_of_tile(anchors: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    """The best ``k`` of the tile for every probe of its anchors; rows of the same label, or of others."""
    out = []
    theirs = dict(sides(rows))
    anchors = anchors.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
    lists = anchors["probes"].to_pylist()
    for n, a in sides(anchors):
        if n not in theirs:
            continue
        own = [(m, p) for m, at in enumerate(a.at) for p in lists[at] or []]
        probes = Probes(*(np.array(x, np.int64) for x in ([m for m, _ in own], [p["low"] for _, p in own],
                                                          [p["high"] for _, p in own])), k)
        for begin, end in slices_of(len(theirs[n].ids)):
            b = theirs[n].part(slice(begin, end))
            alive = (a.labels[:, None] == b.labels[None, :]) == same
            alive &= a.rows[:, None] != b.rows[None, :]
            i, j, scores = scored(a, b, alive, *probes.floors(len(a.ids)))
            probes.add(i, scores, b.ids[j], b.rows[j])
        probe, score, ids, found_rows = probes.best
        at, number = probes.anchor[probe], np.array([p["probe"] for _, p in own], np.int64)
        out.append(np.stack([a.ids[at], a.rows[at], number[probe], ids, found_rows, score]))
    columns = np.concatenate([np.zeros((6, 0), np.int64), *out], axis=1)
    return pa.Table.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in FOUND.split(", ")])


def in_tiles(asked: DataFrame, given: DataFrame, keys: list[str], same: bool, k: int) -> DataFrame:
    """The best of all tiles; both sides carry ``block`` and ``tile``."""
    names = ["vec_id", "row", "label", "vector", "means", "deviations", *[x for x in keys if x != "label"], "block", "tile"]
    none = F.lit(None).cast(asked.schema["probes"].dataType).alias("probes")
    both = (asked.select(*names, "probes", F.lit(True).alias("asks"))
            .unionByName(given.select(*names, none, F.lit(False).alias("asks"))))

    def best(table: pa.Table) -> pa.Table:
        asks = table["asks"]
        return best_of_tile(table.filter(asks), table.filter(pc.invert(asks)), same, k)

    return both.groupBy(*keys, "block", "tile").applyInArrow(best, FOUND)


def numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_row", "probe").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("row"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50,
         high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best other rows of the same label. For each of them come the best rows of other labels
    whose score is from ``low`` to ``high`` percent of the positive's. ``vectors`` has vec_id, embedding and label.
    """
    rows = prepared(vectors, is_anchor)
    deal = F.xxhash64("row")
    per = lambda n, most: F.ceil(F.col(n) / most)
    every = F.array(F.struct(F.lit(0).cast("bigint").alias("probe"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).filter("asked > 0")
    of_label = rows.join(counts, "label").withColumns(
        {"blocks": per("asked", ANCHORS_PER_BLOCK), "shards": per("n", ROWS_PER_SHARD)})
    asked = of_label.filter("asks").select("*", every.alias("probes"), F.pmod(deal, "blocks").alias("block"),
                                           numbers(F.col("shards")).alias("tile"))
    given = of_label.select("*", F.pmod(deal, "shards").alias("tile"), numbers(F.col("blocks")).alias("block"))
    best = written(ranked(in_tiles(asked, given, ["label"], True, positives), positives).select(
        "anchor_id", "anchor_row", F.col("rank").cast("bigint").alias("probe"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")

    # Whole numbers all the way: ceil(low * score / 100) and floor(high * score / 100), in decimals that hold them.
    percent = F.col("positive_score").cast("decimal(28,0)")
    ranges = best.select("anchor_row", "probe", F.ceil(percent * low / F.lit(100).cast("decimal(3,0)")).alias("low"),
                         F.floor(percent * high / F.lit(100).cast("decimal(3,0)")).alias("high")).filter("low <= high")
    probes = ranges.groupBy("anchor_row").agg(F.collect_list(F.struct(
        "probe", F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"))).alias("probes"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).first()
    blocks, shards = (F.lit(max(1, -(-sizes[c] // most))).cast("bigint")
                      for c, most in (("asked", ANCHORS_PER_BLOCK), ("n", ROWS_PER_SHARD)))
    asked = (rows.filter("asks").join(probes.withColumnRenamed("anchor_row", "row"), "row")
             .select("*", F.pmod(deal, blocks).alias("block"), numbers(shards).alias("tile")))
    given = rows.select("*", F.pmod(deal, shards).alias("tile"), numbers(blocks).alias("block"))
    found = ranked(in_tiles(asked, given, [], False, negatives), negatives)
    return (found.join(best.select("anchor_row", "probe", "positive_id", "positive_score"), ["anchor_row", "probe"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
