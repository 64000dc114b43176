"""Exact top-k search by inner product, in tiles.

Queries are dealt into blocks and candidates into shards; each (block, shard) is one tile, a matrix product in one
task. A tile keeps the best k of each of its queries, and these lists are merged in a tree, ``FAN`` tiles at a time.
Every query meets every candidate. Each side is copied once per block of the other and not held whole anywhere.

Components become floor(256 * x). Vectors that are null, or hold null, NaN or infinite components, take no part,
nor do those without an id. Vectors of different lengths are not compared. Rows with equal ids are told apart: a
query meets all rows but its own. Ties go to the smaller id. Scores beyond a long stay at its limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import written

QUERIES_PER_BLOCK = 2048
ROWS_PER_SHARD = 1024
FAN = 64
SCALE = 256.0
EXACT = 2.0**53
TILE = "query_id bigint, query_row bigint, tile bigint, vec_id bigint, row bigint, score bigint"


def by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, rows and whole-number vectors of a side of a tile, by the vectors' length, in order of id and row."""
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
    out = {}
    if not table.num_rows:
        return out
    lists = table["embedding"].chunk(0)
    lengths, offsets = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        at = offsets[own][:, None] + np.arange(n)[None, :]
        out[int(n)] = (ids[own], rows[own], np.floor(SCALE * values[at]))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where these can't round, else in Python's whole numbers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    limits = np.iinfo(np.int64)
    return np.clip(whole(a) @ whole(b).T, limits.min, limits.max).astype(np.int64)


def best_of_tile(queries: pa.Table, candidates: pa.Table, tile: int, k: int) -> pa.Table:
    found: list[tuple] = []
    theirs = by_length(candidates)
    for n, (ids, rows, vectors) in by_length(queries).items():
        if n not in theirs:
            continue
        other_ids, other_rows, others = theirs[n]
        scores = products(vectors, others)
        for i in range(len(ids)):
            own = scores[i]
            open_to = np.flatnonzero(other_rows != rows[i])
            own = own[open_to]
            if len(own) > k:
                least = np.partition(own, len(own) - k)[len(own) - k]
                at = np.flatnonzero(own >= least)
            else:
                at = np.arange(len(own))
            at = at[np.argsort(~own[at], kind="stable")][:k]
            found += [(ids[i], rows[i], tile, other_ids[open_to[j]], other_rows[open_to[j]], own[j]) for j in at]
    columns = np.array(found, np.int64).reshape(-1, 6).T
    return pa.Table.from_arrays([pa.array(c) for c in columns],
                                ["query_id", "query_row", "tile", "vec_id", "row", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row that ``is_query`` holds for."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = written(vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"),
                                  vectors["embedding"].cast("array<double>").alias("embedding"),
                                  F.coalesce(is_query, F.lit(False)).alias("asks"))
                   .filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
                   .withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if("asks").alias("queries")).first()
    blocks = max(1, -(-sizes["queries"] // QUERIES_PER_BLOCK))
    shards = max(1, -(-sizes["rows"] // ROWS_PER_SHARD))
    deal, number = F.xxhash64("row"), lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    asked = rows.filter("asks").select("vec_id", "row", "embedding", F.lit(True).alias("asks"),
                                       F.pmod(deal, F.lit(blocks)).alias("block"), F.explode(number(shards)).alias("tile"))
    given = rows.select("vec_id", "row", "embedding", F.lit(False).alias("asks"),
                        F.explode(number(blocks)).alias("block"), F.pmod(deal, F.lit(shards)).alias("tile"))

    def best_of(table: pa.Table) -> pa.Table:
        asks = table["asks"]
        return best_of_tile(table.filter(asks), table.filter(pc.invert(asks)), table["tile"][0].as_py(), k)

    best = asked.unionByName(given).groupBy("block", "tile").applyInArrow(best_of, TILE)
    order = [F.desc("score"), F.asc("vec_id"), F.asc("row")]
    while shards > FAN:
        merged = W.partitionBy("query_id", "query_row", F.expr(f"tile div {FAN}L")).orderBy(*order)
        best = (best.withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k)
                .withColumn("tile", F.expr(f"tile div {FAN}L")).drop("rank"))
        shards = -(-shards // FAN)
    last = W.partitionBy("query_id", "query_row").orderBy(*order)
    return (best.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
