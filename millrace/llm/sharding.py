"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. DataFrame functions only.

How many rows of a partition go to a shard is drawn first, from the distribution that a uniform shuffle of all rows
would give (multivariate hypergeometric): all partitions' rows are halved again and again, and every half gets its
share of each shard's room by exact inversion. Then each partition permutes its rows and cuts them by its row of the
matrix, rows are exchanged once, and each shard permutes again in blocks of random keys, so that no task gets a
whole shard. Every row goes to one place; a lost executor repeats the same draws, since these hash fixed numbers.

Rows are told apart by their place in the input, so equal rows and equal or null ids are no matter. Shard sizes are
at most one apart. Other columns travel in a struct and can have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import written, written_counting

#: Blocks of a shard for its second permutation, as a power of two at least, and rows of a block: a larger table has more.
BLOCK_BITS, ROWS_PER_BLOCK = 10, 4096


def let(name: str, value: str, body: str) -> str:
    """SQL that works ``value`` out once and uses it under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for one draw: how many of ``drawn`` rows are among the ``marked`` of ``total``; all are doubles.

    Weights relative to the mode follow from each other outwards, for nine standard deviations and 64 steps more
    (or the whole support); the draw inverts their sum, taking values by turns above and below the mode.
    """
    up = "a.up * (p.m - (p.mode + i) + 1) * (p.d - (p.mode + i) + 1) / ((p.mode + i) * (p.t - p.m - p.d + p.mode + i))"
    down = ("a.down * (p.mode - i + 1) * (p.t - p.m - p.d + p.mode - i + 1) "
            "/ ((p.m - (p.mode - i)) * (p.d - (p.mode - i)))")
    summed = (f"aggregate(sequence(1L, p.steps), named_struct('up', 1D, 'down', 1D, 'sum', 1D), (a, i) -> "
              + let("b", f"named_struct('up', {up}, 'down', {down})",
                    "named_struct('up', b.up, 'down', b.down, 'sum', a.sum + b.up + b.down)") + ", a -> a.sum)")
    picked = (f"aggregate(sequence(1L, p.steps), named_struct('up', 1D, 'down', 1D, 'rest', {uniform} * s - 1D, "
              f"'k', IF({uniform} * s < 1D, p.mode, -1D)), (a, i) -> IF(a.k >= 0, a, "
              + let("b", f"named_struct('up', {up}, 'down', {down})",
                    "named_struct('up', b.up, 'down', b.down, 'rest', a.rest - b.up - b.down, 'k', "
                    "CASE WHEN a.rest < b.up THEN p.mode + i WHEN a.rest < b.up + b.down THEN p.mode - i ELSE -1D END)")
              + "), a -> IF(a.k < 0, p.mode, a.k))")
    low, high = f"greatest(0D, {drawn} - ({total} - {marked}))", f"least({drawn}, {marked})"
    spread = (f"sqrt({drawn} * ({marked} / greatest({total}, 1D)) * (1 - {marked} / greatest({total}, 1D)) "
              f"* ({total} - {drawn}) / greatest({total} - 1, 1D))")
    return let("p", f"named_struct('t', {total}, 'm', {marked}, 'd', {drawn}, 'mode', greatest({low}, least({high}, "
                    f"double(floor(({drawn} + 1) * ({marked} + 1) / ({total} + 2))))), 'steps', "
                    f"least(bigint({high} - {low}), bigint(ceil(9 * {spread})) + 64L))",
               "IF(p.steps < 1, p.mode, " + let("s", summed, picked) + ")")


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, room): how many rows of each partition go to every shard. ``counts`` is (part, n).

    The partitions' counts, a number for each of them, begin in one row; every level halves the rows' lists.
    """
    total = "aggregate(parts, 0L, (a, x) -> a + x.n)"
    nodes = counts.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).select(
        "parts", F.expr(f"transform(sequence(0, {shards - 1}), s -> {total} div {shards} + "
                        f"IF(s < {total} % {shards}, 1L, 0L))").alias("room"))
    parts = counts.count()
    level = 0
    while parts > 1:
        uniform = f"((xxhash64({seed}L, {level}L, parts[0].part, i) & 9007199254740991L) / 9007199254740992D)"
        k = hypergeometric("a.t", "double(room[i])", "a.d", "r")
        drawn = (f"aggregate(sequence(0, {shards - 1}), named_struct('t', double({total}), 'd', "
                 f"double(aggregate(slice(parts, 1, half), 0L, (a, x) -> a + x.n)), 'out', cast(array() AS array<bigint>)), "
                 f"(a, i) -> " + let("r", uniform, let("k", k, "named_struct('t', a.t - double(room[i]), 'd', a.d - k, "
                                                               "'out', concat(a.out, array(bigint(k))))"))
                 + ", a -> a.out)")
        nodes = (nodes.withColumn("half", F.expr("cast((size(parts) + 1) div 2 AS int)"))
                 .withColumn("drawn", F.expr(drawn))
                 .select(F.explode(F.expr(
                     "array(named_struct('parts', slice(parts, 1, half), 'room', drawn), named_struct('parts', "
                     "slice(parts, half + 1, greatest(size(parts) - half, 0)), 'room', "
                     "transform(room, (x, i) -> x - drawn[i])))")).alias("node"))
                 .select("node.*").filter("size(parts) > 0"))
        if level % 6 == 5:
            nodes = nodes.repartition("parts")  # so many nodes by now that they are worth dealing out
        parts, level = (parts + 1) // 2, level + 1
    return nodes.filter("size(parts) > 0").select(F.expr("parts[0].part").alias("part"), "room")


def shuffle(df: DataFrame, shards: int = 8, seed: int = 20240611) -> DataFrame:
    """(value, shard, slot): every row of ``df`` as a struct, its shard from 0 and its place there from 0.

    The rows are written once after the first permutation; the matrix and the exchange both start from that table.
    """
    placed, seen = written_counting(
        df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("value"))
        .withColumn("row", F.monotonically_increasing_id())
        .sortWithinPartitions(F.xxhash64(F.lit(seed), "row"), "row")
        .withColumn("part", F.shiftright("row", 33))
        .withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "permuted", rows=F.count("*"))
    bits = max(BLOCK_BITS, (seen["rows"] // (shards * ROWS_PER_BLOCK)).bit_length())
    matrix = written(communication_matrix(placed.groupBy("part").agg(F.count("*").alias("n")), shards, seed), "matrix")
    ends = matrix.select("part", F.expr(
        "transform(room, (x, i) -> aggregate(slice(room, 1, i + 1), 0L, (a, y) -> a + y))").alias("ends"))
    key = F.xxhash64(F.lit(seed + 1), "row")
    sent = (placed.join(ends, "part")
            .withColumn("shard", F.expr("size(filter(ends, e -> e <= pos))"))
            .select("value", "row", "shard", key.alias("key"),
                    F.shiftrightunsigned(key, 64 - bits).alias("block")))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = (sent.groupBy("shard", "block").agg(F.count("*").alias("n"))
               .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry")))
    inside = W.partitionBy("shard", "block").orderBy("key", "row")
    return (sent.withColumn("inside", F.row_number().over(inside)).join(carried, ["shard", "block"])
            .select("value", "shard", (F.col("carry") + F.col("inside") - 1).alias("slot")))
