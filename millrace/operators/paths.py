"""Longest paths and cycles of large graphs, in few rounds.

Stretches of nodes with one way in and one way out are contracted by doubling pointers, so a stretch of any length takes
rounds in its logarithm. What is left is peeled from the ends. A round is one written table; what decides whether there
is another one is counted while it is written.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import scratch_path, written, written_counting


def weighted(edges: DataFrame) -> DataFrame:
    """Distinct edges (job, dep) with the length 1."""
    return edges.select("job", "dep").distinct().withColumn("weight", F.lit(1).cast("bigint"))


def stretches(edges: DataFrame) -> tuple[DataFrame, int]:
    """(job, start, end, above, below, least) of every node with one way in and out, and how many there are.

    ``end`` is the first node down the stretch that is none of these, ``below`` the length of the way there; ``start``
    and ``above`` the same upwards. On a ring of such nodes alone, which has no ends, both are null, and ``least`` is the
    ring's smallest name.
    """
    down = edges.groupBy("job").agg(F.count("*").alias("n"), F.first("dep").alias("end"), F.first("weight").alias("below"))
    up = edges.groupBy(F.col("dep").alias("job")).agg(F.count("*").alias("m"), F.first("job").alias("start"),
                                                      F.first("weight").alias("above"))
    inner, seen = written_counting(
        down.filter("n = 1").join(up.filter("m = 1"), "job").filter("job <> end")
        .select("job", "start", "end", "above", "below", F.col("job").alias("least")), "stretches", rows=F.count("*"))
    n = seen["rows"]
    if not n:
        return inner, 0
    # After k rounds a pointer goes past 2^k nodes, so only those on rings still meet inner nodes after the last round.
    for _ in range(math.ceil(math.log2(n)) + 1):
        lower = inner.select(F.col("job").alias("end"), F.col("end").alias("end_2"), F.col("below").alias("below_2"),
                             F.col("least").alias("least_2"))
        upper = inner.select(F.col("job").alias("start"), F.col("start").alias("start_2"), F.col("above").alias("above_2"))
        inner, seen = written_counting(
            inner.join(lower, "end", "left").join(upper, "start", "left").select(
                "job", F.coalesce("start_2", "start").alias("start"), F.coalesce("end_2", "end").alias("end"),
                (F.col("above") + F.coalesce("above_2", F.lit(0))).alias("above"),
                (F.col("below") + F.coalesce("below_2", F.lit(0))).alias("below"),
                F.least("least", "least_2").alias("least"), (F.col("end_2").isNotNull() | F.col("start_2").isNotNull()).alias("open")),
            "stretches", open=F.count_if(F.col("open")))
        if not seen["open"]:
            break
    ends = [F.when(~F.col("open"), F.col(c)).alias(c) for c in ("start", "end", "above", "below")]
    return inner.select("job", *ends, "least"), n


def contracted(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """The edges of all other nodes, those into a stretch leading to its end; of several ways the longest."""
    skipped = inner.select(F.col("job").alias("dep"), "end", "below")
    return (edges.join(inner.select("job"), "job", "left_anti").join(skipped, "dep", "left")
            .select("job", F.coalesce("end", "dep").alias("dep"), (F.col("weight") + F.coalesce("below", F.lit(0))).alias("weight"))
            .groupBy("job", "dep").agg(F.max("weight").alias("weight")))


def peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job, level) of the nodes that can be peeled off, and (job) of those that stay because of a cycle.

    A node is peeled once all it needs has been; its level is the length of the longest path below it. A round hands the
    levels of what was peeled last to the nodes above, which count down what they still wait for. Edges are written anew
    whenever half of them are done.
    """
    edges, all_ = written_counting(edges.select("job", "dep", "weight"), "edges", rows=F.count("*"))
    spark, kept, rounds = edges.sparkSession, all_["rows"], 0
    folder = scratch_path(spark, "levels")
    counts = {"peeled": F.count_if(F.col("waits") == 0), "left": F.sum("waits")}
    waiting = edges.groupBy("job").agg(F.count("*").alias("waits"))
    state, seen = written_counting(
        nodes.select("job").distinct().join(waiting, "job", "left")
        .select("job", F.coalesce("waits", F.lit(0).cast("bigint")).alias("waits"), F.lit(0).cast("bigint").alias("level")),
        "levels", f"{folder}/round=0", **counts)
    while seen["peeled"]:
        last = state.filter("waits = 0").select("job", "level")
        state = state.filter("waits > 0")
        left, rounds = seen["left"] or 0, rounds + 1
        if left * 2 < kept:
            edges, kept = written(edges.join(state.select("job"), "job", "left_semi").select("job", "dep", "weight"), "edges"), left
        told = (edges.join(last.select(F.col("job").alias("dep"), "level"), "dep").groupBy("job")
                .agg(F.count("*").alias("n"), F.max(F.col("level") + F.col("weight")).alias("reached")))
        state, seen = written_counting(
            state.join(told, "job", "left").select(
                "job", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), F.greatest("level", "reached").alias("level")),
            "levels", f"{folder}/round={rounds}", **counts)
    # A node is without anything to wait for in the table of the round that peeled it, and in no later one.
    every = spark.read.schema("job string, waits bigint, level bigint, round int").parquet(folder)
    return every.filter("waits = 0").select("job", "level"), state.select("job")


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job, level), the longest path from a job that needs nothing, and (job) of all others: on a cycle or above one."""
    all_ = written(weighted(edges), "edges")
    inner, n = stretches(all_)
    if not n:
        found, stuck = peeled(nodes, all_)
    else:
        outer = nodes.select("job").distinct().join(inner.select("job"), "job", "left_anti")
        found, stuck = peeled(outer, contracted(all_, inner))
        along = inner.join(found.select(F.col("job").alias("end"), "level"), "end", "left")
        found = found.unionByName(along.filter("level IS NOT NULL").select("job", F.expr("level + below").alias("level")))
        stuck = stuck.unionByName(along.filter("level IS NULL").select("job"))
    return found.select("job", F.col("level").cast("int").alias("level")), stuck


def _least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job, colour): the smallest node from which each node can be reached, itself included."""
    state, seen = written_counting(nodes.select("job", F.col("job").alias("colour"), F.lit(True).alias("new")), "colours",
                                   new=F.count("*"))
    while seen["new"]:
        told = (edges.join(state.filter("new").select("job", F.col("colour").alias("theirs")), "job")
                .groupBy(F.col("dep").alias("job")).agg(F.min("theirs").alias("theirs")))
        state, seen = written_counting(
            state.select("job", "colour").join(told, "job", "left").select(
                "job", F.least("colour", "theirs").alias("colour"), F.coalesce(F.col("theirs") < F.col("colour"), F.lit(False)).alias("new")),
            "colours", new=F.count_if(F.col("new")))
    return state.select("job", "colour")


def _reaching_first(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """(job, colour) of the nodes that reach the node their colour is named after, by nodes of that colour."""
    a, b = (colours.select(F.col("job").alias(end), F.col("colour").alias(f"of_{end}")) for end in ("job", "dep"))
    inside = written(edges.join(a, "job").join(b, "dep").filter("of_job = of_dep").select("job", "dep"), "inside")
    found, seen = written_counting(colours.filter("job = colour").withColumn("new", F.lit(True)), "found", new=F.count("*"))
    while seen["new"]:
        told = (inside.join(found.filter("new").select(F.col("job").alias("dep"), "colour"), "dep")
                .groupBy("job").agg(F.first("colour").alias("theirs")))
        found, seen = written_counting(
            found.select("job", "colour").join(told, "job", "full").select(
                "job", F.coalesce("colour", "theirs").alias("colour"), F.col("colour").isNull().alias("new")),
            "found", new=F.count_if(F.col("new")))
    return found.select("job", "colour")


def _trimmed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that stay when nodes without a way in or out are taken away again and again."""
    for near, far in (("job", "dep"), ("dep", "job")):
        turned = edges.select(F.col(near).alias("job"), F.col(far).alias("dep"), F.lit(1).cast("bigint").alias("weight"))
        nodes = written(peeled(nodes, turned)[1], "core")
        edges = edges.join(nodes, "job", "left_semi").join(nodes.select(F.col("job").alias("dep")), "dep", "left_semi")
    return nodes, written(edges.select("job", "dep"), "core")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job, cycle) of every job on a cycle of two jobs or more; a cycle is named after its smallest job.

    What lies on no cycle is trimmed, stretches are contracted, and the rest is taken apart by colours: each node gets the
    smallest name that reaches it, and those that reach that name back are one component. Nodes of other components go
    into the next pass. Rounds of a pass grow with the longest way in the contracted core.
    """
    nodes, edges = _trimmed(nodes.select("job").distinct(), edges.filter("job <> dep").select("job", "dep").distinct())
    all_ = written(weighted(edges), "edges")
    inner, n = stretches(all_)
    rings = inner.filter("end IS NULL").select("job", F.col("least").alias("name"))
    outer = nodes.join(inner.select("job"), "job", "left_anti") if n else nodes
    short = written((contracted(all_, inner) if n else all_).select("job", "dep"), "short")
    loops = short.filter("job = dep").select("job")  # by way of a stretch
    left, ways, found = written(outer, "left"), short.filter("job <> dep"), []
    while not left.isEmpty():
        part = written(_reaching_first(_least_reaching(left, ways), ways), "components")
        found.append(part)
        left = written(left.join(part.select("job"), "job", "left_anti"), "left")
        left, ways = _trimmed(left, ways.join(left, "job", "left_semi").join(left.select(F.col("job").alias("dep")), "dep", "left_semi"))
    none = rings.limit(0).select("job", F.col("name").alias("colour"))
    parts = reduce(DataFrame.unionByName, found, none).select("job", F.col("colour").alias("name"))
    if n:
        parts = written(parts, "parts")
        parts = parts.unionByName(loops.join(parts.select("job"), "job", "left_anti").withColumn("name", F.col("job")))
        at = [parts.select(F.col("job").alias(c), F.col("name").alias(f"of_{c}")) for c in ("start", "end")]
        along = inner.filter("end IS NOT NULL").join(at[0], "start").join(at[1], "end").filter("of_start = of_end")
        parts = parts.unionByName(along.select("job", F.col("of_end").alias("name"))).unionByName(rings)
    sizes = parts.groupBy("name").agg(F.min("job").alias("cycle"), F.count("*").alias("n"))
    return parts.join(sizes.filter("n > 1"), "name").select("job", "cycle")
