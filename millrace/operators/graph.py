"""Dependency graphs as tables: ``nodes(job)`` and ``edges(job, dep)``, meaning job needs dep.

Loops run a fixed kind of round until nothing is new. Every round is joins over the whole cluster, is
written to the shared folder, and touches only what the last round reached.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.config_values import as_list
from millrace.operators import paths
from millrace.session import scratch_path, written, written_counting


def dependency_edges(jobs: DataFrame, job: str = "id", dependencies: str = "dependencies") -> DataFrame:
    """(job, dep) out of the comma list of each job; names are trimmed, blank ones skipped."""
    return (jobs.select(F.col(job).alias("job"), F.explode(as_list(dependencies)).alias("dep"))
            .withColumn("dep", F.trim("dep")).filter("dep <> ''").distinct())


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose dependency is not a job."""
    return edges.join(nodes.select(F.col("job").alias("dep")).distinct(), "dep", "left_anti").select("job", "dep")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Jobs nobody depends on."""
    return nodes.join(edges.select(F.col("dep").alias("job")).distinct(), "job", "left_anti")


def duplicates(jobs: DataFrame, job: str = "id") -> DataFrame:
    """Names that more than one job has, with how many."""
    return jobs.groupBy(job).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dependency, dependent) for edges between known jobs."""
    known = nodes.select("job").distinct()
    return (edges.filter("job <> dep").join(known, "job", "left_semi")
            .select(F.col("dep").alias("dependency"), F.col("job").alias("dependent")).distinct()
            .join(known.withColumnRenamed("job", "dependency"), "dependency", "left_semi"))


# Tables of reached sets that a round reads at most.
TABLES = 24


def closure(seeds: DataFrame, edges: DataFrame, tags: tuple[str, ...] = (), only: Column | None = None) -> DataFrame:
    """Everything the seeds need, themselves included, each once per tag.

    ``seeds`` has the column job and the tag columns; every tag keeps its own reached set. Works on cyclic graphs.
    ``only`` is a condition on the edges to follow. Tags are numbered in order of their smallest seed, and a row holds
    which of 64 neighbouring tags have reached a job as bits, so sets that have much in common travel together. A round
    writes the bits that are new; what is known is written as one table again whenever there are ``TABLES`` of them.
    """
    edges = edges if only is None else edges.filter(only)
    steps, spark = written(edges.select("job", "dep").distinct(), "steps"), edges.sparkSession
    if tags:
        seeds = written(seeds.select("job", *[F.col(c).alias(f"_{c}") for c in tags]), "seeds")
        names = [f"_{c}" for c in tags]
        numbers = written(seeds.groupBy(*names).agg(F.min("job").alias("first")).orderBy("first", *names)
                          .select(*names, F.monotonically_increasing_id().alias("id")), "tags")
        same = reduce(lambda a, b: a & b, [seeds[c].eqNullSafe(numbers[c]) for c in names])
        started = seeds.join(numbers, same).select("job", "id")
    else:
        started = seeds.select("job", F.lit(0).cast("bigint").alias("id"))
    first = started.select("job", F.shiftright("id", 6).alias("word"), F.expr("shiftleft(1L, CAST(id & 63 AS INT))").alias("bits"))
    none, folders = F.lit(0).cast("bigint"), [scratch_path(spark, "reached")]
    new, seen = written_counting(first.groupBy("job", "word").agg(F.bit_or("bits").alias("bits")), "reached", folders[0], rows=F.count("*"))

    def known() -> DataFrame:
        return spark.read.schema(new.schema).parquet(*folders)

    while seen["rows"]:
        if len(folders) == TABLES:
            merged = scratch_path(spark, "reached")
            written(known().groupBy("job", "word").agg(F.bit_or("bits").alias("bits")), "reached", merged)
            folders = [merged]
        told = new.join(steps, "job").select(F.col("dep").alias("job"), "word", none.alias("bits"), F.col("bits").alias("got"))
        both = (known().withColumn("got", none).unionByName(told).groupBy("job", "word")
                .agg(F.bit_or("bits").alias("bits"), F.bit_or("got").alias("got")))
        folders.append(scratch_path(spark, "reached"))
        new, seen = written_counting(
            both.select("job", "word", F.col("got").bitwiseAND(F.bitwise_not("bits")).alias("bits")).filter("bits <> 0"),
            "reached", folders[-1], rows=F.count("*"))
    if not tags:
        return known().select("job")
    state = known().groupBy("job", "word").agg(F.bit_or("bits").alias("bits"))
    # A word has at most 64 tags, which are put beside its rows before these are taken apart.
    members = numbers.groupBy(F.shiftright("id", 6).alias("word")).agg(
        F.collect_list(F.struct(F.expr("shiftleft(1L, CAST(id & 63 AS INT))").alias("bit"), *names)).alias("members"))
    own = F.explode(F.filter("members", lambda m: m["bit"].bitwiseAND(F.col("bits")) != 0)).alias("m")
    return (state.join(members, "word").select("job", own)
            .select(*[F.col("m")[f"_{c}"].alias(c) for c in tags if c != "job"], "job"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job, level): longest path from a job that needs nothing. Jobs on or above a cycle have none."""
    return paths.levels(nodes, edges)[0]


def levels_from_sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same, counted from jobs nobody needs."""
    return levels(nodes, edges.select(F.col("dep").alias("job"), F.col("job").alias("dep")))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job, problem): ``self`` for a job that needs itself, else ``cycle`` for one on or above a cycle."""
    stuck = paths.levels(nodes, edges)[1]
    selfish = edges.filter("job = dep").select("job").distinct().withColumn("_self", F.lit(True))
    return (stuck.join(selfish, "job", "left")
            .select("job", F.when(F.col("_self"), F.lit("self")).otherwise(F.lit("cycle")).alias("problem")))


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job, cycle, problem) of all jobs that can't run: ``member`` for one on a cycle of several jobs, named after its
    smallest job; ``self`` for one that only needs itself; ``above`` for one that needs any of these and is on no cycle,
    which then has no name. Cycles that share no job are told apart, whatever edges lead from one to another."""
    members = written(paths.strong_components(nodes, edges), "members")
    selfish = edges.filter("job = dep").select("job").distinct().withColumn("_self", F.lit(True))
    return (cycles(nodes, edges).select("job").join(members, "job", "left").join(selfish, "job", "left").select(
        "job", F.coalesce("cycle", F.when(F.col("_self"), F.col("job"))).alias("cycle"),
        F.when(F.col("cycle").isNotNull(), "member").when(F.col("_self"), "self").otherwise("above").alias("problem")))


def tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The dependency trees of all roots: (job, is_root, json), one row per job that a root reaches.

    ``json`` is the job as a document with the sorted names of what it needs. A job that several jobs need is there
    once, so the result is linear in jobs and edges; a reader nests the documents from the roots down by name.
    """
    top = roots(nodes, edges).select("job").distinct()
    reached = closure(top, edges)
    needs = edges.groupBy("job").agg(F.array_sort(F.collect_set("dep")).alias("dependencies"))
    named = (reached.join(needs, "job", "left").join(top.withColumn("_top", F.lit(True)), "job", "left")
             .withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>"))))
    return named.select("job", F.coalesce("_top", F.lit(False)).alias("is_root"),
                        F.to_json(F.struct(F.col("job").alias("name"), "dependencies")).alias("json"))


def flow_documents(members: DataFrame, edges: DataFrame) -> DataFrame:
    """A flow as JSON lines: one per node with its state, one per dependency inside the flow.

    ``members`` has flow, job, status. One document per flow would put a flow of any size into one value.
    """
    node_lines = members.select("flow", F.to_json(F.struct(F.col("job").alias("name"), "status")).alias("line"))
    here = members.select("flow", "job")
    there = members.select(F.col("flow"), F.col("job").alias("dep"))
    inside = here.join(edges, "job").join(there, ["flow", "dep"])
    edge_lines = inside.select("flow", F.to_json(F.struct("job", "dep")).alias("line"))
    return node_lines.withColumn("part", F.lit("node")).unionByName(edge_lines.withColumn("part", F.lit("dependency")))


def restart(status: DataFrame, selected: DataFrame, edges: DataFrame) -> DataFrame:
    """Failed nodes in what the selected jobs reach go back to READY; all others keep their state."""
    reached = closure(selected, edges).withColumn("_in", F.lit(True))
    return (status.join(reached, "job", "left")
            .withColumn("status", F.when(F.col("_in") & (F.col("status") == "FAILED"), F.lit("READY"))
                        .otherwise(F.col("status"))).drop("_in"))


def restart_disabled(status: DataFrame, selected: DataFrame, disabled: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes the selected jobs reach go back to READY, and the disabled ones among them are IGNORED."""
    reached = closure(selected, edges)
    off = disabled.select("job").distinct().withColumn("_off", F.lit(True))
    return (status.drop("status").join(reached, "job", "left_semi").join(off, "job", "left")
            .withColumn("status", F.when(F.col("_off"), F.lit("IGNORED")).otherwise(F.lit("READY"))).drop("_off"))


def with_everything_needed(nodes: DataFrame, selected: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes among the selected jobs and all they depend on, each once."""
    return nodes.join(closure(selected, edges), "job", "left_semi")


def ready(status: DataFrame, edges: DataFrame) -> DataFrame:
    """READY jobs all of whose dependencies are done. An ignored job counts as done: running it makes it so."""
    waiting = status.filter("status = 'READY'").select("job")
    open_deps = status.filter("status NOT IN ('SUCCEEDED', 'COMPLETED', 'IGNORED')").select(F.col("job").alias("dep"))
    blocked = edges.join(open_deps, "dep", "left_semi").select("job").distinct()
    return waiting.join(blocked, "job", "left_anti")


def folders(root_jobs: DataFrame, job: str = "job", path: str = "path", default: str = "default") -> DataFrame:
    """(folder, job, in_folder) sorted by folder and name; the folder is the first part of the job's path."""
    parts = F.split(path, "/")
    first = F.when(F.get(parts, F.lit(0)) == "", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    listed = root_jobs.select(F.when(F.instr(F.col(path), "/") > 0, first).otherwise(F.lit(default)).alias("folder"),
                              F.col(job).alias("job"))
    sizes = listed.groupBy("folder").agg(F.count(F.lit(1)).alias("in_folder"))
    return listed.join(sizes, "folder").orderBy("folder", "job")


def rebuilt(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and missing jobs out of flow documents (columns id, jobs, root, dependencies)."""
    nodes = documents.select(F.col("id").alias("flow"), F.explode("jobs").alias("job", "state")) \
        .select("flow", "job", F.col("state.status").alias("status"))
    edges = (documents.select(F.col("id").alias("flow"), F.explode("dependencies").alias("job", "deps"))
             .select("flow", "job", F.explode("deps").alias("dep")))
    named = (edges.select("flow", F.col("dep").alias("job")).unionByName(edges.select("flow", "job"))
             .unionByName(documents.select(F.col("id").alias("flow"), F.explode("root").alias("job"))).distinct())
    return nodes, edges, named.join(nodes, ["flow", "job"], "left_anti")

