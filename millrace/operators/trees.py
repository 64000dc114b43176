"""Dependency trees as documents in pieces.

The nested document of a root can be as large as the graph, so it is not built as one value. Its pieces are rows in
order: reading them one behind the other gives the document. Every job is taken apart once, below the job it is first met
at, and only named wherever else it is needed, so there are as many pieces as jobs and needs. Where a piece stands
follows from the sizes of subtrees and from what stands before a job among its siblings, both summed along the way to the
root by doubling pointers: rounds grow with the logarithm of the depth, after those of the search itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.session import scratch_path, written, written_counting


# A table of fewer edges is not written anew: reading it costs no more than a write.
FEW_EDGES = 1 << 20


def first_met(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """(job, parent) of all that the roots reach, level by level; of several parents in a level the smallest name counts.
    Roots have no parent.

    Edges to jobs that have been met are of no more use, those of the jobs taken apart last among them. They are written
    anew without these once an eighth or more is done for, so a round meets what is left and what was met since.
    """
    folder, spark, rounds = scratch_path(steps.sparkSession, "met"), steps.sparkSession, 0
    schema, since, met = "job string, parent string, round int", 1, 0
    new, seen = written_counting(roots.select("job", F.lit(None).cast("string").alias("parent")), "met", f"{folder}/round=0",
                                 rows=F.count("*"))
    left = steps.count()
    while seen["rows"]:
        rounds += 1
        # Nothing leads to a root, so jobs met before count from the first round on.
        known = spark.read.schema(schema).parquet(folder).filter(F.col("round") >= since).select("job")
        told = (new.select(F.col("job").alias("parent")).join(steps.select(F.col("job").alias("parent"), "dep"), "parent")
                .groupBy(F.col("dep").alias("job")).agg(F.min("parent").alias("parent")))
        new, seen = written_counting((told.join(known, "job", "left_anti") if rounds > since else told).select("job", "parent"), "met",
                                     f"{folder}/round={rounds}", rows=F.count("*"))
        met += seen["rows"]
        if left > FEW_EDGES and met * 8 >= left:
            known = spark.read.schema(schema).parquet(folder).filter(F.col("round") >= since).select(F.col("job").alias("dep"))
            steps, kept = written_counting(steps.join(known, "dep", "left_anti").select("job", "dep"), "steps", rows=F.count("*"))
            left, since, met = kept["rows"], rounds + 1, 0
    return spark.read.schema(schema).parquet(folder).select("job", "parent")


def _doubled(state: DataFrame, step) -> DataFrame:
    """Follow pointers (job, up, value) until none is left: ``step(state, above)`` makes the next values of the rows, where
    ``above`` has (up, up_2, value_2) of the jobs pointed to."""
    state, seen = written_counting(state.select("job", "up", "value"), "pointers", open=F.count("up"))
    while seen["open"]:
        above = state.select(F.col("job").alias("up"), F.col("up").alias("up_2"), F.col("value").alias("value_2"))
        state, seen = written_counting(step(state, above), "pointers", open=F.count("up"))
    return state.select("job", "value")


def _add_below(state: DataFrame, above: DataFrame) -> DataFrame:
    """Values of jobs with all below them: what stands 2^k levels below comes to what stands less than that."""
    going, there = state.filter("up IS NOT NULL"), state.filter("up IS NULL")
    given = going.groupBy(F.col("up").alias("job")).agg(F.sum("value").alias("more"))
    # Rows without a pointer have no part in the join by pointer: their nulls would all come to one task.
    moved = going.join(above.select("up", "up_2"), "up").select("job", F.col("up_2").alias("up"), "value").unionByName(there)
    return moved.join(given, "job", "left").select("job", "up", (F.col("value") + F.coalesce("more", F.lit(0))).alias("value"))


def _add_above(state: DataFrame, above: DataFrame) -> DataFrame:
    """Values of jobs with all on their way to the root; ``value`` is a struct with the sum and the last job met."""
    plus = (F.col("value").withField("sum", F.col("value.sum") + F.col("value_2.sum"))
            .withField("top", F.coalesce("value_2.top", "value.top")))
    going = state.filter("up IS NOT NULL").join(above, "up").select("job", F.col("up_2").alias("up"), plus.alias("value"))
    return going.unionByName(state.filter("up IS NULL"))


def tokens(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, pos, piece): the dependency tree of each root that nobody needs, as pieces of a JSON document in order.

    A job is ``{"name":...,"dependencies":[...]}`` with its dependencies by name; one that is taken apart elsewhere, in this
    tree or another, is ``{"name":...}``.
    """
    steps = written(edges.select("job", "dep").filter("job <> dep").distinct(), "steps")
    roots = nodes.select("job").distinct().join(steps.select(F.col("dep").alias("job")).distinct(), "job", "left_anti")
    met = first_met(roots, steps)
    kids = written(steps.join(met.select("job"), "job").join(met.select(F.col("job").alias("dep"), "parent"), "dep")
                   .select("job", "dep", F.coalesce(F.col("parent") == F.col("job"), F.lit(False)).alias("own")), "kids")
    named = kids.filter("not own").groupBy("job").agg(F.count("*").alias("named"))
    alone = met.join(named, "job", "left").select("job", F.col("parent").alias("up"), (F.coalesce("named", F.lit(0)) + 2).alias("value"))
    sizes = _doubled(alone, _add_below).select(F.col("job").alias("dep"), F.col("value").alias("size"))
    # What stands before a dependency inside its job: the job's own beginning and the dependencies before it.
    sized = (kids.filter("own").join(sizes, "dep").select("job", "dep", "own", "size")
             .unionByName(kids.filter("not own").withColumn("size", F.lit(1).cast("bigint"))))
    placed = written(ordering.summed(sized, ["job"], ["dep"], "size", "end")
                     .select("job", "dep", "own", "size", (F.col("end") - F.col("size") + 1).alias("before")), "placed")
    inner = placed.filter("own").select(F.col("dep").alias("job"), F.col("job").alias("parent"), "size", "before")
    # Roots stand in no other job.
    tops = met.filter("parent IS NULL").join(sizes.withColumnRenamed("dep", "job"), "job").withColumn("before", F.lit(0).cast("bigint"))
    way = written(_doubled(inner.unionByName(tops).select("job", F.col("parent").alias("up"), F.struct(
        F.col("before").alias("sum"), F.coalesce("parent", "job").alias("top"), "size", (F.col("before") > 1).alias("later")).alias("value")),
        _add_above).select("job", F.col("value.sum").alias("pos"), F.col("value.top").alias("root"), "value.size", "value.later"), "ways")
    name = F.to_json(F.struct(F.col("job").alias("name")))
    opening = F.concat(F.when(F.col("later"), ",").otherwise(""), F.regexp_replace(name, r"\}$", ',"dependencies":['))
    ends = way.select("root", F.explode(F.array(
        F.struct(F.col("pos"), opening.alias("piece")),
        F.struct((F.col("pos") + F.col("size") - 1).alias("pos"), F.lit("]}").alias("piece")))).alias("p")).select("root", "p.*")
    mention = F.concat(F.when(F.col("before") > 1, ",").otherwise(""), F.to_json(F.struct(F.col("dep").alias("name"))))
    return ends.unionByName(placed.filter("not own").join(way.select("job", "root", "pos"), "job").select(
        "root", (F.col("pos") + F.col("before")).alias("pos"), mention.alias("piece")))
