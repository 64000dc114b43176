"""Layered config tables: ``config(scope, key, value)`` and ``scopes(scope, parent)``.

A scope sees its own entries first, then those of its parent, and so on up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.session import spread, written, written_counting


def chains(scopes: DataFrame) -> DataFrame:
    """(scope, ancestor, depth): every scope with itself at depth 0, its parent at 1, and so on.

    Known stretches are doubled each round, so the number of rounds is the logarithm of the greatest depth.
    """
    links = written(scopes.select("scope", "parent").distinct(), "links")
    chain = links.select("scope", F.col("scope").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    jumps, left = written_counting(links.filter("parent IS NOT NULL"), "jumps", rows=F.count("*"))
    reach = 1
    while left["rows"]:
        # The chain covers depths below `reach`; a jump goes exactly `reach` levels up.
        above = chain.select(F.col("scope").alias("parent"), "ancestor", "depth")
        more, found = written_counting(
            jumps.join(above, "parent").select("scope", "ancestor", (F.col("depth") + reach).alias("depth")), "chain",
            own=F.count_if(F.col("scope") == F.col("ancestor")))
        if found["own"]:
            raise ValueError("a scope is its own ancestor")
        chain = chain.unionByName(more)
        jumps, left = written_counting(
            jumps.alias("a").join(jumps.alias("b"), F.col("a.parent") == F.col("b.scope"))
            .select(F.col("a.scope").alias("scope"), F.col("b.parent").alias("parent")), "jumps", rows=F.count("*"))
        reach *= 2
    return chain


def seen(config: DataFrame, chain: DataFrame) -> DataFrame:
    """(scope, key, value, depth): every entry on the chain of each scope, shadowed ones too."""
    return (chain.join(config.withColumnRenamed("scope", "ancestor"), "ancestor")
            .select("scope", "key", "value", "depth"))


def effective(config: DataFrame, chain: DataFrame) -> DataFrame:
    """(scope, key, value): what ``get`` returns; the nearest scope wins."""
    return (seen(config, chain).groupBy("scope", "key")
            .agg(F.min_by(F.struct("value"), "depth").alias("_at"))
            .select("scope", "key", F.col("_at.value").alias("value")))


def by_prefix(effective_table: DataFrame, prefix: str) -> DataFrame:
    """Entries whose key starts with the prefix, without it."""
    return (effective_table.filter(F.col("key").startswith(prefix))
            .withColumn("key", F.substr("key", F.lit(len(prefix) + 1))))


def interpolate(entries: DataFrame) -> DataFrame:
    """Replace ``${name}`` by the scope's value of that name until none is left: (scope, key, value, problem).

    Problems: ``unknown: name`` for a name without a value, ``circular: name`` for one that leads back to
    itself; both pass on to the values that use them. Finished values are put in, the first name from the
    left in each round, so a value waits only while that name is not finished. What no round can finish is
    circular.
    """
    def with_name(df: DataFrame) -> DataFrame:
        return df.withColumn("_name", F.regexp_extract("value", fixed.VARIABLE_PATTERN, 1))

    result = ["scope", "key", "value", "problem"]
    rows = with_name(entries.select("scope", "key", "value", F.lit(None).cast("string").alias("problem")))
    done = written(rows.filter("_name = ''").select(*result), "finished")
    todo = written(rows.filter("_name <> ''"), "waiting")
    mark = F.concat(F.lit("${"), F.col("_name"), F.lit("}"))
    while not todo.isEmpty():
        values = (done.withColumn("_ready", F.lit(True))
                  .unionByName(todo.select(*result).withColumn("_ready", F.lit(False)))
                  .select("scope", F.col("key").alias("_name"), F.col("value").alias("_value"),
                          F.col("problem").alias("_problem"), "_ready"))
        asked = todo.select("scope", "_name").distinct()  # few, so that most finished entries are left out at once
        met = todo.join(values.join(asked, ["scope", "_name"], "left_semi"), ["scope", "_name"], "left")
        moved = with_name(
            met.filter(F.coalesce("_ready", F.lit(True)))
            .select("scope", "key",
                    F.when(F.col("_ready") & F.col("_problem").isNull(), F.replace("value", mark, "_value"))
                    .otherwise(F.col("value")).alias("value"),
                    F.when(F.col("_ready").isNull(), F.concat(F.lit("unknown: "), F.col("_name")))
                    .otherwise(F.col("_problem")).alias("problem")))
        stays = met.filter(~F.coalesce("_ready", F.lit(True))).select(*todo.columns)
        step = written(moved.withColumn("_moved", F.lit(True)).unionByName(stays.withColumn("_moved", F.lit(False))),
                       "round")
        if step.filter("_moved").isEmpty():
            return done.unionByName(todo.select("scope", "key", "value",
                                                F.concat(F.lit("circular: "), F.col("_name")).alias("problem")))
        over = "problem IS NOT NULL OR _name = ''"
        done = done.unionByName(step.filter(over).select(*result))
        todo = step.filter(f"NOT ({over})").drop("_moved")
    return done


def merge(sets: DataFrame, first_wins: bool = True) -> DataFrame:
    """(scope, key, value) out of several sets (scope, position, key, value) built into one.

    Sets given side by side: the first one wins. Sets put in one after the other: the last one wins.
    """
    pick = F.min_by if first_wins else F.max_by
    return (sets.groupBy("scope", "key").agg(pick(F.struct("value"), "position").alias("_at"))
            .select("scope", "key", F.col("_at.value").alias("value")))


def pass_on(edges: DataFrame, outputs: DataFrame, own: DataFrame) -> DataFrame:
    """(job, key, value): what each job sees once its dependencies are done.

    Outputs of a dependency become inputs of the job; the job's own config wins; between dependencies the
    last one by name wins.
    """
    # Of a job and key its own value comes first, then the last dependency by name. Rows are dealt out before they are
    # combined, so what a task sorts does not follow the row groups of the tables.
    handed = edges.join(outputs.withColumnRenamed("job", "dep"), "dep").select("job", "key", "value", F.lit(False).alias("_own"), "dep")
    mine = own.select("job", "key", "value", F.lit(True).alias("_own"), F.lit(None).cast(edges.schema["dep"].dataType).alias("dep"))
    return (spread(mine.unionByName(handed)).groupBy("job", "key")
            .agg(F.max_by(F.struct("value"), F.struct("_own", "dep")).alias("_at"))
            .select("job", "key", F.col("_at.value").alias("value")))


def contains_value(config: DataFrame, chain: DataFrame, value: str) -> DataFrame:
    """Scopes on whose chain some entry holds the value, shadowed or not."""
    holders = config.filter(F.col("value") == value).select(F.col("scope").alias("ancestor")).distinct()
    return chain.join(holders, "ancestor", "left_semi").select("scope").distinct()


def key_counts(config: DataFrame, chain: DataFrame) -> DataFrame:
    """(scope, local_keys, all_keys)."""
    return (seen(config, chain).groupBy("scope", "key").agg(F.min("depth").alias("_nearest"))
            .groupBy("scope").agg(F.count_if(F.col("_nearest") == 0).alias("local_keys"),
                                  F.count(F.lit(1)).alias("all_keys")))


def equal_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(scope, equal) for two effective tables: equal when the keys and their values are the same."""
    l = left.select("scope", "key", "value", F.lit(1).alias("_side"))
    r = right.select("scope", "key", "value", F.lit(2).alias("_side"))
    per_entry = (l.unionByName(r).groupBy("scope", "key", "value")
                 .agg(F.sum("_side").alias("_sides")))
    return per_entry.groupBy("scope").agg(F.bool_and(F.col("_sides") == 3).alias("equal"))
