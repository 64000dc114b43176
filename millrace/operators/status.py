"""Roll-up of states over the children of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import status as fn


def group_status(children: DataFrame, keys: Sequence[str], own: str = "group_status") -> DataFrame:
    """State, start and end of each group out of its children.

    Any failed child fails the group; all children done makes it SUCCEEDED; all running makes it RUNNING;
    else its own state stays (READY where there is none). An ignored child is not done. Start is the first
    start; end is the last end, only for a group that has ended.
    """
    aggregates = [F.bool_or(F.col("status") == "FAILED").alias("_failed"),
                  F.bool_and(fn.is_done("status")).alias("_done"),
                  F.bool_and(F.col("status") == "RUNNING").alias("_running"),
                  F.min("start_time").alias("_start"), F.max("end_time").alias("_end")]
    kept = F.lit("READY")
    if own in children.columns:
        aggregates.append(F.max(own).alias("_own"))
        kept = F.coalesce("_own", kept)
    rolled = children.groupBy(*keys).agg(*aggregates)
    state = (F.when(F.col("_failed"), F.lit("FAILED")).when(F.col("_done"), F.lit("SUCCEEDED"))
             .when(F.col("_running"), F.lit("RUNNING")).otherwise(kept))
    ended = F.col("status").isin("FAILED", "SUCCEEDED", "COMPLETED")
    return (rolled.withColumn("status", state)
            .select(*keys, "status", F.col("_start").alias("start_time"),
                    F.when(ended, F.col("_end")).alias("end_time")))


def composed_status(pairs: DataFrame) -> DataFrame:
    """State, start and end of (job, what runs before it): columns job_* and before_* in, three columns added."""
    return (pairs
            .withColumn("status", fn.composed("job_status", "before_status"))
            .withColumn("start_time", fn.composed_start("job_status", "before_status", "job_start", "before_start"))
            .withColumn("end_time", fn.composed_end("job_status", "before_status", "job_end", "before_end")))
