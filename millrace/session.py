"""Session settings and the shared folder that jobs write through."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A chain of joins on one key keeps its partitioning, so Spark leaves a hot key alone unless told
    # that splitting it is worth one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g",
                  name: str = "millrace") -> SparkSession:
    """A session on this machine, for tests and the bench. On a cluster, pass your own session around."""
    # Workers import this package too, wherever the session is started from.
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may go without it; it then gets a fresh folder, set once on the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/millrace/{uuid.uuid4().hex}/{name}"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """List many folders in some tasks for each core in place of a task for each folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to as many tasks as a shuffle has. For rows of few bytes that much is made of: a file of one row
    group is read by one task, and Spark would put a small shuffle back into few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Write a step out and read it back: cuts the lineage and survives lost executors.

    The files also carry row counts and sizes, so the next join is planned on what is really there.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_counting(df: DataFrame, name: str, path: str | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates over the rows, taken while these are written."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name, path)
    return out, seen.get
