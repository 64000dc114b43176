"""Three Structured Streaming jobs: latest state per id, last lines per source, run statistics.

Every job writes its updates as files under the shared folder, one set per micro-batch, and a batch that is run again
after a failure overwrites its own set. Readers merge the sets; now and then they are merged into one, so that what is
read grows with the keys and not with the batches.

Where updates of one key can be merged in any order (the newest state, sums), a job keeps no state at all: each batch is
reduced to a row per key and written, and merging does the rest. A late row then needs no rule of its own: an older copy
loses to a newer one by its number, whenever it comes, and a count is a count. Keys that are over cost nothing while
others go on. The last lines of a source can be merged so too (``newest_lines``). ``last_lines`` is a job with state, for
streams that go on from its results: it calls Python for each source and slot of a batch, so it is for few sources that are
busy; a source that falls silent leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from millrace import fixed_values as fixed
from millrace.operators import groups, ordering
from millrace.sources import files

SALTS = 16
#: Marks a set that holds all sets before it; it lies inside the set, so both come into place at once.
MARK = "_merged"

#: From all sets (with the column ``batch``) to a row per key, in the same columns without it.
Merge = Callable[[DataFrame], DataFrame]


def newest(keys: list[str]) -> Merge:
    """The row of the latest batch of each key."""
    return lambda table: groups.last_wins(table, keys, "batch").drop("batch")


def start_updates(updates: DataFrame, target: str, checkpoint: str, mode: str = "update", keys: list[str] | None = None,
                  compact_every: int = 20, reduce: Callable[[DataFrame], DataFrame] | None = None,
                  merge: Merge | None = None) -> StreamingQuery:
    """Write each micro-batch's updates to ``target/batch=<id>``, for as long as there is input now.

    ``reduce`` is applied to each batch first; the stream then needs no state. With ``keys`` or ``merge``, every so many
    batches all sets so far are merged into one.
    """
    merge = merge or (newest(keys) if keys else None)

    def keep(batch: DataFrame, batch_id: int) -> None:
        reduced = reduce(batch) if reduce else batch
        reduced.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if merge and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, target, merge, reduced.schema)

    return (updates.writeStream.outputMode("append" if reduce else mode).foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _sets(spark: SparkSession, target: str) -> list[int]:
    """The ids of the sets that count: the last merged one and those behind it. A set that a merge has moved aside and
    not replaced is put back first."""
    fs, folder = files.file_system(spark, target)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    ids = {int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")}
    for n in (int(n.removeprefix("_old-")) for n in names if n.startswith("_old-")):
        if n not in ids:
            fs.rename(_path(spark, target, f"_old-{n}"), _path(spark, target, f"batch={n}"))
            ids.add(n)
    merged = [n for n in ids if fs.exists(_path(spark, target, f"batch={n}/{MARK}"))]
    return sorted(n for n in ids if n >= max(merged, default=0))


def _path(spark: SparkSession, target: str, name: str):
    return files.file_system(spark, f"{target}/{name}")[1]


def compact(spark: SparkSession, target: str, merge: Merge | list[str], schema: T.StructType) -> None:
    """Merge all sets of updates into the last one; ``merge`` may be a list of keys, of which the newest rows stay.

    The merged set is written aside with a mark in it. The last set is moved aside, the merged one into its place, and
    older sets are deleted last: wherever this breaks off, each update is still there once, and readers leave out what
    lies before a mark.
    """
    ids = _sets(spark, target)
    if not ids:
        return
    fs, _ = files.file_system(spark, target)
    aside, last, old = (_path(spark, target, n) for n in (f"_merging-{ids[-1]}", f"batch={ids[-1]}", f"_old-{ids[-1]}"))
    read_updates(spark, target, merge, schema).write.mode("overwrite").parquet(aside.toString())
    fs.create(_path(spark, target, f"_merging-{ids[-1]}/{MARK}"), True).close()
    fs.delete(old, True)
    if not fs.rename(last, old) or not fs.rename(aside, last):
        raise OSError(f"cannot move {aside} to {last}")
    for status in fs.listStatus(files.file_system(spark, target)[1]):
        name = status.getPath().getName()
        if name.startswith("_old-") or name.startswith("batch=") and int(name.removeprefix("batch=")) < ids[-1]:
            fs.delete(status.getPath(), True)


def read_updates(spark: SparkSession, target: str, merge: Merge | list[str], schema: T.StructType) -> DataFrame:
    """What all sets come to: merged, or the newest row of each of some keys."""
    paths = [f"{target}/batch={n}" for n in _sets(spark, target)]
    full = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    table = (spark.read.schema(full).option("basePath", target).parquet(*paths) if paths else spark.createDataFrame([], full))
    return (newest(merge) if isinstance(merge, list) else merge)(table)


def latest_state(saves: DataFrame) -> DataFrame:
    """(id, seq, state): the newest saved copy per id. Copies of an id are combined before the shuffle."""
    newest = saves.groupBy("id").agg(F.max_by(F.struct("seq", "state"), "seq").alias("_s"))
    return newest.select("id", F.col("_s.seq").alias("seq"), F.col("_s.state").alias("state"))


def run_stats(runs: DataFrame) -> DataFrame:
    """(job, runs, successes), updated as run records appear."""
    return runs.groupBy("job").agg(F.count(F.lit(1)).alias("runs"), F.count_if("succeeded").alias("successes"))


def merged_state(table: DataFrame) -> DataFrame:
    """Of rows (id, seq, state), the newest of each id."""
    return latest_state(table)


def merged_stats(table: DataFrame) -> DataFrame:
    """Of rows (job, runs, successes), the sums of each job."""
    return table.groupBy("job").agg(F.sum("runs").alias("runs"), F.sum("successes").alias("successes"))


def newest_lines(n: int = fixed.RING_LINES) -> Merge:
    """Of rows (source, pos, line), the last n of each source. It reduces a batch and merges sets alike."""
    def cut(table: DataFrame) -> DataFrame:
        last = ordering.top_per_key(table.select("source", "pos", "line"), ["source"], [F.col("pos").desc()], n, "_back")
        return last.drop("_back")

    return cut


LAST_LINES_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("slot", T.IntegerType()),
    T.StructField("lines", T.ArrayType(T.StructType([T.StructField("pos", T.LongType()),
                                                     T.StructField("line", T.StringType())])))])
HELD = "pos bigint, line string"


class LastLines(StatefulProcessor):
    """Keeps the last n lines of a key as a list in the state store."""

    def __init__(self, n: int, silent_ms: int | None):
        self.n, self.silent_ms = n, silent_ms

    def init(self, handle) -> None:
        self.lines = handle.getListState("lines", HELD, ttlDurationMs=self.silent_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.lines.get()) if self.lines.exists() else [], columns=["pos", "line"])
        for batch in rows:
            held = pd.concat([held, batch[["pos", "line"]]]).sort_values("pos", kind="stable").tail(self.n)
        kept = list(zip(held["pos"].tolist(), held["line"].tolist()))
        self.lines.put(kept)
        yield pd.DataFrame({"source": [key[0]], "slot": [key[1]], "lines": [[{"pos": p, "line": t} for p, t in kept]]})

    def close(self) -> None:
        pass


def last_lines(lines: DataFrame, n: int = fixed.RING_LINES, slots: int = SALTS, silent_ms: int | None = None) -> DataFrame:
    """(source, slot, lines): the last n lines of each source and slot, kept as state of at most n lines.

    Lines of one source are dealt to ``slots`` states by position, so a source with most of the lines is worked on by many
    tasks. With ``silent_ms`` a state that got no line for so long is dropped; the source's lines are still in the updates,
    which ``merged_lines`` puts together. Start the stream within ``state_in_files``.
    """
    dealt = lines.select("source", "pos", "line", F.pmod("pos", F.lit(slots)).cast("int").alias("slot"))
    return dealt.groupBy("source", "slot").transformWithStateInPandas(
        LastLines(n, silent_ms), LAST_LINES_SCHEMA, "Update", "None" if silent_ms is None else "ProcessingTime")


def merged_lines(n: int = fixed.RING_LINES) -> Merge:
    """Of rows (source, slot, lines), the last n lines of each source and slot, whichever updates they stand in."""
    def merge(table: DataFrame) -> DataFrame:
        each = table.select("source", "slot", F.inline("lines")).distinct()
        last = ordering.top_per_key(each, ["source", "slot"], [F.col("pos").desc()], n, "back")
        return last.groupBy("source", "slot").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))  # n at most

    return merge


@contextmanager
def state_in_files(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in the store that state of this kind needs, on disk. They run no batches
    without rows: a stream that is to end when its input is used up would otherwise wait for states to fall silent."""
    wanted = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def read_last_lines(spark: SparkSession, target: str, n: int = fixed.RING_LINES) -> DataFrame:
    """(source, rank, pos, line): the last n lines of each source, oldest first."""
    slots = read_updates(spark, target, merged_lines(n), LAST_LINES_SCHEMA)
    return ordering.tail_lines(slots.select("source", F.inline("lines")), n, keep_blank=True)
